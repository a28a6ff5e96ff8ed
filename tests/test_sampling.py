"""Samples by sketches and cut-offs against sorting everything; columns with the names that operators use."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from talata.functions.seeded import order_key
from talata.operators import ordering, sampling
from talata.plans import tasks


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    return sorted({"".join(rng.choice("abcdefg") for _ in range(rng.choice([2, 3, 3, 4, 4, 4, 4, 5, 6]))) for _ in range(3000)})


@pytest.mark.parametrize("salts", [1, 64])
def test_sketches_equal_sorted_groups(spark, words, salts):
    rows = [(w[0] if w[0] != "g" else None, len(w), w) for w in words] * 2
    df = spark.createDataFrame(rows, "key string, part int, item string")
    made = {(r.key, r.part): r["items"] for r in sampling.least_of_each(df, 7, ["key", "part"], "item", order_key(3, F.col("item")), salts).collect()}
    groups = collections.defaultdict(set)
    for key, part, item in rows:
        groups[key, part].add(item)
    assert made == {g: sorted(x, key=lambda w: md5(3, w))[:7] for g, x in groups.items()}


def test_a_hot_key_is_reduced_in_parts(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), F.col("id").cast("string").alias("w"))
    made = sampling.least_of_each(df, 5, ["g"], "w", order_key(1, F.col("w"))).where("g = 0").first()["items"]
    assert made == sorted((str(i) for i in range(200_000) if i % 3 > 0 or i == 0), key=lambda w: md5(1, w))[:5]


@pytest.mark.parametrize("ranked", [1000, 3])
def test_cut_offs_equal_sorting(spark, words, monkeypatch, ranked):
    monkeypatch.setattr(sampling, "RANKED", ranked)
    df = spark.createDataFrame([(w, len(w), "x", 1, 2) for w in words], "word string, stratum int, key string, row int, place int")
    quotas = {2: 5, 3: 100, 4: 333, 5: 1, 6: 0}
    quotas[3] = min(100, sum(len(w) == 3 for w in words))
    made = sampling.least_of_strata(df, F.col("stratum"), order_key(9, F.col("word")), spark.createDataFrame(list(quotas.items()), "stratum int, take long"), "word")
    assert made.columns == df.columns
    want = [w for n, take in quotas.items() for w in sorted((w for w in words if len(w) == n), key=lambda w: md5(9, w))[:take]]
    assert sorted(r.word for r in made.collect()) == sorted(want)


def test_equal_orders_are_told_apart_by_the_key(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("s"))
    made = sampling.least_of_strata(df, F.col("s"), F.lit("0" * 32), spark.createDataFrame([(1, 1234)], "stratum int, take long"), "id")
    assert sorted(r.id for r in made.collect()) == list(range(1234))


def test_stratified_sample(spark, words):
    df = spark.createDataFrame([(w, "z") for w in words], "word string, size string")
    made = sampling.stratified_by_length(df, 500, "word", "word", seed=4)
    sizes = collections.Counter(map(len, words))
    got = collections.Counter(len(r.word) for r in made.collect())
    assert sum(got.values()) == 500 and all(abs(got[n] - 500 * size / len(words)) <= 1.5 for n, size in sizes.items())
    assert sampling.stratified_by_length(df.limit(0), 5, "word", "word").count() == 0


def test_related_words(spark, words):
    rows = [(w, "prefix", w[:1], w[1:], w[:1], None, None) for w in words if len(w) > 2]
    df = spark.createDataFrame(rows, "word string, affix_type string, affix string, root string, prefix string, infix string, suffix string")
    wanted = [r[0] for r in rows[::50]]
    made = {r.word: r.related for r in tasks.related_words(df, spark.createDataFrame([(w,) for w in wanted], "word string"), 6).collect()}
    for w in wanted:
        least = lambda group: sorted(group, key=lambda x: md5("42-related", x))[:7]
        both = set(least([r[0] for r in rows if r[3] == w[1:]])) | set(least([r[0] for r in rows if r[2] == w[0]]))
        assert made.get(w, []) == sorted(sorted(both - {w}, key=lambda x: md5("42-related", x))[:6])
    # Words that are no neighbours are among them.
    assert any(abs(sorted(r[0] for r in rows).index(x) - sorted(r[0] for r in rows).index(w)) > 50 for w in wanted for x in made.get(w, []))


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(i, i % 3, i, i, i, i) for i in range(40)], "_id int, _part int, _at int, _first int, _n int, _rank int")
    numbered = ordering.with_row_index(df, "_id")
    assert [r.row_index for r in numbered.orderBy("_id").collect()] == list(range(40)) and numbered.columns == [*df.columns, "row_index"]
    total = ordering.with_running_total(df, "_n", "_id")
    assert [r.start for r in total.orderBy("_id").collect()] == [i * (i - 1) // 2 for i in range(40)]
    assert ordering.first_per_group(df, 2, ["_part"], "_id").count() == 6 and ordering.first_per_group(df, 2, ["_part"], "_id").columns == df.columns
    assert ordering.keep_first(df, "_part", F.col("_rank")).columns == df.columns
    assert sampling.sample_by_frequency(df.withColumnRenamed("_n", "_order").withColumn("rank", F.lit(1)), 5, "_id").count() == 5
