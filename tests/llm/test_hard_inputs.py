"""Texts and tables that once ended or emptied an operator."""

import math
import random
import re
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from talata.llm import langid, quality, simhash, surrogates

HARD = {
    "labels": "a@" + "b." * 200_000 + "com and then ann@site.org",
    "no end": "a@" + "b." * 200_000,
    "secret": "token = " + "Ab3/" * 250_000,
    "digits": "1" * 100_000 + " " + "1." * 50_000,
    "groups": "1234 " * 50_000,
    "colons": "a:" * 100_000,
    "plus": "+1 23 " * 30_000,
    "name": "Mr. Ann" + "-Ann" * 50_000,
    "hyphens": "x@" + "a-" * 200_000 + ".de",
    "local": "a." * 200_000 + "@b.de",
    "ats": "a@" * 100_000,
}


@pytest.mark.parametrize("case", HARD)
def test_no_text_ends_the_surrogates(spark, case):
    df = spark.createDataFrame([(1, HARD[case]), (2, "call ann@site.org")], "doc_id long, text string")
    began = time.time()
    made = {r.doc_id: r.text for r in surrogates.replace_entities(df, "k").collect()}
    assert time.time() - began < 40  # with all jobs of the operator; the text itself is a small part
    assert "ann@site.org" not in made[2]
    if case == "secret":
        assert len(made[1]) == len(HARD[case]) and made[1].startswith("token = ") and HARD[case][8:40] not in made[1]
        assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(HARD[case], made[1], strict=True))
        assert len({made[1][i : i + 16] for i in range(8, 4000, 16)}) > 200
    if case == "labels":
        assert "ann@site.org" not in made[1]


def test_one_long_text_leaves_the_training_sample(spark):
    rows = [(i, "word " * 20, i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    first = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 5000)).otherwise(F.col("text")))
    taken = quality.sample(long, docs.select("doc_id", "quality"), "quality", chars=4500)
    assert len(taken) == 45 and all(len(t) == 100 for t, _ in taken)
    assert len(quality.sample(long, docs.select("doc_id", "quality"), "quality", chars=25_000)) == 200


def test_languages_are_learned_whatever_the_ids_and_lengths(spark):
    rng = random.Random(6)
    word = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("aa", "abcde"), ("bb", "fghijk"), ("cc", "lmnopq"))}
    text = lambda lang, n: ". ".join(" ".join(rng.choice(word[lang]) for _ in range(8)) for _ in range(n))
    rows = [(7, text("aa", 3), "aa")] * 30_000 + [(i, text("bb", 3), "bb") for i in range(100)] + [(None, text("cc", 5), "cc")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = docs.where("lang = 'bb'").select("doc_id").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").first().doc_id
    docs = docs.withColumn("text", F.when((F.col("lang") == "bb") & (F.col("doc_id") == first), F.repeat("text", 400)).otherwise(F.col("text")))
    learned = langid.learn(docs, chars=20_000)
    assert set(learned) == {"aa", "bb", "cc"} and all(len(d) > 50 for d in learned.values())
    found = langid.identify(docs.distinct(), learned).toPandas()
    assert (found.lang_pred == found.lang).all()


@pytest.mark.parametrize("each", [200, 3, 1])
def test_language_equals_brute_force(spark, data, each):
    """The library called plainly over whole texts; with fewer languages a pass than there are, too."""
    all_ = spark.read.parquet(f"{data}/documents.parquet").withColumns({"c0": F.lit("x"), "sizes": F.lit(1)})
    learned = langid.learn(langid.learnable(all_.withColumn("lang", F.concat("lang", (F.col("doc_id") % 2).cast("string")))))
    assert len(learned) == 8
    made = {r.doc_id: r for r in langid.identify(all_, learned, each=each).collect()}
    kept = {r.doc_id for r in langid.accepted(all_, learned, each=each).collect()}
    assert len(made) == all_.count()
    for row in all_.collect()[:: 1 if each == 200 else 5]:
        words = re.sub(r"[\W\d_]+", " ", (row.text or "").lower()).strip().encode()
        sizes = {}
        for lang, raw in learned.items():
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=5, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(pack.compress(words[i : i + 3000])) for i in range(0, len(words), 3000))
        if not words:
            assert made[row.doc_id].lang_pred == "und" and row.doc_id not in kept
            continue
        ranked = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
        (lang, least), (_, second) = ranked[:2]
        assert made[row.doc_id].lang_pred == lang
        assert math.isclose(made[row.doc_id].score, 1 / sum(math.exp(-60 * (n - least) / least) for n in sizes.values()))
        assert math.isclose(made[row.doc_id].margin, (second - least) / second, abs_tol=1e-12)
        assert (row.doc_id in kept) == ((second - least) / second >= langid.MIN_MARGIN)


def test_searches_go_along_edges_within_the_radius(data):
    """Every node of a tree has one member, and what is not followed holds nothing within the radius."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for c in centres]))
    tree = simhash.BkTree(values)
    found = {(int(values[i]), int(values[j])) for i, near in tree.search(values, 3) for j in near}
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(int(values[i]), int(values[j])) for i, j in np.argwhere(distance <= 3)}
    assert 0 < tree.followed < tree.passed
    nodes, todo = [], [tree.root]
    while todo:
        member, children = todo.pop()
        nodes.append(int(member))
        for d, (child,) in children:
            todo.append(child)
            assert int(np.bitwise_count(values[member] ^ values[child[0]])) == d
    assert sorted(nodes) == list(range(len(values)))


def test_trees_of_the_test_documents_have_followed_edges(spark):
    prints = np.array([simhash.fingerprint_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()], dtype=np.uint64)
    followed = 0
    for a, b in simhash._spans(64, 4):
        block = (np.unique(prints) >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        for key in np.unique(block):
            shard = np.unique(prints)[block == key]
            if len(shard) > 1:
                tree = simhash.BkTree(shard)
                list(tree.search(shard, 3))
                followed += tree.followed
    assert followed > 0
