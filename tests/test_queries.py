"""Queries against their SQL in DuckDB, and invariants of operators without SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talata import catalog
from talata.operators import ordering, sampling
from talata.plans import tasks
from talata.sources import loaders, readers, sinks
from talata.streaming import tokens as streams

CHECKED = [
    "char_token_length_stats", "chunk_assignment", "train_val_split", "range_split", "pad_truncate_tokens", "frequency_rank_join", "weighted_sample",
    "stratified_sample_by_length", "row_diff_summary", "three_way_overlap", "keep_first_dedup", "balanced_labels", "groups_of_four", "permute_char",
    "duplicate_pair_split", "mcq_metrics", "gen_match_buckets", "failure_cascade", "n_model_pivot", "family_means", "boundary_f1_macro", "affix_preservation",
    "information_content", "vocab_merge_self_join", "coverage_by_tokenizer", "homographs", "group_of_four_longest", "addition_questions", "prefixed_words",
]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame):
    columns = sorted(df.columns)
    return columns, df[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, data, duck, name):
    made, wanted = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
    assert made[0] == wanted[0]
    pd.testing.assert_frame_equal(made[1], wanted[1])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 50).cast("int").alias("rank"))
    one = [r.id for r in sampling.sample_by_frequency(df.repartition(1), 40, "id").collect()]
    many = [r.id for r in sampling.sample_by_frequency(df.repartition(7), 40, "id").collect()]
    assert one == many and len(set(one)) == 40
    assert sampling.sample_by_frequency(df, 900, "id").count() == 500


def test_row_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    made = ordering.with_row_index(df.repartition(9), "k").orderBy("row_index").collect()
    assert [(r.k, r.row_index) for r in made] == [(i, i) for i in range(1000)]
    assert ordering.with_row_index(df.limit(0), "k").count() == 0


def test_mcq_items_are_balanced(spark):
    df = spark.range(20).select(F.lit("c").alias("category"), F.lit("s").alias("subcategory"), F.lit("q").alias("text_en"), F.lit("t").alias("text_tl"), F.col("id").cast("string").alias("answer"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("wrong"), F.col("id").cast("string").alias("key"))
    made = tasks.mcq_items(df).select("label", F.col("prompts")[0].alias("p")).collect()
    counts = pd.Series([r.label for r in made]).value_counts()
    assert counts.to_dict() == dict.fromkeys("ABCD", 5)
    assert all(r.p[f"choice{'ABCD'.index(r.label) + 1}"] == r.p.mcq_options.correct for r in made)


@pytest.mark.parametrize("name", ["hierarchical_words_mcq", "hierarchical_affixes_mcq", "syllabification_mcq", "affixation_mcq"])
def test_tasks_have_one_right_answer(spark, data, name):
    made = catalog.QUERIES[name](spark, data).where("wrong IS NOT NULL AND subcategory NOT LIKE 'syllable%'").toPandas()
    assert len(made) > 0
    assert not [r for r in made.itertuples() if r.answer in r.wrong.split("|")]


def test_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text": "one"}\n{"text": ""}\nnot json\n{"text": "two"}\n')
    assert sorted(r.text for r in readers.corpus(spark, str(tmp_path / "c.jsonl")).collect()) == ["one", "two"]
    assert readers.bad_lines(spark, str(tmp_path / "c.jsonl")).count() == 1
    df = spark.range(50).select("id", F.sequence(F.lit(1), F.col("id") % 4 + 1).alias("ids"))
    meta = sinks.write_padded(df, f"file://{tmp_path}/bin", "ids", "id")
    assert meta["shape"] == [50, 4] and meta["n_ids"] == 200
    back = sinks.read_ids(spark, meta["parts"], width=4).orderBy("part", "row").collect()
    assert [r.ids for r in back] == [(list(range(1, i % 4 + 2)) + [0] * 4)[:4] for i in range(50)]
    with pytest.raises(Exception, match="do not fit"):
        sinks.write_ids(spark.range(1).select("id", F.array(F.lit(70000)).alias("ids")), f"file://{tmp_path}/bad", "ids", "id")
    (tmp_path / "h.jsonl").write_text('{"id": "1", "prompt_tl": "t", "answer": "b", "options": ["a", "b", "c", "d"]}\n')
    row = loaders.load_benchmark(spark, "hierarchical-mcq", str(tmp_path / "h.jsonl")).first()
    assert (row.ground_truth, sorted(row.false_options)) == ("b", ["a", "c", "d"])
    with pytest.raises(ValueError, match="unknown benchmark"):
        loaders.load_benchmark(spark, "nothing", "")
    with pytest.raises(ValueError, match="missing columns"):
        readers.require_columns(df, ["rank"])


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "one"}\n{"text": ""}\n{"text": "three"}\n')
    made = streams.tokenize(streams.corpus_stream(spark, str(tmp_path / "in")))
    streams.write_exactly_once(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    batch = streams.tokenize(readers.corpus(spark, str(tmp_path / "in")))
    key = lambda df: sorted((r.text, r.len) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch) == [("one", 4), ("three", 6)]
