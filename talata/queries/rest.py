"""Validation losses, counts by level, chunk paths, and samples that stop early."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars
from ..operators import profiles, sampling
from ..sources import loaders, readers, sinks
from ..working import new_path
from .base import WORDS_SQL, query, table, words


@query("""SELECT event_type, n_batches, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM (
    SELECT event_type, count(*) AS n_batches, avg(m) AS loss FROM (SELECT event_type, user_id, avg(value / 100) AS m FROM events GROUP BY 1, 2) GROUP BY 1)""")
def validation_loss(spark, sf_dir):
    """The mean over batches of their mean loss, and its perplexity; users stand for batches."""
    batches = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg(F.col("value") / 100).alias("m"))
    made = profiles.mean_over_ranks(batches, "m", "user_id", "event_type")
    return made.select("event_type", F.col("n_ranks").alias("n_batches"), F.round("mean", 6).alias("loss"), F.round(F.exp("mean"), 6).alias("perplexity"))


@query("""SELECT (doc_id % 6)::INT AS level, lang AS subcategory, count(*) AS n_tasks, sum(count(*)) OVER (PARTITION BY doc_id % 6)::BIGINT AS n_level FROM documents GROUP BY 1, 2, doc_id % 6""")
def level_task_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 6).cast("int").alias("level"), F.col("lang").alias("subcategory"))
    each = profiles.profile(rows, F.lit(True), "level", "subcategory")
    levels = profiles.profile(rows, F.lit(True), "level").select("level", F.col("n_total").alias("n_level"))
    return each.join(levels, "level").select("level", "subcategory", F.col("n_total").alias("n_tasks"), "n_level")


@query("SELECT doc_id % 5 AS chunk, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def chunk_path_scan(spark, sf_dir):
    """Chunks of one tokenizer by the names that they have by rule."""
    folder = new_path(spark, "chunk-paths")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    paths = readers.chunk_paths(folder, 5, "words")
    for i, path in enumerate(paths):  # one folder a chunk
        sinks.write_jsonl(docs.where(F.col("doc_id") % 5 == i).select("doc_id", "text"), path)
    back = readers.jsonl(spark, paths, "doc_id LONG, text STRING").select(F.regexp_extract("_metadata.file_path", "/chunk_(\\d+)_words/", 1).cast("bigint").alias("chunk"), "text")
    return back.groupBy("chunk").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("SELECT item_id::VARCHAR AS sample_id, text AS prefix FROM benchmark ORDER BY md5(concat_ws('|', '42', item_id, text)) LIMIT 15")
def first_samples(spark, sf_dir):
    """The first samples in the loader's seeded order; the limit is the operator's."""
    path = new_path(spark, "first-samples")
    items = table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"))
    sinks.write_jsonl(items, path)
    return loaders.load_benchmark(spark, "multi-digit-addition", path, max_samples=15).select("sample_id", "prefix")


VALID = "length(word) >= 7 AND length(word) - length(replace(word, 'a', '')) = 2"


@query(f"SELECT word FROM {WORDS_SQL} WHERE {VALID} ORDER BY md5('42|' || word), word LIMIT 300")
def oversampled_scan(spark, sf_dir):
    """Words with two a among seven letters or more, looked for in growing samples."""
    w = F.col("word")
    return sampling.sample_until(words(spark, sf_dir).select("word"), 300, (F.length(w) >= 7) & (chars.count_char(w, F.lit("a")) == 2), "word")


FOLDED = f"translate(word, '{chars.MARKED}', '{chars.PLAIN}')"


@query(f"SELECT folded, n FROM (SELECT {FOLDED} AS folded, count(*) AS n, count(DISTINCT word) AS k FROM {WORDS_SQL} GROUP BY 1) WHERE k > 1 ORDER BY md5('7|' || folded), folded LIMIT 40")
def homograph_sample(spark, sf_dir):
    """Some of the words that are one without their marks, chosen by hash."""
    w = words(spark, sf_dir).select("word", chars.normalize_diacritics(F.col("word")).alias("folded"))
    return sampling.uniform_sample(w.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1"), 40, "folded", seed=7)
