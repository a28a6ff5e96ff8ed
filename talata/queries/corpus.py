"""Corpus scans, splits, chunks, padding, samples and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars, tokens
from ..functions.seeded import order_key
from ..operators import diff, ordering, sampling
from ..streaming import tokens as stream_tokens
from .base import WORDS_SQL, number_sql, query, raw_words, table, words


@query("""
    SELECT lang, count(*) AS n_rows, round(avg(n), 6) AS mean_len, round(stddev_pop(n), 6) AS std_len,
           min(n) AS min_len, max(n) AS max_len, median(n)::DOUBLE AS median_len
    FROM (SELECT lang, length(text)::BIGINT AS n FROM documents) GROUP BY lang""")
def char_token_length_stats(spark, sf_dir):
    """Character tokens of every document, length statistics by language."""
    docs = table(spark, sf_dir, "documents")
    return diff.length_statistics(docs, F.size(tokens.char_tokens(F.col("text"))).cast("bigint"), "lang")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0")
def corpus_nonempty_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // ceil(count(*) OVER () / 20.0)::BIGINT)::INT AS chunk_id FROM documents")
def chunk_assignment(spark, sf_dir):
    return ordering.contiguous_chunks(table(spark, sf_dir, "documents").select("doc_id"), 20, "doc_id").select("doc_id", "chunk_id")


@query(f"SELECT doc_id, CASE WHEN ({number_sql(chr(39) + '489|' + chr(39) + ' || doc_id')} + 0.5) / 4294967296.0 < 0.01 THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark, sf_dir):
    held = sampling.is_validation(489, 1.0, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(held, "val").otherwise("train").alias("split"))


@query("""SELECT doc_id, CASE WHEN r < (n * 0.1)::BIGINT THEN 'validation' WHEN r < (n * 0.6)::BIGINT THEN 'train' ELSE 'test' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)""")
def range_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    total = docs.count()
    return ordering.with_row_index(docs, "doc_id").select("doc_id", sampling.range_split(F.col("row_index"), total, {"validation": 0.1, "train": 0.5, "test": 0.4}, rounded=True).alias("split"))


@query("""SELECT item_id, array_to_string(list_transform(range(1, 201), lambda i: CASE WHEN i > length(text) THEN 0 WHEN ascii(substr(text, i, 1)) < 128 THEN ascii(substr(text, i, 1)) ELSE 0 END), ',') AS ids,
    least(length(text), 200)::BIGINT AS n_real FROM benchmark""")
def pad_truncate_tokens(spark, sf_dir):
    ids = tokens.char_tokens(F.col("text"))
    mask = tokens.pad_mask(ids, 200)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens.pad_truncate(ids, 200), ",").alias("ids"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_real"))
    return rows


@query("SELECT sum(length(text) + 1)::BIGINT AS n_tokens, count(*) AS n_docs, max(length(text) + 1)::BIGINT AS max_len FROM documents")
def eot_append_total_tokens(spark, sf_dir):
    ids = tokens.append_end(tokens.char_tokens(F.col("text")), 256)
    return table(spark, sf_dir, "documents").select(F.size(ids).cast("bigint").alias("n")).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("n").alias("max_len"))


@query("SELECT doc_id, substr(text, 11, 32) AS x, substr(text, 12, 32) AS y FROM documents WHERE length(text) >= 43")
def window_pairs(spark, sf_dir):
    w = tokens.windows(F.split("text", ""), F.lit(10), 32)
    return table(spark, sf_dir, "documents").where(F.length("text") >= 43).select("doc_id", F.array_join(w["x"], "").alias("x"), F.array_join(w["y"], "").alias("y"))


@query("SELECT lang, count(*) AS n_words, count(DISTINCT lower(w)) AS n_distinct FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM documents) GROUP BY lang")
def words_by_language(spark, sf_dir):
    return raw_words(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_words"), F.count_distinct(F.lower("w")).alias("n_distinct"))


RANKS = "(SELECT w AS normalized, row_number() OVER (ORDER BY n DESC, w) AS rank, n FROM (SELECT lower(w) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM documents) GROUP BY 1))"


def _ranks(spark, sf_dir):
    return sampling.frequency_ranks(raw_words(spark, sf_dir).select(F.lower("w").alias("word")), "word")


@query(f"SELECT normalized, rank::INT AS rank, n FROM {RANKS}")
def frequency_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"""SELECT item_id, w AS word, coalesce(r.rank, 100000)::INT AS rank FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM benchmark) b
    LEFT JOIN {RANKS} r ON lower(b.w) = r.normalized""")
def frequency_rank_join(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1))).alias("word"))
    return sampling.add_frequency_ranks(items, _ranks(spark, sf_dir), "word").select("item_id", "word", "rank")


@query(f"""SELECT word FROM (SELECT word, -ln(({number_sql(chr(39) + '42|' + chr(39) + ' || word')} + 0.5) / 4294967296.0) / (0.5 / (rank + 1) + 0.5 / count(*) OVER ()) AS o
    FROM (SELECT normalized AS word, rank FROM {RANKS})) ORDER BY o, word LIMIT 500""")
def weighted_sample(spark, sf_dir):
    return sampling.sample_by_frequency(_ranks(spark, sf_dir).select(F.col("normalized").alias("word"), "rank"), 500, "word").select("word")


@query(f"SELECT word FROM {WORDS_SQL} ORDER BY md5('42|' || word), word LIMIT 300")
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(words(spark, sf_dir), 300, "word")


@query(f"""
    WITH w AS (SELECT word, length(word) AS len FROM {WORDS_SQL}),
    s AS (SELECT len, count(*) AS size, round_even(count(*) * 400 / (SELECT count(*) FROM w)::DOUBLE, 0)::BIGINT AS q FROM w GROUP BY len),
    o AS (SELECT *, 400 - sum(q) OVER () AS off, row_number() OVER (ORDER BY size DESC, len) AS r FROM s),
    t AS (SELECT len, least(size, q + CASE WHEN r <= abs(off) THEN sign(off) ELSE 0 END) AS take FROM o)
    SELECT word FROM (SELECT word, len, row_number() OVER (PARTITION BY len ORDER BY md5('42|' || word), word) AS p FROM w) JOIN t USING (len) WHERE p <= take""")
def stratified_sample_by_length(spark, sf_dir):
    return sampling.stratified_by_length(words(spark, sf_dir), 400, "word", "word")


@query(f"""SELECT d.id AS draw, doc_id FROM range(0, 200) d(id) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) t
    ON r = floor(({number_sql("'42|' || d.id")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE * n)""")
def sample_with_replacement(spark, sf_dir):
    return sampling.sample_with_replacement(table(spark, sf_dir, "documents").select("doc_id"), 200, "doc_id")


@query(f"""SELECT count(*) AS n_rows, sum(s)::BIGINT AS same, sum(1 - s)::BIGINT AS different, round(100.0 * sum(s) / count(*), 6) AS percent_same, round(100.0 * sum(1 - s) / count(*), 6) AS percent_different
    FROM (SELECT CASE WHEN text = translate(text, '{chars.MARKED}', '{chars.PLAIN}') THEN 1 ELSE 0 END AS s FROM documents)""")
def row_diff_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return diff.row_differences(docs.select("doc_id", "text"), docs.select("doc_id", chars.normalize_diacritics(F.col("text")).alias("text")), "doc_id", "text")


@query(f"""SELECT count(*) AS n_rows, sum((a = b AND a = c)::INT)::BIGINT AS all_equal, sum((a = b AND a <> c)::INT)::BIGINT AS only_ab, sum((a = c AND a <> b)::INT)::BIGINT AS only_ac,
    sum((b = c AND a <> b)::INT)::BIGINT AS only_bc, sum((a <> b AND a <> c AND b <> c)::INT)::BIGINT AS none_equal
    FROM (SELECT item_id, text AS a, replace(text, 'x', 'y') AS b, translate(text, '{chars.MARKED}', '{chars.PLAIN}') AS c FROM benchmark)""")
def three_way_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return diff.three_way_overlap(b, b.select("item_id", F.replace("text", F.lit("x"), F.lit("y")).alias("text")), b.select("item_id", chars.normalize_diacritics(F.col("text")).alias("text")), "item_id", "text")


@query("SELECT sum(length(text))::BIGINT AS original_tokens, sum(length(replace(text, 'e', 'ee')))::BIGINT AS expanded_tokens, round(sum(length(replace(text, 'e', 'ee'))) / sum(length(text)), 6) AS ratio FROM documents")
def token_totals(spark, sf_dir):
    return diff.token_totals(table(spark, sf_dir, "documents"), F.length("text").cast("bigint"), F.length(F.replace("text", F.lit("e"), F.lit("ee"))).cast("bigint"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first_dedup(spark, sf_dir):
    return ordering.keep_first(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", F.col("doc_id")).select("text", "doc_id")


@query("SELECT item_id, format('passage_gen_{:05d}', row_number() OVER (ORDER BY item_id) - 1) AS id FROM benchmark")
def sequential_ids(spark, sf_dir):
    return ordering.sequential_ids(table(spark, sf_dir, "benchmark").select("item_id"), "passage", "gen", "item_id").select("item_id", "id")


@query("""SELECT item_id, substr('ABCD', (r % 4 + 1)::INT, 1) AS label, item_id::VARCHAR AS answer FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS r FROM benchmark)""")
def balanced_labels(spark, sf_dir):
    right = F.col("item_id").cast("string")
    wrong = F.array(*[F.concat(right, F.lit(x)) for x in "xyz"])
    made = ordering.balanced_answers(table(spark, sf_dir, "benchmark").select("item_id"), right, wrong, 1, "item_id")
    chosen = F.when(F.col("label") == "A", F.col("choice1")).when(F.col("label") == "B", F.col("choice2")).when(F.col("label") == "C", F.col("choice3")).otherwise(F.col("choice4"))
    return made.select("item_id", "label", chosen.alias("answer"))


@query("SELECT (r // 4) AS group_id, string_agg(doc_id::VARCHAR, ',' ORDER BY r) AS members FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY 1 HAVING count(*) = 4")
def groups_of_four(spark, sf_dir):
    made = ordering.groups_of_four(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return made.select("group_id", F.array_join(F.transform("members", lambda m: m["doc_id"].cast("string")), ",").alias("members"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def first_per_group(spark, sf_dir):
    return ordering.first_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), 3, ["source"], "doc_id")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS sum_value FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    """The streaming operator's plan on a batch."""
    return stream_tokens.windowed_counts(table(spark, sf_dir, "events")).withColumn("sum_value", F.round("sum_value", 6))


@query("SELECT doc_id, md5('9|' || doc_id) AS k FROM documents")
def shuffle_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", order_key(9, F.col("doc_id")).alias("k"))
