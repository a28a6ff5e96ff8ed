"""Training sets: id streams, indexed files, padded games and sums, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chars import to_chars
from ..operators import expand, ordering, profiles
from ..plans import tasks
from ..sources import sinks
from ..working import new_path
from . import task_sql
from .base import query, raw_words, table

#: A token id for each character, as a column function: its code.
codes = lambda s: F.transform(to_chars(s), lambda c: F.ascii(c))
CODES = "list_transform(string_split({}, ''), lambda c: unicode(c))"
END, PAD, BATCH = 60_000, 7, 1000

try:
    import public_tokenizers
except ImportError:  # the query needs a vocabulary file
    public_tokenizers = None

if public_tokenizers:

    @query("SELECT item_id, text, length(text) > 0 AS has_ids FROM benchmark")
    def bpe_round_trip(spark, sf_dir):
        """Texts encoded with a byte-level vocabulary's merges and decoded again."""
        from ..operators import bpe

        path = public_tokenizers.path("byte_bpe_50k.json")
        ids = table(spark, sf_dir, "benchmark").select("item_id", bpe.encoder(path)("text").alias("ids"))
        return ids.select("item_id", bpe.decoder(path)("ids").alias("text"), (F.size("ids") > 0).alias("has_ids"))


LENGTHS = "list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))"


def _lengths(spark, sf_dir):
    """The lengths of the space-separated words of each document, as ids."""
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("ids"))


@query(f"""SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS position, len(ids) + 1 AS n_ids, list_sum(ids)::BIGINT + {END} AS total FROM (SELECT doc_id, {LENGTHS} AS ids FROM documents)""")
def indexed_files(spark, sf_dir):
    """Documents written as pairs of indexed files, with an end id each, and read again in order."""
    prefixes = sinks.write_indexed(_lengths(spark, sf_dir), new_path(spark, "indexed"), "ids", "doc_id", end_id=END)
    numbered = ordering.with_row_index(sinks.read_indexed(spark, prefixes), "part", "row", name="position")
    return numbered.select("position", F.size("ids").cast("bigint").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"""SELECT r // {BATCH} AS batch, count(*) AS n_ids, sum(x)::BIGINT AS total, arg_min(x, r)::INT AS first_id FROM (
    SELECT x, row_number() OVER (ORDER BY doc_id, i) - 1 AS r FROM (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM (SELECT doc_id, {LENGTHS} AS ids FROM documents))) GROUP BY 1""")
def stream_batches(spark, sf_dir):
    made = ordering.stream_batches(_lengths(spark, sf_dir), "ids", "doc_id", batch=BATCH)
    return made.select("batch", F.size("ids").cast("bigint").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.get("ids", F.lit(0)).alias("first_id"))


@query(f"""WITH g AS (SELECT id, {CODES.format('question')} AS q, {CODES.format('answer')} AS a FROM ({task_sql.language_game('most')}))
    SELECT CASE WHEN id < 40 THEN 'train' ELSE 'val' END AS split, id, (SELECT max(len(q) + len(a)) FROM g)::INT AS n_ids,
      (list_sum(q) + list_sum(a) + {PAD} * ((SELECT max(len(q) + len(a)) FROM g) - len(q) - len(a)))::BIGINT AS total, '0|' || len(q) || '|' || len(q) + len(a) AS places FROM g""")
def game_training(spark, sf_dir):
    """A language game as padded ids with the places of question and answer."""
    often = raw_words(spark, sf_dir).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).where("n >= 2 AND length(word) <= 11").orderBy(F.desc("n"), "word").limit(1000)
    made = tasks.game_training(tasks.language_games(often.select("word"), "most", 50), codes, PAD, 40)
    return made.select("split", "id", F.size("ids").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_join("idxs_for_masks", "|").alias("places"))


SUMS_SQL = """(SELECT id AS pair, '$' || id // 100 || '+' || id % 100 || '=' AS question, reverse((id // 100 + id % 100)::VARCHAR) AS answer, CASE WHEN r <= 90 THEN 'train' ELSE 'val' END AS split
    FROM (SELECT id, row_number() OVER (ORDER BY (id * 48271) % 2147483647, id) AS r FROM range(1000, 10000) t(id)) WHERE r <= 100)"""
JOINED_CODES = f"array_to_string({CODES.format('question || answer')}, ' ')"


@query(f"SELECT split, pair, question, answer, {JOINED_CODES} AS ids, {JOINED_CODES} AS character_ids FROM {SUMS_SQL}")
def sum_training(spark, sf_dir):
    made = tasks.sum_training(tasks.sums(spark, 2, 90, 10), codes)
    return made.select("split", "pair", "question", "answer", *[F.array_join(c, " ").alias(c) for c in ("ids", "character_ids")])


@query(f"""SELECT split, (row_number() OVER (PARTITION BY split ORDER BY pair) - 1)::INT AS place, array_to_string({CODES.format('question')}, ' ') AS question, array_to_string({CODES.format('answer')}, ' ') AS answer FROM {SUMS_SQL}""")
def sum_question_answers(spark, sf_dir):
    """The id streams of the two splits cut into questions and answers again."""
    rows = tasks.sum_training(tasks.sums(spark, 2, 90, 10), codes)
    streams = rows.groupBy("split").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pair", "ids"))), lambda s: s["ids"])).alias("ids"))  # a hundred sums
    cut = streams.select("split", F.posexplode(tasks.question_answers(F.col("ids"), ord("="), ord("$"))).alias("place", "qa"))
    return cut.select("split", "place", F.array_join("qa.question", " ").alias("question"), F.array_join("qa.answer", " ").alias("answer"))


@query("SELECT event_type, round(sum(value) / count(DISTINCT user_id), 4) AS mean, count(DISTINCT user_id) AS n_ranks FROM events GROUP BY event_type")
def rank_means(spark, sf_dir):
    return profiles.mean_over_ranks(table(spark, sf_dir, "events"), "value", "user_id", "event_type").withColumn("mean", F.round("mean", 4))


@query("SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS file FROM events")
def stamped_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sinks.stamped(F.col("event_type"), F.col("ts")).alias("file"))


@query("""SELECT source, count(*) AS n_rows, sum(length(text))::BIGINT AS n_ids, max(length(text))::BIGINT AS longest, 0::BIGINT AS n_failed FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source""")
def converted_folder(spark, sf_dir):
    """Files of each source converted to ids in one scan, one id a character; sums over the files of a source."""
    folder = new_path(spark, "to-convert")
    sinks.write_jsonl(table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("source", F.col("text").alias("question")), folder, by=["source"])
    ones = lambda s: F.transform(F.split(s, ""), lambda c: F.pmod(F.ascii(c), F.lit(50_000)))
    made = sinks.convert_files(spark, folder, new_path(spark, "converted"), lambda s: F.when(s != "", ones(s)).otherwise(F.array().cast("array<int>")))
    source = F.regexp_extract("file", "/source=([^/]*)/", 1)
    return made.groupBy(source.alias("source")).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_ids")], F.max("longest").alias("longest"), F.sum("n_failed").alias("n_failed"))


def _expanded_sql() -> str:
    """Batches of the items' encoded stream, each expanded by as many tries as it has ids."""
    from . import vocab

    draw = lambda what: f"('0x' || substr(md5(concat_ws('|', '3', batch, step, '{what}')), 1, 8))::BIGINT"
    return f"""WITH RECURSIVE {vocab.ENCODED_SQL}, pairs AS MATERIALIZED {vocab.PAIRS_SQL},
  splits AS (SELECT merged, list({{'l': "left", 'r': "right"}} ORDER BY "left", "right") AS ways FROM pairs GROUP BY merged),
  stream AS (SELECT x, row_number() OVER (ORDER BY item_id, i) - 1 AS r FROM (SELECT item_id, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM encoded)),
  batches AS (SELECT r // 100 AS batch, list(x ORDER BY r) AS ids FROM stream GROUP BY 1),
  steps AS (SELECT batch, 0 AS step, len(ids)::INT AS tries, ids AS s FROM batches
    UNION ALL SELECT batch, step + 1, tries, CASE WHEN ways IS NULL THEN s ELSE s[:i - 1] || [ways[{draw('pair')} % len(ways) + 1].l, ways[{draw('pair')} % len(ways) + 1].r] || s[i + 1:] END
      FROM (SELECT *, {draw('at')} % len(s) + 1 AS i FROM steps WHERE step < tries) x LEFT JOIN splits t ON t.merged = x.s[x.i])
  SELECT batch, len(s)::INT AS n_ids, md5(array_to_string(s, ' ')) AS digest FROM (SELECT batch, arg_max(s, step) AS s FROM steps GROUP BY batch)"""


@query(_expanded_sql())
def expanded_batches(spark, sf_dir):
    from . import vocab

    entries = vocab._entries(spark, sf_dir)
    batches = ordering.stream_batches(vocab._known_items(spark, sf_dir, entries), "ids", "item_id", batch=100)
    made = expand.expand_known_batches(batches, entries, seed=3)
    return made.select("batch", F.size("ids").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("digest"))


@query("""SELECT lang AS level, doc_id, md5(coalesce(text, '')) AS digest, count(*) OVER (PARTITION BY lang) AS in_manifest FROM documents WHERE lang IS NOT NULL""")
def level_files(spark, sf_dir):
    """A folder for each level, after a run that broke off: one level whole, one torn, the others missing."""
    path = new_path(spark, "levels")
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("level"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sinks.write_partitions(docs.where("level = 'en'"), path, ["level"])
    torn = docs.where("level = 'de'").withColumn("doc_id", -F.col("doc_id"))
    torn.write.mode("append").partitionBy("level").json(path)
    whole = sinks.write_partitions(docs, path, ["level"], jobs=3)
    back = sinks.read_partitions(spark, path, "level STRING, doc_id LONG, text STRING")
    return back.join(whole, "level").select("level", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("n_rows").alias("in_manifest"))


@query("""SELECT 'mcq' AS form, item_id, text, length(text)::BIGINT AS n_chars FROM benchmark UNION ALL SELECT 'gen', item_id, text, length(text)::BIGINT FROM benchmark""")
def combined_files(spark, sf_dir):
    """Items of both forms in one folder each, read back as one table."""
    path = new_path(spark, "combined")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    both = items.withColumn("form", F.explode(F.array(F.lit("mcq"), F.lit("gen"))))
    sinks.write_partitions(both, path, ["form"])
    return sinks.read_partitions(spark, path, "form STRING, item_id LONG, text STRING").withColumn("n_chars", F.length("text").cast("bigint"))


@query("SELECT event_type, event_id, user_id, value FROM events")
def csv_export(spark, sf_dir):
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value"), path)
    return sinks.read_csv(spark, path, "event_type STRING, event_id LONG, user_id LONG, value DOUBLE").select("event_type", "event_id", "user_id", "value")


@query("""SELECT lang AS run, count(*) AS n_items, count(*) FILTER (quality = 1) AS n_right, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL GROUP BY lang""")
def run_summaries(spark, sf_dir):
    """One summary line for each run, beside the run's result lines; the lines are whole when the summary is there."""
    path = new_path(spark, "runs")
    results = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("lang IS NOT NULL AND quality IS NOT NULL").select(F.col("lang").alias("run"), "doc_id", F.col("quality").cast("int").alias("right"))
    sinks.write_partitions(results, f"{path}/results", ["run"])
    back = sinks.read_partitions(spark, f"{path}/results", "run STRING, doc_id LONG, right INT")
    summed = back.groupBy("run").agg(F.count("*").alias("n_items"), F.sum("right").cast("bigint").alias("n_right"), F.round(F.avg("right"), 6).alias("accuracy"))
    sinks.write_partitions(summed, f"{path}/summaries", ["run"])
    return sinks.read_partitions(spark, f"{path}/summaries", "run STRING, n_items LONG, n_right LONG, accuracy DOUBLE")
