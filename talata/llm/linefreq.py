"""Quality rules: frequency of lines across the documents of a host, and simple text counts.

Every expression is a built-in: texts are split and hashed inside each row, and only line hashes
are shuffled, counted before they move. A line in more documents of its host than a limit is
removed, and a document that loses most of its words is rejected. The limit is a number of documents
that holds for hosts of any size; on small hosts, which never reach it, a share of the host counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line is above the limits in more than MAX_DOCS distinct documents of its host, or in more than
#: MAX_SHARE of them and more than MIN_DOCS.
MAX_DOCS, MAX_SHARE, MIN_DOCS = 20, 0.05, 3
#: A document with removed lines is depleted when less than this share of its words is left.
MIN_LEFT = 0.30
#: Frequent lines up to so many rows (24 bytes each) are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 500_000
_SPACES = "[\\x20\\x09-\\x0D]"


def _flat(text: Column) -> Column:
    """The text with every white space as a space."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _without(text: Column, c: str) -> Column:
    return F.replace(text, F.lit(c), F.lit(""))


def line_key(line: Column) -> Column:
    """A line without case and with single spaces; equal keys count as one line."""
    return F.lower(F.trim(F.regexp_replace(line, _SPACES + "+", " ")))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(_flat(text), " ", -1), lambda w: w != "")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, which take the place of such columns.

    Null and empty texts count 0 everywhere, very long ones are counted whole. Windows of WINDOW
    words are compared by a 64-bit hash within one document; documents without a repeated window
    never sort theirs. Other columns may have any name.
    """
    kept = [c for c in docs.columns if c.lower() not in COUNTS]
    t, h, g, s, p = (F.col(c) for c in ("t", "hashes", "windows", "sorted", "starts"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text_or_empty(text).alias("t"))
    out = out.select(
        "doc",
        F.transform(words_of(t), lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(_without(_flat(t), " ")).cast("long").alias("word_chars"),
        sum((F.length(t) - F.length(_without(t, c)) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        lines_of(t).alias("lines"),
    )
    n = F.size(h)
    each = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    out = out.select("doc", n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(n >= WINDOW, each).alias("windows"))
    repeated = F.size(F.array_distinct(g)) < F.size(g)
    out = out.withColumn("sorted", F.when(repeated, F.sort_array(F.transform(g, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))))
    twice = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"]), x["p"]))
    out = out.withColumn("starts", F.sort_array(F.filter(twice, lambda q: q.isNotNull())))
    spread = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(spread, F.lit(0)).cast("long"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in kept], *COUNTS)


def _by_document(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, host, keys: distinct line hashes) -> (host, key), once for each document that has the line.

    Only documents of several rows are put together; the others' lines are counted where they are.
    """
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    repeated = materialize(repeated, "repeated-documents")
    if repeated.isEmpty():
        return rows.select("host", F.explode("keys").alias("key"))
    if repeated.count() <= MOST_BROADCAST:
        repeated = F.broadcast(repeated)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    single = rows.join(repeated, same, "left_anti").select("host", F.explode("keys").alias("key"))
    several = rows.join(repeated, same, "left_semi").select("host", "doc_id", F.explode("keys").alias("key")).distinct()
    return single.unionAll(several.select("host", "key"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lines`` (host, key: a line hash, once for each distinct document) -> host, key of lines above limits.

    ``hosts`` (host, n_docs) sets the share. A null host is a host of its own.
    """
    counted = lines.groupBy("host", "key").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") > min(max_docs, min_docs)).withColumnRenamed("host", "_host")
    met = often.join(hosts, F.col("_host").eqNullSafe(F.col("host")))
    return met.where((F.col("n") > max_docs) | ((F.col("n") > max_share * F.col("n_docs")) & (F.col("n") > min_docs))).select("host", "key")


def filter_lines(docs: DataFrame, host: str = "source", *, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, host): counts, base_failed, removed lines, kept.

    Rows with one doc_id are one document, and so are all rows without an id: a line counts once for
    it, and each row keeps its own result. Null text has no words and fails the base rules; a null
    host is a host of its own; a blank line is never frequent. A line at a limit, not above it, stays. ``with_text`` adds the text without its removed lines. Empty tables give no rows.
    """
    picked = docs.select("doc_id", F.col(host).alias("host"), "text")
    counted = text_counts(picked).withColumn("_lines", lines_of(text_or_empty()))
    with_lines = counted.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        *["text"] * with_text,
        F.transform("_lines", lambda line: F.struct(F.xxhash64(line_key(line)).alias("key"), F.size(words_of(line)).alias("words"))).alias("lines"),
    )
    base = materialize(with_lines, "line-counts")
    hosts = base.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    lines = _by_document(base.select("doc_id", "host", F.array_distinct("lines.key").alias("keys")))
    often = materialize(frequent_lines(lines, hosts, max_docs, max_share, min_docs), "frequent-lines")
    often = often.select(F.xxhash64("host", F.isnull("host"), "key").alias("host_key"))
    if often.count() <= MOST_BROADCAST:
        often = F.broadcast(often)
    lines = base.select("row", "host", F.explode("lines").alias("line"))
    lines = lines.select("row", F.xxhash64("host", F.isnull("host"), "line.key").alias("host_key"), F.col("line.key").alias("key"), "line.words")
    lost = lines.join(often, "host_key", "left_semi").groupBy("row").agg(
        F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"), *[F.collect_set("key").alias("removed_keys")] * with_text
    )
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    gone = F.coalesce("removed_words", F.lit(0))
    depleted = (gone > 0) & (n - gone < MIN_LEFT * n)
    left = F.filter(F.split(text_or_empty(), "\n", -1), lambda line: ~F.array_contains(F.coalesce("removed_keys", F.array().cast("array<bigint>")), F.xxhash64(line_key(line))))
    return base.join(lost, "row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"),
        gone.alias("removed_words"),
        *([F.array_join(left, "\n").alias("text")] if with_text else []),
    )


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_lines(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(doc_id, -1) AS doc, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT r, u.p AS p, array_to_string(ws[u.p:u.p + 7], ' ') AS k
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS p) u WHERE len(ws) >= 8),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY r),
line AS (
  SELECT r, doc, source, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k,
         len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, doc, source, unnest(ls) AS l FROM w)),
host AS (SELECT source, count(DISTINCT doc) AS n_docs FROM d GROUP BY source),
often AS (
  SELECT f.source, f.k FROM (SELECT source, k, count(DISTINCT doc) AS n FROM line GROUP BY source, k) f
  JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 20 OR (f.n > 3 AND f.n > 0.05 * h.n_docs)),
gone AS (
  SELECT l.r, count(*) AS ln, sum(l.n) AS wn FROM line l JOIN often o ON l.k = o.k AND l.source IS NOT DISTINCT FROM o.source GROUP BY l.r),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.ln, 0)::BIGINT AS removed_lines, coalesce(gone.wn, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN gone ON gone.r = w.r),
failed AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < 0.3 * n_words)) AS kept, removed_lines, removed_words
FROM failed"""
