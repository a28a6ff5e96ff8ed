"""Benchmark decontamination: MinHash containment search of test items in documents, then exact counts.

A short item inside a long document leaves almost no trace in a MinHash of the whole document, so
the MinHash signatures (bottom-k) are taken on the items alone, and each document is probed with all
of its shingles. This is the method here, by decision: signatures of item-sized windows of documents
would cost more and could miss items, this search can't.
Items are partitioned by size. In a partition whose largest item has u shingles, an item's signature
is its k = floor((1 - t) * u) + 1 least shingle hashes: a document that contains the share t of an
item's shingles misses at most (1 - t) * u of them, so it must hold one of any k. No contaminated
document is missed; what the probe finds is verified by counting shared shingles as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_or_empty

SHINGLE, THRESHOLD = 5, 0.8
#: Item tables up to so many rows (some 100 bytes each) are broadcast; beyond it they are shuffled.
MOST_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ", -1))


def _windows(items: Column, n: int, f) -> Column:
    """``f`` over each run of ``n`` neighbours of an array column; none if it is shorter."""
    some = F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: f(*[F.get(items, i + k) for k in range(n)]))
    return F.when(F.size(items) >= n, some)


def _hashes(h: Column, n: int) -> Column:
    return _windows(h, n, lambda *x: F.xxhash64(*x))


def _strings(w: Column, n: int) -> Column:
    return _windows(w, n, lambda *x: F.concat_ws(" ", *x))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, list[int]]:
    """Tables (width, shingle, item_id, item, n) and (width, hash) of all items and their signatures, and the widths.

    An item of fewer than ``shingle`` words is one shingle of its own width; an item without words
    has none and is found nowhere. Equal rows are one ``item``; texts that share an id are items of their own.
    """
    w = items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")).dropDuplicates(["item"])
    w = w.select("item_id", "item", words_of(text_or_empty()).alias("w"))
    w = materialize(w.where(F.size("w") > 0).select("item_id", "item", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.least(F.size("w"), F.lit(shingle)).alias("width")), "items")
    widths = sorted(r.width for r in w.select("width").distinct().collect())  # `shingle` numbers at most
    rows = None
    for n in widths:
        one = w.where(F.col("width") == n).select("item_id", "item", "width", F.array_distinct(_strings(F.col("w"), n)).alias("strings"), F.array_sort(F.array_distinct(_hashes(F.col("h"), n))).alias("hashes"))
        rows = one if rows is None else rows.unionAll(one)
    if rows is None:
        rows = w.select("item_id", "item", "width", F.col("w").alias("strings"), F.col("h").alias("hashes"))
    n = F.size("strings")
    rows = rows.select("item_id", "item", "width", "strings", "hashes", n.alias("n"), F.floor(F.log2(n)).alias("part"))
    largest = rows.groupBy("part").agg((F.floor(F.max("n") * (1 - threshold) + 1e-9) + 1).cast("int").alias("k"))
    signed = rows.join(F.broadcast(largest), "part")  # one row for each power of two
    signatures = signed.select("width", F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("hash")).distinct()
    strings = rows.select("width", F.explode("strings").alias("shingle"), "item_id", "item", "n")
    return materialize(strings, "item-shingles"), materialize(signatures, "item-signatures"), widths


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (doc_id, item_id, containment): ``docs`` (doc_id, text) that hold the share ``threshold`` of an item.

    Containment is the share of the item's distinct word shingles that the document has. Null and
    empty texts on either side are in no pair; null ids are kept as null; equal rows of either table
    count once, and texts that share an id are compared each and give one pair with the greatest
    containment; empty tables give no pairs. Very long texts are searched whole.
    """
    strings, signatures, widths = item_shingles(items, threshold, shingle)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    hashed = keyed.select("key", F.transform(words_of(text_or_empty()), lambda x: F.xxhash64(x)).alias("h"))
    limit = signatures.agg(F.max("hash")).first()[0]
    signatures, strings = _bounded(signatures), _bounded(strings)
    found = None
    for n in widths:
        low = hashed.select("key", F.explode(F.filter(_hashes(F.col("h"), n), lambda x: x <= limit)).alias("hash"))
        met = low.join(signatures.where(F.col("width") == n).select("hash"), "hash", "left_semi").select("key").distinct()
        found = met if found is None else found.unionAll(met)
    if found is None:
        return docs.where(F.lit(False)).select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("containment"))
    found = materialize(found.distinct(), "candidates")
    suspects = keyed.join(_bounded(found), "key", "left_semi").dropDuplicates(["key"])
    suspects = materialize(suspects.select("doc_id", "key", words_of(text_or_empty()).alias("w")), "suspects")
    pairs = None
    for n in widths:
        own = suspects.select("doc_id", "key", F.explode(F.array_distinct(_strings(F.col("w"), n))).alias("shingle"))
        met = own.join(strings.where(F.col("width") == n).drop("width"), "shingle").groupBy("doc_id", "key", "item_id", "item", "n").agg(F.count("*").alias("shared"))
        pairs = met if pairs is None else pairs.unionAll(met)
    share = F.col("shared") / F.col("n")
    return pairs.groupBy("doc_id", "item_id").agg(F.max(share).alias("containment")).where(F.col("containment") >= threshold)


def clean_documents(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents (all rows of their doc_id) that hold an item, columns as they are."""
    bad = materialize(contaminated(docs, items, threshold=threshold, shingle=shingle).select(F.col("doc_id").alias("_bad_doc_id")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_doc_id"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


OP8_SQL = r"""
WITH it AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
its AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM it WHERE len(w) > 0),
i AS (SELECT item_id, len(s) AS n, unnest(s) AS k FROM its),
dw AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM dw WHERE len(w) >= 5))
SELECT doc_id, item_id, round(count(*) / max(n)::DOUBLE, 6) AS containment
FROM d JOIN i USING (k) GROUP BY doc_id, item_id HAVING count(*) / max(n)::DOUBLE >= 0.8"""
