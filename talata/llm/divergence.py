"""Source divergence audit: how far each source's words lie from those of each other source of its language.

The method is joint count histograms. A source's probability of a term depends on the term's count
alone, so a measure between two sources depends on how many terms have each combination of counts:

1. Terms that fall on the same counts in the same sources are one vector with a multiplicity.
2. Each pair of a vector's sources adds its multiplicity to the cell (count, count) of that pair.
3. Cells with a zero are never enumerated by term: they are a source's own count histogram less
   what the pair's cells have already, and the terms that neither has are the rest of the vocabulary.
4. f is evaluated once for each cell, in both directions, times its multiplicity.

What is sent is one row for a term and source, then one for a distinct vector, then cells. A vector
has at most one entry for each source of the language, so pairs grow with the sources, as the result
does, and not with documents or copies. All arithmetic is exact: whole numbers, decimals for products.
"""

from __future__ import annotations

import string
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: Bytes of UTF-8 to A-Z lower-cased, what lies between terms to blanks; terms are runs of ASCII letters and of anything beyond ASCII.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Terms that a task holds before it sends what it has counted; bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 20
#: Documents of a language that a kept term is in at least; terms reported for a source.
LEAST_DOCUMENTS, MOST_TERMS = 3, 200
SCALE = 1_000_000_000
#: Rows (one for a language and source) up to which a table is broadcast; beyond it joins shuffle.
MOST_BROADCAST = 100_000


def terms_of(text: bytes):
    """The terms of a text in order, repeats included, in lists; a long text is cut between terms."""
    clean = text.translate(_TERMS)
    start = 0
    while len(clean) - start > PIECE:
        end = clean.rfind(b" ", start, start + PIECE)
        end = clean.find(b" ", start + PIECE) if end < start else end
        if end < 0:
            break
        yield clean[start:end].split()
        start = end + 1
    yield clean[start:].split()


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def _count(batches, held: int):
    """Rows (lang, source, text) to occurrences and documents of each term, summed as far as a task goes."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def sent():
        for (lang, source), (count, docs) in counts.items():
            terms = pa.array(list(count), pa.binary()).cast(pa.string())
            n = len(terms)
            names = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, pa.array(count.values(), pa.int64(), size=n), pa.array(map(docs.get, count), pa.int64(), size=n)], schema=COUNTED)
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            count, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for terms in terms_of(text.as_buffer().to_pybytes()):
                count.update(terms)
                distinct.update(terms)
            docs.update(distinct)
        if sum(len(count) for count, _ in counts.values()) > held:
            yield from sent()
    yield from sent()


def probability(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)) as a long; null of an empty vocabulary."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), F.nullif(wide(total + vocabulary), F.lit(0)))


def deviation(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def term_vectors(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, counts): the kept terms of each language, with counts as sorted (source, count)."""
    each = docs.select("lang", "source", "text").mapInArrow(partial(_count, held=HELD), "lang string, source string, term string, count long, docs long")
    counted = each.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("counts"))
    return by_term.where(F.col("docs") >= least).drop("docs")


def source_divergence(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs`` (text, lang, source).

    Part ``pair`` has a row for each other source of the language: the divergence of this source's
    probabilities from that one's over all kept terms. Part ``term`` has this source's most
    over-represented terms against the language as a whole. Null text, lang and source are ''. A
    language without a kept term has pairs of value 0 and no terms; a language of one source has no
    pairs. Repeated rows are documents of their own. Ties in value go by item in UTF-8 order. Other
    columns may have any name. No rows, no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = materialize(term_vectors(docs, least), "term-vectors")
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    one = terms.select("lang", "term", "total", F.inline("counts"))
    own = one.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("present"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = materialize(groups.na.fill(0, ["total", "present", "v", "lang_total"]), "groups")
    few = groups.count()

    # Cells of terms that both have.
    vectors = terms.groupBy("lang", "counts").agg(F.count("*").alias("m")).where(F.size("counts") > 1)
    first = vectors.select("lang", "m", "counts", F.posexplode("counts").alias("i", "a"))
    both = first.select("lang", "m", "a", F.explode(F.slice("counts", F.col("i") + 2, F.size("counts"))).alias("b"))
    joint = both.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.count").alias("ca"), F.col("b.count").alias("cb")).agg(F.sum("m").alias("m"))
    joint = materialize(joint, "joint-counts")

    # Implied cells: each source's histogram less what the pair has, on either side, and what neither has.
    of = lambda name, side: _small(groups.select("lang", F.col("source").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in name]), few)
    pairs = of(["total", "present"], "a").join(of(["total", "present"], "b"), "lang").where("a < b").join(F.broadcast(vocabulary) if few <= MOST_BROADCAST else vocabulary, "lang", "left").na.fill(0, ["v"])
    pairs = materialize(pairs.select("lang", "a", "b", "total_a", "total_b", "present_a", "present_b", "v"), "pairs")
    histogram = one.groupBy("lang", "source", "count").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    at_a = histogram.select("lang", F.col("source").alias("a"), F.col("count").alias("ca"), "m").join(pairs.select("lang", "a", "b"), ["lang", "a"]).select("lang", "a", "b", "ca", zero.alias("cb"), "m")
    at_b = histogram.select("lang", F.col("source").alias("b"), F.col("count").alias("cb"), "m").join(pairs.select("lang", "a", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("ca"), "cb", "m")
    neither = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("present_a") - F.col("present_b")).alias("m"))
    m = F.col("m")
    taken = joint.select("lang", "a", "b", F.inline(F.array(*[F.struct(ca.alias("ca"), cb.alias("cb"), n.alias("m")) for ca, cb, n in ((F.col("ca"), F.col("cb"), m), (F.col("ca"), zero, -m), (zero, F.col("cb"), -m), (zero, zero, m))])))
    cells = taken.unionAll(at_a).unionAll(at_b).unionAll(neither).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))

    # f once for a cell, in both directions.
    p, q = probability(F.col("ca"), F.col("total_a"), F.col("v")), probability(F.col("cb"), F.col("total_b"), F.col("v"))
    valued = cells.where("m <> 0 OR (ca = 0 AND cb = 0)").join(pairs.drop("present_a", "present_b"), ["lang", "a", "b"]).withColumns({"p": p, "q": q})
    summed = valued.groupBy("lang", "a", "b").agg(*[F.coalesce(F.sum(m * deviation(F.col(x), F.col(y))), zero).alias(n) for x, y, n in (("p", "q", "ab"), ("q", "p", "ba"))])
    by_pair = summed.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))))

    # Terms of a source against its language.
    held = one.select("lang", "source", "term", "count", F.col("total").alias("in_lang")).join(_small(groups, few), ["lang", "source"])
    p, q = probability(F.col("count"), F.col("total"), F.col("v")), probability(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    over = held.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.col("term").alias("item"), deviation(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shown = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(by_pair, "pair").unionAll(shown(over, "term").where(F.col("rank") <= most_terms))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}),
vocabulary AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, k.in_lang, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
          FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
chances AS (SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + 1) // (total + v)::HUGEINT AS p, 1 + {SCALE}::HUGEINT * (in_lang + 1) // (lang_total + v)::HUGEINT AS q FROM dense JOIN vocabulary USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM chances WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
