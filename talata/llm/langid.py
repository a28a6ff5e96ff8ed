"""Language identification by compression with one raw-content zstandard dictionary a language.

A text is encoded with each language's dictionary in reach and gets the language whose output is
smallest. Texts are reduced to lower-case letters and compressed in short independent blocks, so
that in long texts the dictionary stays what the compressor refers to.
"""

from __future__ import annotations

import math
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read

UNKNOWN = "und"
#: Documents learned from, a language, at most: so many, and so many characters of whole texts in all.
SAMPLE_DOCS, SAMPLE_CHARS = 250, 2 << 20
#: Languages whose compressors a worker holds at once; more are measured in several passes over the texts.
LANGS_EACH = 200
#: Languages up to which their counts are broadcast.
MOST_BROADCAST = 100_000
DICT_BYTES = 100 << 10
LEVEL, BLOCK = 5, 3000
#: A language is rejected as doubtful when its output is not smaller than the next by this share.
MIN_MARGIN = 0.002

_JUNK = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of the text with single spaces between them."""
    kept = _JUNK.sub(" ", text.lower()).strip()
    return kept.encode() if any(c.isalpha() for c in kept) else b""


def build_dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """Distinct sentences of the texts until ``size`` bytes are full."""
    seen: set[bytes] = set()
    out, n = [], 0
    for text in texts:
        for sentence in re.split(r"[.\n]", text):
            s = letters(sentence)
            if s and s not in seen:
                seen.add(s)
                out.append(s)
                n += len(s) + 1
        if n > size:
            break
    return b" ".join(out)[-size:]


def _choose(table: pa.Table, most: int, chars: int) -> pa.Table:
    """The sampled rows (row, lang, o, size) of one language in the order of ``o``: each that fits into what is left."""
    left, chosen = chars, []
    for _, row, size in sorted(zip(table["o"].to_pylist(), table["row"].to_pylist(), table["size"].to_pylist(), strict=True)):
        if size <= left and len(chosen) < most:
            left -= size
            chosen.append(row)
    return pa.table({"row": pa.array(chosen, pa.int64())})


def _build(table: pa.Table) -> pa.Table:
    """The chosen rows (lang, o, text) of one language to its dictionary."""
    rows = sorted(zip(table["o"].to_pylist(), table["text"].to_pylist(), strict=True))
    return pa.table({"lang": table["lang"].slice(0, 1), "dictionary": pa.array([build_dictionary([t for _, t in rows])], pa.binary())})


def learn(docs: DataFrame, *, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries by language from ``docs`` (doc_id, text, lang), null langs and texts left out.

    Of every language the documents with the least hash of their id are taken, at most ``most``, each
    whose whole text fits into what is left of ``chars`` characters; a text too long for that is left
    out alone. Rows that share an id and a language count as one with the least text, and null ids as
    one id. A language all of whose texts are without letters or longer than ``chars`` has no
    dictionary. A task holds one language's sample, and the driver DICT_BYTES for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = materialize(known.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count("*").alias("ids")), "languages")
    share = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    likely = known.select("doc_id", "lang", "text", order.alias("o")).join(share, "lang").where(F.col("o") * F.col("ids") < 4.0 * most * (1 << 30))
    likely = likely.groupBy("lang", "doc_id", "o").agg(F.min("text").alias("text"))
    likely = materialize(likely.select(F.monotonically_increasing_id().alias("row"), "lang", "o", "text"), "language-sample")
    sizes = likely.select("row", "lang", "o", F.length("text").cast("long").alias("size"))

    def choose(table: pa.Table) -> pa.Table:
        return _choose(table, most, chars)

    chosen = sizes.groupBy("lang").applyInArrow(choose, "row long")
    built = likely.join(chosen, "row").select("lang", "o", "text").groupBy("lang").applyInArrow(_build, "lang string, dictionary binary")
    return {r.lang: bytes(r.dictionary) for r in sorted(built.collect()) if r.dictionary}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            shared = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str | None) -> list[int] | None:
        """The bytes that each language makes of the text; null of one without a letter."""
        data = letters(text or "")
        if not data:
            return None
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1), and margin: how much smaller than the next its output is."""
        return decide(self.langs, self.sizes(text))


def decide(langs: list[str], sizes: list[int] | None) -> tuple[str, float, float]:
    """Language, score and margin of the sizes under all ``langs``; of equal sizes the lesser name wins."""
    if not sizes:
        return UNKNOWN, 0.0, 0.0
    least = min(sizes)
    best = sizes.index(least)
    others = [n for i, n in enumerate(sizes) if i != best]
    margin = (min(others) - least) / min(others) if others else 1.0
    score = 1.0 / (1.0 + sum(math.exp(-60.0 * (n - least) / least) for n in others))
    return langs[best], score, margin


def _measure(batches, dictionaries, at: int, before: bool):
    """Adds the sizes under these dictionaries as the last column, after those that it has if ``before``."""
    classifier = Classifier(dictionaries.value)
    for batch in batches:
        sizes = [classifier.sizes(t.as_py()) for t in batch.column(at)]
        columns = batch.columns
        if before:
            sizes = [None if new is None else [*old, *new] for old, new in zip(columns[-1].to_pylist(), sizes, strict=True)]
            columns = columns[:-1]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.list_(pa.int64()))], [*(f"c{j}" for j in range(len(columns))), "sizes"])


FOUND = ["lang_pred", "score", "margin"]


def _classify(batches, dictionaries, langs: list[str], at: int, kept: dict[int, str], measured: bool):
    classifier = Classifier(dictionaries.value)
    for batch in batches:
        sizes = [classifier.sizes(t.as_py()) for t in batch.column(at)]
        if measured:
            sizes = [None if new is None else [*old, *new] for old, new in zip(batch.columns[-1].to_pylist(), sizes, strict=True)]
        out = [decide(langs, x) for x in sizes]
        more = [pa.array([x[i] for x in out], t) for i, t in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *more], [*kept.values(), *FOUND])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, each: int = LANGS_EACH) -> DataFrame:
    """``docs`` with lang_pred, score, margin, which take the place of columns with those names.

    Null texts and texts without a letter get ``und`` with score and margin 0; very long texts are
    read whole; ties go to the lesser language name. Every other column is passed through, and so
    are null ids and repeated rows; an empty table gives no rows. Without dictionaries all is ``und``.
    Workers hold ``each`` dictionaries at once: with more languages the rows are written between the
    passes with the sizes so far, and decided under all of them in the last.
    """
    langs, spark = sorted(dictionaries), docs.sparkSession
    groups = [{lang: dictionaries[lang] for lang in langs[i : i + each]} for i in range(0, len(langs), each)] or [{}]
    at, kept = docs.columns.index("text"), {i: c for i, c in enumerate(docs.columns) if c.lower() not in FOUND}
    rows, fields = docs, docs.schema.fields
    for i, group in enumerate(groups[:-1]):
        # Positions, not names, tell the columns apart, so any name may be there.
        shared = spark.sparkContext.broadcast(group)  # DICT_BYTES a language
        named = T.StructType([*[T.StructField(f"c{j}", f.dataType) for j, f in enumerate(fields)], T.StructField("sizes", T.ArrayType(T.LongType()))])
        rows = materialize(rows.mapInArrow(partial(_measure, dictionaries=shared, at=at, before=i > 0), named), "language-sizes")
    shared = spark.sparkContext.broadcast(groups[-1])
    schema = T.StructType([*[fields[i] for i in kept], *T.StructType().add("lang_pred", "string").add("score", "double").add("margin", "double")])
    return rows.mapInArrow(partial(_classify, dictionaries=shared, langs=langs, at=at, kept=kept, measured=len(groups) > 1), schema)


def _accept(batches, dictionaries, at: int, least: float):
    classifier = Classifier(dictionaries.value)
    for batch in batches:
        out = (classifier(t.as_py()) for t in batch.column(at))
        yield batch.filter(pa.array([lang != UNKNOWN and margin >= least for lang, _, margin in out], pa.bool_()))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], *, least: float = MIN_MARGIN, each: int = LANGS_EACH) -> DataFrame:
    """The rows of ``docs`` whose language is told with a margin of ``least`` or more, as they are.

    Null texts, texts without a letter, and narrow margins go. Any columns may be there besides
    ``text``.
    """
    if len(dictionaries) > each:
        rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        found = identify(rows, dictionaries, each=each).where((F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= least))
        return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return docs.mapInArrow(partial(_accept, dictionaries=shared, at=docs.columns.index("text"), least=least), docs.schema)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text has this remainder; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that the contract lets the operator learn from."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(4, 2))


def op7_language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(learnable(docs)))
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < MIN_MARGIN)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "margin", rejected.alias("rejected"))
