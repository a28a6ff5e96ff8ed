"""Quality scores: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features are n-grams of words (one and two) and of word forms (one to three), where a form tells the
case of a word, the marks in it, and whether it repeats the word before it. They are
hashed to DIM places and weighted by their share of the text's n-grams, times SCALE. A score is the
logistic of a sparse dot product.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .langid import held_out

DIM_BITS = 18
DIM = 1 << DIM_BITS
#: Labelled documents learned from, at most: so many, and so many characters of whole texts in all.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 32 << 20
SCALE = 8.0
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.3
MAX_KEPT = 500_000

_MARKS = re.compile(r"[\W_]+")


class _Words(dict):
    """A space-separated word -> hash of its letters in the low 32 bits, its form in the next 15."""

    def __missing__(self, word: str) -> int:
        core = _MARKS.sub("", word)
        marks = "".join(_MARKS.findall(word))
        if not core or core[0].isdigit():
            case = 0 if not core else 1
        elif core.islower():
            case = 2
        else:
            case = 3 if core[1:].islower() or len(core) == 1 else 4 if core.isupper() else 5
        form = (zlib.crc32(marks[:8].encode()) & 0xFFF if marks else 0) << 3 | case
        value = zlib.crc32((core or marks).lower().encode()) | form << 32
        if len(word) <= 48:
            if len(self) >= MAX_KEPT:
                self.clear()
            self[word] = value
        return value


_words = _Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _place(value: np.ndarray, kind: int) -> np.ndarray:
    return (((value + np.uint64(kind * 0x51_7C_C1_B7)) * _MIX) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def places(text: str | None) -> np.ndarray:
    """The hashed place of every n-gram of a text, repeats included; none for a blank text."""
    words = (text or "").split()
    found = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    word, form = found & np.uint64(0xFFFFFFFF), found >> np.uint64(32)
    form[1:] |= (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(15)
    pair = word[:-1] * np.uint64(0x100000001B3) + word[1:]
    two = (form[:-1] << np.uint64(16)) | form[1:]
    three = (two[:-1] << np.uint64(16)) | form[2:]
    return np.concatenate([_place(word, 1), _place(pair, 2), _place(form, 3), _place(two, 4), _place(three, 5)])


class Ftrl:
    """Follow-the-regularised-leader updates for one logistic model; the last place is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ value)))))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[str | None, int]]) -> np.ndarray:
    """Weights from (text, label) rows, in the order given, EPOCHS times over."""
    model = Ftrl()
    made = []
    for text, label in rows:
        at, count = np.unique(places(text), return_counts=True)
        made.append((np.append(at, DIM), np.append(count * (SCALE / max(1, count.sum())), 1.0), label))
    for _ in range(EPOCHS):
        for row in made:
            model.update(*row)
    return model.weights().astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label: str, *, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``most`` labelled documents, chosen by the hash of their id, with their whole texts.

    Rows with a null id or label are left out. A document's repeated labels count as the greatest
    of them, and its repeated rows as one with the least text. In the order of the hash, each
    document is taken whose text fits into what is left of ``chars`` characters; one too long for
    that is left out alone, and those after it are not. So what comes to the driver is bounded
    whatever the tables hold.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = usable.select("doc_id", "label", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    texts = materialize(texts.groupBy("doc_id", "label", "o").agg(F.min("text").alias("text")), "labelled-sample")
    left, fits = chars, []
    for r in texts.select("o", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy("o", "doc_id").collect():  # at most `most` rows
        if r.n <= left:
            left -= r.n
            fits.append((r.doc_id,))
    taken = docs.sparkSession.createDataFrame(fits, texts.select("doc_id").schema)
    rows = texts.join(F.broadcast(taken), "doc_id").select("o", "doc_id", "label", "text").collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.o, r.doc_id))]


def _score(batches, weights):
    w = weights.value
    for batch in batches:
        out = []
        for text in batch.column("text"):
            at = places(text.as_py())
            out.append(1.0 / (1.0 + math.exp(-(float(w[at].sum(dtype=np.float64)) * SCALE / max(1, len(at)) + float(w[DIM])))))
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(out, pa.float64())], [n for n, _ in kept] + ["score"])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row of ``docs``, null ids and repeated rows included.

    Null, empty and blank texts get the bias alone; very long texts are scored whole; an empty table
    gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIM + 1 numbers
    return docs.select("doc_id", "text").mapInArrow(partial(_score, weights=shared), "doc_id long, score double")


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    weights = train(sample(docs, labels.where(~held_out(5, 0)), "quality"))
    scored = score(docs, weights)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
