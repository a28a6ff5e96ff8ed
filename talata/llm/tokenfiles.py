"""Token-id files: each document compressed on its own with one shared zstandard dictionary.

File format (all numbers little-endian):

    8 bytes   magic ``TLTIDS01``
    32 bytes  SHA-256 of the dictionary (zeros: no dictionary)
    4 bytes   bytes of one id (2 or 4)
    frames    one zstandard frame for each document, in ascending doc_id order
    index     doc_id int64[n] (null: the least int64), frame end uint64[n], ids uint64[n]
    24 bytes  n uint64, place of the index uint64, ids in the file uint64

The dictionary is ``dictionary-<sha256>.zdict`` in the same folder. A reader finds a document by
its index entry and reads that one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, new_path, range_partitions, read
from .wordbpe import word_bpe

MAGIC = b"TLTIDS01"
FOOT = struct.Struct("<QQQ")
END_ID = 2
FILE_BYTES = 64 << 20  # a file is closed once it has so many bytes
SAMPLE_DOCS = 600  # documents that the dictionary is trained on, about
SAMPLE_IDS = 16_384  # ids taken from each of them at most, as the trainer asks for short samples
DICT_BYTES = 64 << 10
LEVEL = 3
KEPT = 600_000  # words that an encoder remembers in each of its generations: some 240 MB a worker at most
NO_ID = -(1 << 63)
MOST_READERS = 10_000  # tasks that read files back; beyond it a task reads several


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _serialized(batches, path: str, width: int, most: int):
    encoder = word_bpe(path, KEPT)
    for batch in batches:
        out = [np.frombuffer(encoder.encode(t.as_py() or ""), dtype="<u4")[:most].astype(f"<u{width}").tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])


def train_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    """A dictionary from about SAMPLE_DOCS documents chosen by the hash of their id and text; b"" if too few."""
    import zstandard

    every = max(1, docs.count() // SAMPLE_DOCS)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").limit(2 * SAMPLE_DOCS)
    samples = [bytes(r.ids) for r in chosen.mapInArrow(partial(_serialized, path=path, width=width, most=SAMPLE_IDS), "ids binary").collect()]
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 16:
        return b""
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes() if size >= 256 else b""
    except zstandard.ZstdError:  # the trainer refuses samples without anything in common
        return b""


class _Writer:
    """One file; a failed attempt leaves a file that no manifest names."""

    def __init__(self, folder: str, digest: bytes, width: int):
        self.fs, base = _open(folder)
        self.path = f"{base}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tlt"
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC + digest + struct.pack("<I", width))
        self.at = len(MAGIC) + len(digest) + 4
        self.docs, self.ends, self.counts = array("q"), array("Q"), array("Q")

    def add(self, doc_id: int | None, frame: bytes, ids: int) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.ends.append(self.at)
        self.counts.append(ids)

    def close(self) -> tuple:
        total = sum(self.counts)
        for column in (self.docs, self.ends, self.counts):
            self.out.write(column.tobytes())
        self.out.write(FOOT.pack(len(self.docs), self.at, total))
        self.out.close()
        return self.path, len(self.docs), total, self.docs[0], self.docs[-1]


FRAMES = "doc_id long, size int, hash long, row long, frame binary, ids long"


def _encode(batches, path: str, dictionary, width: int, end_id: int):
    """Rows (doc_id, size, hash, row, text) with the text as its compressed frame and the number of its ids."""
    import zstandard

    encoder, end = word_bpe(path, KEPT), int(end_id).to_bytes(4, "little")
    shared = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False).compress
    for batch in batches:
        frames, counts = [], []
        for text in batch.column(4):
            ids = encoder.encode(text.as_py() or "") + end
            frames.append(compress(ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()))
            counts.append(len(ids) // 4)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(frames, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "size", "hash", "row", "frame", "ids"])


def _write(batches, folder: str, digest: bytes, width: int, file_bytes: int):
    """Rows (doc_id, frame, ids) in order to files."""
    writer, done = None, []
    for batch in batches:
        for doc_id, frame, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            writer = writer or _Writer(folder, digest, width)
            writer.add(doc_id, frame.as_buffer(), ids)
            if writer.at >= file_bytes:
                done.append(writer.close())
                writer = None
    if writer:
        done.append(writer.close())
    if done:
        task = TaskContext.get().partitionId()
        columns = [pa.array([x[i] for x in done]) for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), columns[0].cast(pa.string()), *(c.cast(pa.int64()) for c in columns[1:])],
            ["task", "part", "path", "n_docs", "n_ids", "first_doc", "last_doc"],
        )


MANIFEST = "task long, part long, path string, n_docs long, n_ids long, first_doc long, last_doc long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them to ``folder`` in ascending doc_id order.

    Returns the manifest: one row per file with its path, counts, doc_id range and ``start``, the
    ids in all files before it. Null text counts as empty and is written as the end id alone; a null
    doc_id sorts first; repeated doc_ids are all written, shorter texts first and equal ones next to
    each other; an empty table gives no file. Texts become frames where they lie and are written as
    such; the frames, not the texts, are then range-partitioned, by doc_id and then by text length,
    text hash and row, so rows of one id or without an id are split like any others;
    each task writes its own range, so no file or order is made in one place.
    """
    spark = docs.sparkSession
    width = 2 if word_bpe(tokenizer_path).vocab_size <= 1 << 16 and end_id < 1 << 16 else 4
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, tokenizer_path, width)
    digest = hashlib.sha256(raw).digest() if raw else bytes(32)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary-{hashlib.sha256(raw).hexdigest()}.zdict") as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)  # DICT_BYTES at most
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    frames = materialize(keyed.mapInArrow(partial(_encode, path=tokenizer_path, dictionary=shared, width=width, end_id=end_id), FRAMES), "frames")
    # Left to the session, small partitions are merged; a number is given only where the session's is too few.
    order, parts, usual = ["doc_id", "size", "hash", "row"], range_partitions(frames), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = frames.repartitionByRange(parts, *order) if parts > usual else frames.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order).select("doc_id", "frame", "ids")
    manifest = materialize(ordered.mapInArrow(partial(_write, folder=folder, digest=digest, width=width, file_bytes=file_bytes), MANIFEST), "token-manifest")
    drop_table(frames)
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class TokenFile:
    """Reads one file; ``ids(i)`` decompresses the i-th document alone."""

    def __init__(self, folder: str, path: str, dictionaries: dict[bytes, object]):
        import zstandard

        self.fs, base = _open(folder)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 36, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        digest, self.width = head[8:40], struct.unpack("<I", head[40:44])[0]
        n, at, self.total = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        index = self.file.read_at(24 * n, at)
        self.docs = np.frombuffer(index, "<i8", n, 0)
        self.ends = np.frombuffer(index, "<u8", n, 8 * n)
        self.counts = np.frombuffer(index, "<u8", n, 16 * n)
        self.begin = len(MAGIC) + 36
        if digest not in dictionaries:
            shared = None
            if any(digest):
                raw = self.fs.open_input_file(f"{base}/dictionary-{digest.hex()}.zdict").readall()
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"the dictionary of {path} has changed")
                shared = zstandard.ZstdCompressionDict(raw)
            dictionaries[digest] = zstandard.ZstdDecompressor(dict_data=shared)
        self.decompressor = dictionaries[digest]

    def bytes32(self, frame: bytes) -> bytes:
        data = self.decompressor.decompress(frame)
        return data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()

    def ids(self, i: int) -> np.ndarray:
        first = int(self.ends[i - 1]) if i else self.begin
        return np.frombuffer(self.bytes32(self.file.read_at(int(self.ends[i]) - first, first)), "<u4")

    def scan(self, block: int = 8 << 20) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, read in blocks of about ``block`` bytes."""
        i, first = 0, self.begin
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.ends, first + block, side="right")))
            data = self.file.read_at(int(self.ends[j - 1]) - first, first)
            at = 0
            for k in range(i, j):
                to = int(self.ends[k]) - first
                yield (None if self.docs[k] == NO_ID else int(self.docs[k])), self.bytes32(data[at:to])
                at = to
            i, first = j, int(self.ends[j - 1])


def _read(batches, folder: str, with_ids: bool):
    dictionaries: dict = {}
    for batch in batches:
        for path, start in zip(batch.column(0), batch.column(1), strict=True):
            at = start.as_py()
            rows: list[tuple] = []
            for doc_id, ids in TokenFile(folder, path.as_py(), dictionaries).scan():
                rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").astype(np.int64)] if with_ids else [])))
                at += len(ids) // 4
                if len(rows) == 2000:
                    yield _batch(rows, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, with_ids)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def read_token_files(manifest: DataFrame, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Read the files of a manifest: doc_id, start, n_tokens, ids_crc32, and ids on demand.

    An empty manifest gives no rows. A file whose dictionary is missing or differs from the hash in
    its head raises an error.
    """
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = manifest.count()  # one row per file; the number given keeps Spark from reading all files in one task
    spread = manifest.select("path", "start").repartition(min(max(1, files), MOST_READERS))
    return spread.mapInArrow(partial(_read, folder=folder, with_ids=with_ids), fields)


def read_documents(manifest: DataFrame, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of all documents with this id by the offset index: only its files' indexes and its frames are read."""
    out = []
    within = manifest.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for row in within.orderBy("task", "part").select("path").collect():  # one file, or those that this id fills
        file = TokenFile(folder, row.path, {})
        first, end = (int(np.searchsorted(file.docs, doc_id, side)) for side in ("left", "right"))
        out += [file.ids(i) for i in range(first, end)]
    return out


def read_document(manifest: DataFrame, folder: str, doc_id: int) -> np.ndarray | None:
    """One document's ids, the first of several with its id, or None."""
    return next(iter(read_documents(manifest, folder, doc_id)), None)


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-files")
    manifest = write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest, folder)
