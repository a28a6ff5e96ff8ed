"""Writers: JSON lines, chunks, and binary id files that the executors write and read in parts."""

from __future__ import annotations

import json
import struct
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import pad_truncate
from .idfiles import DTYPES, INDEX_CODES, INDEX_MAGIC, INDEX_VERSION, FlatIds, IndexedIds, Opener, opened, read_files


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_jsonl(df: DataFrame, path: str, *, mode: str = "error", by: list[str] = ()) -> None:  # noqa: B006
    """JSON lines in UTF-8, a part for each task; ``by`` makes a folder for each value. Sorted rows are read back in order by ``readers.in_file_order``."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


MANIFEST = "_manifest"


def manifest(spark: SparkSession, path: str, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """(``by`` columns, n_rows) of the partitions at ``path`` that are whole; none if there is no manifest yet."""
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n_rows LONG"])
    where = f"{path.rstrip('/')}/{MANIFEST}"
    return spark.read.schema(schema).json(where) if exists(spark, where) else spark.createDataFrame([], schema)


def write_partitions(df: DataFrame, path: str, by: list[str], *, jobs: int = 1) -> DataFrame:
    """JSON lines in a folder for each value of ``by``; what the manifest has already is skipped. Returns the manifest.

    Missing partitions are written in ``jobs`` jobs, each replacing its own folders as a whole and
    then entering them in the manifest. So a run that broke off goes on: what a broken job left has
    no entry and is replaced, and whole partitions stay as they are. Values of ``by`` are not null.
    """
    from ..working import materialize

    spark, kinds = df.sparkSession, dict(df.dtypes)
    done = materialize(manifest(spark, path, by, kinds).select(*by).distinct(), "whole-partitions")
    todo = df.join(done, by, "left_anti")
    for i in range(jobs):
        part = todo.where(F.pmod(F.xxhash64(*by), F.lit(jobs)) == i) if jobs > 1 else todo
        part = materialize(part, "partitions")  # counted as it is written
        if not part.isEmpty():
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)
            part.groupBy(*by).agg(F.count("*").alias("n_rows")).write.mode("append").json(f"{path.rstrip('/')}/{MANIFEST}")
    return manifest(spark, path, by, kinds)


def read_partitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at ``path`` of whole partitions and others; the schema names the columns of ``by`` too."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A header in every part; quotes are doubled, so texts with commas, quotes and line ends come back."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_unless_there(df: DataFrame, path: str) -> bool:
    """Parquet at ``path`` unless it is there already; whether it was written."""
    if exists(df.sparkSession, path):
        return False
    df.write.parquet(path)
    return True


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written on first use."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write_chunks(df: DataFrame, path: str, text: Column, chunk: str = "chunk_id") -> None:
    """One folder of text for each chunk id."""
    df.select(F.col(chunk), text.alias("value")).write.partitionBy(chunk).text(path)


def text_of(df: DataFrame, field: str) -> Column:
    """``field`` if there is one, else question, prompt, or the row as JSON."""
    named = [F.col(f"`{c}`").cast("string") for c in dict.fromkeys([field, "question", "prompt"]) if c in df.columns]
    return F.coalesce(*named, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def _values(x, dtype: str) -> np.ndarray:
    limits = np.iinfo(DTYPES[dtype])
    values = np.asarray(x.values if x.is_valid else [], dtype=np.int64)
    if len(values) and (values.min() < limits.min or values.max() > limits.max):
        raise ValueError(f"ids do not fit {dtype}")
    return values


def _write(batches, folder: str, name: str, dtype: str, opener: Opener | None):
    """The task's rows as one file; its path is a URI as the folder is one, so tasks anywhere can read it."""
    task = TaskContext.get().partitionId()
    path = f"{folder.rstrip('/')}/{name}-{task:06d}-{uuid.uuid4().hex}.bin"
    rows = ids = 0
    out = None
    for batch in batches:
        for x in batch.column(0):
            values = _values(x, dtype)
            if out is None:
                system, there = opened(path, opener)
                out = system.open_output_stream(there)
            out.write(values.astype(DTYPES[dtype]).tobytes())
            rows, ids = rows + 1, ids + len(values)
    if out:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([path]), pa.array([rows], pa.int64()), pa.array([ids], pa.int64())], ["task", "path", "n_rows", "n_ids"])


def _qualified(spark: SparkSession, folder: str, opener: Opener | None) -> str:
    """A folder without a scheme is on the session's default file system, as it is for Spark."""
    if opener or "://" in folder:
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def _make(folder: str, opener: Opener | None):
    system, base = opened(folder, opener)
    system.create_dir(base, recursive=True)
    return system, base.rstrip("/")


def write_ids(df: DataFrame, folder: str, ids: str, *order: str, name: str = "ids", dtype: str = "uint16", opener: Opener | None = None) -> dict:
    """Ids of all rows in order as headerless binary parts; the metadata is returned and written beside them.

    The parts follow each other by name, so their concatenation is one flat array. The driver sees
    one metadata row a part.
    """
    folder = _qualified(df.sparkSession, folder, opener)
    system, base = _make(folder, opener)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(ids)
    parts = placed.mapInArrow(partial(_write, folder=folder, name=name, dtype=dtype, opener=opener), "task long, path string, n_rows long, n_ids long").collect()
    parts = sorted(parts, key=lambda r: r.task)
    meta = {"dtype": dtype, "n_rows": sum(p.n_rows for p in parts), "n_ids": sum(p.n_ids for p in parts), "parts": [p.path for p in parts]}
    with system.open_output_stream(f"{base}/{name}_metadata.json") as f:
        f.write(json.dumps(meta).encode())
    return meta


def write_padded(df: DataFrame, folder: str, ids: str, *order: str, length: int | None = None, pad: int = 0, name: str = "ids", dtype: str = "uint16", opener: Opener | None = None) -> dict:
    """A matrix of ids: every row cut or padded to ``length``, or to the longest row."""
    n = length if length is not None else (df.agg(F.max(F.size(ids))).first()[0] or 0)
    meta = write_ids(df.withColumn("_row", pad_truncate(F.col(ids), n, pad)), folder, "_row", *order, name=name, dtype=dtype, opener=opener)
    return meta | {"shape": [meta["n_rows"], n]}


def _write_indexed(batches, folder: str, name: str, dtype: str, end_id: int | None, opener: Opener | None):
    task = TaskContext.get().partitionId()
    prefix = f"{folder.rstrip('/')}/{name}-{task:06d}-{uuid.uuid4().hex}"
    system, there = opened(prefix, opener)
    sizes, out = [], None
    for batch in batches:
        for x in batch.column(0):
            values = _values(x, dtype)
            if end_id is not None:
                values = np.append(values, end_id)
            out = out or system.open_output_stream(f"{there}.bin")
            out.write(values.astype(DTYPES[dtype]).tobytes())
            sizes.append(len(values))
    if out:
        out.close()
        lengths = np.array(sizes, dtype="<i4")
        places = (np.cumsum(lengths, dtype=np.int64) - lengths) * np.dtype(DTYPES[dtype]).itemsize
        with system.open_output_stream(f"{there}.idx") as f:
            f.write(INDEX_MAGIC + struct.pack("<QBQQ", INDEX_VERSION, INDEX_CODES[dtype], len(sizes), len(sizes) + 1))
            f.write(lengths.tobytes() + places.astype("<i8").tobytes() + np.arange(len(sizes) + 1, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([prefix]), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["task", "prefix", "n_rows", "n_ids"])


def write_indexed(df: DataFrame, folder: str, ids: str, *order: str, name: str = "text_document", dtype: str = "uint16", end_id: int | None = None, opener: Opener | None = None) -> list[str]:
    """Indexed training files: a pair prefix.bin and prefix.idx for each range of rows; the prefixes in order.

    Each row is one document of one sequence, with ``end_id`` after it if given; null ids are an
    empty one. The driver sees one row a pair. A blend takes all prefixes.
    """
    folder = _qualified(df.sparkSession, folder, opener)
    _make(folder, opener)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(ids)
    parts = placed.mapInArrow(partial(_write_indexed, folder=folder, name=name, dtype=dtype, end_id=end_id, opener=opener), "task long, prefix string, n_rows long, n_ids long").collect()
    return [p.prefix for p in sorted(parts, key=lambda r: r.task)]


def read_indexed(spark: SparkSession, prefixes: list[str], *, opener: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """(part, row, ids) of the pairs of files that ``write_indexed`` made; many tasks read one pair."""
    return read_files(spark, IndexedIds, prefixes, opener=opener, splitbytes=split_bytes)


def _convert(batches, folder: str, dtype: str, opener: Opener | None):
    """Rows (file, ids) in order, each file's together: a part for each file that the task has rows of."""
    task, made, open_, current = TaskContext.get().partitionId(), [], None, None
    for batch in batches:
        for file, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if file != current:
                if open_:
                    open_.close()
                path = f"{folder.rstrip('/')}/{file.rsplit('/', 1)[1].rsplit('.', 1)[0]}/ids-{task:06d}-{uuid.uuid4().hex}.bin"
                system, there = opened(path, opener)
                system.create_dir(there.rsplit("/", 1)[0], recursive=True)
                open_, current = system.open_output_stream(there), file
                made.append([file, task, path, 0, 0, 0])
            values = _values(x, dtype)
            open_.write(values.astype(DTYPES[dtype]).tobytes())
            last = made[-1]
            last[3:] = last[3] + 1, last[4] + len(values), max(last[5], len(values))
    if open_:
        open_.close()
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], ["file", "task", "path", "n_rows", "n_ids", "longest"])


def convert_files(spark: SparkSession, pattern: str, folder: str, encode, *, field: str = "question", dtype: str = "uint16", opener: Opener | None = None) -> DataFrame:
    """Every JSON-lines file of ``pattern`` as binary ids in a folder of its own, in one scan and one write.

    ``encode`` is a column function from text to ids; a line's text is ``field``, else question, else
    prompt, else the line. Returns file, n_rows, n_ids, longest (ids of a row), parts in order,
    n_failed and reason: a line that is no JSON, or whose ids do not fit ``dtype``, is left out and
    counted for its file. Files of one name in several folders need folders of their own.
    """
    from ..working import materialize

    folder = _qualified(spark, folder, opener)
    lines = spark.read.text(pattern, recursiveFileLookup=True).where("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    names = list(dict.fromkeys([field, "question", "prompt"]))
    fields = ", ".join(f"`{n}` STRING" for n in names)
    parsed = lines.withColumn("row", F.from_json("value", f"{fields}, `_bad line` STRING", {"columnNameOfCorruptRecord": "_bad line"}))
    text = F.coalesce(*[F.col("row").getField(n) for n in names], F.col("value"))
    whole = F.col("row").isNotNull() & F.col("row").getField("_bad line").isNull()
    encoded = parsed.select("file", "block", "at", whole.alias("whole"), F.when(whole, encode(text)).alias("ids"))
    limits = np.iinfo(DTYPES[dtype])
    fits = F.coalesce(F.forall("ids", lambda x: x.between(int(limits.min), int(limits.max))), F.lit(True))
    reason = F.when(~F.col("whole"), "no JSON").when(~fits, f"ids do not fit {dtype}")
    checked = materialize(encoded.select("file", "block", "at", "ids", reason.alias("reason")), "encoded-lines")
    placed = checked.where("reason IS NULL").repartitionByRange("file", "block", "at").sortWithinPartitions("file", "block", "at").select("file", "ids")
    parts = materialize(placed.mapInArrow(partial(_convert, folder=folder, dtype=dtype, opener=opener), "file string, task long, path string, n_rows long, n_ids long, longest long"), "converted-parts")
    good = parts.groupBy("file").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"), F.max("longest").alias("longest"), F.transform(F.array_sort(F.collect_list(F.struct("task", "path"))), lambda p: p["path"]).alias("parts"))
    bad = checked.groupBy("file").agg(F.count("reason").alias("n_failed"), F.min("reason").alias("reason"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return bad.join(good, "file", "left").select("file", zero("n_rows"), zero("n_ids"), zero("longest"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"), "n_failed", "reason")


def convert_folder(spark: SparkSession, pattern: str, folder: str, encode, *, field: str = "question", dtype: str = "uint16") -> dict[str, dict | str]:
    """``convert_files`` for as many files as a driver lists: file name -> metadata, or why lines of it failed."""
    if not spark._jvm.org.apache.hadoop.fs.Path(pattern).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)):
        return {}
    made = convert_files(spark, pattern, folder, encode, field=field, dtype=dtype).collect()
    return {r.file.rsplit("/", 1)[1]: f"{r.n_failed} lines: {r.reason}" if r.n_failed else {"dtype": dtype, "n_rows": r.n_rows, "n_ids": r.n_ids, "longest": r.longest, "parts": r.parts} for r in made}


def stamped(name: Column, moment: Column) -> Column:
    """A file name with its moment: name_20240131_235959."""
    return F.concat(name, F.lit("_"), F.date_format(moment, "yyyyMMdd_HHmmss"))


def read_ids(spark: SparkSession, parts: list[str], *, width: int = 1, dtype: str = "uint16", opener: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """(part, row, ids): rows of ``width`` ids of binary parts; many tasks read one part."""
    return read_files(spark, FlatIds, parts, width=width, dtype=dtype, opener=opener, splitbytes=split_bytes)
