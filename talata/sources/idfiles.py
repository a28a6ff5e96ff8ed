"""Binary id files as Spark data sources: byte ranges are partitions, and row ranges are pushed down.

Paths are URIs of any file system that pyarrow opens, or that a given opener does; they are kept as
they are given. ``flat`` files are rows of ``width`` ids each, without a head. ``indexed`` files are
pairs prefix.bin and prefix.idx; the head of an index tells how many rows it has, and a task reads the
part of the index that its rows need.
"""

from __future__ import annotations

import importlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

DTYPES = {"uint16": np.uint16, "uint32": np.uint32, "int32": np.int32}
#: Codes of id types in the index files of training sets. Fixed values of that format, as its magic and version are.
INDEX_MAGIC, INDEX_VERSION = b"MMIDIDX\0\0", 1
INDEX_CODES = {"int32": 4, "uint16": 8}
HEAD = len(INDEX_MAGIC) + 25
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SCHEMA = "part LONG, row LONG, ids ARRAY<INT>"

Opener = Callable[[str], tuple]


def opened(uri: str, opener: str | Opener | None = None) -> tuple:
    """The file system of a URI and the path in it. ``opener`` does it for other schemes: a function, or its "module:name"."""
    from pyarrow import fs

    if isinstance(opener, str) and opener:
        module, _, name = opener.partition(":")
        opener = getattr(importlib.import_module(module), name)
    if opener:
        return opener(uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Range(InputPartition):
    def __init__(self, part: int, path: str, first: int, end: int):
        super().__init__((part, first))
        self.part, self.path, self.first, self.end = part, path, first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.opener = json.loads(options["paths"]), options.get("opener", "")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.limits = {"part": [0, len(self.paths)], "row": [int(options.get("firstrow", 0)), int(options.get("endrow", 1 << 62))]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Comparisons of part and row with a number narrow what is read; all others are Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.limits or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            limits = self.limits[name]
            if isinstance(f, EqualTo):
                self.limits[name] = [max(limits[0], f.value), min(limits[1], f.value + 1)]
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                limits[0] = max(limits[0], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                limits[1] = min(limits[1], f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def size_of(self, path: str) -> tuple[int, int]:
        """Rows of a file, and bytes of a row on average."""
        raise NotImplementedError

    def partitions(self) -> list[Range]:
        """One for each SPLIT_BYTES of what is wanted; the driver sees a file's length alone."""
        out = []
        for part in range(max(0, self.limits["part"][0]), min(len(self.paths), self.limits["part"][1])):
            rows, each = self.size_of(self.paths[part])
            first, end = max(0, self.limits["row"][0]), min(rows, self.limits["row"][1])
            step = max(1, self.split // max(1, each))
            out += [Range(part, self.paths[part], i, min(i + step, end)) for i in range(first, end, step)]
        return out or [Range(0, "", 0, 0)]


def _rows(part: int, first: int, ids: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(first, first + n)), ids], ["part", "row", "ids"])


class FlatReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.dtype, self.width = options.get("dtype", "uint16"), int(options.get("width", 1))

    def size_of(self, path: str) -> tuple[int, int]:
        system, name = opened(path, self.opener)
        each = np.dtype(DTYPES[self.dtype]).itemsize * self.width
        size = system.get_file_info(name).size
        if size % each:
            raise ValueError(f"{path}: {size} bytes are no rows of {self.width} {self.dtype}")
        return size // each, each

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kind, width = np.dtype(DTYPES[self.dtype]), self.width
        system, name = opened(partition.path, self.opener)
        step = max(1, BATCH_BYTES // (kind.itemsize * width))
        with system.open_input_file(name) as f:
            for i in range(partition.first, partition.end, step):
                n = min(step, partition.end - i)
                values = np.frombuffer(f.read_at(n * width * kind.itemsize, i * width * kind.itemsize), kind).astype(np.int32)
                yield _rows(partition.part, i, pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values)))


class IndexedReader(_Reader):
    def _head(self, f, path: str) -> tuple[np.dtype, int]:
        raw = f.read_at(HEAD, 0)
        if raw[: len(INDEX_MAGIC)] != INDEX_MAGIC:
            raise ValueError(f"{path}.idx is no index of training files")
        _, code, n, _ = struct.unpack("<QBQQ", raw[len(INDEX_MAGIC) :])
        return {code: np.dtype(DTYPES[name]) for name, code in INDEX_CODES.items()}[code], n

    def size_of(self, path: str) -> tuple[int, int]:
        system, prefix = opened(path, self.opener)
        with system.open_input_file(f"{prefix}.idx") as f:
            n = self._head(f, path)[1]
        return n, -(-system.get_file_info(f"{prefix}.bin").size // max(1, n)) + 12

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, prefix = opened(partition.path, self.opener)
        with system.open_input_file(f"{prefix}.idx") as index, system.open_input_file(f"{prefix}.bin") as data:
            kind, n = self._head(index, partition.path)
            for i in range(partition.first, partition.end, 1000):
                some = min(1000, partition.end - i)
                sizes = np.frombuffer(index.read_at(4 * some, HEAD + 4 * i), "<i4")
                places = np.frombuffer(index.read_at(8 * some, HEAD + 4 * n + 8 * i), "<i8")
                rows = [np.frombuffer(data.read_at(int(s) * kind.itemsize, int(p)), kind).astype(np.int32) for s, p in zip(sizes, places, strict=True)]
                yield _rows(partition.part, i, pa.array(rows, pa.list_(pa.int32())))


class FlatIds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "talata_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FlatReader(self.options)


class IndexedIds(FlatIds):
    @classmethod
    def name(cls) -> str:
        return "talata_indexed_ids"

    def reader(self, schema) -> DataSourceReader:
        return IndexedReader(self.options)


def read_files(spark: SparkSession, source: type[DataSource], paths: list[str], **options) -> DataFrame:
    """(part, row, ids) of the files; ``where`` on part and row narrows the ranges that are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(paths=json.dumps(paths), **{k: v for k, v in options.items() if v is not None}).load()
