"""Readers: explicit schemas, bad records kept apart, and the newest file of each model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..working import materialize
from . import schemas

#: Affixes that a decomposition starts from when no list is given. Fixed values.
DEFAULT_AFFIXES = ["um", "in", "an", "mag", "nag", "pag", "ka", "ma", "na", "pa", "i"]


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a line; a line that does not parse gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str | list[str], key: str = "text") -> DataFrame:
    """Documents with a non-empty text; bad lines and empty texts are left out."""
    rows = spark.read.schema(f"`{key}` STRING, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & (F.length(F.col(f"`{key}`")) > 0)).select(F.col(f"`{key}`").alias("text"))


def bad_lines(spark: SparkSession, path: str | list[str], key: str = "text") -> DataFrame:
    """The lines that ``corpus`` leaves out because they do not parse."""
    parsed = F.from_json("value", f"`{key}` STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(parsed["_bad"].isNotNull()).select(F.col("value").alias("line"))


def in_file_order(df: DataFrame, name: str = "position") -> DataFrame:
    """Rows just read from files, with a value that rises in order of file names and lines."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))


def annotations(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Morpheme annotations, the first ``limit`` lines if given."""
    rows = jsonl(spark, path, schemas.ANNOTATIONS)
    return rows if limit is None else in_file_order(rows).orderBy("position").limit(limit).drop("position")


def newest_per_model(spark: SparkSession, pattern: str, schema: str, *, excluded: str = "benchmark_evaluation") -> DataFrame:
    """The newest JSON document of each folder under ``pattern`` with its model (the folder's name)."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    rows = rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("model"), F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_path"))
    newest = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("_time"), F.desc("_path")))
    return rows.where(F.col("model") != excluded).withColumn("_newest", newest).where("_newest = 1").drop("_newest", "_time", "_path")


def newest_file(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All rows of the newest file that matches ``pattern``."""
    rows = spark.read.schema(schema).json(pattern).select("*", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p")).alias("_file"))
    newest = rows.agg(F.max("_file").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("_file") == F.col("_newest")).drop("_file", "_newest")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with at least ``normalized`` and ``rank``; others are an error."""
    rows = spark.read.option("header", True).csv(path)
    require_columns(rows, ["normalized", "rank"])
    return rows.withColumn("rank", F.col("rank").cast("int"))


def inflections(spark: SparkSession, path: str) -> DataFrame:
    """Inflections as a spreadsheet, CSV or JSON lines."""
    if path.endswith(".xlsx"):
        rows = spreadsheet(spark, path)
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c in {f.split()[0] for f in schemas.INFLECTIONS.split(", ")}])
    return jsonl(spark, path, schemas.INFLECTIONS) if path.endswith((".jsonl", ".json")) else spark.read.option("header", True).schema(schemas.INFLECTIONS).csv(path)


def _column_number(place: str) -> int:
    """AB12 -> 27: the column of a cell from 0."""
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The rows of one sheet of an .xlsx file as texts: shared and inline strings, numbers and booleans as stored."""
    import io
    import zipfile
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if local(e) != "row":
                    continue
                row: list[str | None] = []
                for i, cell in enumerate(c for c in e if local(c) == "c"):
                    at = _column_number(cell.get("r", "")) if cell.get("r") else i
                    value = next((v.text for v in cell if local(v) == "v"), None)
                    kind = cell.get("t")
                    said = text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                    row += [None] * (at + 1 - len(row))
                    row[at] = said if said != "" else None
                yield row
                e.clear()


def _sheet(batches, sheet: int):
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = list(enumerate(sheet_rows(data.as_py(), sheet)))
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([r for _, r in part], pa.list_(pa.string()))], ["path", "row", "cells"])


def spreadsheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """One sheet of each .xlsx file of ``path``, its first row as column names and all values as text.

    A file is read by one task, as its rows are one compressed stream. Files with other headers than
    the first one's are an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = materialize(files.mapInArrow(partial(_sheet, sheet=sheet), "path string, row long, cells array<string>"), "sheet")
    headers = [r.cells for r in rows.where("row = 0").select("cells").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"the files of {path} have different headers")
    names = headers[0] if headers else []
    return rows.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names) if n])


def affix_list(spark: SparkSession, path: str, kind: str, *, keep_hyphens: bool = True) -> DataFrame:
    """(affix, affix_type) of the non-blank lines."""
    value = F.trim("value") if keep_hyphens else F.replace(F.trim("value"), F.lit("-"), F.lit(""))
    return spark.read.text(path).select(value.alias("affix"), F.lit(kind).alias("affix_type")).where("affix <> ''")


def default_affixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in DEFAULT_AFFIXES], "affix STRING")


def word_list(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    words = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    if expected is not None and (n := words.count()) != expected:
        raise ValueError(f"{path} has {n} words, not {expected}")
    return words


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id) from parquet."""
    rows = spark.read.parquet(path)
    require_columns(rows, ["token", "token_id"])
    return rows.select(F.col("token").cast("binary").alias("token"), F.col("token_id").cast("int").alias("token_id"))


def bpe_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id) from a file of lines ``base64 rank``."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.length("value") > 0)
    return rows.select(F.unbase64(F.get(parts, F.lit(0))).alias("token"), F.get(parts, F.lit(1)).cast("int").alias("token_id"))


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    require_columns(rows, ["ids"])
    return rows


def model_configs(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """(name, path, type) from a parsed configuration ``name -> {path, type}``."""
    rows = [(name, m["path"], m.get("type", "pt")) for name, m in sorted(models.items())]
    return spark.createDataFrame(rows, "name STRING, path STRING, type STRING")


def prefix_pairs(spark: SparkSession, pattern: str, expected: list[str]) -> DataFrame:
    """One row for each expected prefix: whether its .bin and .idx exist, and their bytes."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\.(bin|idx)$", 1)
    found = files.where(F.col("path").rlike(r"\.(bin|idx)$")).groupBy(name.alias("prefix")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    want = spark.createDataFrame([(e,) for e in expected], "prefix STRING")
    return want.join(found, "prefix", "left").select("prefix", (F.coalesce("n_files", F.lit(0)) == 2).alias("complete"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def chunk_paths(folder: str, n: int, tokenizer: str, form: str = "chunk_%04d") -> list[str]:
    return [f"{folder}/{form % i}_{tokenizer}" for i in range(n)]


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_range(name: str, value: float, least: float, most: float) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} is {value}, not from {least} to {most}")
