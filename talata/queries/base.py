"""The registry, and the derived tables that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: The distinct lower-case words of all documents, in DuckDB SQL.
WORDS_SQL = f"(SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents))"


def query(sql: str | None = None):
    """Register a query under its function's name, with the DuckDB SQL of its result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as it is written."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), F.lit(1))).alias("w"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lower-case words of all documents."""
    return raw_words(spark, sf_dir).select(F.lower("w").alias("word")).distinct()


def number_sql(text: str) -> str:
    """The seeded number of ``talata.functions.seeded`` in DuckDB SQL."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
