"""What the operators share: working tables in the cluster's shared folder and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..working import drop_table, materialize, new_path, shared_dir  # noqa: F401  (the operators' working tables)


def range_partitions(df: DataFrame, bytes_each: int = 512 << 20) -> int:
    """Partitions for a shuffle of all of ``df``: the session's number, and more where its files are larger than that can hold."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-min(size, 1 << 50) // bytes_each))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
