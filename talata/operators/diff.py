"""Row-level comparison of tokenized data sets, joined on a row key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_statistics(df: DataFrame, length: Column, *group: str) -> DataFrame:
    """Rows, mean, population standard deviation, least, greatest and median length."""
    return df.select(*group, length.alias("_n")).groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("_n"), 6).alias("mean_len"),
        F.round(F.stddev_pop("_n"), 6).alias("std_len"),
        F.min("_n").alias("min_len"),
        F.max("_n").alias("max_len"),
        F.median("_n").cast("double").alias("median_len"),
    )


def row_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many rows with a common key have the same value, how many differ, and percents."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    same = F.count_if(F.col("_a").eqNullSafe(F.col("_b")))
    n = F.count("*")
    percent = lambda x: F.round(F.coalesce(100.0 * x / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    return both.agg(n.alias("n_rows"), same.alias("same"), (n - same).alias("different"), percent(same).alias("percent_same"), percent(n - same).alias("percent_different"))


def three_way_overlap(a: DataFrame, b: DataFrame, c: DataFrame, key: str, value: str) -> DataFrame:
    """One row of counts: all equal, only two of the three equal (three kinds), none equal."""
    sides = [x.select(key, F.col(value).alias(f"_{n}")) for n, x in zip("abc", (a, b, c), strict=True)]
    rows = reduce(lambda x, y: x.join(y, key), sides)
    ab, ac, bc = (F.col(f"_{x}").eqNullSafe(F.col(f"_{y}")) for x, y in ("ab", "ac", "bc"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(ab & ac).alias("all_equal"),
        F.count_if(ab & ~ac).alias("only_ab"),
        F.count_if(ac & ~ab).alias("only_ac"),
        F.count_if(bc & ~ab).alias("only_bc"),
        F.count_if(~ab & ~ac & ~bc).alias("none_equal"),
    )


def token_totals(df: DataFrame, original: Column, expanded: Column) -> DataFrame:
    """Sums of two lengths and their ratio, null for no original tokens."""
    a, b = F.sum(original), F.sum(expanded)
    return df.agg(a.alias("original_tokens"), b.alias("expanded_tokens"), F.round(b / F.nullif(a, F.lit(0)), 6).alias("ratio"))
