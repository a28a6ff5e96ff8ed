"""Comparison tables of evaluated models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered parts of model names and what they tell.
SIZES = [("14b", 14.0), ("9b", 9.0), ("8b", 8.0), ("7b", 7.0), ("4b", 4.0), ("3b", 3.0), ("2b", 2.0), ("1.5b", 1.5), ("1b", 1.0), ("0.5b", 0.5), ("large", 0.8), ("medium", 0.35), ("xl", 1.5), ("gpt2", 0.12)]
FAMILIES = [("sea-lion", "SEA-LION"), ("qwen", "Qwen"), ("llama", "LLaMA"), ("gemma", "Gemma"), ("gpt2", "GPT-2")]


def _first_part(name: Column, table: list[tuple[str, object]], default: object) -> Column:
    out = F.lit(default)
    for part, value in reversed(table):
        out = F.when(F.lower(name).contains(part), F.lit(value)).otherwise(out)
    return out


def model_size(name: Column) -> Column:
    """Billions of parameters by the name; 1.0 if it does not tell. ``1.5b`` and ``0.5b`` are read before ``5b``-like parts."""
    return F.when(F.lower(name).contains("1.5b"), 1.5).when(F.lower(name).contains("0.5b"), 0.5).otherwise(_first_part(name, SIZES, 1.0))


def model_family(name: Column) -> Column:
    return _first_part(name, FAMILIES, "Other")


def is_instruct(name: Column) -> Column:
    return F.lower(name).contains("-it")


def best_score(metrics: Column) -> Column:
    """Percent of contains-matches if there is one, else of accuracy, of a map of metrics."""
    return 100.0 * F.coalesce(F.element_at(metrics, "contains_match_accuracy"), F.element_at(metrics, "accuracy"))


def long_scores(summaries: DataFrame) -> DataFrame:
    """``summaries`` (model, benchmarks: map of maps) -> (model, benchmark, score)."""
    each = summaries.select("model", F.explode("benchmarks").alias("benchmark", "metrics"))
    return each.select("model", "benchmark", F.round(best_score(F.col("metrics")), 6).alias("score"))


def wide_scores(scores: DataFrame, benchmarks: list[str]) -> DataFrame:
    """One column a benchmark, and the mean of those that a model has."""
    wide = scores.groupBy("model").pivot("benchmark", benchmarks).agg(F.first("score"))
    have = F.filter(F.array(*[F.col(f"`{b}`") for b in benchmarks]), lambda x: x.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(have), F.lit(0))
    return wide.withColumn("mean_score", F.round(mean, 6))


def top_models(wide: DataFrame, n: int, by: str = "mean_score") -> DataFrame:
    return wide.orderBy(F.desc_nulls_last(by), "model").limit(n)


def family_means(scores: DataFrame) -> DataFrame:
    """Mean score of each family and benchmark."""
    return scores.groupBy(model_family(F.col("model")).alias("family"), "benchmark").agg(F.count("*").alias("n_models"), F.round(F.avg("score"), 6).alias("mean_score"))
