"""Profiles of prediction rows by level, their cascades and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.6


def profile(rows: DataFrame, correct: Column, *group: str) -> DataFrame:
    """n_total, n_correct, accuracy by group."""
    hit = F.coalesce(correct.cast("int"), F.lit(0))
    return rows.select(*group, hit.alias("_hit")).groupBy(*group).agg(
        F.count("*").alias("n_total"), F.sum("_hit").alias("n_correct"), F.round(F.avg("_hit"), 6).alias("accuracy")
    )


def mean_over_ranks(values: DataFrame, value: str, rank: str, *group: str) -> DataFrame:
    """The sum of all values over the number of ranks (workers) that gave one, by group: the mean loss of a step."""
    return values.groupBy(*group).agg((F.sum(value) / F.count_distinct(rank)).alias("mean"), F.count_distinct(rank).alias("n_ranks"))


def failure_cascade(levels: DataFrame, level: str = "level", threshold: float = THRESHOLD) -> DataFrame:
    """Neighbouring levels where the lower is under the threshold and the next is not better.

    ``levels`` is a profile: one row a level, so its one window is as small as that.
    """
    w = Window.orderBy(level)
    nxt = levels.select(F.col(level).alias("from_level"), F.col("accuracy").alias("from_accuracy"), F.lead(level).over(w).alias("to_level"), F.lead("accuracy").over(w).alias("to_accuracy"))
    return nxt.where(F.col("to_level").isNotNull() & (F.col("from_accuracy") < threshold) & (F.col("to_accuracy") <= F.col("from_accuracy")))


def level_dependencies(levels: DataFrame, level: str = "level") -> DataFrame:
    """accuracy_i / (accuracy_j + 1e-6) for each pair of levels j < i of a profile."""
    a = levels.select(F.col(level).alias("level_i"), F.col("accuracy").alias("_i"))
    b = levels.select(F.col(level).alias("level_j"), F.col("accuracy").alias("_j"))
    return a.join(F.broadcast(b), F.col("level_j") < F.col("level_i")).select("level_i", "level_j", F.round(F.col("_i") / (F.col("_j") + 1e-6), 6).alias("ratio"))


def compare_two(a: DataFrame, b: DataFrame, level: str = "level", significant: float = 0.05) -> DataFrame:
    """Accuracies of two profiles by common level, their difference and whether it is significant."""
    left = a.select(level, F.col("accuracy").alias("accuracy_a"))
    both = left.join(b.select(level, F.col("accuracy").alias("accuracy_b")), level)
    d = F.round(F.col("accuracy_b") - F.col("accuracy_a"), 6)
    return both.select(level, "accuracy_a", "accuracy_b", d.alias("difference"), (F.abs(d) > significant).alias("significant"))


def compare_many(profiles: DataFrame, models: list[str], level: str = "level") -> DataFrame:
    """One row a level over the union of levels: a column for each model, best, worst and range."""
    wide = profiles.groupBy(level).pivot("model", models).agg(F.first("accuracy"))
    scored = F.filter(F.array(*[F.struct(F.col(f"`{m}`").alias("a"), F.lit(m).alias("m")) for m in models]), lambda s: s["a"].isNotNull())
    top, low = F.array_max(F.transform(scored, lambda s: s["a"])), F.array_min(F.transform(scored, lambda s: s["a"]))
    first = lambda value: F.get(F.filter(scored, lambda s: s["a"] == value), F.lit(0))["m"]
    return wide.select(level, *[F.col(f"`{m}`") for m in models], first(top).alias("best_model"), first(low).alias("worst_model"), F.round(top - low, 6).alias("accuracy_range"))


def best_and_worst(levels: DataFrame, level: str = "level") -> DataFrame:
    """The levels with the greatest and the least accuracy; the least level on ties."""
    rank = lambda sign: F.struct((sign * F.col("accuracy")).alias("a"), F.col(level).alias("l"))
    return levels.agg(F.min_by(level, rank(-1)).alias("best_level"), F.min_by(level, rank(1)).alias("worst_level"))


def failures(rows: DataFrame, correct: Column, n: int, group: list[str], *order: str) -> DataFrame:
    """The first ``n`` wrong rows of each group."""
    from .ordering import first_per_group

    return first_per_group(rows.where(~F.coalesce(correct.cast("boolean"), F.lit(False))), n, group, *order)


def export(levels: DataFrame, parts: DataFrame, samples: DataFrame, level: str = "level") -> DataFrame:
    """One JSON document a level: its profile, subprofile and sample failures."""
    sub = parts.groupBy(level).agg(F.array_sort(F.collect_list(F.struct(*[c for c in parts.columns if c != level]))).alias("subprofile"))
    bad = samples.groupBy(level).agg(F.array_sort(F.collect_list(F.struct(*[c for c in samples.columns if c != level]))).alias("failures"))
    rows = levels.join(sub, level, "left").join(bad, level, "left")
    return rows.select(level, F.to_json(F.struct(*[c for c in rows.columns])).alias("document"))
