"""Multiple-choice and generative scores from exported model outputs.

Confidences are arrays whose first entry is the true answer's; shorter ones are padded with PADDING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PADDING = -1e10
EPSILON = 1e-10


def padded(confidences: Column, width: Column | int) -> Column:
    n = F.lit(width) if isinstance(width, int) else width
    return F.concat(confidences, F.array_repeat(F.lit(PADDING), F.greatest(n - F.size(confidences), F.lit(0))))


def is_first_best(confidences: Column) -> Column:
    """Whether the first entry is the greatest; it wins ties."""
    return F.array_position(confidences, F.array_max(confidences)) == 1


def predicted_index(confidences: Column) -> Column:
    return (F.array_position(confidences, F.array_max(confidences)) - 1).cast("int")


def first_softmax(confidences: Column) -> Column:
    top = F.array_max(confidences)
    return F.exp(F.get(confidences, F.lit(0)) - top) / F.aggregate(confidences, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def normalized(value: Column, options: Column) -> Column:
    """(v * N - 1) / (N - 1): 0 at chance, 1 at best; null for one option."""
    return (value * options - 1) / F.nullif(options - 1, F.lit(0))


def metric_columns(confidences: str) -> dict[str, Column]:
    """The registry of aggregates by metric name."""
    c = F.col(confidences)
    hit = is_first_best(c).cast("double")
    n = F.max(F.size(c))
    accuracy, path = F.avg(hit), F.avg(first_softmax(c))
    right, wrong = F.sum(hit), F.sum(1.0 - hit)
    precision, recall = right / (right + EPSILON), right / (right + wrong + EPSILON)
    return {
        "accuracy": accuracy,
        "path_confidence": path,
        "ground_confidence": F.avg(F.get(c, F.lit(0))),
        "num_options": n.cast("bigint"),
        "normalized_accuracy": normalized(accuracy, n),
        "normalized_path_confidence": normalized(path, n),
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / (precision + recall + EPSILON),
    }


def calculate_metrics(rows: DataFrame, confidences: str = "confidences", *group: str, digits: int = 6) -> DataFrame:
    """All metrics in one aggregation; confidences must be equally long within a group (see ``padded``)."""
    made = [(c if n == "num_options" else F.round(c, digits)).alias(n) for n, c in metric_columns(confidences).items()]
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), *made)


def match_flags(generated: Column, truth: Column) -> Column:
    """exact, contains, prefix of trimmed, lower-cased strings."""
    g, t = F.lower(F.trim(generated)), F.lower(F.trim(truth))
    return F.struct((g == t).alias("exact_match"), g.contains(t).alias("contains_match"), g.startswith(t).alias("prefix_match"))


def match_bucket(exact: Column, contains: Column, prefix: Column) -> Column:
    """One bucket a row. A prefix match is also a contains match, so its own bucket stays empty."""
    return F.when(exact, "exact").when(contains, "contains").when(prefix, "prefix").otherwise("none")


def generative_accuracy(rows: DataFrame, *group: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return rows.groupBy(*group).agg(
        F.count("*").alias("n_rows"), rate("exact_match").alias("exact_match_accuracy"), rate("contains_match").alias("contains_match_accuracy"), rate("prefix_match").alias("prefix_match_accuracy")
    )


def bucket_counts(rows: DataFrame) -> DataFrame:
    bucket = match_bucket(F.col("exact_match"), F.col("contains_match"), F.col("prefix_match"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_rows"))


def mcq_summary(rows: DataFrame, correct: Column, logprobs: Column) -> DataFrame:
    """By outcome: rows and mean greatest log-probability."""
    return rows.groupBy(correct.alias("is_correct")).agg(F.count("*").alias("n_rows"), F.round(F.avg(F.array_max(logprobs)), 6).alias("mean_confidence"))


def answer_found(rows: DataFrame, generated: Column, answer: Column, *group: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), F.round(F.avg(generated.contains(answer).cast("double")), 6).alias("accuracy"))


def outcome_differences(results: DataFrame, models: int) -> DataFrame:
    """``results`` (model, id, ok): ids that all ``models`` have and whose outcomes differ."""
    by_id = results.groupBy("id").agg(F.count_distinct("model").alias("n_models"), F.min(F.col("ok").cast("int")).alias("lo"), F.max(F.col("ok").cast("int")).alias("hi"))
    return by_id.where((F.col("n_models") == models) & (F.col("lo") != F.col("hi"))).select("id")


def masked_loss(logprobs: Column, mask: Column) -> Column:
    """Mean negative log-probability over the masked positions; null if there are none."""
    kept = F.filter(F.zip_with(logprobs, mask, lambda p, m: F.when(m == 1, p)), lambda p: p.isNotNull())
    return -F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(kept), F.lit(0))


def perplexity(rows: DataFrame, logprob: Column, *group: str) -> DataFrame:
    """exp of the mean negative log-probability; infinite for a group without values."""
    return rows.groupBy(*group).agg(F.count(logprob).alias("n_rows"), F.round(F.coalesce(F.exp(-F.avg(logprob)), F.lit(float("inf"))), 6).alias("perplexity"))
