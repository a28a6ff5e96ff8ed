"""The column functions' SQL surface: functions of the session that SQL text calls by name.

All are Spark SQL functions, scalar ones and table functions for LATERAL, so Catalyst sees through
them and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, result, body)
FUNCTIONS = {
    "talata_softmax": ("scores ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(scores, s -> exp(s - array_max(scores)) / aggregate(transform(scores, t -> exp(t - array_max(scores))), 0D, (a, x) -> a + x))"),
    "talata_argmax": ("scores ARRAY<DOUBLE>", "INT", "CAST(array_position(scores, array_max(scores)) - 1 AS INT)"),
    "talata_choice_metrics": (
        "scores ARRAY<DOUBLE>, truth INT",
        "TABLE(predicted INT, is_right BOOLEAN, confidence DOUBLE, log2_confidence DOUBLE)",
        "SELECT best, best = truth, share, log2(share) FROM (SELECT talata_argmax(scores) AS best, element_at(talata_softmax(scores), truth + 1) AS share)",
    ),
    "talata_splits": (
        "token STRING",
        "TABLE(place INT, `left` STRING, `right` STRING)",
        "SELECT i, substr(token, 1, i), substr(token, i + 1) FROM (SELECT explode(IF(length(token) > 1, sequence(1, length(token) - 1), CAST(array() AS ARRAY<INT>))) AS i)",
    ),
    "talata_windows": (
        "ids ARRAY<INT>, size INT",
        "TABLE(place INT, x ARRAY<INT>, y ARRAY<INT>)",
        "SELECT i, slice(ids, i * size + 1, size), slice(ids, i * size + 2, size) FROM (SELECT explode(IF(size(ids) > size, sequence(0, (size(ids) - 1) DIV size - 1), CAST(array() AS ARRAY<INT>))) AS i)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, replacing earlier ones; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
