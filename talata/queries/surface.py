"""Queries written as SQL text over the session's functions."""

from __future__ import annotations

from ..functions import sql
from .base import LETTERS, WORDS_SQL, query


def _asked(spark, sf_dir, text):
    """The text over the test tables; {documents} and the like name the files."""
    sql.register(spark)
    names = ("documents", "embeddings", "benchmark")
    return spark.sql(text.format(**{n: f"parquet.`{sf_dir}/{n}.parquet`" for n in names}, letters=LETTERS))


@query("""SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS predicted, list_position(e, list_max(e)) - 1 = label AS is_right,
    round(exp(e[label + 1] - list_max(e)) / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS confidence
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL)""")
def sql_choice_metrics(spark, sf_dir):
    return _asked(spark, sf_dir, """
        SELECT vec_id, predicted, is_right, round(confidence, 6) AS confidence
        FROM {embeddings} AS e, LATERAL talata_choice_metrics(CAST(e.embedding AS ARRAY<DOUBLE>), CAST(e.label AS INT))
        WHERE e.label IS NOT NULL""")


@query(f"""WITH w AS (SELECT word FROM {WORDS_SQL})
    SELECT l || '+' || r AS split, count(*) AS n FROM (SELECT word, substr(word, 1, i::INT) AS l, substr(word, i::INT + 1) AS r FROM (SELECT word, unnest(range(1, length(word))) AS i FROM w)) s
    WHERE l IN (SELECT word FROM w) AND r IN (SELECT word FROM w) GROUP BY 1""")
def sql_word_splits(spark, sf_dir):
    """Words that are two other words, by a lateral join and two semi-joins."""
    return _asked(spark, sf_dir, r"""
        WITH w AS (SELECT DISTINCT lower(x) AS word FROM (SELECT explode(regexp_extract_all(text, '({letters})', 1)) AS x FROM {documents}))
        SELECT concat(s.`left`, '+', s.`right`) AS split, count(*) AS n
        FROM w, LATERAL talata_splits(w.word) AS s
        LEFT SEMI JOIN w AS a ON s.`left` = a.word LEFT SEMI JOIN w AS b ON s.`right` = b.word
        GROUP BY 1""")


@query("""SELECT doc_id, place::INT AS place, list_sum(ids[place * 16 + 1:place * 16 + 16])::BIGINT AS sum_x, list_sum(ids[place * 16 + 2:place * 16 + 17])::BIGINT AS sum_y
    FROM (SELECT doc_id, ids, unnest(range(0, (len(ids) - 1) // 16)) AS place FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents WHERE text IS NOT NULL))""")
def sql_windows(spark, sf_dir):
    """Training windows of the words' lengths, each with its successor ids."""
    return _asked(spark, sf_dir, """
        SELECT d.doc_id, w.place, aggregate(w.x, 0L, (a, v) -> a + v) AS sum_x, aggregate(w.y, 0L, (a, v) -> a + v) AS sum_y
        FROM (SELECT doc_id, transform(split(text, ' '), v -> length(v)) AS ids FROM {documents} WHERE text IS NOT NULL) AS d, LATERAL talata_windows(d.ids, 16) AS w""")
