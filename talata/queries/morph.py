"""Morphology and information metrics: words, a first-two-letters prefix, and pieces of three letters as tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import information, morphology
from .base import WORDS_SQL, query, words


def _annotated(spark, sf_dir):
    rows = words(spark, sf_dir).where(F.length("word") >= 5)
    head, rest = F.substring("word", 1, 2), F.substr("word", F.lit(3))
    rows = rows.select("word", tokens.fixed_width(F.col("word"), 3).alias("tokens"), F.array(head, rest).alias("morphemes"), F.array(F.lit("prefix"), F.lit("root")).alias("morpheme_types"), F.array(F.when(F.length("word") % 3 == 0, 3).otherwise(2)).alias("boundaries"))
    return morphology.with_token_boundaries(rows)


# len, token boundaries tb, morpheme boundary mb of each word.
B = f"(SELECT word, length(word) AS len, CASE WHEN length(word) % 3 = 0 THEN 3 ELSE 2 END AS mb, (length(word) - 1) // 3 AS nt FROM {WORDS_SQL} WHERE length(word) >= 5)"


@query(f"SELECT word, array_to_string(list_transform(range(1, ((length(word) - 1) // 3 + 1)::BIGINT), lambda i: i * 3), ',') AS bounds FROM {WORDS_SQL} WHERE length(word) >= 5")
def token_boundaries(spark, sf_dir):
    return _annotated(spark, sf_dir).select("word", F.array_join(F.transform("token_boundaries", lambda b: b.cast("string")), ",").alias("bounds"))


@query(f"SELECT sum((mb = 3)::INT)::BIGINT AS aligned, count(*) AS total, round(avg((mb = 3)::INT), 6) AS morph_score FROM {B}")
def morph_score(spark, sf_dir):
    return morphology.morph_score(_annotated(spark, sf_dir))


@query(f"SELECT word, (mb = 3)::INT AS aligned, 1 AS total, (mb = 3)::INT::DOUBLE AS score FROM {B}")
def word_morph_scores(spark, sf_dir):
    return morphology.word_morph_scores(_annotated(spark, sf_dir))


@query(f"""SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1
    FROM (SELECT sum((mb = 3)::INT)::BIGINT AS tp, sum(nt - (mb = 3)::INT)::BIGINT AS fp, sum(1 - (mb = 3)::INT)::BIGINT AS fn FROM {B})""")
def boundary_f1_micro(spark, sf_dir):
    return morphology.boundary_f1_micro(_annotated(spark, sf_dir))


@query(f"""SELECT count(*) AS n_words, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1
    FROM (SELECT (mb = 3)::INT / nt AS p, (mb = 3)::INT::DOUBLE AS r FROM {B})""")
def boundary_f1_macro(spark, sf_dir):
    return morphology.boundary_f1_macro(_annotated(spark, sf_dir))


@query(f"""SELECT sum(ceil(len / 3.0))::BIGINT AS n_tokens, sum(2)::BIGINT AS n_morphemes, round(sum(ceil(len / 3.0)) / sum(2), 6) AS fragmentation FROM {B}""")
def fragmentation_ratio(spark, sf_dir):
    return morphology.fragmentation_ratio(_annotated(spark, sf_dir))


@query(f"""SELECT kind, count(*) AS n_morphemes, round(avg(n), 6) AS mean_tokens, round(stddev_pop(n), 6) AS std_tokens
    FROM (SELECT 'prefix' AS kind, 1 AS n FROM {B} UNION ALL SELECT 'root', ceil(len / 3.0) FROM {B}) GROUP BY kind""")
def morpheme_fragmentation(spark, sf_dir):
    return morphology.fragmentation(_annotated(spark, sf_dir), "kind")


@query(f"""WITH a AS (SELECT substr(word, 1, 2) AS affix, list_contains(list_transform(range(1, length(word) + 1, 3), lambda i: substr(word, i, 3)), substr(word, 1, 2))::INT AS whole FROM {WORDS_SQL} WHERE length(word) >= 5)
    SELECT NULL AS kind, NULL AS affix, count(*) AS n, sum(whole)::BIGINT AS n_whole, round(avg(whole), 6) AS preserved FROM a
    UNION ALL SELECT 'prefix', NULL, count(*), sum(whole)::BIGINT, round(avg(whole), 6) FROM a
    UNION ALL SELECT NULL, affix, count(*), sum(whole)::BIGINT, round(avg(whole), 6) FROM a GROUP BY affix""")
def affix_preservation(spark, sf_dir):
    return morphology.affix_preservation(_annotated(spark, sf_dir))


@query(f"""SELECT tokenizer, morph_score, n_words, precision, recall, f1, fragmentation FROM (
    SELECT 'three' AS tokenizer, round(avg((mb = 3)::INT), 6) AS morph_score, count(*) AS n_words, round(avg((mb = 3)::INT / nt), 6) AS precision, round(avg((mb = 3)::INT), 6) AS recall,
      round(avg(CASE WHEN mb = 3 THEN 2.0 * (1.0 / nt) / (1.0 / nt + 1) ELSE 0 END), 6) AS f1, round(sum(ceil(len / 3.0)) / sum(2), 6) AS fragmentation FROM {B}
    UNION ALL SELECT 'two', round(avg((mb = 2)::INT), 6), count(*), round(avg((mb = 2)::INT / ((len - 1) // 2)), 6), round(avg((mb = 2)::INT), 6),
      round(avg(CASE WHEN mb = 2 THEN 2.0 * (1.0 / ((len - 1) // 2)) / (1.0 / ((len - 1) // 2) + 1) ELSE 0 END), 6), round(sum(ceil(len / 2.0)) / sum(2), 6) FROM {B})""")
def compare_tokenizers(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    two = morphology.with_token_boundaries(rows.withColumn("tokens", tokens.fixed_width(F.col("word"), 2)))
    return morphology.compare_tokenizers(rows.withColumn("tokenizer", F.lit("three")).unionByName(two.withColumn("tokenizer", F.lit("two"))))


T3 = f"(SELECT unnest(list_transform(range(1, length(word) + 1, 3), lambda i: substr(word, i, 3))) AS v FROM {WORDS_SQL} WHERE length(word) >= 5)"


@query(f"SELECT sum(n)::BIGINT AS n, count(*) AS n_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT v, count(*) AS n FROM {T3} GROUP BY v)")
def token_entropy(spark, sf_dir):
    return information.entropy(_annotated(spark, sf_dir).select(F.explode("tokens").alias("t")), F.col("t"))


@query("SELECT sum(n)::BIGINT AS n, count(*) AS n_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT v, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS v FROM benchmark) GROUP BY v)")
def character_entropy(spark, sf_dir):
    from .base import table

    return information.entropy(table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("c")), F.col("c"))


BINS = f"(SELECT floor(mb / len * 10) AS v, count(*) AS n FROM {B} GROUP BY 1)"
BIN_H = f"(SELECT abs(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)) FROM {BINS})"


@query(f"SELECT sum(n)::BIGINT AS n, count(*) AS n_values, {BIN_H} AS entropy FROM {BINS}")
def boundary_bin_entropy(spark, sf_dir):
    return information.boundary_entropy(_annotated(spark, sf_dir))


@query(f"SELECT {BIN_H} AS entropy, 0.0::DOUBLE AS conditional_entropy, {BIN_H} AS mutual_information")
def boundary_mutual_information(spark, sf_dir):
    """Words have one boundary each, so alignment is certain within a word."""
    return information.boundary_mutual_information(_annotated(spark, sf_dir))


SIG = f"(SELECT substr(word, 1, 2) AS affix, substr(word, 1, 3) AS v, count(*) AS c FROM {WORDS_SQL} WHERE length(word) >= 5 GROUP BY 1, 2)"


@query(f"SELECT affix, sum(c)::BIGINT AS n, count(*) AS n_values, abs(round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6)) AS entropy FROM {SIG} GROUP BY affix")
def affix_signature_entropy(spark, sf_dir):
    rows = _annotated(spark, sf_dir).select("word", "tokens", F.array(F.get("morphemes", F.lit(0))).alias("affixes"))
    return information.affix_signature_entropy(rows)


@query(f"""
    WITH w AS (SELECT word, substr(word, 1, 2) AS m1, substr(word, 3) AS m2, range(1, length(word) + 1, 3) AS st FROM {WORDS_SQL} WHERE length(word) >= 5),
    tk AS (SELECT word, i, substr(word, i, 3) AS token FROM (SELECT word, unnest(st) AS i FROM w)),
    mo AS (SELECT m1 AS morpheme FROM w UNION ALL SELECT m2 FROM w),
    pr AS (SELECT w.m1 AS morpheme, tk.token FROM w JOIN tk USING (word) WHERE tk.i = 1 UNION ALL SELECT w.m2, tk.token FROM w JOIN tk USING (word)),
    ht AS (SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM (SELECT token, count(*) AS n FROM tk GROUP BY 1)),
    hm AS (SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM (SELECT morpheme, count(*) AS n FROM mo GROUP BY 1)),
    em AS (SELECT morpheme, abs(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)) AS h FROM (SELECT morpheme, token, count(*) AS n FROM pr GROUP BY 1, 2) GROUP BY 1),
    et AS (SELECT token, abs(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)) AS h FROM (SELECT morpheme, token, count(*) AS n FROM pr GROUP BY 1, 2) GROUP BY 1),
    tm AS (SELECT round(sum(n * h) / sum(n), 6) AS h FROM (SELECT morpheme, count(*) AS n FROM mo GROUP BY 1) JOIN em USING (morpheme)),
    mt AS (SELECT round(sum(n * h) / sum(n), 6) AS h FROM (SELECT token, count(*) AS n FROM tk GROUP BY 1) JOIN et USING (token))
    SELECT ht.h AS token_entropy, hm.h AS morpheme_entropy, tm.h AS token_given_morpheme_entropy, mt.h AS morpheme_given_token_entropy, round(hm.h - mt.h, 6) AS mutual_information FROM ht, hm, tm, mt""")
def information_content(spark, sf_dir):
    return information.information_content(_annotated(spark, sf_dir))
