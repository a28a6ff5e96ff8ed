"""Entropies of tokens, morphemes and their boundaries, in bits. Empty inputs have entropy 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..working import materialize
from .morphology import affix_tokens, spans


def entropy(values: DataFrame, value: Column, *group: str) -> DataFrame:
    """Shannon entropy of ``value`` by group: counts by value, then one sum a group."""
    counts = values.select(*group, value.alias("_v")).where(F.col("_v").isNotNull()).groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    h = F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n
    return counts.groupBy(*group).agg(F.coalesce(n, F.lit(0)).alias("n"), F.count("*").alias("n_values"), F.round(F.abs(F.coalesce(h, F.lit(0.0))), 6).alias("entropy"))


def boundary_bin(boundary: Column, length: Column) -> Column:
    """The tenth of the word that a boundary lies in."""
    return F.floor(boundary / length * 10).cast("int")


def boundary_entropy(rows: DataFrame, boundaries: str = "boundaries") -> DataFrame:
    each = rows.select(F.length("word").alias("_len"), F.explode(boundaries).alias("_b"))
    return entropy(each, boundary_bin(F.col("_b"), F.col("_len")))


def conditional_boundary_entropy(rows: DataFrame) -> DataFrame:
    """Mean over words of the entropy of aligned against unaligned, weighted by their boundaries."""
    m = F.size("boundaries")
    p = F.size(F.filter("boundaries", lambda b: F.array_contains(F.col("token_boundaries"), b))) / m
    h = F.when((p == 0) | (p == 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    words = rows.where(m > 0).select(m.alias("w"), h.alias("h"))
    return words.agg(F.round(F.coalesce(F.sum(F.col("h") * F.col("w")) / F.sum("w"), F.lit(0.0)), 6).alias("conditional_entropy"))


def boundary_mutual_information(rows: DataFrame) -> DataFrame:
    """H(boundaries) - H(boundaries | token boundaries)."""
    both = boundary_entropy(rows).crossJoin(conditional_boundary_entropy(rows))  # one row each
    return both.select("entropy", "conditional_entropy", F.round(F.col("entropy") - F.col("conditional_entropy"), 6).alias("mutual_information"))


def affix_signature_entropy(rows: DataFrame, joined: str = "|") -> DataFrame:
    """``rows`` (word, affixes, tokens): entropy of each affix's tokenizations."""
    each = rows.select("word", "tokens", F.explode("affixes").alias("affix"))
    found = each.select("affix", affix_tokens(F.col("word"), F.col("affix"), F.col("tokens")).alias("t")).where(F.size("t") > 0)
    return entropy(found, F.array_join("t", joined), "affix")


def overlap_pairs(rows: DataFrame) -> DataFrame:
    """(morpheme, token) for each pair in a word that shares a character."""
    each = rows.select(F.explode(spans(F.col("morphemes"))).alias("m"), spans(F.col("tokens")).alias("ts"))
    pairs = each.select(F.col("m.piece").alias("morpheme"), F.col("m.start").alias("ms"), F.col("m.end").alias("me"), F.explode("ts").alias("t"))
    return pairs.where("t.end > ms AND t.start < me").select("morpheme", F.col("t.piece").alias("token"))


def _bits(n: str = "n") -> Column:
    """The entropy of counts, as an aggregate."""
    h = F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)
    return F.round(F.abs(F.coalesce(h, F.lit(0.0))), 6)


def conditional_entropy(counts: DataFrame, given: str, marginal: DataFrame) -> DataFrame:
    """``counts`` (given, value, n): sum over ``given`` of its share in ``marginal`` (given, n) times the entropy of its values."""
    h = counts.groupBy(given).agg(_bits().alias("h"))
    both = marginal.join(h, given, "left")
    return both.agg(F.round(F.coalesce(F.sum(F.col("n") * F.coalesce("h", F.lit(0.0))) / F.sum("n"), F.lit(0.0)), 6).alias("h"))


def information_content(rows: DataFrame) -> DataFrame:
    """H(T), H(M), H(T|M), H(M|T) and mutual information in one row.

    The words are read once, and pairs, tokens and morphemes are counted once: their counts are
    written, and every entropy is made of counts.
    """
    words = materialize(rows.select("tokens", "morphemes"), "segmented-words")
    pairs = materialize(overlap_pairs(words).groupBy("morpheme", "token").agg(F.count("*").alias("n")), "overlaps")
    count = lambda column, name: materialize(words.select(F.explode(column).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")), name)
    tokens, morphemes = count("tokens", "token"), count("morphemes", "morpheme")
    parts = [
        tokens.agg(_bits().alias("token_entropy")),
        morphemes.agg(_bits().alias("morpheme_entropy")),
        conditional_entropy(pairs, "morpheme", morphemes).select(F.col("h").alias("token_given_morpheme_entropy")),
        conditional_entropy(pairs, "token", tokens).select(F.col("h").alias("morpheme_given_token_entropy")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    return one.withColumn("mutual_information", F.round(F.col("morpheme_entropy") - F.col("morpheme_given_token_entropy"), 6))


def compare_information(named: dict[str, DataFrame]) -> DataFrame:
    """One row of information content for each named tokenization."""
    out = None
    for name, rows in named.items():
        one = information_content(rows).select(F.lit(name).alias("tokenization"), "*")
        out = one if out is None else out.unionByName(one)
    return out
