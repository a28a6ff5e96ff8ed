"""How well token boundaries follow morpheme boundaries.

Rows have word, tokens and morphemes (arrays of strings), morpheme_types, and boundaries (ends of
the morphemes inside the word). Token boundaries come from the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_boundaries


def with_token_boundaries(rows: DataFrame) -> DataFrame:
    return rows.withColumn("token_boundaries", token_boundaries(F.col("tokens"), F.col("word")))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def aligned(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def morph_score(rows: DataFrame, *group: str) -> DataFrame:
    """Share of morpheme boundaries that are token boundaries, over all words."""
    hit, all_ = F.sum(aligned(F.col("token_boundaries"), F.col("boundaries"))), F.sum(F.size(F.array_distinct("boundaries")))
    return rows.groupBy(*group).agg(hit.alias("aligned"), all_.alias("total"), _ratio(hit, all_).alias("morph_score"))


def word_morph_scores(rows: DataFrame) -> DataFrame:
    """The score of each word that has a boundary."""
    n = F.size(F.array_distinct("boundaries"))
    return rows.where(n > 0).select("word", aligned(F.col("token_boundaries"), F.col("boundaries")).alias("aligned"), n.alias("total"), _ratio(aligned(F.col("token_boundaries"), F.col("boundaries")), n).alias("score"))


def boundary_f1_micro(rows: DataFrame, *group: str) -> DataFrame:
    """tp, fp, fn over the inner positions of all words, and their precision, recall and F1."""
    inner = lambda c: F.array_distinct(F.filter(c, lambda b: (b > 0) & (b < F.length("word"))))
    t, m = inner(F.col("token_boundaries")), inner(F.col("boundaries"))
    tp = F.size(F.array_intersect(t, m))
    sums = rows.groupBy(*group).agg(F.sum(tp).alias("tp"), F.sum(F.size(t) - tp).alias("fp"), F.sum(F.size(m) - tp).alias("fn"))
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return sums.select(*group, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_f1(p, r), 6).alias("f1"))


def boundary_f1_macro(rows: DataFrame, *group: str) -> DataFrame:
    """Means of each word's precision, recall and F1; words without a morpheme boundary are left out."""
    t, m = F.array_distinct("token_boundaries"), F.array_distinct("boundaries")
    tp = F.size(F.array_intersect(t, m))
    p = F.coalesce(tp / F.nullif(F.size(t), F.lit(0)), F.lit(0.0))
    r = tp / F.size(m)
    words = rows.where(F.size("boundaries") > 0).select(*group, p.alias("p"), r.alias("r"), _f1(p, r).alias("f"))
    return words.groupBy(*group).agg(F.count("*").alias("n_words"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def affix_preservation(rows: DataFrame) -> DataFrame:
    """How often affixes are whole tokens: overall, by type and by affix (the others are null)."""
    pairs = F.explode(F.arrays_zip(F.col("morphemes").alias("affix"), F.col("morpheme_types").alias("kind")))
    each = rows.select("tokens", pairs.alias("m")).where(F.col("m.kind").isin("prefix", "suffix", "infix", "circumfix"))
    each = each.select(F.col("m.affix").alias("affix"), F.col("m.kind").alias("kind"), F.array_contains("tokens", F.col("m.affix")).cast("int").alias("whole"))
    sets = each.groupingSets([[], ["kind"], ["affix"]], "kind", "affix")
    return sets.agg(F.count("*").alias("n"), F.sum("whole").alias("n_whole"), F.round(F.avg("whole"), 6).alias("preserved"))


def spans(pieces: Column) -> Column:
    """(piece, start, end) in characters, one after the other."""
    state = "array<struct<piece:string,start:int,end:int>>"

    def step(acc: Column, p: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.concat(acc, F.array(F.struct(p.alias("piece"), at.alias("start"), (at + F.length(p)).alias("end")))).cast(state)

    return F.aggregate(pieces, F.array().cast(state), step)


def overlapping(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens that share a character with [start, end)."""
    return F.transform(F.filter(spans(tokens), lambda s: (s["end"] > start) & (s["start"] < end)), lambda s: s["piece"])


def affix_tokens(word: Column, affix: Column, tokens: Column) -> Column:
    """The tokens over the affix's first place in the word; null if the word lacks it."""
    at = F.instr(F.lower(word), F.lower(affix)) - 1
    return F.when(at >= 0, overlapping(tokens, at, at + F.length(affix)))


def fragmentation(rows: DataFrame, *group: str) -> DataFrame:
    """Tokens over each morpheme: mean and population standard deviation, by type if asked."""
    each = rows.select("tokens", F.explode(F.arrays_zip(spans(F.col("morphemes")).alias("span"), F.col("morpheme_types").alias("kind"))).alias("m"))
    n = each.select(F.col("m.kind").alias("kind"), F.size(overlapping(F.col("tokens"), F.col("m.span.start"), F.col("m.span.end"))).alias("n"))
    return n.groupBy(*group).agg(F.count("*").alias("n_morphemes"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.stddev_pop("n"), 6).alias("std_tokens"))


def fragmentation_ratio(rows: DataFrame, *group: str) -> DataFrame:
    a, b = F.sum(F.size("tokens")), F.sum(F.size("morphemes"))
    return rows.groupBy(*group).agg(a.alias("n_tokens"), b.alias("n_morphemes"), _ratio(a, b).alias("fragmentation"))


def compare_tokenizers(rows: DataFrame, tokenizer: str = "tokenizer") -> DataFrame:
    """One row a tokenizer: score, macro F1 and fragmentation, best score first."""
    scores = morph_score(rows, tokenizer).select(tokenizer, "morph_score")
    f1 = boundary_f1_macro(rows, tokenizer)
    return scores.join(f1, tokenizer).join(fragmentation_ratio(rows, tokenizer).select(tokenizer, "fragmentation"), tokenizer).orderBy(F.desc("morph_score"), tokenizer)
