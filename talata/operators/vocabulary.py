"""Vocabularies as tables (token BINARY, token_id INT): merges, decompositions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import byte_splits
from ..working import materialize

# Units that count as meaningful in a decomposition.
MEANINGFUL = ["um", "in", "an", "ka", "ma", "pa", "na", "mag", "nag", "pag"]
EXACT_SCORE, FALLBACK_SCORE = 10.0, 0.5
MAX_PARTS = 5
MOST_AFFIXES = 20_000


def merges(vocab: DataFrame) -> DataFrame:
    """(merged, left, right): every token that is the byte concatenation of two others.

    Splits are exploded and looked up by two equi-joins, so the work is the number of splits.
    """
    splits = vocab.select(F.col("token_id").alias("merged"), F.explode(byte_splits(F.col("token"))).alias("s")).select("merged", "s.left", "s.right")
    left = vocab.select(F.col("token").alias("left"), F.col("token_id").alias("left_id"))
    right = vocab.select(F.col("token").alias("right"), F.col("token_id").alias("right_id"))
    return splits.join(left, "left").join(right, "right").select("merged", F.col("left_id").alias("left"), F.col("right_id").alias("right"))


def expansions(vocab: DataFrame) -> DataFrame:
    """(token_id, pairs): all ways to write a token as two; tokens without one are left out."""
    return merges(vocab).groupBy(F.col("merged").alias("token_id")).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("pairs"))


def contractions(vocab: DataFrame) -> DataFrame:
    """(left, right, merged): the same pairs keyed the other way."""
    return merges(vocab).select("left", "right", "merged")


def affix_versions(affixes: DataFrame) -> DataFrame:
    """``affixes`` (affix, affix_type) -> (version, affix, affix_type) as they occur in running text.

    Prefixes plain, after a space, capitalized and both; infixes plain; suffixes plain and before a space.
    """
    a = F.col("affix")
    capital = F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substr(a, F.lit(2))))
    forms = F.when(F.col("affix_type") == "prefix", F.array(a, F.concat(F.lit(" "), a), capital, F.concat(F.lit(" "), capital))).when(
        F.col("affix_type") == "suffix", F.array(a, F.concat(a, F.lit(" ")))
    ).otherwise(F.array(a))
    return affixes.select(F.explode(forms).alias("version"), "affix", "affix_type").distinct()


def affix_ids(versions: DataFrame, vocab: DataFrame) -> DataFrame:
    """The versions that are single tokens: (token_id, version)."""
    side = vocab.select("token_id", F.decode("token", "UTF-8").alias("version"))
    return versions.select("version").distinct().join(side, "version").select("token_id", "version")


def splits_of(text: Column, parts: int) -> Column:
    """Every way to cut a short string into ``parts`` non-empty pieces, in order of the first cuts.

    A string with ``parts`` characters or fewer gives its characters.
    """
    n = F.length(text)
    state = "array<struct<done:array<string>,at:int>>"
    ways = F.array(F.struct(F.array().cast("array<string>").alias("done"), F.lit(1).alias("at"))).cast(state)

    def cut(left: int):
        """The next piece of a way, with ``left`` pieces still to come."""

        def longer(w: Column) -> Column:
            ends = F.sequence(w["at"], n - left)
            return F.transform(ends, lambda e: F.struct(F.concat(w["done"], F.array(F.substr(text, w["at"], e - w["at"] + 1))).alias("done"), (e + 1).alias("at")))

        return longer

    for left in range(parts - 1, 0, -1):
        ways = F.flatten(F.transform(ways, cut(left))).cast(state)
    whole = F.transform(ways, lambda w: F.concat(w["done"], F.array(F.substr(text, w["at"]))))
    return F.when(n > parts, whole).otherwise(F.array(F.split(text, "")))


def split_score(pieces: Column) -> Column:
    """How good a decomposition is: few, balanced, syllable-like and meaningful pieces."""
    n = F.size(pieces)
    lengths = F.transform(pieces, lambda p: F.length(p).cast("double"))
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n

    def piece(p: Column) -> Column:
        q = F.lower(p)
        single = F.when(F.length(p) == 1, F.when(q.rlike("[aeiou]"), 0.5).otherwise(-1.0)).otherwise(0.0)
        syllable = F.when((F.length(p) >= 2) & q.rlike("^[^aeiou].*[aeiou]"), 0.5).otherwise(0.0)
        return single + syllable + F.when(q.isin(MEANINGFUL), 1.5).otherwise(0.0)

    count = F.when(n == 1, 5.0).when(n == 2, 3.0).when(n == 3, 1.5).otherwise((3 - n).cast("double"))
    total = 5.0 + count + F.when(variance < 1.0, 1.0).otherwise(0.0) + F.aggregate(F.transform(pieces, piece), F.lit(0.0), lambda a, x: a + x)
    return F.greatest(total, F.lit(0.0))


def decompositions(affixes: DataFrame, vocab: DataFrame, max_parts: int = MAX_PARTS) -> DataFrame:
    """(affix, tokens, token_ids, score, decomposition_type, place), best first by ``place`` from 1.

    An affix in the vocabulary has itself alone; else all splits into 2 to ``max_parts`` tokens;
    else its characters if all are tokens; else no row. Ties keep the order of enumeration.
    """
    tokens = materialize(vocab.select(F.decode("token", "UTF-8").alias("piece"), F.col("token_id").alias("id")), "vocabulary")
    tokens = F.broadcast(tokens) if tokens.count() <= 1_000_000 else tokens
    a = F.col("affix")
    names = affixes.select("affix").distinct().where(F.length(a) > 0)
    exact = names.join(tokens.select(F.col("piece").alias("affix"), "id"), "affix").select("affix", F.array(a).alias("tokens"), F.array("id").alias("token_ids"), F.lit(EXACT_SCORE).alias("score"), F.lit("exact_match").alias("decomposition_type"), F.lit(0).alias("seq"))
    rest = names.join(exact.select("affix"), "affix", "left_anti")
    ways = F.flatten(F.array(*[F.when(F.length(a) >= n, splits_of(a, n)).otherwise(F.array().cast("array<array<string>>")) for n in range(2, max_parts + 1)]))
    numbered = rest.select("affix", F.posexplode(F.array_distinct(ways)).alias("seq", "tokens"))
    longest = F.size("tokens")
    checked = (
        numbered.select("affix", "seq", "tokens", longest.alias("k"), F.posexplode("tokens").alias("at", "piece"))
        .join(tokens, "piece")
        .groupBy("affix", "seq", "k", "tokens")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("token_ids"))
        .where((F.size("token_ids") == F.col("k")) & (F.col("k") <= max_parts))
        .select("affix", "tokens", "token_ids", split_score(F.col("tokens")).alias("score"), F.lit("optimal").alias("decomposition_type"), "seq")
    )
    chars = rest.join(checked.select("affix").distinct(), "affix", "left_anti").select("affix", F.split(a, "").alias("tokens"))
    spelled = (
        chars.select("affix", "tokens", F.posexplode("tokens").alias("at", "piece"))
        .join(tokens, "piece")
        .groupBy("affix", "tokens")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("token_ids"))
        .where(F.size("token_ids") == F.size("tokens"))
        .select("affix", "tokens", "token_ids", F.lit(FALLBACK_SCORE).alias("score"), F.lit("fallback").alias("decomposition_type"), F.lit(0).alias("seq"))
    )
    ordered = F.row_number().over(_by_score())
    return exact.unionByName(checked).unionByName(spelled).withColumn("place", ordered).drop("seq")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("affix").orderBy(F.desc("score"), "seq")


def best_decompositions(affixes: DataFrame, vocab: DataFrame) -> DataFrame:
    return decompositions(affixes, vocab).where("place = 1").drop("place")


def coverage(affixes: DataFrame, vocab: DataFrame, *, tokenizer: str) -> DataFrame:
    """One row: affixes in the vocabulary, decomposable, impossible, and the rate of the first."""
    best = best_decompositions(affixes, vocab).select("affix", "decomposition_type")
    rows = affixes.select("affix").distinct().join(best, "affix", "left")
    kind = F.col("decomposition_type")
    inside = F.count_if(kind == "exact_match")
    return rows.agg(
        F.lit(tokenizer).alias("tokenizer"),
        F.count("*").alias("total_affixes"),
        inside.alias("in_vocabulary"),
        F.round(F.coalesce(inside / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("coverage_rate"),
        F.count_if(kind.isin("optimal", "fallback")).alias("need_decomposition"),
        F.count_if(kind.isNull()).alias("cannot_decompose"),
    )


def similar_affixes(affixes: DataFrame, top_k: int = 3) -> DataFrame:
    """The ``top_k`` most similar other affixes of each, by indel similarity; the affix breaks ties.

    Affix lists have some hundred entries; all pairs are compared, against the broadcast list. A
    list of more than MOST_AFFIXES is an error, as its pairs would grow with the square.
    """
    from pyspark.sql import Window

    from ..functions.chars import similarity_ratio

    names = materialize(affixes.select("affix").distinct(), "affixes")
    if names.count() > MOST_AFFIXES:
        raise ValueError(f"more than {MOST_AFFIXES} affixes to compare with each other")
    other = F.broadcast(names.select(F.col("affix").alias("other")))
    pairs = names.join(other, F.col("affix") != F.col("other")).withColumn("ratio", F.round(similarity_ratio(F.col("affix"), F.col("other")), 6))
    place = F.row_number().over(Window.partitionBy("affix").orderBy(F.desc("ratio"), "other"))
    return pairs.withColumn("place", place).where(F.col("place") <= top_k)
