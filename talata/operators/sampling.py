"""Frequency ranks, and samples that are functions of a seed and the rows' keys."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import order_key, uniform
from ..working import materialize

NO_RANK = 100_000
#: Rank tables up to so many rows are broadcast.
MOST_BROADCAST = 1_000_000


def frequency_ranks(words: DataFrame, column: str) -> DataFrame:
    """(normalized, rank): words by falling count; the word breaks ties.

    Ranks are numbers of distinct words, ordered by range so that no task sorts all of them.
    """
    from .ordering import with_row_index

    counts = words.groupBy(F.col(column).alias("normalized")).agg(F.count("*").alias("n")).withColumn("_neg", -F.col("n"))
    return with_row_index(counts, "_neg", "normalized", name="_at").select("normalized", (F.col("_at") + 1).cast("int").alias("rank"), "n")


def add_frequency_ranks(df: DataFrame, ranks: DataFrame, column: str, fill: int = NO_RANK) -> DataFrame:
    """``df`` with ``rank`` by the lower-cased word; words without one get ``fill``.

    Repeated words on the right give repeated rows. The ranks are written once, and broadcast if
    their count allows.
    """
    side = materialize(ranks.select(F.col("normalized").alias("_word"), F.col("rank")), "ranks")
    side = F.broadcast(side) if side.count() <= MOST_BROADCAST else side
    return df.join(side, F.lower(column) == F.col("_word"), "left").drop("_word").withColumn("rank", F.coalesce("rank", F.lit(fill)))


def frequency_weight(rank: Column, n: int, freq_weight: float) -> Column:
    """fw / (rank + 1) + (1 - fw) / n, before normalization."""
    return freq_weight / (rank + 1) + (1.0 - freq_weight) / max(1, n)


def weighted_order(weight: Column, seed: int, *key: Column) -> Column:
    """Sort key of a weighted permutation: -ln(u) / w, least first (exponential keys)."""
    return -F.log(uniform(seed, *key)) / weight


def sample_by_frequency(df: DataFrame, n: int, *key: str, freq_weight: float = 0.5, seed: int = 42) -> DataFrame:
    """``n`` rows of ``df`` (with ``rank``) without replacement, all if there are fewer."""
    df = materialize(df, "sampled-from")  # counted and sampled without making it twice
    weight = frequency_weight(F.col("rank"), df.count(), freq_weight)
    return df.orderBy(weighted_order(weight, seed, *map(F.col, key)), *key).limit(n)


def uniform_sample(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(seed, *map(F.col, key)), *key).limit(n)


def sample_until(df: DataFrame, n: int, valid: Column, *key: str, seed: int = 42, factor: int = 4) -> DataFrame:
    """The first ``n`` rows in the seeded order that are ``valid``, which is asked of as few rows as it takes.

    Rows are scanned by ranges of their seeded number, the first for ``factor * n`` rows and each
    later one eight times as long, until there are ``n``; so a dear test is not made for all rows.
    All valid rows come if there are fewer.
    """
    found, had, low = None, 0, 0.0
    share = min(1.0, factor * n / max(1, df.count()))
    place = uniform(seed, *map(F.col, key))
    while True:
        part = materialize(df.where((place > low) & (place <= share)).where(valid), "valid-rows")
        found, had = (part if found is None else found.unionAll(part)), had + part.count()
        if had >= n or share >= 1:
            return found.orderBy(order_key(seed, *map(F.col, key)), *key).limit(n)
        low, share = share, min(1.0, share * 8)


def shuffle_rows(df: DataFrame, *key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(seed, *map(F.col, key)), *key)


def sample_with_replacement(df: DataFrame, draws: int, *order: str, seed: int = 42) -> DataFrame:
    """``draws`` rows, each drawn from all of ``df``; ``draw`` numbers them from 0."""
    from .ordering import with_row_index

    numbered = with_row_index(df, *order)  # written once
    n = numbered.count()
    at = F.floor(uniform(seed, F.col("id")) * n).cast("bigint")
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), at.alias("row_index"))
    return picks.join(numbered, "row_index").drop("row_index")


#: Parts of a key that are reduced on their own before they are merged.
SALTS = 64


def least_of_each(df: DataFrame, k: int, keys: list[str], item: str, order: Column, salts: int = SALTS) -> DataFrame:
    """``keys`` and ``items``: the ``k`` items of each key with the least ``order``, in that order; the item breaks ties.

    A bottom-k sketch in two stages: each key's items are dealt to ``salts`` parts by their hash, the
    least of each part are taken, and these, ``k * salts`` at most, are merged. So no task has all
    items of a frequent key. Repeated items count once. Null keys are a key.
    """
    some = df.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("key"), order.alias("order"), F.col(f"`{item}`").alias("item")).distinct()
    salted = some.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(salts)))
    first = F.row_number().over(Window.partitionBy("key", "part").orderBy("order", "item"))
    parts = salted.withColumn("place", first).where(F.col("place") <= k).select("key", "order", "item")
    merged = parts.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "item"))), 1, k).alias("least"))
    return merged.select("key.*", F.transform("least", lambda x: x["item"]).alias("items"))


#: Hexadecimal digits of the order that one round of a cut-off looks at; rows of a cut that are then ranked one by one.
DIGITS, RANKED = 3, 1000


def cut_offs(keys: DataFrame, quotas: DataFrame) -> tuple[DataFrame, int]:
    """Where the ``take`` least keys of each stratum end: (stratum, prefix, left) and the prefix's length.

    ``keys`` (stratum, key: digits of one length) and ``quotas`` (stratum, take: 1 to the stratum's
    size). Keys below ``prefix`` are taken, and the ``left`` least of those that have it. Each round
    counts the next digits of the keys that have a stratum's prefix, so no task sorts a stratum; it
    ends when no prefix has more than RANKED keys.
    """
    state, digits = quotas.select("stratum", F.lit("").alias("prefix"), F.col("take").alias("left")), 0
    while True:
        small = F.broadcast(state) if state.count() <= MOST_BROADCAST else state
        having = keys.join(small, "stratum").where(F.col("key").startswith(F.col("prefix")))
        digits += DIGITS
        counts = having.groupBy("stratum", "left", F.substring("key", 1, digits).alias("next")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 16 ** DIGITS rows
        at = counts.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("n")))
        found = materialize(at.select("stratum", F.col("next").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "n"), "cut-offs")
        state = found.drop("n")
        if digits >= 32 or not found.where(F.col("n") > RANKED).head(1):
            return state, digits


def least_of_strata(df: DataFrame, stratum: Column, order: Column, quotas: DataFrame, *key: str) -> DataFrame:
    """The rows of ``df`` with the least ``order`` (hexadecimal) of each stratum, as many as ``quotas`` (stratum, take) says.

    ``key`` breaks ties. Rows at the cut-off's prefix alone are ranked. Columns of ``df`` may have any name.
    """
    rows = df.select(stratum.alias("stratum"), order.alias("key"), F.struct(*[F.col(f"`{c}`") for c in key]).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = materialize(rows, "strata")
    cuts, digits = cut_offs(rows.select("stratum", "key"), quotas.where("take > 0"))
    near = rows.join(F.broadcast(cuts) if cuts.count() <= MOST_BROADCAST else cuts, "stratum").withColumn("head", F.substring("key", 1, digits))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("key", "tie"))
    last = near.where("head = prefix").withColumn("place", place).where("place <= left")
    return near.where("head < prefix").select("row.*").unionAll(last.select("row.*"))


def stratified_by_length(df: DataFrame, n: int, column: str, *key: str, seed: int = 42) -> DataFrame:
    """Shares of each length kept: quota = n * share rounded half to even.

    Where the quotas miss ``n``, the largest groups get one more or one less, one each; quotas end
    at the group's size, so fewer than ``n`` rows may come. Each length's cut-off is found by counts.
    """
    df = materialize(df, "sampled-from")
    everything = Window.partitionBy()  # one row a length
    total = F.greatest(F.sum("size").over(everything), F.lit(1))
    sizes = df.groupBy(F.length(column).alias("stratum")).agg(F.count("*").alias("size")).withColumn("quota", F.bround(F.col("size") * n / total.cast("double")).cast("bigint"))
    off = F.lit(n) - F.sum("quota").over(everything)
    rank = F.row_number().over(Window.orderBy(F.col("size").desc(), "stratum"))
    quota = F.least(F.col("size"), F.col("quota") + F.when(rank <= F.abs(off), F.signum(off)).otherwise(0).cast("bigint"))
    quotas = materialize(sizes.select("stratum", quota.alias("take")), "quotas")
    return least_of_strata(df, F.length(column), order_key(seed, *map(F.col, key)), quotas, *key)


def is_validation(seed: int, percent: float, *key: Column) -> Column:
    """A stable train/validation split by the hash of a key."""
    return uniform(seed, *key) < percent / 100.0


def range_split(row_index: Column, total: int, shares: dict[str, float], rounded: bool = False) -> Column:
    """Names of consecutive index ranges by their shares; the last takes the rest.

    The ranges' ends are cut down to whole rows or, if ``rounded``, go to the nearest, halves up, by decimal shares.
    """
    out, names, edge, exact = None, list(shares), 0.0, Decimal(0)
    for name in names[:-1]:
        edge, exact = edge + shares[name], exact + Decimal(str(shares[name]))
        test = row_index < (int((total * exact).to_integral_value(ROUND_HALF_UP)) if rounded else int(total * edge))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
