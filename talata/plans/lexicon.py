"""Lexicons and morpheme annotations from raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars, syllables, tokens
from ..operators.ordering import keep_first
from ..working import materialize


def build_lexicon(raw: DataFrame) -> DataFrame:
    """``raw`` (word, etymology, part_of_speech, word_sense) -> the lexicon, sorted within partitions.

    Filipino etymology, one word, one accented syllable, no hyphen at an end. Syllables are made
    once for each distinct word.
    """
    kept = raw.where(chars.is_filipino(F.col("etymology")) & chars.is_single_word(F.col("word")) & chars.no_edge_hyphen(F.col("word")))
    each = kept.select("word").distinct().withColumn("accented_syllable_list", syllables.syllabify(F.trim("word")))
    each = each.where(syllables.count_accented(F.col("accented_syllable_list")) == 1)
    rows = kept.join(each, "word")
    accented, last = syllables.accented_syllable(F.col("accented_syllable_list")), syllables.last_syllable(F.col("accented_syllable_list"))
    return rows.select(
        "word", "etymology", "part_of_speech", "word_sense", "accented_syllable_list",
        accented["syllable"].alias("accented_syllable"),
        accented["at"].cast("bigint").alias("accented_syllable_index"),
        last.alias("last_syllable"),
        (F.size("accented_syllable_list") - 1).cast("bigint").alias("last_syllable_index"),
        syllables.stress_type(last).alias("last_syllable_pronunciation"),
        chars.normalize_text(F.col("word")).alias("normalized_word"),
        F.transform("accented_syllable_list", chars.normalize_text).alias("normalized_syllable_list"),
    ).sortWithinPartitions("normalized_word")


def annotate_inflections(rows: DataFrame) -> DataFrame:
    """``rows`` (root, inflected, aspect_affix, aspect, focus) -> annotations."""
    parsed = rows.withColumn("_p", tokens.parse_affix(F.col("aspect_affix"))).where("_p.kind IS NOT NULL AND inflected IS NOT NULL AND root IS NOT NULL")
    made = parsed.withColumn("_m", tokens.annotate(F.col("root"), F.col("inflected"), F.col("_p.affix"), F.col("_p.kind")))
    return made.select(
        F.col("inflected").alias("word"), "root", F.col("_p.affix").alias("affix"), F.col("_p.kind").alias("affix_type"), "aspect", "focus",
        "_m.morphemes", "_m.morpheme_types", "_m.boundaries", "_m.infix_position", F.lit("inflections").alias("source"), F.lit(None).cast("array<string>").alias("syllables"),
    )


MOST_PREFIXES = 10_000


def _rounds(prefixes: list[str]) -> list[list[str]]:
    """The prefixes in rounds: each comes after the earlier ones of the list that begin it or that it begins."""
    at: dict[str, int] = {}
    for p in prefixes:
        if p not in at:
            at[p] = 1 + max((n for q, n in at.items() if q.startswith(p) or p.startswith(q)), default=-1)
    return [[p for p, n in at.items() if n == i] for i in range(max(at.values(), default=-1) + 1)]


def prefixed_words(lexicon: DataFrame, prefixes: DataFrame, most: int) -> DataFrame:
    """Annotations of words that start with a prefix: words of four letters or more, roots of two or more.

    ``prefixes`` (affix, position) is a short list. Each prefix keeps its first ``most`` words, and
    a word goes to the first prefix of the list that fits and has room: as each prefix's words are
    the first of those that earlier ones left, the prefixes are taken in rounds, of which there are
    as many as the longest chain of prefixes that begin each other.
    """
    from ..operators.ordering import first_per_group

    w = F.lower("normalized_word")
    words = lexicon.select(w.alias("word"), F.col("normalized_syllable_list").alias("syllables")).where(F.length("word") >= 4)
    words = materialize(words.groupBy("word").agg(F.min("syllables").alias("syllables")), "words")
    listed = [r.affix for r in prefixes.orderBy("position", "affix").limit(MOST_PREFIXES + 1).collect() if r.affix]
    if len(listed) > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    capped = words.select("word", "syllables", F.lit("").alias("affix")).limit(0)
    for group in _rounds(listed):
        side = F.broadcast(words.sparkSession.createDataFrame([(p,) for p in group], "affix STRING"))  # at most MOST_PREFIXES
        heads = F.array(*[F.substr("word", F.lit(1), F.lit(n)) for n in sorted({len(p) for p in group})])
        free = words.join(capped.select("word"), "word", "left_anti")
        fits = free.withColumn("affix", F.explode(F.array_distinct(heads))).join(side, "affix").where(F.length("word") - F.length("affix") >= 2)
        capped = materialize(capped.unionByName(first_per_group(fits.select("word", "syllables", "affix"), most, ["affix"], "word")), "prefixed")
    root = F.substr("word", F.length("affix") + 1)
    return capped.select(
        "word", root.alias("root"), "affix", F.lit("prefix").alias("affix_type"), F.lit(None).cast("string").alias("aspect"), F.lit(None).cast("string").alias("focus"),
        F.array("affix", root).alias("morphemes"), F.array(F.lit("prefix"), F.lit("root")).alias("morpheme_types"), F.array(F.length("affix")).alias("boundaries"),
        F.lit(None).cast("int").alias("infix_position"), F.lit("heuristic").alias("source"), "syllables",
    )


def build_annotations(inflections: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Both sources, one annotation a word: inflections come first."""
    both = inflections.unionByName(heuristic, allowMissingColumns=True)
    return keep_first(both, "word", F.when(F.col("source") == "inflections", 0).otherwise(1), F.col("affix"), F.col("root"))


def wide_affixes(annotations: DataFrame) -> DataFrame:
    """(word, root, prefix, infix, suffix): the affix under its type's column; circumfixes leave all null."""
    return annotations.select("word", "root", *[F.when(F.col("affix_type") == k, F.col("affix")).alias(k) for k in ("prefix", "infix", "suffix")])
