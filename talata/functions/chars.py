"""Character functions: Column in, Column out, all built-in expressions.

Null words give null. Positions are counted from 1.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seeded import number, pick, shuffled, uniform

# Vowels with their marks, and the letters they fold to.
MARKED = "áàâéèêíìîóòôúùûñÁÀÂÉÈÊÍÌÎÓÒÔÚÙÛÑ"
PLAIN = "aaaeeeiiiooouuunAAAEEEIIIOOOUUUN"
ACCENTED_VOWELS = "ÀÁÂÈÉÊÌÍÎÒÓÔÙÚÛàáâèéêìíîòóôùúû"
VOWELS = "AEIOUaeiou" + ACCENTED_VOWELS
DIACRITICS = ACCENTED_VOWELS + "Ññ"
ACUTE, GRAVE, CIRCUMFLEX = "ÁÉÍÓÚáéíóú", "ÀÈÌÒÙàèìòù", "ÂÊÎÔÛâêîôû"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def to_chars(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def from_chars(a: Column, *, spaced: bool = False) -> Column:
    return F.array_join(a, " " if spaced else "")


def random_char(s: Column, seed: int | str) -> Column:
    return F.when(s != "", F.substr(s, (F.pmod(number(seed, s), F.greatest(F.length(s), F.lit(1))) + 1).cast("int"), F.lit(1)))


def same(s: Column) -> Column:
    return s


def delete_char(s: Column, c: Column) -> Column:
    """Without every occurrence of ``c``."""
    return F.replace(s, c, F.lit(""))


def insert_char(s: Column, after: Column, new: Column) -> Column:
    """``new`` after every occurrence of ``after``."""
    return F.replace(s, after, F.concat(after, new))


def substitute_char(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, old, new)


def permute_char(s: Column, a: Column, b: Column) -> Column:
    """Every ``a`` as ``b`` and every ``b`` as ``a``."""
    return F.array_join(F.transform(to_chars(s), lambda c: F.when(c == a, b).when(c == b, a).otherwise(c)), "")


def duplicate_char(s: Column, c: Column) -> Column:
    return F.replace(s, c, F.concat(c, c))


def normalize_diacritics(s: Column) -> Column:
    """The closed set of marked letters folded; other marks stay."""
    return F.translate(s, MARKED, PLAIN)


def diacritize(s: Column, seed: int | str, share: float = 1.0) -> Column:
    """Each letter that can bear a mark gets one of its marks, with chance ``share``; otherwise none."""
    marks: dict[str, list[str]] = {}
    for m, p in zip(MARKED, PLAIN, strict=True):
        marks.setdefault(p, []).append(m)
    table = F.create_map(*[x for p, options in marks.items() for x in (F.lit(p), F.array(*map(F.lit, options)))])

    def mark(c: Column, i: Column) -> Column:
        bare = normalize_diacritics(c)
        hit = uniform(f"{seed}-share", s, i) < share
        return F.when(hit & F.map_contains_key(table, bare), pick(F.element_at(table, bare), number(seed, s, i))).otherwise(bare if share < 1 else c)

    return F.array_join(F.transform(to_chars(s), mark), "")


def spell(s: Column) -> Column:
    return F.array_join(to_chars(s), " ")


def shuffle_chars(a: Column, seed: int | str) -> Column:
    """Another order of the characters where there is one; equal characters alone stay as they are."""
    tries = [shuffled(a, f"{seed}-{i}", F.array_join(a, "")) for i in range(4)]
    rotated = F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))
    out = a
    for t in [rotated, *tries]:
        out = F.when(t != a, t).otherwise(out)
    return F.when(F.size(F.array_distinct(a)) > 1, out).otherwise(a)


def insert_random_char(a: Column, seed: int | str) -> Column:
    """A letter a to z somewhere in the array."""
    word = F.array_join(a, "")
    at = F.pmod(number(f"{seed}-at", word), F.size(a) + 1).cast("int")
    letter = F.substr(F.lit(ALPHABET), (F.pmod(number(f"{seed}-letter", word), F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.concat(F.slice(a, F.lit(1), at), F.array(letter), F.slice(a, at + 1, F.size(a)))


def delete_random_char(a: Column, seed: int | str) -> Column:
    """One element less; arrays of one or none stay."""
    at = F.pmod(number(seed, F.array_join(a, "")), F.greatest(F.size(a), F.lit(1))).cast("int")
    return F.when(F.size(a) <= 1, a).otherwise(F.concat(F.slice(a, F.lit(1), at), F.slice(a, at + 2, F.size(a))))


def merge_random_chars(a: Column, seed: int | str) -> Column:
    """From the left, join two (chance 1/2) or three (1/4) neighbours or keep one; at least one join."""
    word = F.array_join(a, "")
    state = "struct<skip:int,joins:int,out:array<string>>"
    zero = F.from_json(F.lit('{"skip":0,"joins":0,"out":[]}'), state)

    def step(acc: Column, item: Column) -> Column:
        c, i = item["c"], item["i"]
        left = F.size(a) - i
        two = uniform(f"{seed}-two", word, i) < 0.5
        three = uniform(f"{seed}-three", word, i) < 0.5
        size = F.when(two & (left >= 2), 2).when(three & (left >= 3), 3).otherwise(1)
        joined = F.array_join(F.slice(a, i + 1, size), "")
        going = F.struct((size - 1).alias("skip"), (acc["joins"] + (size > 1).cast("int")).alias("joins"), F.concat(acc["out"], F.array(joined)).alias("out"))
        staying = F.struct((acc["skip"] - 1).alias("skip"), acc["joins"].alias("joins"), acc["out"].alias("out"))
        return F.when(acc["skip"] > 0, staying).otherwise(going).cast(state)

    done = F.aggregate(F.transform(a, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), zero, step)
    at = F.pmod(number(f"{seed}-forced", word), F.greatest(F.size(a) - 1, F.lit(1))).cast("int")
    forced = F.concat(F.slice(a, F.lit(1), at), F.array(F.array_join(F.slice(a, at + 1, F.lit(2)), "")), F.slice(a, at + 3, F.size(a)))
    return F.when(F.size(a) < 2, a).when(done["joins"] > 0, done["out"]).otherwise(forced)


def perturbations(s: Column, seed: int | str) -> Column:
    """Three of the four perturbations of the characters, each joined by spaces."""
    a = to_chars(s)
    four = F.array(*[F.array_join(x, " ") for x in (shuffle_chars(a, seed), merge_random_chars(a, seed), insert_random_char(a, seed), delete_random_char(a, seed))])
    return F.slice(shuffled(four, f"{seed}-three-of-four", s), 1, 3)


def delete_at(w: Column, p: Column) -> Column:
    return F.when((p >= 1) & (p <= F.length(w)), F.concat(F.substr(w, F.lit(1), p - 1), F.substr(w, p + 1))).otherwise(w)


def insert_at(w: Column, p: Column, c: Column) -> Column:
    return F.when((p >= 1) & (p <= F.length(w) + 1), F.concat(F.substr(w, F.lit(1), p - 1), c, F.substr(w, p))).otherwise(w)


def substitute_at(w: Column, p: Column, c: Column) -> Column:
    return F.when((p >= 1) & (p <= F.length(w)), F.concat(F.substr(w, F.lit(1), p - 1), c, F.substr(w, p + 1))).otherwise(w)


def swap_at(w: Column, p: Column, q: Column) -> Column:
    both = (F.least(p, q) >= 1) & (F.greatest(p, q) <= F.length(w))
    return F.when(both, substitute_at(substitute_at(w, p, char_at(w, q)), q, char_at(w, p))).otherwise(w)


def char_at(w: Column, p: Column) -> Column:
    return F.substr(w, p.cast("int"), F.lit(1))


def count_char(w: Column, c: Column) -> Column:
    return F.length(w) - F.length(F.replace(w, c, F.lit("")))


def count_diacritics(w: Column) -> Column:
    return F.length(w) - F.length(F.translate(w, DIACRITICS, ""))


def count_upper(w: Column) -> Column:
    return F.regexp_count(w, F.lit(r"\p{Lu}"))


def count_lower(w: Column) -> Column:
    return F.regexp_count(w, F.lit(r"\p{Ll}"))


def half_upper(w: Column) -> Column:
    half = F.floor(F.length(w) / 2).cast("int")
    return F.concat(F.upper(F.substr(w, F.lit(1), half)), F.lower(F.substr(w, half + 1)))


def random_case(w: Column, seed: int | str) -> Column:
    return F.array_join(F.transform(to_chars(w), lambda c, i: F.when(uniform(seed, w, i) < 0.5, F.upper(c)).otherwise(F.lower(c))), "")


def capitalize(w: Column) -> Column:
    """First character upper, the rest lower; not by word."""
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


def ordinal(p: Column) -> Column:
    """1st, 2nd, 3rd, and th after every other number, 21 included."""
    return F.concat(p.cast("string"), F.when(p == 1, "st").when(p == 2, "nd").when(p == 3, "rd").otherwise("th"))


def file_name(s: Column) -> Column:
    return F.translate(s, "/\\", "--")


def has_diacritic(s: Column) -> Column:
    return s.rlike(f"[{DIACRITICS}]")


def has_vowel(s: Column) -> Column:
    return s.rlike(f"[{VOWELS}]")


def is_upper_letter(c: Column) -> Column:
    return c.rlike("^[A-ZÑÀÁÂÈÉÊÌÍÎÒÓÔÙÚÛ]$")


def contains_ng(s: Column) -> Column:
    return F.coalesce(F.contains(s, F.lit("ng")), F.lit(False))


def is_single_word(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " ")).rlike("^[^ ]+$")


def no_edge_hyphen(s: Column) -> Column:
    return ~s.startswith("-") & ~s.endswith("-")


def is_filipino(etymology: Column) -> Column:
    return etymology.contains("Tag") | etymology.contains("ST") | etymology.contains("none")


def normalize_text(s: Column) -> Column:
    """Trimmed, without ASCII punctuation but the hyphen, and without the closed set of marks."""
    return normalize_diacritics(F.regexp_replace(F.trim(s), r"""[!-,./:-@\[-`{-~]""", ""))


def similarity_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b): one minus the normalized insert-delete distance; two empties give 1.

    The row of the dynamic programme is folded over the characters, so it stays in the JVM; it is
    meant for affixes and words.
    """
    second = to_chars(b)
    zero = F.transform(F.concat(F.array(F.lit("")), second), lambda _: F.lit(0))

    def row(prev: Column, ca: Column) -> Column:
        def cell(acc: Column, item: Column) -> Column:
            j = item["j"]
            here = F.when(item["c"] == ca, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        return F.aggregate(F.transform(second, lambda c, j: F.struct(c.alias("c"), j.alias("j"))), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(to_chars(a), zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs / total)


@functools.cache
def _nfd():
    """Full canonical decomposition needs Python: Spark has no such expression."""
    import unicodedata

    @F.pandas_udf(T.StringType())
    def strip_marks(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return strip_marks


def normalize_text_nfd(s: Column) -> Column:
    """As ``normalize_text`` for all of Unicode: every combining mark goes."""
    return _nfd()(F.regexp_replace(F.trim(s), r"""[!-,./:-@\[-`{-~]""", ""))
