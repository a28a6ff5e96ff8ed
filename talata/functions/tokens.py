"""Functions on token sequences and affixes: Column in, Column out, built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import to_chars


def char_tokens(text: Column) -> Column:
    """ASCII codes of the characters; 0 for any other character."""
    return F.transform(to_chars(text), lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(0))


def char_decode(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.char(i)), "")


def append_end(ids: Column, end: int) -> Column:
    return F.concat(ids, F.array(F.lit(end)))


def pad_truncate(ids: Column, length: Column | int, pad: int = 0, *, left: bool = False) -> Column:
    """Exactly ``length`` ids: cut at the end, or padded on the right (or left)."""
    n = F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0)))
    cut = F.slice(ids, F.lit(1), n)
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def pad_mask(ids: Column, length: Column | int, *, left: bool = False) -> Column:
    """1 where ``pad_truncate`` keeps an id, 0 where it pads."""
    return pad_truncate(F.transform(ids, lambda _: F.lit(1)), length, 0, left=left)


def fixed_width(word: Column, width: int) -> Column:
    """Pieces of ``width`` characters, the last one shorter: a stand-in for a tokenizer."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)), F.lit(width))
    return F.when(word == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substr(word, s, F.lit(width))))


def token_boundaries(tokens: Column, word: Column) -> Column:
    """Ends of the tokens in characters, those inside the word only."""
    ends = F.aggregate(
        tokens,
        F.array().cast("array<int>"),
        lambda acc, t: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(t))),
    )
    return F.filter(ends, lambda e: e < F.length(word))


def cut_at(word: Column, bounds: Column) -> Column:
    """The word cut at sorted positions inside it."""
    inner = F.array_sort(F.array_distinct(F.filter(bounds, lambda b: (b > 0) & (b < F.length(word)))))
    starts = F.concat(F.array(F.lit(0)), inner)
    return F.transform(starts, lambda s, i: F.substr(word, s + 1, F.coalesce(F.get(inner, i), F.length(word)) - s))


def splice(ids: Column, at: Column, new: Column, count: Column | int) -> Column:
    """``count`` elements from ``at`` (from 0) replaced by ``new``."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.concat(F.slice(ids, F.lit(1), at), new, F.slice(ids, at + n + 1, F.greatest(F.size(ids), F.lit(1))))


def repeated_pair_at(s: Column) -> Column:
    """The first i (from 0) with s[i:i+2] = s[i+2:i+4]; -1 if there is none."""
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s) - 3, F.lit(1))), lambda i: (i + 3 <= F.length(s)) & (F.substr(s, i, F.lit(2)) == F.substr(s, i + 2, F.lit(2))))
    return F.coalesce(F.get(spots, F.lit(0)) - 1, F.lit(-1))


def split_repeated_pair(s: Column) -> Column:
    """[before, pair, the rest without one pair], empty pieces left out; [s] without a repeated pair."""
    i = repeated_pair_at(s)
    pieces = F.array(F.substr(s, F.lit(1), i), F.substr(s, i + 1, F.lit(2)), F.substr(s, i + 3))
    return F.when(i < 0, F.array(s)).otherwise(F.filter(pieces, lambda p: p != ""))


def windows(ids: Column, start: Column, length: int) -> Column:
    """(x, y): ``length`` ids from ``start`` (from 0), and the same shifted by one."""
    return F.struct(F.slice(ids, start + 1, F.lit(length)).alias("x"), F.slice(ids, start + 2, F.lit(length)).alias("y"))


def causal_block_mask(segments: Column) -> Column:
    """Rows of 0/1: a position sees the earlier ones of its own segment and itself."""
    return F.transform(segments, lambda s, i: F.transform(segments, lambda t, j: ((t == s) & (j <= i)).cast("int")))


def answer_mask(segments: Column, starts: Column) -> Column:
    """1 on positions at or after the start of their segment's answer."""
    return F.transform(segments, lambda s, i: F.coalesce(i >= F.get(starts, s), F.lit(False)).cast("int"))


def questions_and_answers(text: Column) -> Column:
    """A flat stream ``$question=answer$...`` -> array of (question, answer); unfinished pairs are left out."""
    parts = F.filter(F.split(text, r"\$"), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("question"), F.substr(p, F.instr(p, "=") + 1).alias("answer")))


def byte_splits(token: Column) -> Column:
    """Every cut of a BINARY token into two non-empty parts: (left, right)."""
    n = F.octet_length(token)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.substr(token, F.lit(1), i).alias("left"), F.substr(token, i + 1, n).alias("right"))))


# --- affixes ---------------------------------------------------------------------------------


def parse_affix(s: Column) -> Column:
    """(affix, kind): ``a--b`` circumfix a-b, ``-x-`` infix, ``x-`` prefix, ``-x`` suffix, bare prefix.

    Quotes and outer spaces go first; empty and null give nulls.
    """
    t = F.trim(F.regexp_replace(s, "['\"]", ""))
    kind = (
        F.when(t.isNull() | (t == ""), None)
        .when(t.contains("--"), "circumfix")
        .when(t.startswith("-") & t.endswith("-"), "infix")
        .when(t.endswith("-"), "prefix")
        .when(t.startswith("-"), "suffix")
        .otherwise("prefix")
    )
    affix = F.when(kind == "circumfix", F.replace(t, F.lit("--"), F.lit("-"))).otherwise(F.regexp_replace(t, "^-+|-+$", ""))
    return F.struct(F.when(kind.isNotNull(), affix).alias("affix"), kind.alias("kind"))


def infix_position(inflected: Column, root: Column, infix: Column) -> Column:
    """The least i >= 1 where the root takes the infix to give the inflected form, else null."""
    w, r, x = F.lower(inflected), F.lower(root), F.lower(infix)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))), lambda i: F.concat(F.substr(r, F.lit(1), i), x, F.substr(r, i + 1)) == w)
    return F.get(fits, F.lit(0))


def annotate(root: Column, inflected: Column, affix: Column, kind: Column) -> Column:
    """Morphemes, their types, inner boundaries and infix position of an inflected word."""
    head, tail = F.substring_index(affix, "-", 1), F.substring_index(affix, "-", -1)
    at = infix_position(inflected, root, affix)
    strings = "array<string>"
    morphemes = (
        F.when(kind == "prefix", F.array(affix, root))
        .when(kind == "suffix", F.array(root, affix))
        .when(kind == "circumfix", F.array(head, root, tail))
        .when((kind == "infix") & at.isNotNull(), F.array(F.substr(root, F.lit(1), at), affix, F.substr(root, at + 1)))
        .when(kind == "infix", F.array(root, affix))
        .otherwise(F.array().cast(strings))
    )
    types = (
        F.when(kind == "prefix", F.array(F.lit("prefix"), F.lit("root")))
        .when(kind == "suffix", F.array(F.lit("root"), F.lit("suffix")))
        .when(kind == "circumfix", F.array(F.lit("prefix"), F.lit("root"), F.lit("suffix")))
        .when((kind == "infix") & at.isNotNull(), F.array(F.lit("root_part"), F.lit("infix"), F.lit("root_part")))
        .when(kind == "infix", F.array(F.lit("root"), F.lit("infix")))
        .otherwise(F.array().cast(strings))
    )
    bounds = (
        F.when(kind == "prefix", F.array(F.length(affix)))
        .when(kind == "suffix", F.array(F.length(root)))
        .when(kind == "circumfix", F.array(F.length(head), F.length(head) + F.length(root)))
        .when((kind == "infix") & at.isNotNull(), F.array(at, at + F.length(affix)))
        .otherwise(F.array().cast("array<int>"))
    )
    return F.struct(morphemes.alias("morphemes"), types.alias("morpheme_types"), bounds.alias("boundaries"), F.when(kind == "infix", at).alias("infix_position"))
