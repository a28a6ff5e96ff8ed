"""Syllables, stress and reduplication of Filipino words."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import ACCENTED_VOWELS, ACUTE, CIRCUMFLEX, GRAVE, VOWELS
from .seeded import number, pick

# Clusters that stay together after a nasal, and the labels of the four stress types.
CLUSTERS = {"bl", "br", "dr", "pl", "tr"}
STRESS_LABELS = {"mabilis": "mabilis (acute: á)", "malumi": "malumi (grave: à)", "maragsa": "maragsa (circumflex: â)", "malumay": "malumay (unmarked)"}
STRESS_BENCHMARK_LABELS = {"mabilis": "mabilis (acute á)", "malumi": "malumi (grave à)", "maragsa": "maragsa (circumflex â)", "malumay": "malumay (unmarked)"}


def split_syllables(word: str) -> list[str]:
    """Syllables of one word.

    A state machine over units: a vowel opens a nucleus; the consonants between two nuclei are dealt
    by their number (one goes right; two one each; three are split 1 + 2 where a nasal precedes a
    cluster, else 2 + 1; of more, two stay left). Consonants around a hyphen or at the ends stay on
    their side. ``ng`` is one consonant, an apostrophe none, and hyphens end syllables and go.
    """
    vowels = set(VOWELS)
    units = word.replace("ng", "ŋ").replace("NG", "Ŋ").replace("'", "").split()
    out: list[str] = []
    for part in "\0".join(units).split("\0"):
        for piece in part.split("-"):
            if not piece:
                continue
            nuclei = [i for i, c in enumerate(piece) if c in vowels]
            if not nuclei:
                out.append(piece)
                continue
            starts = [0]
            for left, right in zip(nuclei, nuclei[1:], strict=False):
                run = piece[left + 1 : right]
                if len(run) <= 1:
                    keep = 0
                elif len(run) == 2:
                    keep = 1
                elif len(run) == 3:
                    keep = 1 if run[0].lower() in "nm" and run[1:].lower() in CLUSTERS else 2
                else:
                    keep = 2
                starts.append(left + 1 + keep)
            out += [piece[a:b] for a, b in zip(starts, [*starts[1:], len(piece)], strict=True)]
    return [s.replace("ŋ", "ng").replace("Ŋ", "NG") for s in out]


@functools.cache
def _syllabify():
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def syllables(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else split_syllables(w))

    return syllables


def syllabify(word: Column) -> Column:
    """Syllables of a word as an array; null for null, empty for an empty word.

    Arrow batches in Python: the edits are sequential. Apply it to distinct words.
    """
    return _syllabify()(word)


def accented_syllable(syllables: Column) -> Column:
    """(syllable, at): the first with an accented vowel, counted from 0; ("", -1) if there is none."""
    marked = F.filter(F.transform(syllables, lambda s, i: F.struct(s.alias("syllable"), i.alias("at"))), lambda x: x["syllable"].rlike(f"[{ACCENTED_VOWELS}]"))
    return F.coalesce(F.get(marked, F.lit(0)), F.struct(F.lit("").alias("syllable"), F.lit(-1).alias("at")))


def count_accented(syllables: Column) -> Column:
    return F.size(F.filter(syllables, lambda s: s.rlike(f"[{ACCENTED_VOWELS}]")))


def last_syllable(syllables: Column) -> Column:
    return F.get(syllables, F.size(syllables) - 1)


def stress_type(syllable: Column) -> Column:
    """mabilis, malumi, maragsa by the mark, in this order; malumay without one."""
    return F.when(syllable.rlike(f"[{ACUTE}]"), "mabilis").when(syllable.rlike(f"[{GRAVE}]"), "malumi").when(syllable.rlike(f"[{CIRCUMFLEX}]"), "maragsa").otherwise("malumay")


def label_of(stress: Column, labels: dict[str, str] = STRESS_LABELS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), stress)


def is_reduplicated(syllables: Column) -> Column:
    """The first two syllables begin with the same two characters, whatever the case."""
    a, b = F.lower(F.get(syllables, F.lit(0))), F.lower(F.get(syllables, F.lit(1)))
    return F.coalesce((F.length(a) >= 2) & (F.length(b) >= 2) & (F.substring(a, 1, 2) == F.substring(b, 1, 2)), F.lit(False))


def reduplicated_syllable(syllables: Column) -> Column:
    """The first syllable if the second equals it, else their common first two characters, else null."""
    a, b = F.lower(F.get(syllables, F.lit(0))), F.lower(F.get(syllables, F.lit(1)))
    return F.when(a == b, a).when(is_reduplicated(syllables), F.substring(a, 1, 2))


#: Sentence frames by part of speech; {w} is the word and {W} the word capitalized.
CONTEXTS = {
    "pnb": ["Ang {w} ay ...", "May {w} sa ...", "Nakita ko ang {w}."],
    "pdw": ["{W} ako ...", "Umuwi {w} ...", "{W} siyang ..."],
    "pdd": ["{W}!", 'Sabi niya, "{W}!"'],
    "pnr": ["{W} ang ...", "May {w} na ..."],
    "pkw": ["Gusto kong {w}.", "Kailangan {w} ...", "Ayaw {w} ..."],
}


def context_of(word: Column, pos: Column, seed: int | str) -> Column:
    """A frame of the part of speech around the word; unknown parts of speech use the noun frames."""
    from .chars import capitalize

    frames = F.create_map(*[x for p, fs in CONTEXTS.items() for x in (F.lit(p), F.array(*map(F.lit, fs)))])
    options = F.coalesce(F.element_at(frames, pos), F.array(*map(F.lit, CONTEXTS["pnb"])))
    return F.replace(F.replace(pick(options, number(seed, word, pos)), F.lit("{w}"), word), F.lit("{W}"), capitalize(word))
