"""DuckDB SQL, as text, of the functions that the task generators use: seeded choices, characters, syllables, prompts."""

from __future__ import annotations

import string

from ..functions import chars, syllables
from .base import WORDS_SQL

Q = lambda s: "'" + str(s).replace("'", "''") + "'"
ALPHABET = "string_split('abcdefghijklmnopqrstuvwxyz', '')"


def key(seed: object, *parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join([Q(seed), *parts])}))"


def num(seed: object, *parts: str) -> str:
    return f"('0x' || substr({key(seed, *parts)}, 1, 8))::BIGINT"


def uniform(seed: object, *parts: str) -> str:
    return f"(({num(seed, *parts)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def pick(options: str, n: str) -> str:
    return f"({options})[(({n}) % greatest(len({options}), 1)) + 1]"


def shuffled(options: str, seed: object, *parts: str) -> str:
    """Lambda variables sx and si must not be in the parts."""
    return f"list_transform(list_sort(list_transform({options}, lambda sx, si: {{'k': {key(seed, *parts, 'si - 1')}, 'x': sx}})), lambda sx: sx.x)"


def ordered_distinct(options: str) -> str:
    return f"list_filter({options}, lambda dx, di: list_position({options}, dx) = di)"


def but(options: str, *gone: str) -> str:
    return f"list_filter({options}, lambda bx: bx NOT IN ({', '.join(gone)}))"


def upper(s: str) -> str:
    """As the JVM does it: a sharp s becomes two letters."""
    return f"replace(replace(upper({s}), 'ẞ', 'SS'), 'ß', 'SS')"


def spell(w: str) -> str:
    return f"array_to_string(string_split({w}, ''), ' ')"


def fold(w: str) -> str:
    return f"translate({w}, '{chars.MARKED}', '{chars.PLAIN}')"


def count_char(w: str, c: str) -> str:
    return f"(length({w}) - length(replace({w}, {c}, '')))"


def count_marks(w: str) -> str:
    return f"length(regexp_replace({w}, '[^{chars.DIACRITICS}]', '', 'g'))"


def permuted(w: str, a: str, b: str) -> str:
    return f"array_to_string(list_transform(string_split({w}, ''), lambda px: CASE WHEN px = {a} THEN {b} WHEN px = {b} THEN {a} ELSE px END), '')"


def half_upper(w: str) -> str:
    return f"concat({upper(f'substr({w}, 1, length({w}) // 2)')}, lower(substr({w}, length({w}) // 2 + 1)))"


def random_case(w: str, seed: object) -> str:
    return f"array_to_string(list_transform(string_split({w}, ''), lambda cx, ci: CASE WHEN {uniform(seed, w, 'ci - 1')} < 0.5 THEN {upper('cx')} ELSE lower(cx) END), '')"


def diacritized(w: str, seed: object, share: float = 1.0) -> str:
    marks: dict[str, list[str]] = {}
    for m, p in zip(chars.MARKED, chars.PLAIN, strict=True):
        marks.setdefault(p, []).append(m)
    options = "CASE " + " ".join(f"WHEN {fold('mx')} = '{p}' THEN {pick(str(ms), num(seed, w, 'mi - 1'))}" for p, ms in marks.items()) + " END"
    bare = fold("mx") if share < 1 else "mx"
    return f"array_to_string(list_transform(string_split({w}, ''), lambda mx, mi: CASE WHEN {uniform(f'{seed}-share', w, 'mi - 1')} < {share} THEN coalesce({options}, {bare}) ELSE {bare} END), '')"


def shuffled_word(w: str, seed: object, joint: str) -> str:
    """Another order of a word's characters, joined; the word itself where there is none."""
    a = f"string_split({w}, '')"
    tries = [f"array_to_string({shuffled(a, f'{seed}-{i}', w)}, '{joint}')" for i in range(4)]
    rotated = f"array_to_string(string_split(substr({w}, 2) || substr({w}, 1, 1), ''), '{joint}')"
    own = f"array_to_string({a}, '{joint}')"
    return f"CASE WHEN len(list_distinct({a})) > 1 THEN coalesce({', '.join(f'nullif({t}, {own})' for t in [*reversed(tries), rotated])}, {own}) ELSE {own} END"


def merged_word(w: str, seed: object) -> str:
    """Neighbours joined from the left by chance, at least one pair; pieces joined by spaces."""
    n = f"length({w})"
    size = f"CASE WHEN {uniform(f'{seed}-two', w, 'e.i')} < 0.5 AND {n} - e.i >= 2 THEN 2 WHEN {uniform(f'{seed}-three', w, 'e.i')} < 0.5 AND {n} - e.i >= 3 THEN 3 ELSE 1 END"
    step = f"""CASE WHEN a.skip > 0 THEN {{'skip': a.skip - 1, 'joins': a.joins, 'done': a.done, 'i': e.i}}
      ELSE {{'skip': ({size}) - 1, 'joins': a.joins + (({size}) > 1)::INT, 'done': a.done || CASE WHEN e.i > 0 THEN ' ' ELSE '' END || substr({w}, e.i + 1, {size}), 'i': e.i}} END"""
    folded = f"list_reduce(list_transform(range(-1, {n}), lambda ri: {{'skip': 0, 'joins': 0, 'done': '', 'i': ri::INT}}), lambda a, e: {step})"
    at = f"(({num(f'{seed}-forced', w)}) % greatest({n} - 1, 1))"
    forced = f"trim(concat({spell(f'substr({w}, 1, {at})')}, ' ', substr({w}, {at} + 1, 2), ' ', {spell(f'substr({w}, {at} + 3)')}))"
    return f"CASE WHEN {n} < 2 THEN {w} WHEN ({folded}).joins > 0 THEN ({folded}).done ELSE {forced} END"


def perturbations(w: str, seed: object) -> str:
    n = f"length({w})"
    at, letter = f"(({num(f'{seed}-at', w)}) % ({n} + 1))", f"substr('{chars.ALPHABET}', ({num(f'{seed}-letter', w)}) % 26 + 1, 1)"
    inserted = spell(f"(substr({w}, 1, {at}) || {letter} || substr({w}, {at} + 1))")
    gone = f"(({num(seed, w)}) % greatest({n}, 1))"
    deleted = f"CASE WHEN {n} <= 1 THEN {w} ELSE {spell(f'(substr({w}, 1, {gone}) || substr({w}, {gone} + 2))')} END"
    four = f"[{shuffled_word(w, seed, ' ')}, {merged_word(w, seed)}, {inserted}, {deleted}]"
    return f"({shuffled(four, f'{seed}-three-of-four', w)})[1:3]"


def ordinal(p: str) -> str:
    return f"({p}::VARCHAR || CASE {p} WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END)"


def render(template: str, **values: str) -> str:
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(Q(text))
        if name is not None:
            parts.append(f"({values.get(name, name)})::VARCHAR")
    return " || ".join(parts)


V = chars.VOWELS


def _keep(t: str) -> str:
    """How many consonants of a run before a vowel stay with the syllable before it."""
    cluster = f"substr({t}, 1, 1) IN ('n', 'm') AND substr({t}, 2, 2) IN ({', '.join(map(Q, sorted(syllables.CLUSTERS)))})"
    return f"(CASE WHEN length({t}) <= 2 THEN 0 WHEN length({t}) = 3 THEN 1 WHEN length({t}) = 4 AND {cluster} THEN 1 ELSE 2 END)"


#: (word, syl): the syllables of the distinct words, by runs of consonants before each vowel.
SYLLABLES = f"""(SELECT word, CASE WHEN len(k) = 0 THEN [word] ELSE list_transform(list_transform(range(1, len(k) + 1), lambda i: concat(
      CASE WHEN i = 1 THEN k[i] ELSE substr(k[i], {_keep('k[i]')} + 1) END, CASE WHEN i = len(k) THEN tail ELSE substr(k[i + 1], 1, {_keep('k[i + 1]')}) END)), lambda x: replace(x, 'ŋ', 'ng')) END AS syl
    FROM (SELECT word, regexp_extract_all(replace(word, 'ng', 'ŋ'), '[^{V}]*[{V}]') AS k, regexp_extract(replace(word, 'ng', 'ŋ'), '[^{V}]*$') AS tail FROM {WORDS_SQL}))"""


def stress_of(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '[{chars.ACUTE}]') THEN 'mabilis' WHEN regexp_matches({s}, '[{chars.GRAVE}]') THEN 'malumi' WHEN regexp_matches({s}, '[{chars.CIRCUMFLEX}]') THEN 'maragsa' ELSE 'malumay' END"


def reduplicated(syl: str) -> str:
    return f"coalesce(length({syl}[1]) >= 2 AND length({syl}[2]) >= 2 AND substr({syl}[1], 1, 2) = substr({syl}[2], 1, 2), false)"


def reduplicated_syllable(syl: str) -> str:
    return f"CASE WHEN {syl}[1] = {syl}[2] THEN {syl}[1] WHEN {reduplicated(syl)} THEN substr({syl}[1], 1, 2) END"


#: (word, norm, syl, nsyl, acc, kind): the lexicon of the generators.
LEXICON = f"""(SELECT word, {fold('word')} AS norm, syl, list_transform(syl, lambda x: {fold('x')}) AS nsyl,
      coalesce(list_position(list_transform(syl, lambda x: regexp_matches(x, '[{chars.ACCENTED_VOWELS}]')), true), 0) - 1 AS acc, {stress_of('syl[-1]')} AS kind
    FROM {SYLLABLES} WHERE length(word) >= 3)"""


def row(category: str, subcategory: str, texts: tuple[str, str], answer: str, wrong: str | None, order: str) -> str:
    """The columns of a task row as the queries show it."""
    said = "NULL::VARCHAR" if wrong is None else f"array_to_string({wrong}, '|')"
    return f"{Q(category)} AS category, {subcategory} AS subcategory, {texts[0]} AS text_en, {texts[1]} AS text_tl, ({answer})::VARCHAR AS answer, {said} AS wrong, ({order})::VARCHAR AS key"


def rendered(pair: tuple[str, str], **values: str) -> tuple[str, str]:
    return render(pair[0], **values), render(pair[1], **values)


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"(SELECT * FROM ({p}))" for p in parts)
