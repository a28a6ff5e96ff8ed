"""DuckDB SQL of the task generators' queries, written from the task rules on the helpers of ``sqltext``."""

from __future__ import annotations

from ..functions import chars, syllables
from ..plans import prompts
from ..plans.tasks import ROUND_IDS, ROUNDS
from .base import LETTERS, WORDS_SQL
from .sqltext import (
    ALPHABET, LEXICON, Q, SYLLABLES, but, count_char, count_marks, diacritized, fold, half_upper, key, num, ordered_distinct, ordinal, permuted, perturbations, pick,
    random_case, reduplicated, reduplicated_syllable, render, rendered, row, shuffled, shuffled_word, spell, stress_of, union, upper,
)

N, SEED = 20, 100
#: Distinct words as they are written, capitals kept.
WRITTEN = f"(SELECT DISTINCT w AS word, {fold('w')} AS norm FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents) WHERE length(w) >= 3)"
NAMES = {"normalized_word": "norm"}


def _sampled(least: int, seed: object, where: str = "true", source: str = LEXICON) -> str:
    return f"(SELECT * FROM {source} WHERE length(norm) >= {least} AND {where} ORDER BY {key(seed, 'norm')}, norm, word LIMIT {N})"


# --- composition -----------------------------------------------------------------------------


def composition(form: str) -> str:
    if form == "gen":
        letter = f"substr(norm, {num(SEED, 'norm')} % length(norm) + 1, 1)"
        parts = [
            ("spelling", prompts.SPELLING_GEN, spell("norm"), "true"),
            ("character", prompts.CHARACTER_GEN, count_char("norm", f"({letter})"), "true"),
            ("length", prompts.LENGTH_GEN, "length(norm)", "true"),
            ("diacritic", prompts.DIACRITIC_GEN, count_marks("word"), f"{count_marks('word')} > 0"),
            ("uppercase", prompts.UPPERCASE_GEN, r"length(regexp_replace(norm, '[^\p{Lu}]', '', 'g'))", r"regexp_matches(norm, '\p{Lu}')"),
        ]
        return union([f"SELECT {row('composition', Q(kind), rendered(texts, character=letter, **NAMES), answer, None, 'norm')} FROM {_sampled(3, SEED + i, where, WRITTEN)}" for i, (kind, texts, answer, where) in enumerate(parts)])
    spelling = f"SELECT {row('composition', Q('spelling'), rendered(prompts.SPELLING_MCQ, **NAMES), spell('norm'), perturbations('norm', SEED), 'norm')} FROM {_sampled(3, SEED, source=WRITTEN)}"
    return union([spelling, *[_group(kind) for kind in ("character_exactly", "character_most", "character_least", "diacritic_exactly", "uppercase_exactly", "length_exactly", "length_most", "length_least")]])


def _letter(words: str) -> str:
    """The chosen letter of four words: one that they have in four different numbers."""
    letters = f"list_sort(list_distinct(flatten(list_transform({words}, lambda gw: string_split(gw, '')))))"
    apart = f"list_filter({letters}, lambda gl: len(list_distinct(list_transform({words}, lambda gw: {count_char('gw', 'gl')}))) = 4)"
    return pick(apart, num(SEED, f"array_to_string({words}, '|')"))


def rounds(subject: str, n: int) -> str:
    """(g, ws, char, counts) of unambiguous groups: rounds over the words left, each of them empty once there are n."""
    source, char, count, where = {
        "length": ("words", "''", "length(x)", "len(list_distinct(counts)) = 4"),
        "character": ("words", _letter("words"), count_char("x", "char"), "char IS NOT NULL AND len(list_distinct(counts)) = 4"),
        "diacritic": ("marked", "'diacritic'", count_marks("x"), "list_sum(counts) = 1"),
        "uppercase": ("words", "'uppercase'", r"length(regexp_replace(x, '[^\p{Lu}]', '', 'g'))", "list_sum(counts) = 1"),
    }[subject]
    parts = []
    for i in range(ROUNDS):
        before = " UNION ALL ".join(f"SELECT marked FROM a{k}" for k in range(i))
        words = f"SELECT norm, word FROM {WRITTEN}" if not i else f"SELECT norm, word FROM w0 WHERE (SELECT count(*) FROM ({before})) < {n} AND word NOT IN (SELECT unnest(marked) FROM ({before}))"
        numbered = f"SELECT norm, word, row_number() OVER (ORDER BY {key(SEED if not i else f'{SEED}-{i}', 'norm')}, norm, word) - 1 AS r FROM w{i}"
        groups = f"SELECT {i * ROUND_IDS} + r // 4 AS g, list(norm ORDER BY r) AS words, list(word ORDER BY r) AS marked FROM ({numbered}) GROUP BY 1 HAVING count(*) = 4 AND count(DISTINCT norm) = 4"
        counted = f"SELECT g, ws, char, marked, list_transform(ws, lambda x: {count}) AS counts FROM (SELECT g, marked, {source} AS ws, {char} AS char FROM ({groups}))"
        parts.append(f"w{i} AS MATERIALIZED ({words}), a{i} AS MATERIALIZED (SELECT * FROM ({counted}) WHERE {where})")
    return f"(WITH {', '.join(parts)} {' UNION ALL '.join(f'SELECT g, ws, char, counts FROM a{i}' for i in range(ROUNDS))})"


def _group(kind: str) -> str:
    subject, _, how = kind.partition("_")
    wanted = {"most": "list_max(counts)", "least": "list_min(counts)"}.get(how, "1" if subject in ("diacritic", "uppercase") else "counts[1]")
    texts = {"length_exactly": prompts.LENGTH_EXACTLY, "length_most": prompts.LENGTH_MOST, "length_least": prompts.LENGTH_LEAST, "character_most": prompts.CHAR_MOST, "character_least": prompts.CHAR_LEAST}.get(kind, prompts.CHAR_EXACTLY)
    right = f"ws[list_position(counts, {wanted})]"
    wrong = f"({but(ordered_distinct('ws'), right)})[1:3]"
    made = row("composition", Q(kind), rendered(texts, target_count=wanted, target_length=wanted, char="char"), right, wrong, "lpad(g::VARCHAR, 12, '0')")
    return f"SELECT {made} FROM {rounds(subject, N)} ORDER BY g LIMIT {N}"


GROUP_CHARACTERS = f"""SELECT g AS group_id, ws[list_position(counts, list_max(counts))] AS answer, {render(prompts.CHAR_MOST[0], char='char')} AS question
  FROM (SELECT g, ws, char, list_transform(ws, lambda x: {count_char('x', 'char')}) AS counts FROM (SELECT g, words AS ws, {_letter('words')} AS char
    FROM (SELECT r // 4 AS g, list(word ORDER BY r) AS words FROM (SELECT word, row_number() OVER (ORDER BY {key(SEED, 'word')}, word) - 1 AS r FROM {WORDS_SQL} WHERE length(word) >= 3) GROUP BY 1 HAVING count(*) = 4)))
  WHERE char IS NOT NULL AND len(list_distinct(counts)) = 4"""


# --- manipulation ----------------------------------------------------------------------------


def manipulation(form: str) -> str:
    own = "list_sort(list_distinct(string_split(norm, '')))"
    one = f"SELECT *, {pick(own, num('100-a', 'norm'))} AS a FROM {WRITTEN} WHERE length(norm) >= 5"
    two = f"SELECT *, {pick(but(ALPHABET, 'a'), num('100-new', 'norm'))} AS new FROM ({one})"
    three = f"SELECT *, coalesce({pick(but(own, 'a'), num('100-b', 'norm'))}, new) AS b FROM ({two})"
    source = f"(SELECT *, coalesce({pick(but(own, 'a', 'b'), num('100-other', 'norm'))}, new) AS other FROM ({three}))"
    done = {"deletion": "replace(norm, a, '')", "insertion": "replace(norm, a, a || new)", "substitution": "replace(norm, a, new)", "permutation": permuted("norm", "a", "b"), "duplication": "replace(norm, a, a || a)"}
    astray = {
        "deletion": "replace(norm, other, '')", "insertion": "replace(norm, other, other || new)", "substitution": "replace(norm, other, new)",
        "permutation": permuted("norm", "a", "(CASE WHEN other <> b THEN other ELSE new END)"), "duplication": "replace(norm, other, other || other)",
    }
    names = {"char_to_delete": "a", "char_to_insert": "new", "preceding_char": "a", "char_to_replace": "a", "char_to_substitute": "new", "char1": "a", "char2": "b", "char_to_duplicate": "a", **NAMES}
    texts = prompts.MANIPULATION_MCQ if form == "mcq" else prompts.MANIPULATION_GEN
    parts = []
    for i, (kind, right) in enumerate(done.items()):
        others = f"[{', '.join(['norm', *[x for k, x in done.items() if k != kind]])}]"
        first = f"CASE WHEN {astray[kind]} <> answer THEN {astray[kind]} ELSE answer || new END"
        rows = f"(SELECT *, {right} AS answer FROM {_sampled(5, SEED + i, source=source)})"
        listed = f"(SELECT *, list_concat([{first}], {but(shuffled(others, f'100-{kind}', 'norm'), 'answer')}) AS options FROM {rows})"
        parts.append(f"SELECT {row('manipulation', Q(kind), rendered(texts[kind], **names), 'answer', f'({ordered_distinct("options")})[1:3]' if form == 'mcq' else None, 'norm')} FROM {listed}")
    mixed, half = random_case("norm", SEED), half_upper("norm")
    mcq = lambda *options: f"[{', '.join(options)}]" if form == "mcq" else None
    cased = r"regexp_matches(norm, '\p{L}')"
    parts.append(f"SELECT {row('manipulation', Q('uppercasing'), rendered(texts['uppercasing'], **NAMES), upper('norm'), mcq('lower(norm)', half, mixed), 'norm')} FROM {_sampled(5, 105, cased, WRITTEN)}")
    parts.append(f"SELECT {row('manipulation', Q('lowercasing'), rendered(texts['lowercasing'], **NAMES), 'lower(norm)', mcq(half, mixed, upper('norm')), 'norm')} FROM {_sampled(5, 106, cased, WRITTEN)}")
    bare = fold("word")
    marks = f"list_transform([word, {diacritized('word', 100)}, {diacritized('word', 101, 0.5)}], lambda vx: CASE WHEN vx = {bare} THEN {shuffled_word('word', '100-m', '')} ELSE vx END)"
    parts.append(f"SELECT {row('manipulation', Q('diacritic_normalization'), rendered(texts['diacritic_normalization'], word='word'), bare, marks if form == 'mcq' else None, 'norm')} FROM {_sampled(5, 107, count_marks('word') + ' > 0', WRITTEN)}")
    return union(parts)


MCQ_ITEMS = f"""SELECT subcategory, key, text_en, answer, label FROM (
  SELECT subcategory, key, text_en, answer, substr('ABCD', ((row_number() OVER (ORDER BY subcategory, key, text_en) - 1) % 4 + 1)::INT, 1) AS label FROM ({manipulation('mcq')}) WHERE len(string_split(wrong, '|')) = 3)"""


# --- syllables and stress --------------------------------------------------------------------


def _label(kind: str, labels: dict[str, str]) -> str:
    return f"(CASE {kind} {' '.join(f'WHEN {Q(k)} THEN {Q(v)}' for k, v in labels.items())} END)"


def _labels_but(right: str, labels: dict[str, str]) -> str:
    return but(f"[{', '.join(map(Q, labels.values()))}]", right)


def syllabification(form: str) -> str:
    mcq = form == "mcq"
    right = _label("kind", syllables.STRESS_LABELS)
    stress = f"SELECT {row('syllabification', Q('stress'), rendered(prompts.STRESS, word='word', **NAMES), right, _labels_but(right, syllables.STRESS_LABELS) if mcq else None, 'norm')} FROM {_sampled(3, SEED)}"
    if mcq:
        each = f"SELECT DISTINCT norm, {reduplicated('nsyl')} AS doubled FROM {LEXICON}"
        numbered = f"(SELECT norm, doubled, row_number() OVER (PARTITION BY doubled ORDER BY {key(SEED, 'norm')}, norm) - 1 AS r FROM ({each}))"
        plain = f"(SELECT r // 4 AS g, list(norm ORDER BY r)[1:3] AS plain FROM {numbered} WHERE NOT doubled GROUP BY 1 HAVING count(*) = 4)"
        redup = f"SELECT {row('syllabification', Q('reduplication'), rendered(prompts.REDUPLICATION_MCQ), 'norm', 'plain', 'norm')} FROM {numbered} n JOIN {plain} p ON n.r = p.g WHERE doubled ORDER BY r LIMIT {N}"
    else:
        redup = f"SELECT {row('syllabification', Q('reduplication'), rendered(prompts.REDUPLICATION_GEN, **NAMES), reduplicated_syllable('nsyl'), None, 'norm')} FROM {_sampled(3, SEED + 1, reduplicated('nsyl'))}"
    near = "list_filter([len(nsyl) - 1, len(nsyl) + 1, len(nsyl) + 2], lambda x: x > 0)"
    wrong = f"(list_concat({near}, [len(nsyl), len(nsyl), len(nsyl)]))[1:3]" if mcq else None
    shown = lambda kind: row("syllabification", Q(kind), rendered(prompts.SYLLABLES, **NAMES), "len(nsyl)", wrong, "norm")
    ng = f"(SELECT * FROM {LEXICON} ORDER BY (NOT contains(norm, 'ng'))::INT, {key(SEED + 2, 'norm')}, norm, word LIMIT {N})"
    return union([stress, redup, f"SELECT {shown('syllable_counting_ng')} FROM {ng}", f"SELECT {shown('syllable_counting')} FROM {_sampled(7, SEED + 3)}"])


def stress_benchmark() -> str:
    entries = "list({'word': word, 'norm': norm, 'n': len(nsyl), 'acc': acc, 'kind': kind} ORDER BY word)"
    groups = f"SELECT lower(norm) AS folded, {entries} AS entries FROM {LEXICON} GROUP BY 1 HAVING count(DISTINCT kind) > 1 ORDER BY {key(42, 'folded')}, folded LIMIT {N}"
    chosen = f"(SELECT folded, entries, {pick('entries', num(42, 'folded'))} AS e FROM ({groups}))"
    frames = f"[{', '.join(map(Q, syllables.CONTEXTS['pnb']))}]"
    capital = f"concat({upper('substr(e.norm, 1, 1)')}, lower(substr(e.norm, 2)))"
    context = f"replace(replace({pick(frames, num(42, 'e.norm', Q('pnb')))}, '{{w}}', e.norm), '{{W}}', {capital})"
    at = "(CASE WHEN e.acc >= 0 THEN e.acc + 1 ELSE greatest(e.n, 1) END)"
    names = {"word": "e.norm", "context": f"({context})"}
    labels = syllables.STRESS_BENCHMARK_LABELS
    right = _label("e.kind", labels)
    places = f"list_transform((list_filter([1, 2, 3, 4, 5], lambda x: x <> {at}))[1:3], lambda x: {ordinal('x')})"
    others = "(list_concat(list_filter(list_transform(entries, lambda x: x.word), lambda x: x <> e.word), [e.norm, e.norm, e.norm]))[1:3]"
    parts = [
        row("stress_identification", Q("syllable_position"), rendered(prompts.STRESSED_SYLLABLE, **names), ordinal(at), places, "folded"),
        row("stress_classification", Q("stress_type"), rendered(prompts.STRESS_KIND, **names), right, _labels_but(right, labels), "folded"),
        row("deaccent", Q("accent_placement"), rendered(prompts.ACCENT_MARKS, **names), "e.word", others, "folded"),
    ]
    return union([f"SELECT {p} FROM {chosen}" for p in parts])


_MARKED = f"list_transform(syl, lambda x: regexp_matches(x, '[{chars.ACCENTED_VOWELS}]'))"
LEXICON_BUILD = f"""SELECT word, {fold('word')} AS normalized_word, syl[list_position(marked, true)] AS accented_syllable, (list_position(marked, true) - 1)::BIGINT AS accented_syllable_index,
    syl[-1] AS last_syllable, {stress_of('syl[-1]')} AS last_syllable_pronunciation
  FROM (SELECT word, syl, {_MARKED} AS marked FROM {SYLLABLES}) WHERE len(list_filter(marked, lambda x: x)) = 1"""


# --- levels ----------------------------------------------------------------------------------


def _level(category: str, kind: str, answer: str, wrong: str | None, values: dict[str, str], subcategory: str | None = None) -> str:
    return row(category, subcategory or Q(kind), rendered(prompts.LEVELS[kind], **{"word": "word", **values}), answer, wrong, values.get("word", "word"))


def _three(options: str, right: str, seed: object, by: str = "word") -> str:
    kept = f"list_filter({options}, lambda tx: tx IS NOT NULL AND tx <> {right})"
    return f"({shuffled(ordered_distinct(kept), seed, by)})[1:3]"


def _cut(p: str) -> str:
    return f"concat(substr(word, 1, {p} - 1), substr(word, {p} + 1))"


def _put(p: str, c: str) -> str:
    return f"concat(substr(word, 1, {p} - 1), {c}, substr(word, {p}))"


def _set(p: str, c: str, w: str = "word") -> str:
    return f"concat(substr({w}, 1, {p} - 1), {c}, substr({w}, {p} + 1))"


def _swap(p: str, q: str) -> str:
    return _set(q, f"substr(word, {p}, 1)", f"({_set(p, f'substr(word, {q}, 1)')})")


def word_levels(form: str) -> str:
    mcq = form == "mcq"
    rows = f"SELECT word, length(word) AS n FROM {WORDS_SQL} WHERE length(word) >= 3 ORDER BY {key(42, 'word')}, word LIMIT {N}"
    one = f"SELECT *, {num('42-p', 'word')} % n + 1 AS p, list_sort(list_distinct(string_split(word, ''))) AS letters FROM ({rows})"
    two = f"SELECT *, (p + {num('42-q', 'word')} % (n - 1)) % n + 1 AS q, substr(word, p, 1) AS own, {pick('letters', num('42-c', 'word'))} AS c FROM ({one})"
    absent = pick(f"list_filter({ALPHABET}, lambda x: NOT list_contains(letters, x))", num("42-absent", "word"))
    source = f"""(SELECT *, {count_char('word', 'c')} AS count, {pick(but(ALPHABET, 'own'), num('42-new', 'word'))} AS new,
      CASE WHEN {num('42-has', 'word')} % 2 = 0 THEN c ELSE coalesce({absent}, c) END AS asked FROM ({two}))"""
    at = {"position": "p", "ordinal": ordinal("p")}
    every = lambda f: f"list_transform(range(1, n + 1), lambda ei: {f})"
    wrong = lambda f, right, tag: _three(every(f), f"({right})", f"42-{tag}") if mcq else None
    strange = f"({shuffled(f'list_filter({ALPHABET}, lambda x: NOT list_contains(letters, x))', 42, 'word')})[1:3]"
    near = "(list_filter([count - 1, count + 1, count - 2, count + 2], lambda x: x >= 0))[1:3]"
    parts = [
        _level("recognition", "character_identification", "own", _three(f"list_concat(letters, {strange})", "own", 42) if mcq else None, at),
        _level("recognition", "character_counting", "count", near if mcq else None, {"char": "c"}),
        _level("recognition", "character_presence", "CASE WHEN contains(word, asked) THEN 'Yes' ELSE 'No' END", None, {"char": "asked"}),
        _level("manipulation", "deletion", _cut("p"), wrong(_cut("ei"), _cut("p"), "del"), at),
        _level("manipulation", "insertion", _put("p", "new"), wrong(_put("ei", "new"), _put("p", "new"), "ins"), {"position": "p", "char": "new"}),
        _level("manipulation", "substitution", _set("p", "new"), wrong(_set("ei", "new"), _set("p", "new"), "sub"), {**at, "char": "new"}),
        _level("manipulation", "permutation", _swap("p", "q"), wrong(_swap("ei", "(ei % n + 1)"), _swap("p", "q"), "swap"), {"pos1": "p", "pos2": "q"}),
    ]
    return union([f"SELECT {p} FROM {source}" for p in parts])


#: (word, root, kind, affix, n): the words of six letters or more, cut as the queries cut them.
ANNOTATED = f"""(SELECT word, length(word) % 2 = 0 AS even, CASE WHEN length(word) % 2 = 0 THEN substr(word, 3) ELSE substr(word, 1, length(word) - 2) END AS root,
      CASE WHEN length(word) % 2 = 0 THEN 'prefix' ELSE 'suffix' END AS kind, CASE WHEN length(word) % 2 = 0 THEN substr(word, 1, 2) ELSE substr(word, length(word) - 1) END AS affix
    FROM {WORDS_SQL} WHERE length(word) >= 6)"""


def affix_levels() -> str:
    rows = f"SELECT a.word, root, kind, affix, len(syl) AS count FROM {ANNOTATED} a JOIN {SYLLABLES} s ON a.word = s.word ORDER BY {key(42, 'a.word')}, a.word LIMIT {N}"
    buckets = f"greatest(1, (SELECT count(DISTINCT root) FROM {ANNOTATED}) // 4)"
    drawn = f"SELECT bucket, arg_min(root, k || root) AS other FROM (SELECT root, {num('42-bucket', 'root')} % {buckets} AS bucket, {key(42, 'root')} AS k FROM (SELECT DISTINCT root FROM {ANNOTATED})) GROUP BY bucket"
    others = f"SELECT word, list_sort(list(DISTINCT other)) AS others FROM (SELECT word, {num(42, 'word', 'i')} % {buckets} AS bucket FROM (SELECT word, unnest(range(8)) AS i FROM picked)) JOIN ({drawn}) USING (bucket) GROUP BY word"
    sketch = lambda by: f"SELECT {by}, word AS other FROM (SELECT {by}, word, row_number() OVER (PARTITION BY {by} ORDER BY {key('42-related', 'word')}, word) AS r FROM {ANNOTATED}) WHERE r <= 21"
    shared = " UNION ".join(f"SELECT word, kind, affix, other FROM picked JOIN ({sketch(by)}) USING ({by}) WHERE other <> word" for by in ("root", "kind, affix"))
    related = f"SELECT word, kind, affix, list_sort((list(other ORDER BY {key('42-related', 'other')}, other))[1:20]) AS related FROM ({shared}) GROUP BY word, kind, affix"
    pools = f"SELECT kind, list_sort(list(DISTINCT affix)) AS pool FROM {ANNOTATED} GROUP BY kind"
    near = "(list_filter([count - 1, count + 1, count + 2, count - 2], lambda x: x > 0))[1:3]"
    values = {"affix_type": "kind", "affix": "affix", "root": "root"}
    plain = "affix || root"
    applied = f"(list_concat({_three('coalesce(related, [])', 'word', 42)}, [{plain}, {plain}, {plain}]))[1:3]"
    joined = lambda r: f"(CASE WHEN kind = 'prefix' THEN affix || {r} ELSE {r} || affix END)"
    pairs = f"SELECT word, root, kind, affix, row_number() OVER (ORDER BY {key('42-pairs', 'word')}, word) - 1 AS r FROM {ANNOTATED}"
    both = "SELECT a.word, a.root, b.kind, b.affix, b.root AS other_root FROM pairs a JOIN pairs b ON b.r = a.r + 1 WHERE a.r % 2 = 0 ORDER BY a.r LIMIT 20"
    turned = "(CASE WHEN kind = 'prefix' THEN root || affix ELSE affix || root END)"
    multi = f"({but(f'[{joined("other_root")}, {turned}, {joined("word")}, root]', joined('root'))})[1:3]"
    parts = [
        f"SELECT {_level('morphology', 'affix_identification', 'affix', _three('pool', 'affix', '42-id'), values, Q('affix_identification_') + ' || kind')} FROM out_",
        f"SELECT {_level('morphology', 'root_extraction', 'root', _three('others', 'root', '42-root'), values)} FROM out_",
        f"SELECT {_level('morphology', 'syllable_counting', 'count', near, values)} FROM out_",
        f"SELECT {_level('decomposition', 'affix_removal', 'root', _three('list_append(others, word)', 'root', '42-rem'), values, Q('affix_removal_') + ' || kind')} FROM out_",
        f"SELECT {_level('composition', 'affix_application', 'word', applied, values, Q('affix_application_') + ' || kind')} FROM out_",
        f"SELECT {_level('reasoning', 'multi_step', joined('root'), multi, {'affix_type': 'kind', 'affix': 'affix'})} FROM ({both})",
    ]
    return f"""WITH picked AS ({rows}), pairs AS ({pairs}), pools AS ({pools}), others AS ({others}), related AS ({related}),
out_ AS (SELECT picked.*, pool, coalesce(others, []) AS others, related FROM picked JOIN pools USING (kind) LEFT JOIN others USING (word) LEFT JOIN related USING (word, kind, affix))
{union(parts)}"""


# --- affixation ------------------------------------------------------------------------------


def subsequences(table: str) -> str:
    """(affix, piece): every subsequence of the short strings of ``table`` (affix)."""
    return f"""(SELECT DISTINCT affix, array_to_string(list_transform(list_filter(range(1, length(affix) + 1), lambda i: (mask >> (i - 1)) & 1 = 1), lambda i: substr(affix, i, 1)), '') AS piece
    FROM (SELECT affix, unnest(range(0, (1 << length(affix)::INT)::BIGINT)) AS mask FROM {table}))"""


def similar(table: str, top: int = 3) -> str:
    """(affix, place, other, ratio): the most similar other affixes by twice the longest common subsequence over both lengths."""
    common = f"SELECT a.affix, b.affix AS other, max(length(a.piece)) AS lcs FROM {subsequences(table)} a JOIN {subsequences(table)} b ON a.piece = b.piece AND a.affix <> b.affix GROUP BY 1, 2"
    ratio = f"SELECT affix, other, round(2.0 * lcs / (length(affix) + length(other)), 6)::DOUBLE AS ratio FROM ({common})"
    return f"(SELECT * FROM (SELECT affix, other, ratio, row_number() OVER (PARTITION BY affix ORDER BY ratio DESC, other) AS place FROM ({ratio})) WHERE place <= {top})"


def affixation(form: str) -> str:
    mcq = form == "mcq"
    texts = prompts.AFFIX_MCQ if mcq else prompts.AFFIX_GEN
    names = {"prefix": "affix", "suffix": "affix", "root": "root", "infix": "''"}
    said = tuple(f"(CASE kind WHEN 'prefix' THEN {render(texts['prefix'][i], **names)} ELSE {render(texts['suffix'][i], **names)} END)" for i in (0, 1))
    inflection = f"SELECT {row('affixation', Q('inflection_') + ' || kind', said, 'word', '[CASE WHEN reverse(word) = word THEN word || ' + Q('a') + ' ELSE reverse(word) END, root, word || ' + Q('s') + ']' if mcq else None, 'word')} FROM {ANNOTATED}"
    identified = rendered(prompts.AFFIX_ID_MCQ if mcq else prompts.AFFIX_ID_GEN, correct="word")
    source = ANNOTATED
    if mcq:
        near = f"SELECT affix, list(other ORDER BY place) AS near FROM {similar(f'(SELECT DISTINCT affix FROM {ANNOTATED})')} GROUP BY affix"
        source = f"(SELECT * FROM {ANNOTATED} JOIN ({near}) USING (affix))"
    named = f"SELECT {row('affixation', Q('identification_') + ' || kind', identified, 'affix', 'near' if mcq else None, 'word')} FROM {source}"
    return union([inflection, named])


# --- games and sums --------------------------------------------------------------------------


def language_game(game: str, n: int = 50) -> str:
    listed = f"(SELECT list(word ORDER BY word) AS words FROM (SELECT lower(w) AS word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 2 AND length(lower(w)) <= 11 ORDER BY c DESC, word LIMIT 1000))"
    one = f"SELECT id, {shuffled('words', 0, 'id')} AS words FROM range(0, {n}) t(id), {listed}"
    two = f"SELECT *, words[1] AS head, {num('0-n', 'id')} % least(3, length(words[1])) + 1 AS span FROM ({one})"
    aux = {
        "most": f"substr('abcdefghijklmnopqrstuvwxyz', {num('0-l', 'id')} % 26 + 1, 1)", "contains": f"substr(head, {num('0-s', 'id')} % (length(head) - span + 1) + 1, span)",
        "starts": "substr(head, 1, span)", "ends": "substr(head, length(head) - span + 1, span)",
    }.get(game, "''")
    yes, no = {
        "most": (count_char("x", "aux") + " >= 2", count_char("x", "aux") + " <= 1"), "contains": ("contains(x, aux)", "NOT contains(x, aux)"), "starts": ("starts_with(x, aux)", "NOT starts_with(x, aux)"),
        "ends": ("ends_with(x, aux)", "NOT ends_with(x, aux)"), "longest": ("length(x) >= 7", "length(x) <= 4"), "shortest": ("length(x) <= 3", "length(x) >= 6"),
    }[game]
    three = f"SELECT id, aux, (list_filter(words, lambda x: {yes}))[1] AS answer, (list_filter(words, lambda x: {no}))[1:3] AS wrong FROM (SELECT *, {aux} AS aux FROM ({two}))"
    four = f"SELECT *, list_prepend(answer, wrong) AS options, {num('0-r', 'id')} % 4 AS turn FROM ({three}) WHERE answer IS NOT NULL AND len(wrong) = 3"
    choose = lambda xs, tag: pick(f"[{', '.join(map(Q, xs))}]", num(f"0-{tag}", "id"))
    fill = lambda t: f"replace(replace(replace({t}, '<OPTIONS>', {choose(prompts.OPTIONS, 'os')}), '<OPTION>', {choose(prompts.OPTION, 'o')}), '<THE>', {choose(prompts.THE, 't')})"
    capital = lambda t: f"concat(upper(substr({t}, 1, 1)), substr({t}, 2))"
    asked = f"concat({capital(fill(choose(prompts.GAME_OPENINGS, 'q')))}, ' ', replace({Q(prompts.GAMES[game])}, '<AUX>', aux))"
    listing = f"concat({capital(fill(choose(prompts.GAME_LISTS, 'ls')))}, ' [ ', array_to_string(list_concat(options[turn + 1:], options[1:turn]), ', '), ']. ')"
    listing = listing.replace("']. ')", "'].')")
    five = f"SELECT *, {asked} AS asked, {listing} AS listing FROM ({four})"
    return f"SELECT id, concat(CASE WHEN {num('0-ord', 'id')} % 2 = 0 THEN asked || ' ' || listing ELSE listing || ' ' || asked END, ' Answer:') AS question, answer, array_to_string(options, '|') AS options FROM ({five})"


ADDITION_OPTIONS = f"""SELECT id // 100 || '+' || id % 100 || '=' AS question, s AS answer, array_to_string(({shuffled('good', 0, 's')})[1:3], '|') AS wrong
  FROM (SELECT *, {ordered_distinct("list_filter(candidates, lambda x: x <> s AND regexp_full_match(x, '[1-9][0-9]*'))")} AS good FROM (
    SELECT *, [(x + 1 + k % 20)::VARCHAR, (x - 1 - k % 20)::VARCHAR, reverse(s), CASE WHEN length(s) > 1 THEN substr(s, 1, length(s) - 1) ELSE (x * 10)::VARCHAR END, s || (k % 10)::VARCHAR,
      CASE WHEN x % 10 < 5 THEN (x + 10)::VARCHAR ELSE (x - 10)::VARCHAR END, CASE WHEN x >= 100 THEN (x + 100)::VARCHAR ELSE (x + 10)::VARCHAR END, (x + 21 + k % 29)::VARCHAR, (x + 51)::VARCHAR, (x + 52)::VARCHAR] AS candidates
    FROM (SELECT id, id // 100 + id % 100 AS x, (id // 100 + id % 100)::VARCHAR AS s, {num(0, '(id // 100 + id % 100)::VARCHAR')} AS k FROM (SELECT id FROM range(1000, 10000) t(id) ORDER BY (id * 48271) % 2147483647, id LIMIT 100))))"""
