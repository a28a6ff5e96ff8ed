"""Character, syllable and token functions on exact cases."""

import json
import random
import re
import time

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talata.functions import chars, syllables, tokens
from talata.operators import expand, vocabulary
from talata.operators.places import Places


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_characters(spark):
    h = F.lit("hello")
    r = one(
        spark,
        delete=chars.delete_char(h, F.lit("l")),
        insert=chars.insert_char(h, F.lit("l"), F.lit("x")),
        substitute=chars.substitute_char(h, F.lit("l"), F.lit("r")),
        permute=chars.permute_char(h, F.lit("h"), F.lit("o")),
        duplicate=chars.duplicate_char(h, F.lit("l")),
        fold=chars.normalize_diacritics(F.lit("á é í ó ú")),
        spelled=chars.spell(h),
        empty=chars.spell(F.lit("")),
        none=chars.delete_char(F.lit(None).cast("string"), F.lit("l")),
        capital=chars.capitalize(F.lit("mAG aral")),
        at=chars.delete_at(h, F.lit(9)),
        swapped=chars.swap_at(h, F.lit(1), F.lit(5)),
        ratio=chars.similarity_ratio(F.lit("mag"), F.lit("nag")),
        first=chars.ordinal(F.lit(21)),
    )
    assert r.asDict() == {
        "delete": "heo", "insert": "helxlxo", "substitute": "herro", "permute": "oellh", "duplicate": "hellllo", "fold": "a e i o u", "spelled": "h e l l o", "empty": "", "none": None,
        "capital": "Mag aral", "at": "hello", "swapped": "oellh", "ratio": pytest.approx(4 / 6), "first": "21th",
    }


def test_random_characters_keep_their_invariants(spark):
    words = ["hello", "aaa", "ab", "x", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    a = chars.to_chars(F.col("w"))
    for parts in (1, 4):
        rows = {r.w: r for r in df.repartition(parts).select("w", chars.shuffle_chars(a, 1).alias("s"), chars.merge_random_chars(a, 1).alias("m"), chars.delete_random_char(a, 1).alias("d"), chars.insert_random_char(a, 1).alias("i"), chars.diacritize(F.col("w"), 1).alias("marked")).collect()}
        assert sorted(rows["hello"].s) == sorted("hello") and rows["hello"].s != list("hello")
        assert rows["aaa"].s == list("aaa")  # no other order
        assert all("".join(rows[w].m) == w for w in words) and len(rows["hello"].m) < 5 and rows["ab"].m == ["ab"]
        assert len(rows["hello"].d) == 4 and rows["x"].d == ["x"] and len(rows["hello"].i) == 6
        assert rows["hello"].marked != "hello"
        first = rows if parts == 1 else first
    assert first["hello"] == rows["hello"]


def test_syllables(spark):
    assert syllables.split_syllables("kumain") == ["ku", "ma", "in"]
    assert syllables.split_syllables("magandá") == ["ma", "gan", "dá"]
    assert syllables.split_syllables("sombrero") == ["som", "bre", "ro"]
    assert syllables.split_syllables("mag-aral") == ["mag", "a", "ral"]
    assert syllables.split_syllables("") == []
    df = spark.createDataFrame([("kumain",), (None,), ("",)], "w string")
    assert [r.s for r in df.select(syllables.syllabify(F.col("w")).alias("s")).collect()] == [["ku", "ma", "in"], None, []]
    arr = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, a=syllables.is_reduplicated(arr("ba", "ba", "e")), b=syllables.is_reduplicated(arr("ma", "gan", "da")), c=syllables.accented_syllable(arr("ma", "gan", "dá")), d=syllables.stress_type(F.lit("dá")), e=syllables.accented_syllable(arr("a")))
    assert (r.a, r.b, r.c.at, r.d, r.e.at) == (True, False, 2, "mabilis", -1)


def test_tokens(spark):
    word = F.lit("tumakbo")
    r = one(
        spark,
        bounds=tokens.token_boundaries(F.array(*map(F.lit, ["tum", "ak", "bo"])), word),
        cut=tokens.cut_at(word, F.array(F.lit(3), F.lit(1), F.lit(9))),
        pair=tokens.split_repeated_pair(F.lit("gaganda")),
        no_pair=tokens.split_repeated_pair(F.lit("abc")),
        padded=tokens.pad_truncate(F.array(F.lit(1), F.lit(2)), 4),
        cut_off=tokens.pad_truncate(F.array(F.lit(1), F.lit(2)), 1),
        infix=tokens.infix_position(word, F.lit("takbo"), F.lit("um")),
        affix=tokens.parse_affix(F.lit("mag--an")),
        inner=tokens.parse_affix(F.lit("-um-")),
        ids=tokens.char_tokens(F.lit("aé")),
        ways=vocabulary.splits_of(F.lit("abcd"), 3),
        score=vocabulary.split_score(F.array(F.lit("ma"), F.lit("ka"))),
    )
    assert r.bounds == [3, 5] and r.cut == ["t", "um", "akbo"] and r.pair == ["ga", "ganda"] and r.no_pair == ["abc"]
    assert r.padded == [1, 2, 0, 0] and r.cut_off == [1] and r.infix == 1 and r.ids == [97, 0]
    assert (r.affix.affix, r.affix.kind, r.inner.affix, r.inner.kind) == ("mag-an", "circumfix", "um", "infix")
    assert r.ways == [["a", "b", "cd"], ["a", "bc", "d"], ["ab", "c", "d"]] and r.score == 5 + 3 + 1 + 2 * 0.5 + 2 * 1.5


TOKENS = {i: c.encode() for i, c in enumerate(["a", "b", "c", "ab", "bc", "abc", "ma"])}
PAIRS = {3: [(0, 1)], 4: [(1, 2)], 5: [(0, 4), (3, 2)]}
EDITS = (expand.expand, expand.contract, expand.selective_expand, expand.affix_contract, expand.cycles, expand.contract_expand)


def test_token_edits_keep_the_text():
    t = expand.Tables(PAIRS, TOKENS, ["ab"])
    ids = [5, 3, 4, 0, 1] * 8
    for seed in range(20):
        for edit in EDITS:
            out = edit(ids, t, expand.generator(seed, "k"))
            assert t.decode(out) == t.decode(ids) and ids == [5, 3, 4, 0, 1] * 8
        assert len(ids) < len(expand.expand(ids, t, expand.generator(seed, 1), 0.5)) <= len(ids) + len(ids) // 2
    assert expand.expand([3, 3], t, expand.generator(0, 0), 1.0, skip_affixes=True) == [3, 3]  # affixes alone: it ends
    assert all(edit([], t, expand.generator(0, 0)) == [] for edit in EDITS)


def plain(edit, ids, t, draws, share=0.3):
    """The edits on plain lists, every place looked for anew at each step."""
    out = list(ids)
    for step in range(int(len(ids) * share)):
        if edit is expand.expand:
            able = liked = list(range(len(out)))
        elif edit is expand.contract:
            able = liked = list(range(len(out) - 1))
        elif edit is expand.selective_expand:
            able = [i for i, x in enumerate(out) if x in t.expansions]
            liked = [i for i in able if out[i] not in t.affix_ids] or able
        else:
            able = [i for i in range(len(out) - 1) if (out[i], out[i + 1]) in t.contractions]
            liked = [i for i in able if t.contractions[out[i], out[i + 1]] in t.affix_ids]
            liked = liked if liked and draws.number(step, "prefer") < 0.7 * 2**32 else able
        if not able:
            break
        i = liked[draws.number(step, "at") % len(liked)]
        if edit in (expand.expand, expand.selective_expand):
            if ways := t.expansions.get(out[i]):
                out[i : i + 1] = ways[draws.number(step, "pair") % len(ways)]
        elif (merged := t.contractions.get((out[i], out[i + 1]))) is not None:
            out[i : i + 2] = [merged]
    return out


def test_token_edits_equal_plain_lists():
    rng = random.Random(2)
    t = expand.Tables(PAIRS, TOKENS, ["ab"])
    for n in (1, 2, 5, 63, 64, 65, 300, 1500):
        ids = [rng.choice([0, 1, 2, 3, 4, 5, 6, 0, 1, 2]) for _ in range(n)]
        for edit in (expand.expand, expand.contract, expand.selective_expand, expand.affix_contract):
            for share in (0.3, 2.0):
                draws = expand.generator(n, "x")
                assert edit(ids, t, draws, share) == plain(edit, ids, t, draws, share), (edit.__name__, n)


def test_places_equal_a_list():
    rng = random.Random(4)
    kinds = lambda a, b: a % 2 | (b is not None and b % 3 == 0) << 1
    own = [rng.randrange(100) for _ in range(500)]
    places = Places(own, kinds, 2)
    for _ in range(2000):
        own_kinds = [kinds(a, b) for a, b in zip(own, [*own[1:], None], strict=True)]
        for kind in (0, 1):
            at = [i for i, k in enumerate(own_kinds) if k >> kind & 1]
            assert places.count(kind) == len(at)
        if not at:
            break
        k = rng.randrange(len(at))
        i, width = at[k], rng.randrange(1, 4)
        new = [rng.randrange(100) for _ in range(rng.randrange(0, 4))]
        place = places.find(1, k)
        assert places.following(*place, 3) == own[i : i + 3]
        if i + width <= len(own):
            places.replace(*place, width, new)
            own[i : i + width] = new
    assert places.ids() == own


def vocabulary_file():
    """The byte-level vocabulary as bytes: its file writes each byte as a printable character."""
    plain_ = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain_} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain_)}
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        return {i: bytes(back[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items()}


def test_merging_equals_the_library():
    tokens_ = vocabulary_file()
    t = expand.Tables({}, tokens_)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").column("text").to_pylist() + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += ["a  b\n\n c", "x" * 3000, "é漢字 \U0001f600\U0001f600", "ab" * 5000, "   ", "", "I'll can't <|endoftext|>"]
    for text in texts:
        if text is not None:
            assert t.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert expand.Tables({}, {0: b"a"}).encode("ab") is None
    assert expand.contract_expand([0, 1, 0], expand.Tables({}, {0: b"a", 1: b"xy"}, ["ax"]), expand.generator(1, 1)) == [0, 1, 0]  # x and y are no tokens


def test_runs_are_encoded_again_by_merging():
    """On bytes cut inside characters, against plain lists."""
    tokens_ = vocabulary_file()
    pairs, ids_ = {}, {b: i for i, b in tokens_.items()}
    for i, b in tokens_.items():
        if ways := [(ids_[b[:k]], ids_[b[k:]]) for k in range(1, len(b)) if b[:k] in ids_ and b[k:] in ids_]:
            pairs[i] = sorted(ways)
    t = expand.Tables(pairs, tokens_, ["the", "ing", " un", "é"])
    text = "the unthinking banana singing, mamamama élève 漢字漢字 \U0001f600 and the rest of it " * 4
    ids = t.encode(text)
    changed = 0
    for seed in range(12):
        draws, out = expand.generator(seed, "k"), list(ids)
        for step in range(int(len(ids) * 0.9)):
            share = draws.number(step, "run") / 2**32
            n = 2 if share < 0.35 else 3 if share < 0.7 else 4
            at = 0
            for k in range(100):
                start = draws.number(step, f"start{k}") % (len(out) - n + 1)
                run = out[start : start + n]
                where = [m.start() for a in t.affixes for m in re.finditer(f"(?={re.escape(a)})", t.decode(run))]
                keep = 0.75 if len(where) != len(set(where)) else 0.95
                if not t.affix_ids.intersection(run) or draws.number(step, f"keep{k}") >= keep * 2**32:
                    at = start
                    break
            s = t.decode(out[at : at + n])
            found = sorted((m.start(), a) for a in t.affixes for m in re.finditer(f"(?={re.escape(a)})", s))
            pieces = [s]
            if found and draws.number(step, "cut") < 0.95 * 2**32:
                among = [m for m in found if " " in m[1]] or found
                i, a = among[draws.number(step, "affix") % len(among)]
                pieces = [p for p in (s[:i], a, s[i + len(a) :]) if p]
            new = [t.encode(q) for p in pieces for q in expand.split_pair(p)]
            out[at : at + n] = [i for x in new for i in x]
        skip = draws.named("expand")
        for step in range(int(len(out) * 0.1)):
            able = [i for i, x in enumerate(out) if x not in t.affix_ids]
            i = able[skip.number(step, "at") % len(able)]
            if ways := t.expansions.get(out[i]):
                out[i : i + 1] = ways[skip.number(step, "pair") % len(ways)]
        made = expand.contract_expand(ids, t, expand.generator(seed, "k"))
        assert made == out and t.decode(made) == text
        changed += made != ids
    assert changed == 12


def test_a_million_ids_in_one_row():
    t = expand.Tables(PAIRS, TOKENS, ["ab"])
    ids = [5, 3, 4, 0, 1, 2, 0, 1] * 125_000
    for edit in (expand.expand, expand.contract, expand.selective_expand, expand.affix_contract):
        began = time.time()
        out = edit(ids, t, expand.generator(1, "k"), 0.3)
        assert out != ids and t.decode(out) == t.decode(ids) and time.time() - began < 40
