"""Source divergence, spherical caps and conversation repair against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talata.llm import conversations, divergence, embednear
from talata.llm.common import materialize

# --- source divergence


def brute_divergence(rows, least=3, most=200):
    lang_docs, counts, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        lang_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in lang_docs[lang].items() if n >= least]
        sources = [s for la, s in groups if la == lang]

        def chances(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = chances(sum((counts[lang, s] for s in sources), collections.Counter()))
        p = {s: chances(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < most]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "The", "ÉTÉ", "été", "naïve", "漢字", "x", "don't", "a_b", "z9z", "\U0001f600a"]
    rows = [(" ".join(rng.choice(words[: 3 + i % 9]) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None])) for i in range(120)]
    rows += [(None, "de", "a"), ("", "de", "b"), ("one two", "de", "b"), ("alone " * 9, "xx", "only"), ("alone", "xx", "only"), ("alone", "xx", "only")] + [("word " * 200_000, "en", "a")] * 2
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, count int")
    made = divergence.source_divergence(df)
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, made.collect())) == brute_divergence(rows)
    assert sorted(map(tuple, divergence.source_divergence(df, least=1, most_terms=2).collect())) == brute_divergence(rows, 1, 2)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_divergence_zero_cells_and_large_counts(spark):
    # A source without terms, and counts whose product with the scale leaves a long.
    rows = [("a b c", "en", "x"), ("a b", "en", "x"), ("a b c c", "en", "y"), ("...", "en", "z"), (None, "en", None), ("c", "en", "y")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == brute_divergence(rows)
    big = spark.range(1).select(divergence.probability(F.lit(10**13), F.lit(3 * 10**13), F.lit(10**6)).alias("p"))
    assert big.first().p == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**6)


# --- spherical caps


def brute_near(rows, cosine=0.98):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = [(i, v if ok(v) and label is not None else None, label) for i, v, label in rows]
    links = collections.defaultdict(list)
    for a, b in itertools.combinations(range(len(rows)), 2):
        (_, v, x), (_, w, y) = rows[a], rows[b]
        if v is None or w is None or x != y or len(v) != len(w):
            continue
        v, w = (np.array(z, dtype=np.float64) / np.max(np.abs(z)) for z in (v, w))
        if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
            links[a].append(b)
            links[b].append(a)
    out, seen = [], {}
    for a in range(len(rows)):
        if a not in seen:
            todo, group = [a], {a}
            while todo:
                for b in links[todo.pop()]:
                    if b not in group:
                        group.add(b)
                        todo.append(b)
            ids = [rows[b][0] for b in group if rows[b][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
        out.append((rows[a][0], len(links[a]), seen[a], rows[a][0] == seen[a]))
    return sorted(out, key=str)


def clusters(rng, size, groups=12, each=14):
    rows = []
    for label in range(3):
        for _ in range(groups):
            base = rng.standard_normal(size)
            for _ in range(each):
                rows.append((len(rows), (base + rng.standard_normal(size) * np.linalg.norm(base) / np.sqrt(size) * rng.choice([0.05, 0.1, 0.15])).tolist(), label))
    return rows


@pytest.mark.parametrize("most", [embednear.MOST, 5])
def test_cap_links_equal_all_pairs(spark, most):
    rng = np.random.default_rng(8)
    rows = clusters(rng, 48) + clusters(rng, 100, 2, 9)
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    made = sorted(map(tuple, embednear.near_embeddings(df, most=most).collect()), key=str)
    wanted = brute_near(rows)
    assert sum(r[1] for r in wanted) > 2000
    assert made == wanted


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.98 exactly: those that share a cap, at several sizes of the code."""
    rng = np.random.default_rng(5)
    v, u = rng.standard_normal((2, 2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    u -= (u * v).sum(axis=1, keepdims=True) * v
    w = 0.98 * v + np.sqrt(1 - 0.98**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    for nodes in (500, 50_000, 1_000_000):
        words = embednear.words_for(nodes)
        a, b = embednear.caps_of(v, words), embednear.caps_of(3 * w, words)
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b, strict=True)]) >= 0.998
        assert 45 < np.mean([len(x) for x in a]) < 70


def test_caps_are_all_directions_beyond_the_threshold():
    """List decoding against inner products with every direction."""
    rng = np.random.default_rng(2)
    words, size = 40, 20
    signs, (left, right) = embednear.code(size, words)
    v = rng.standard_normal((30, size))
    padded = np.zeros((30, 64))
    padded[:, :size] = v / np.linalg.norm(v, axis=1, keepdims=True)
    directions = np.concatenate([np.repeat(left, words, axis=0), np.tile(right, (words, 1))], axis=1)
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    wanted = [[] for _ in v]
    for number, (before, after) in enumerate(signs):
        turned = embednear._mixed(embednear._mixed(padded * before) * after)
        assert np.allclose(np.linalg.norm(turned, axis=1), 1)
        for i, row in enumerate(turned @ directions.T >= embednear.threshold(size, words)):
            wanted[i] += (number * words * words + np.flatnonzero(row)).tolist()
    assert [c.tolist() for c in embednear.caps_of(v, words)] == wanted


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, a, 1), (2, b, 1), (3, b, 1), (3, b, 1), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [nan, 2.0, 3.0], 1), (10, [inf, 2.0, 3.0], 1)]
    rows += [(11, [x * 1e300 for x in a], 1), (12, [x * 1e-300 for x in a], 1), (13, [-x for x in a], 1), (14, [1.0], 1), (15, [2.0], 1), (16, [1.0, 2.0], 1), (17, a, 2), (None, a, 2), (None, [5.0, -1.0, 0.0], 3), (None, [5.0, -1.0, 0.01], 3), (None, None, None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, cap string")
    assert sorted(map(tuple, embednear.near_embeddings(df).collect()), key=str) == sorted(((i, n, c, i == c) for i, n, c, _ in brute_near(rows)), key=str)
    assert embednear.near_embeddings(df.limit(0)).collect() == []
    assert embednear.near_embeddings(df.where("embedding IS NULL")).count() == 2


def test_a_pair_counts_in_its_least_common_cap():
    rng = random.Random(1)
    lists = [np.array(sorted(rng.sample(range(300), 40))) for _ in range(30)]
    pairs = np.array(list(itertools.combinations(range(30), 2)))
    for cap in (0, 17, 150, 299):
        assert embednear.first_common(pairs, lists, lists, cap).tolist() == [not any(x < cap for x in set(lists[i]) & set(lists[j])) for i, j in pairs]


# --- conversation repair


def brute_repair(rows):
    """(cost, edits, repaired) by trying all edits breadth first in cost; rows: (role, text, fault)."""
    import heapq

    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (to := step[state].get(role[0])) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (to := step[state].get(role[:1])) is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := step[state].get(new[0])) is not None:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, to, (*lines, f"{new}:{text}")))


def brute_report(rows):
    out = []
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        by_conv[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, held in by_conv.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faulty, found = [t for t, _, _ in held if t is not None], set(), [], collections.Counter()
        for _, role, text in held:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"
            seen.add((role, text))
            found[fault] += 1
            faulty.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, repaired = brute_repair(faulty)
        out.append((conv, gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \n", "What? ", "é。", "a.\nb", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "summary"]
    rows = [(conv, rng.choice([*range(8), None]), rng.choice(roles[: 3 + conv % 7]), rng.choice(texts[: 2 + conv % 8])) for conv in range(150) for _ in range(rng.randrange(1, 9))]
    rows += [(None, t, "user" if t % 2 else "assistant", "ok.") for t in range(12)] + [(500, None, None, None)] * 3
    rows += [(501, t, ("user", "assistant")[t % 2], "word " * 300_000 + ".") for t in range(4)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, fault string")
    made = conversations.repair_report(conversations.damaged(df)).collect()
    assert sorted(map(tuple, made), key=str) == brute_report(rows)
    assert conversations.repair_report(conversations.damaged(df.limit(0))).collect() == []


def test_repaired_rows_are_whole_texts(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "user", "There.", 1), (1, 2, "assistant", "Yes.", 1), (2, 0, "system", "Be kind.", 1), (3, 0, "assistant", "Late.", 0)]
    report, repaired = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int"))
    assert sorted((r.conv_id, r.cost, r.audit) for r in report.collect()) == [(1, 2, "DKK"), (2, 2, "D"), (3, 0, "")]
    assert sorted(map(tuple, repaired.collect())) == [(1, 0, "user", "There."), (1, 1, "assistant", "Yes.")]


def test_layers_are_computed_once_for_a_shared_prefix():
    rng = random.Random(4)
    signatures = sorted("".join(rng.choice("duasxUASX") for _ in range(rng.randrange(1, 7))) for _ in range(3000))
    made = list(conversations.solved(iter(signatures)))
    prefixes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    assert sum(layers for _, _, layers in made) == len(prefixes)
    sign = {"U": "truncated", "A": "truncated", "S": "truncated", "X": "truncated", "d": "blank"}
    for signature, (cost, audit, _) in list(zip(signatures, made, strict=True))[::17]:
        assert (cost, audit) == brute_repair([({"u": "user", "a": "assistant", "s": "system"}.get(c.lower(), "tool"), "t", sign.get(c, "none")) for c in reversed(signature)])[:2]


def test_a_very_long_conversation(spark):
    began = time.time()
    signature = "uaUdxsaA" * 40_000
    ((cost, audit, layers),) = conversations.solved(iter([signature]))
    assert layers == len(signature) and len(audit) >= len(signature) and cost > 0 and time.time() - began < 30
    # A third of all rows in one conversation, most of them equal.
    rows = spark.range(30_000).select((F.col("id") % 3).cast("long").alias("c"), "id").selectExpr("if(c = 0, 0, id) AS conv_id", "id % 500 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'Same.' AS text")
    made = conversations.repair_report(conversations.damaged(materialize(rows, "rows")))
    assert made.count() == rows.select("conv_id").distinct().count()
