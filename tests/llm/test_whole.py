"""Whole jobs: what an earlier cut would have left out."""

import random

import corpus_pipeline
import pytest

from talata.llm import shingles, simhash


def similar_roots(texts, least=0.8):
    """For each text the first one it is connected to, by comparing all pairs of shingle sets."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited_copies(seed, groups, copies, words=200):
    """Texts of random words, each with copies that have one to four words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for _ in range(groups):
        first = [word() for _ in range(words)]
        yield " ".join(first)
        for _ in range(copies):
            copy = list(first)
            for at in rng.sample(range(words), rng.randint(1, 4)):
                copy[at] = word()
            yield " ".join(copy)


@pytest.mark.parametrize("most", [shingles.MOST_SHINGLES, 500])
def test_near_duplicates_are_all_that_are_similar(spark, data, monkeypatch, most):
    """Edited copies go though their SimHash is more than 3 bits away, in whole groups and in blocks of larger ones."""
    monkeypatch.setattr(shingles, "MOST_SHINGLES", most)
    texts = [*edited_copies(7, 12, 9), "a b", "A  b", "a c", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(similar_roots(texts))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, rows, data).collect()} == want
    assert len({r.component_id for r in simhash.simhash_components(rows).collect()}) > len(want)


def test_exact_links_equal_all_pairs():
    """Spanning links of random overlapping sets, whole and across two sides."""
    rng = random.Random(9)
    texts = [*edited_copies(3, 5, 8, words=60), "a", "a b c d e f", ""]
    rng.shuffle(texts)
    sets = [shingles.shingle_set(t) for t in texts]
    sides = [i % 2 for i in range(len(sets))]

    def roots(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
        return root

    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(set(sets[i]) & set(sets[j])) * 9 >= 4 * (len(sets[i]) + len(sets[j]))]
    assert roots(shingles.exact_links(sets, [0] * len(sets))) == roots(near)
    assert roots(shingles.exact_links(sets, sides)) == roots([(i, j) for i, j in near if sides[i] != sides[j]])


def test_bits_of_similar_documents(data):
    """Recall of the BK-trees' radius: every pair of texts at a similarity of 0.8 or more is within it."""
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"SELECT DISTINCT text FROM '{data.replace('0.001', '0.01')}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    for words in (30, 60, 120, 400):  # documents have few similar pairs; edited copies of several lengths have hundreds
        texts += edited_copies(words, 20, 6, words=words)
    sets = [shingles.shingle_set(t) for t in texts]
    by_hash = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            by_hash.setdefault(h, []).append(i)
    pairs = {(i, j) for found in by_hash.values() if len(found) < 200 for i in found for j in found if i < j}
    near = [(i, j) for i, j in pairs if 9 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * (len(sets[i]) + len(sets[j]))]
    bits = [(simhash.fingerprint_of_hashes(sets[i]) ^ simhash.fingerprint_of_hashes(sets[j])).bit_count() for i, j in near]
    assert len(near) > 500 and max(bits) <= shingles.RADIUS
