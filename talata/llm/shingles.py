"""Near-duplicates by similarity: SimHash and BK-trees find candidates, exact Jaccard links them.

Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Their SimHash fingerprints are then some 10 bits apart and at most RADIUS, which is too wide
for shards of equal bits as in ``simhash``; the shards are the keys of BANDS times ROWS least hashes
instead (two documents at 0.8 share none with a chance of (1 - 0.8 ** 4) ** 24, about 3 in a
million). The steps:

1. Documents with equal sets are one node, with one fingerprint.
2. A BK-tree over each shard links the fingerprints within RADIUS bits; shards over SHARD_MOST are
   dealt as pairs of bounded trees. The components of these links hold every candidate pair.
3. Each component's sets are compared exactly, one text a node, in a task. Components over
   MOST_SHINGLES or MOST_NODES are dealt as pairs of bounded blocks, so nothing a task holds grows
   with a component. A task emits a spanning forest of its exact links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .simhash import MOST_BROADCAST, SEED, fingerprint_of_hashes, keep_one, labelled, shard_links, shingle_hashes

SHINGLE, RADIUS = 5, 24
#: Linked at 0.8 or more: 9 * common >= 4 * (both sizes).
COMMON, SIZES = 9, 4
BANDS, ROWS = 24, 4
#: Shingles and nodes of a component that one task compares at once; also of the blocks of larger ones.
MOST_SHINGLES, MOST_NODES = 1_000_000, 3000
#: Texts a task holds the sets of at once while it signs them.
HELD = 256
_DRAWN = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of one text; a text of fewer words is one shingle, a blank one none."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE, SEED), dtype=np.uint64))


def node_of(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> list[int]:
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512] * _TIMES + _PLUS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _parts(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, HELD):
            yield batch.slice(i, HELD)


SIGNATURE = "doc_id long, key long, node long, print long, n int, bands array<long>"


def _signatures(batches):
    for batch in _parts(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column(2)]
        keys = [band_keys(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        columns = [batch.column(0), batch.column(1), _signed([node_of(s) for s in sets]), _signed([fingerprint_of_hashes(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32())]
        columns.append(pa.ListArray.from_arrays(pa.array(ends), _signed([k for ks in keys for k in ks])))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "print", "n", "bands"])


def _nodes(batches):
    """(key, text) -> (doc_id, print), as ``keep_one`` asks for rows without an id."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _signed([node_of(shingle_set(t.as_py())) for t in batch.column(1)])], ["doc_id", "print"])


def exact_links(sets: list[np.ndarray], sides: list[int]) -> list[tuple[int, int]]:
    """Links (place, least place of its component) that connect all similar pairs of ``sets``.

    All pairs are compared by counting common hashes; with two sides, only pairs across them.
    """
    n, two = len(sets), len(set(sides)) > 1
    sizes, side = np.array([len(s) for s in sets]), np.array(sides)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = owner[np.argsort(which, kind="stable")]
    begin = np.cumsum(count) - count
    root = np.arange(n)
    for i in range(n):
        if two and sides[i]:
            continue
        own = which[ends[i] : ends[i + 1]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        each = count[own]
        at = np.repeat(begin[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        common = np.bincount(postings[at], minlength=n)
        near = COMMON * common >= SIZES * (sizes[i] + sizes)
        met = np.unique(root[near & (side != sides[i]) if two else near])
        met = np.union1d(met, root[i : i + 1])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def _compared(batches):
    """Rows (cell, side, text) sorted by cell -> links of similar nodes."""
    current, sets, sides = None, [], []

    def close():
        links = exact_links(sets, sides) if len(sets) > 1 else []
        nodes = [node_of(s) for s in sets] if links else []
        sets.clear()
        sides.clear()
        return pa.RecordBatch.from_arrays([_signed([nodes[x[i]] for x in links]) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for cell, side, text in zip(*batch.columns, strict=True):
            if cell.as_py() != current:
                yield close()
                current = cell.as_py()
            sets.append(shingle_set(text.as_py()))
            sides.append(side.as_py())
    yield close()


def similar_links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what pairs of similar nodes of ``signed`` (see SIGNATURE) connect."""
    one = F.min(F.struct("key", "print", "n", "bands")).alias("one")
    nodes = materialize(signed.where("n > 0").groupBy("node").agg(one).select("one.*"), "signed-nodes")
    keyed = nodes.select("print", F.explode("bands").alias("shard"))
    shared = keyed.groupBy("shard").agg(F.count("*").alias("members")).where("members > 1").select("shard")
    sharded = materialize(keyed.join(shared, "shard", "left_semi").select("shard", "print"), "shards")
    roots = connected_components(shard_links(sharded, RADIUS)).withColumnRenamed("node", "print")
    placed = nodes.select("key", "print", "n").join(roots, "print", "left").select("key", "n", F.coalesce("root", "print").alias("group"))
    groups = materialize(placed.groupBy("group").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles")).where("nodes > 1"), "group-sizes")
    parts = F.greatest(F.ceil(F.col("shingles") / MOST_SHINGLES), F.ceil(F.col("nodes") / MOST_NODES)).cast("int")
    placed = placed.join(groups, "group").select("key", "group", parts.alias("parts"))
    placed = materialize(placed.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "groups")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    texts = texts.join(F.broadcast(placed) if placed.count() <= MOST_BROADCAST else placed, "key").dropDuplicates(["key"])
    cells = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "text"
    )
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(_compared, "u long, v long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (of its shingle set), component_id.

    Null and blank texts are one group. Ids, nulls and repeated rows are as in ``simhash_components``.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    signed = materialize(rows.mapInArrow(_signatures, SIGNATURE), "signatures")
    return labelled(signed.select("doc_id", F.col("node").alias("print")), materialize(similar_links(docs, signed), "similar"))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """``keep_one`` with similar documents as groups."""
    return keep_one(docs, components=jaccard_components, prints=_nodes)
