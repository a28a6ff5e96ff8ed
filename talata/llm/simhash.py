"""SimHash near-duplicates, linked through BK-trees over shards of the fingerprints.

Fingerprints within R bits agree on at least one of R + 1 blocks of their bits. The distinct
fingerprints are therefore sharded by (block, its value), and a tree is built over each shard and
searched for each of its members. A shard over SHARD_MOST members is sharded again on three or more
equal blocks of its remaining bits, and a shard that is still larger is dealt to tasks as pairs of
bounded trees and query groups, so no task's memory or work depends on the size of a group. A shard
emits a spanning forest of its links, not all pairs.

The trees go to tasks through the shuffle: a broadcast of all of them would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read
from .components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a shard that one task takes whole; also the size of the trees of larger ones.
SHARD_MOST = 1500


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """The hashes of a text's shingles in order; fewer words than a shingle are one, no words none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white spaces alone
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint_of_hashes(hashes) -> int:
    """The bits set in over half of the hashes, unsigned; zero of none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    return fingerprint_of_hashes(shingle_hashes(text, shingle, seed))


def _fingerprints(batches, shingle: int, seed: int):
    for batch in batches:
        prints = np.array([fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


class BkTree:
    """A BK-tree over distinct fingerprints: each node has one member, and its children are keyed by their distance to it.

    ``followed`` and ``passed`` count the edges that queries went along and left out.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.followed = self.passed = 0
        self.root = self._build(np.arange(len(values)))

    def _build(self, members: np.ndarray):
        top: list = []
        todo = [(members, top)]
        while todo:
            at, into = todo.pop()
            pivot, rest = at[0], at[1:]
            distance = np.bitwise_count(self.values[rest] ^ self.values[pivot])
            order = np.argsort(distance, kind="stable")
            keys, starts = np.unique(distance[order], return_index=True)
            children = []
            for d, members in zip(keys.tolist(), np.split(rest[order], starts[1:]), strict=False):
                child: list = []
                todo.append((members, child))
                children.append((d, child))
            into.append((pivot, children))
        return top[0]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, positions of the queries within the radius), following only edges that can hold one."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            (at, children), who = stack.pop()
            distance = np.bitwise_count(queries[who] ^ self.values[at]).astype(np.int16)
            yield int(at), who[distance <= radius]
            for d, child in children:
                go = who[np.abs(distance - d) <= radius]
                self.followed += len(go)
                self.passed += len(who) - len(go)
                if len(go):
                    stack.append((child[0], go))


def spanning_links(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the searches connect: (value, least value of its local component)."""
    values = tree if queries is None else np.concatenate([tree, queries])
    root = np.arange(len(values))
    shift = 0 if queries is None else len(tree)
    for member, near in BkTree(tree).search(tree if queries is None else queries, radius):
        met = np.unique(np.concatenate([[root[member]], root[near + shift]]))
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    least = np.full(len(values), np.iinfo(np.int64).max)
    signed = values.view(np.int64)
    np.minimum.at(least, root, signed)
    to = least[root]
    linked = to != signed
    return list(zip(signed[linked].tolist(), to[linked].tolist(), strict=True))


def _link(batches, radius: int):
    """Rows arrive sorted by shard, and in a shard tree members (side 0) before queries (side 1)."""
    kept: dict[int, list] = {0: [], 1: []}
    current, out = None, []

    def close() -> None:
        if current is not None and (len(kept[0]) > 1 or kept[1]):
            tree = np.unique(np.array(kept[0], dtype=np.int64)).view(np.uint64)
            queries = np.unique(np.array(kept[1], dtype=np.int64)).view(np.uint64) if kept[1] else None
            if len(tree) and (queries is not None or len(tree) > 1):
                out.extend(spanning_links(tree, queries, radius))
        kept[0], kept[1] = [], []

    for batch in batches:
        for shard, side, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != current:
                close()
                current = shard
            kept[side].append(value)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])
            out.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])


def _spans(bits: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _mask(spans: list[tuple[int, int]]) -> int:
    whole = sum(((1 << (b - a)) - 1) << a for a, b in spans)
    return whole - (1 << 64) if whole >= 1 << 63 else whole


def _keys(value: Column, masks: list[int]) -> Column:
    """One key for each mask: its number and the masked bits, hashed together."""
    return F.array(*[F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])


def _linked_shards(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (shard, side, print) -> edges (u, v)."""
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "side")
    return dealt.select("shard", "side", "print").mapInArrow(partial(_link, radius=radius), "u long, v long")


def _cells(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (shard, print, n: members of the shard) dealt as pairs of parts of at most about ``most`` members."""
    parts = rows.select("shard", "print", F.ceil(F.col("n") / most).cast("int").alias("k"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("print"), F.col("k")).cast("int"))
    return parts.select("shard", "print", "part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select(
        F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("shard"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "print"
    )


def _large(sharded: DataFrame, most: int) -> DataFrame:
    return materialize(sharded.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most), "large-shards")


def _whole(rows: DataFrame) -> DataFrame:
    return rows.select("shard", F.lit(0).alias("side"), "print")


def shard_links(sharded: DataFrame, radius: int, most: int = SHARD_MOST) -> DataFrame:
    """Edges that connect, within each shard of ``sharded`` (shard, print), what is within the radius.

    A shard over ``most`` is searched as pairs of bounded trees.
    """
    large = _large(sharded, most)
    if large.isEmpty():
        return _linked_shards(_whole(sharded), radius)
    fits = _linked_shards(_whole(sharded.join(large, "shard", "left_anti")), radius)
    return fits.unionAll(_linked_shards(_cells(sharded.join(large, "shard"), most), radius))


def near_links(prints: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST) -> DataFrame:
    """Edges that connect all of ``prints`` (print: distinct longs) within ``radius`` bits of each other.

    Two prints within the radius are in one component of the returned (u, v); not every such pair
    is an edge. Null prints link nothing; no rows give no edges.
    """
    p = F.col("print")
    sharded = prints.where(p.isNotNull()).select(p, F.explode(_keys(p, [_mask([s]) for s in _spans(BITS, radius + 1)])).alias("shard"))
    large = _large(sharded, most)
    if large.isEmpty():
        return _linked_shards(_whole(sharded), radius)
    edges = _linked_shards(_whole(sharded.join(large, "shard", "left_anti")), radius)
    # Second level: among 2 * radius blocks, at least `radius` are equal.
    blocks = _spans(BITS, 2 * radius)
    masks = [_mask([blocks[i] for i in c]) for c in combinations(range(2 * radius), radius)]
    hot = sharded.join(large.select("shard"), "shard", "left_semi").select("print").distinct()
    return edges.unionAll(shard_links(hot.select("print", F.explode(_keys(p, masks)).alias("shard")), radius, most))


def simhash_components(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Null and blank texts have fingerprint zero and link like any other. component_id is the least
    doc_id of all documents reachable through links; documents with null ids take part, and their
    component_id is null only if every id in it is. Repeated rows stay repeated. No rows, no rows.
    """
    run = partial(_fingerprints, shingle=shingle, seed=seed)
    prints = materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long"), "prints")
    return labelled(prints, near_links(materialize(prints.select("print").distinct(), "nodes"), radius))


def labelled(prints: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` (doc_id, print) with the components that ``links`` (u, v: prints) make of them."""
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links)
    linked = nodes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").select("print", "first", "n", F.coalesce("root", "print").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("size"))
    found = materialize(linked.join(least.where("size > 1"), "root").select("print", "component_id"), "components")
    joined = prints.join(found, "print", "left")
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


#: Ids of dropped documents up to so many (8 bytes each) are broadcast; beyond it they are shuffled.
MOST_BROADCAST = 1_000_000


def keep_one(docs: DataFrame, *, components=simhash_components, prints=partial(_fingerprints, shingle=SHINGLE, seed=SEED)) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, columns as they are.

    The document with the least doc_id stays. Rows that share a doc_id are one document, of which
    the row with the least text hash stays. Rows with a null id go if they are linked to a document
    with one; otherwise they all stay, as nothing tells them apart. Other columns may have any name.
    ``components`` makes the groups, and ``prints`` their fingerprints of (doc_id, text).
    """
    found = materialize(components(docs.select("doc_id", "text")), "groups")
    by_id = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("rows"))
    by_id = materialize(by_id.where("doc_id IS NOT NULL AND (NOT stays OR rows > 1)").withColumnRenamed("doc_id", "id"), "losers")
    losers, repeated = by_id.where("NOT stays").select("id"), by_id.where("rows > 1 AND stays").select("id")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    out = out.join(F.broadcast(losers) if losers.count() <= MOST_BROADCAST else losers, "id", "left_anti")
    linked = found.where("doc_id IS NULL AND component_id IS NOT NULL").select(F.conv("fingerprint", 16, -10).cast("bigint").alias("print")).distinct()
    if not linked.isEmpty():
        anonymous = out.where("id IS NULL")
        texts = anonymous.select(F.col("text_key").alias("doc_id"), F.col("doc").getField("text").alias("text")).distinct()
        going = texts.mapInArrow(prints, "doc_id long, print long").join(linked, "print", "left_semi").select(F.col("doc_id").alias("text_key"))
        out = out.where("id IS NOT NULL").unionByName(anonymous.join(going, "text_key", "left_anti").select(*out.columns))
    if repeated.isEmpty():
        return out.select(*kept)
    once = out.join(repeated, "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("text_key"))
    again = out.join(repeated, "id", "left_semi").withColumn("rank", rank).where("rank = 1")
    return once.select(*kept).unionAll(again.select(*kept))


def op5_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
