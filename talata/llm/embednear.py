"""Near-duplicate embeddings by spherical-cap filters: random product codes, list decoding, exact verification.

A filter is a direction; a vector is in the cap of every direction whose inner product with it is
the threshold or more. Two vectors at a small angle have most of their caps in common, two unrelated
ones almost none. The directions are product codes: after a random rotation a vector has two halves,
and each pair of a code word for the first and one for the second is a direction, so B words a half
make B * B directions, and a vector is decoded to its list of caps from 2 * B products. CODES such
codes with rotations of their own even out how many caps a vector is in.

1. Equal vectors of a label are one node with a size; what follows has distinct vectors only.
2. Nodes are decoded to caps (label, cap); caps with one node are dropped by a count.
3. The nodes of a cap meet in a task and are compared exactly. Caps over MOST nodes are dealt as pairs
   of bounded blocks, so a task holds 2 * MOST vectors at most, whatever a cap holds.
4. A pair counts only in its least common cap, so links are summed without a table of pairs. Each
   block emits its nodes' link counts and a spanning forest of its links.

B grows with the square root of the nodes, so that unrelated nodes of a cap stay few at any size.
Near copies share caps by design: comparing k distinct near copies costs k * k products, in blocks.
A vector is in 56 caps on average; at a cosine of just 0.98 a pair shares none with a chance of about
1 in 2000, measured, and less above that; tests hold links against all pairs.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .components import connected_components

COSINE = 0.98
#: Codes, and caps that a vector is in on average, over all codes.
CODES, CAPS = 8, 56
#: Least dimensions after padding; least code words a half.
LEAST_SIZE, LEAST_WORDS = 64, 32
#: Nodes of a cap that are compared at once.
MOST = 1500
SEED = 42


def words_for(nodes: int) -> int:
    """Code words a half: B * B is 4 times the nodes."""
    return max(LEAST_WORDS, int(np.ceil(2 * np.sqrt(nodes))))


def padded_size(size: int) -> int:
    return max(LEAST_SIZE, 1 << max(size - 1, 1).bit_length())


@lru_cache(maxsize=8)
def threshold(size: int, words: int) -> float:
    """The inner product that a random direction of the padded size reaches with a chance of CAPS / (CODES * words^2)."""
    x = np.linspace(-1, 1, 200_001)
    density = (1 - x * x) ** ((padded_size(size) - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    chance = above / above[0]
    return float(x[np.searchsorted(-chance, -CAPS / (CODES * words * words))])


@lru_cache(maxsize=4)
def code(size: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotations (CODES, 2, D) and the words of both halves (2, words, D / 2), of length 1 / sqrt(2)."""
    drawn, wide = np.random.Generator(np.random.PCG64(SEED)), padded_size(size)
    signs = drawn.integers(0, 2, (CODES, 2, wide)) * 2.0 - 1
    halves = drawn.standard_normal((2, words, wide // 2))
    return signs, halves / np.linalg.norm(halves, axis=2, keepdims=True) / np.sqrt(2)


def _mixed(rows: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row."""
    n, wide = rows.shape
    step = 1
    while step < wide:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
        step *= 2
    return rows / np.sqrt(wide)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square leaves the range."""
    rows = vectors.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def caps_of(vectors: np.ndarray, words: int) -> list[np.ndarray]:
    """The ids of all caps that each row (non-zero, finite) is in, ascending."""
    n, size = vectors.shape
    signs, (left, right) = code(size, words)
    least, wide = threshold(size, words), padded_size(size)
    rows = np.zeros((n, wide))
    rows[:, :size] = unit(vectors)
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    for number, (before, after) in enumerate(signs):
        turned = _mixed(_mixed(rows * before) * after)
        xs, ys = turned[:, : wide // 2] @ left.T, turned[:, wide // 2 :] @ right.T
        for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
            a, b = np.flatnonzero(x >= least - y.max()), np.flatnonzero(y >= least - x.max())
            p, q = np.nonzero(x[a][:, None] + y[b][None, :] >= least)
            out[i].append((number * words + a[p]) * words + b[q])
    return [np.sort(np.concatenate(lists)) for lists in out]


def _decode(batches, words: int):
    """Rows (node, embedding) to (node, cap); vectors of a length are decoded together."""
    for batch in batches:
        node, column = batch.column(0), batch.column(1)
        lengths = np.diff(column.offsets.to_numpy())
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            for some in np.array_split(at, -(-len(at) // 512)):
                held = np.array(column.take(pa.array(some)).to_pylist(), dtype=np.float64)
                caps = caps_of(held, words)
                ids = np.repeat(node.take(pa.array(some)).to_numpy(), [len(c) for c in caps])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(caps), pa.int64())], ["node", "cap"])


def first_common(pairs: np.ndarray, lists_a: list[np.ndarray], lists_b: list[np.ndarray], cap: int) -> np.ndarray:
    """Which of the pairs (i of a, j of b) have no common cap below ``cap``."""
    own_a, own_b = ([c[c < cap] for c in lists] for lists in (lists_a, lists_b))
    shared = np.intersect1d(np.concatenate(own_a), np.concatenate(own_b))
    if not len(shared):
        return np.ones(len(pairs), bool)
    wide = -(-len(shared) // 64)

    def bits(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), wide * 64), np.uint8)
        for row, c in zip(out, lists, strict=True):
            row[np.searchsorted(shared, c[np.isin(c, shared)])] = 1
        return np.packbits(out, axis=1).view(np.uint64)

    in_a, in_b, new = bits(own_a), bits(own_b), np.empty(len(pairs), bool)
    each = max(1, (1 << 22) // wide)
    for k in range(0, len(pairs), each):
        i, j = pairs[k : k + each].T
        new[k : k + each] = ~(in_a[i] & in_b[j]).any(axis=1)
    return new


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (from, to) of a spanning forest of a symmetric boolean matrix."""
    left, out = near.any(axis=1), []
    while left.any():
        start = int(np.flatnonzero(left)[0])
        left[start] = False
        edge = np.array([start])
        while len(edge):
            found = np.flatnonzero(near[edge].any(axis=0) & left)
            left[found] = False
            out.extend((start, int(x)) for x in found)
            edge = found
    return out


def links_of(cap: int, a: list, b: list | None, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links within rows ``a`` (node, size, embedding, caps), or between ``a`` and ``b``: what each node gains, and a forest.

    Only pairs whose least common cap is this one count.
    """
    other = a if b is None else b
    va, vb = (unit(np.array([r[2] for r in rows], dtype=np.float64)) for rows in (a, other))
    near = va @ vb.T >= cosine
    if b is None:
        near = np.triu(near, 1)
    pairs = np.argwhere(near)
    if len(pairs):
        in_a, in_b = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        local = np.stack([np.searchsorted(in_a, pairs[:, 0]), np.searchsorted(in_b, pairs[:, 1])], axis=1)
        lists_a, lists_b = [np.asarray(a[i][3]) for i in in_a], [np.asarray(other[j][3]) for j in in_b]
        pairs = pairs[first_common(local, lists_a, lists_b, cap)]
    if not len(pairs):
        return {}, []
    nodes = [r[0] for r in a] + ([] if b is None else [r[0] for r in b])
    size = np.array([r[1] for r in a] + ([] if b is None else [r[1] for r in b]), dtype=np.int64)
    i, j = pairs[:, 0], pairs[:, 1] + (0 if b is None else len(a))
    gains, whole = np.zeros(len(nodes), np.int64), np.zeros((len(nodes), len(nodes)), bool)
    np.add.at(gains, i, size[j])
    np.add.at(gains, j, size[i])
    whole[i, j] = whole[j, i] = True
    return {nodes[k]: int(gains[k]) for k in np.flatnonzero(gains)}, [(nodes[u], nodes[v]) for u, v in _forest(whole)]


LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _compare(batches, cosine: float):
    """Rows sorted by block (kind, cap, low, high), the nodes of its first part (side 0) before those of its second."""
    current, sides, out = None, ([], []), []

    def close() -> None:
        across = current is not None and current[2] != current[3]
        if sides[0] and (sides[1] if across else len(sides[0]) > 1):
            gains, forest = links_of(current[1], sides[0], sides[1] if across else None, cosine)
            out.extend((node, None, n) for node, n in gains.items())
            out.extend((u, v, 0) for u, v in forest)
        sides[0].clear()
        sides[1].clear()

    for batch in batches:
        for kind, cap, low, high, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, cap, low, high) != current:
                close()
                current = (kind, cap, low, high)
            sides[side].append(row)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=LINKS)
            out.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=LINKS)


def usable(embedding: Column) -> Column:
    """Not null, only finite components, and not all of them zero."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def cap_links(nodes: DataFrame, *, words: int, cosine: float = COSINE, most: int = MOST) -> DataFrame:
    """(node, other, links) of ``nodes`` (node, kind, size, embedding: distinct in a kind).

    Rows without ``other`` add to a node's number of linked vectors; the others are edges that
    connect what is linked. Only nodes of the same kind are compared.
    """
    caps = nodes.select("node", "embedding").mapInArrow(partial(_decode, words=words), "node long, cap long")
    caps = materialize(caps.join(nodes.select("node", "kind"), "node"), "caps")
    met = caps.groupBy("kind", "cap").agg(F.count("*").alias("n")).where("n > 1")
    lists = caps.join(met, ["kind", "cap"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("cap", "n"))).alias("met"))
    placed = nodes.join(lists, "node").select("node", "kind", "size", "embedding", F.col("met.cap").alias("caps"), F.explode("met").alias("at"))
    parts = placed.withColumn("parts", F.ceil(F.col("at.n") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = blocks.select(
        "kind", F.col("at.cap").alias("cap"), F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), F.when(F.col("part") <= F.col("with"), 0).otherwise(1).alias("side"), "node", "size", "embedding", "caps"
    )
    key = ["kind", "cap", "low", "high"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(partial(_compare, cosine=cosine), "node long, other long, links long")


def near_embeddings(rows: DataFrame, *, cosine: float = COSINE, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``rows`` (vec_id, embedding, label).

    Vectors of the same non-null label and the same length are linked at a cosine of ``cosine`` or
    more. n_links counts the other rows linked directly, equal ones included; component_id is the
    least vec_id reachable, itself included. Null, empty and zero vectors, those with a null or
    non-finite component and those without a label link with nothing. Rows of the same vec_id are
    rows of their own; rows with a null id take part, and their component_id is null only if every id
    in it is. Other columns may have any name. No rows, no rows.
    """
    vectors = rows.select("vec_id", "label", "embedding")
    keyed = vectors.select("vec_id", F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), F.struct(F.xxhash64("label", "embedding").alias("k"), F.xxhash64("embedding", F.lit(SEED), "label").alias("l"))).alias("key"), "label", "embedding")
    keyed = keyed.select("vec_id", F.col("key.k").alias("k"), F.col("key.l").alias("l"), "label", "embedding")
    once = keyed.where("k IS NOT NULL").groupBy("k", "l").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialize(once.select(F.monotonically_increasing_id().alias("node"), "k", "l", "first", "size", F.struct("label", F.size("embedding").alias("length")).alias("kind"), "embedding"), "nodes")
    found = materialize(cap_links(nodes.select("node", "kind", "size", "embedding"), words=words_for(nodes.count()), cosine=cosine, most=most), "links")
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = nodes.drop("embedding", "kind").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    known = joined.where("size > 1 OR links > 0").join(least, "root").select("k", "l", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "k", "l").join(materialize(known, "linked"), ["k", "l"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op12_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(read(spark, sf_dir, "embeddings"))


#: All pairs of a label, which the tests' tables are small enough for.
OP12_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= {COSINE}),
reach AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
roots AS (SELECT vec_id, min(other) AS root FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""
