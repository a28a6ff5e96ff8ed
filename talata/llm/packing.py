"""Best-fit packing of tokenized documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so all that packing needs of the corpus is how many
pieces have each length: a table of at most ``capacity`` rows whatever the input. The plan is made
from that table by bin completion (branch and bound), and each piece then finds its place from its
length and its number among the pieces of that length. No piece moves to the driver.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read
from .wordbpe import word_bpe

CAPACITY = 4096
END_ID = 1
#: Nodes of the search beyond the first descent, and steps of one enumeration of fillings.
NODE_BUDGET = 6000
#: Bounds of one enumeration of fillings: steps, lengths tried at each level, fillings without waste, fillings kept.
FILL_STEPS, FILL_TRIED, FILL_EXACT, FILL_KEEP = 300, 12, 6, 24

Pattern = tuple[tuple[int, int], ...]  # (length, copies), lengths descending


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: no packing of these counts (by length) has fewer bins."""
    n = np.concatenate([[0], np.cumsum(counts)])  # n[i]: items shorter than i
    s = np.concatenate([[0], np.cumsum(counts * np.arange(len(counts)))])
    half = capacity // 2
    best = -(-int(s[-1]) // capacity)
    k = np.arange(0, half + 1)
    over = n[-1] - n[np.minimum(capacity - k + 1, capacity + 1)]  # longer than capacity - k
    wide_n = n[capacity - k + 1] - n[half + 1]
    wide_s = s[capacity - k + 1] - s[half + 1]
    small_s = s[half + 1] - s[k]
    more = np.maximum(0, -(-(small_s - (wide_n * capacity - wide_s)) // capacity))
    return max(best, int((over + wide_n + more).max()))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: the first incumbent."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    room: list[int] = []  # residuals that have bins, ascending

    def put(residual: int, pattern: Pattern, bins: int) -> None:
        if residual not in open_bins:
            open_bins[residual] = []
            room.insert(bisect_left(room, residual), residual)
        open_bins[residual].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(room, length)
            if i < len(room):
                residual = room[i]
                pattern, bins = open_bins[residual].pop()
                if not open_bins[residual]:
                    del open_bins[residual]
                    room.pop(i)
            else:
                residual, pattern, bins = capacity, (), left
            each = residual // length
            full = min(bins, left // each)
            if full:
                put(residual - each * length, (*pattern, (length, each)), full)
                left -= full * each
            rest = bins - full
            if left and rest:  # one bin takes what is left of this length
                put(residual - left * length, (*pattern, (length, left)), 1)
                left, rest = 0, rest - 1
            if rest and pattern:
                put(residual, pattern, rest)
    return [x for bins in open_bins.values() for x in bins]


class _Search:
    """Bin completion: fill the bin of the largest remaining length, then go on with the rest."""

    def __init__(self, counts: dict[int, int], capacity: int, budget: int):
        self.capacity, self.budget = capacity, budget
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.counts[length] = n
        self.lengths = sorted(counts)
        self.best = best_fit_decreasing(counts, capacity)
        self.best_bins = sum(m for _, m in self.best)
        self.floor = lower_bound(self.counts, capacity)
        self.nodes = 0
        self.cut = False  # whether a bound kept any choice from being tried
        self.proven = self.best_bins <= self.floor

    def take(self, pattern: Pattern, times: int) -> None:
        for length, copies in pattern:
            had = self.counts[length]
            self.counts[length] = had - copies * times
            if had and not self.counts[length]:
                self.lengths.pop(bisect_left(self.lengths, length))
            elif not had and self.counts[length]:
                self.lengths.insert(bisect_left(self.lengths, length), length)

    def fillings(self) -> list[Pattern]:
        """Undominated fillings around the largest length, least waste first."""
        largest = self.lengths[-1]
        have = {largest: 1}
        found: dict[tuple[int, ...], int] = {}
        steps = [FILL_STEPS]
        exact = [0]

        def dominated(waste: int) -> bool:
            """A longer remaining piece fits in place of one piece, or of two together."""
            own = [x for x in have if x != largest or have[x] > 1]
            sums = set(own) | {a + b for i, a in enumerate(own) for b in own[i + 1 :]} | {2 * a for a in own if have[a] - (a == largest) > 1}
            for x in sums:
                j = bisect_right(self.lengths, x)
                while j < len(self.lengths) and self.lengths[j] <= x + waste:
                    y = self.lengths[j]
                    if self.counts[y] > have.get(y, 0):
                        return True
                    j += 1
            return False

        def add(more: list[int], waste: int) -> None:
            key = tuple(sorted([x for x, c in have.items() for _ in range(c)] + more, reverse=True))
            if key not in found:
                found[key] = waste
                exact[0] += not waste

        def greedily(residual: int, most: int) -> None:
            """What the steps leave unfinished is completed with the longest pieces that fit."""
            more: list[int] = []
            for j in range(bisect_right(self.lengths, min(residual, most)) - 1, -1, -1):
                length = self.lengths[j]
                copies = min(residual // length, int(self.counts[length]) - have.get(length, 0))
                more += [length] * copies
                residual -= copies * length
            add(more, residual)

        def fill(residual: int, most: int) -> None:
            steps[0] -= 1
            j = bisect_right(self.lengths, min(residual, most)) - 1
            tried = 0
            while j >= 0:
                length = self.lengths[j]
                if self.counts[length] > have.get(length, 0):
                    if tried == FILL_TRIED or steps[0] <= 0 or exact[0] >= FILL_EXACT:
                        self.cut = True
                        if not tried:
                            greedily(residual, most)
                        return
                    have[length] = have.get(length, 0) + 1
                    fill(residual - length, length)
                    have[length] -= 1
                    if not have[length]:
                        del have[length]
                    tried += 1
                j -= 1
            if not tried and (not residual or not dominated(residual)):
                add([], residual)

        fill(self.capacity - largest, largest)
        self.cut |= len(found) > FILL_KEEP
        out = sorted(found, key=lambda k: (found[k], [-x for x in k]))[:FILL_KEEP]
        return [tuple((x, k.count(x)) for x in dict.fromkeys(k)) for k in out]

    def run(self) -> list[tuple[Pattern, int]]:
        if self.best_bins <= self.floor:
            return self.best
        path: list[tuple[Pattern, int]] = []
        used = 0
        stack = [self.choices()]
        while stack:
            if self.best_bins <= self.floor:
                break
            if self.nodes > self.budget + 4 * self.capacity:
                self.cut = True
                break
            pattern, times = next(stack[-1], (None, 0))
            if pattern is None:
                stack.pop()
                if path:
                    undone, times = path.pop()
                    self.take(undone, -times)
                    used -= times
                continue
            self.nodes += 1
            self.take(pattern, times)
            path.append((pattern, times))
            used += times
            if not self.lengths:
                if used < self.best_bins:
                    self.best, self.best_bins = list(path), used
            elif used + lower_bound(self.counts, self.capacity) < self.best_bins:
                stack.append(self.choices())
                continue
            path.pop()
            self.take(pattern, -times)
            used -= times
        self.proven = self.best_bins <= self.floor or not self.cut
        return self.best

    def choices(self) -> Iterator[tuple[Pattern, int]]:
        """Each filling as often as the counts allow, then once."""
        for pattern in self.fillings():
            most = min(int(self.counts[x]) // c for x, c in pattern)
            yield pattern, most
            if most > 1:
                yield pattern, 1


def solve(counts: dict[int, int], capacity: int, budget: int = NODE_BUDGET) -> tuple[list[tuple[Pattern, int]], bool]:
    """A plan for ``counts`` pieces of each length, (pattern, number of bins with it), and whether it is proven.

    It is proven to have as few bins as can be where it meets the lower bound, or where the search
    ended without any bound of the enumeration or the budget having kept a choice from being tried.
    Otherwise it is the best incumbent; nothing is ever dropped.
    """
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return [], True
    search = _Search(counts, capacity, budget)
    return search.run(), search.proven


def pack_counts(counts: dict[int, int], capacity: int, budget: int = NODE_BUDGET) -> list[tuple[Pattern, int]]:
    """The plan of ``solve``."""
    return solve(counts, capacity, budget)[0]


def _places(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """The plan by length: from which number on a pattern takes pieces, how many a bin, and where."""
    rows, next_rank, first_bin = [], {}, 0
    for pattern, bins in plan:
        offset = 0
        for length, copies in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, copies, first_bin, offset))
            next_rank[length] = rank + copies * bins
            offset += length * copies
        first_bin += bins
    rows.sort()
    out = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return {"key": (out[0] << 44) + out[1], "rank": out[1], "copies": out[2], "bin": out[3], "offset": out[4]}


def _cut(batches, path: str, end_id: int, capacity: int, with_ids: bool):
    """Encode, append the end id, cut into pieces; number equal lengths within the task."""
    encoder, end = word_bpe(path), int(end_id).to_bytes(4, "little")
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    step = 4 * capacity
    for batch in batches:
        rows = [[] for _ in range(6)]
        ids_out = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = encoder.encode(text.as_py() or "") + end
            for piece, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                n = len(part) // 4
                for column, value in zip(rows, (doc_id.as_py(), piece, at // 4, n, zlib.crc32(part), seen[n]), strict=True):
                    column.append(value)
                seen[n] += 1
                if with_ids:
                    ids_out.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(rows, types, strict=True)]
        columns.append(pa.array(np.full(len(rows[0]), task), pa.int64()))
        if with_ids:
            columns.append(pa.array(ids_out, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"] + ["ids"] * with_ids)


def _place(batches, plan):
    where = plan.value
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        i = np.searchsorted(where["key"], (length << 44) + rank, side="right") - 1
        bins, within = np.divmod(rank - where["rank"][i], where["copies"][i])
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
        columns = [c for _, c in kept] + [pa.array(where["bin"][i] + bins, pa.int64()), pa.array(where["offset"][i] + within * length, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [n for n, _ in kept] + ["sequence_id", "offset"])


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    node_budget: int = NODE_BUDGET,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text; other columns are ignored) into sequences.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``with_ids`` the ids themselves. Longer documents than ``capacity`` are cut; nothing is
    padded or dropped. Null text counts as empty and gives one piece with the end id alone; a null
    doc_id stays null; repeated rows are packed each; an empty table gives no rows. Equal lengths
    are interchangeable, so which of two ties comes first does not change the number of sequences.
    The search is bounded (see ``solve``); a plan that is not proven best is logged as such.
    """
    spark = docs.sparkSession
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task long" + ", ids array<int>" * with_ids
    pieces = materialize(
        docs.select("doc_id", "text").mapInArrow(partial(_cut, path=tokenizer_path, end_id=end_id, capacity=capacity, with_ids=with_ids), fields), "pieces"
    )
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    found, proven = solve(counts, capacity, node_budget)
    if not proven:
        logging.getLogger(__name__).warning("packing into %d sequences is not proven to be the fewest", sum(n for _, n in found))
    plan = spark.sparkContext.broadcast(_places(found))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = [f for f in pieces.select(*kept).schema] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.select(*kept, "rank").mapInArrow(partial(_place, plan=plan), T.StructType(out))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
