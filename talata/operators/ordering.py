"""Row numbers, chunks, answer positions, groups of four, and first-of-group choices."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import order_key
from ..working import materialize


def _row(df: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets a helper column's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` as ``row`` in order over range partitions, written once, with ``_part`` and ``_at`` within it.

    As the table is written, numbers made from it do not change when an executor is lost.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(_row(df).alias("row"), F.monotonically_increasing_id().alias("id"))
    return materialize(ranged, "ordered").select("row", F.shiftright("id", 33).alias("_part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("_at"))


def _before(counts: DataFrame, n: str) -> DataFrame:
    """(_part, _first): the sum of ``n`` over the partitions before; one row a partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(counts.select("_part", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("_first")))


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the order of ``order``, without one task for all of them.

    The rows are range-partitioned, sorted and written once; each partition's first number comes
    from the partitions' counts, of which there is one row a partition. Columns may have any name.
    """
    placed = _placed(df, *order)
    first = _before(placed.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    numbered = placed.join(first, "_part").select("row", (F.col("_first") + F.col("_at")).alias("number"))
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("number").alias(name))


def with_running_total(df: DataFrame, size: str, *order: str, name: str = "start") -> DataFrame:
    """The sum of ``size`` over all rows before each, in the order of ``order``; a window a partition, as above."""
    placed = _placed(df, *order).withColumn("_size", F.col("row").getField(size))
    first = _before(placed.groupBy("_part").agg(F.sum("_size").alias("_n")), "_n")
    within = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = placed.withColumn("_within", within).join(first, "_part").select("row", (F.col("_first") + F.col("_within")).alias("number"))
    return summed.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("number").alias(name))


def _offsets(batches):
    """Adds to rows (ids) of a partition in order how many ids stand before them in it."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part), pa.int32()), pa.array(starts), pa.array(sizes), batch.column(0)], ["part", "start", "size", "ids"])


def _cut(batches, batch: int):
    """Rows (start, ids) to pieces (batch, at, ids): runs of rows that follow each other are cut at the batches' ends."""
    held, first, size = [], 0, 0  # arrays that follow each other from place `first` on

    def pieces(least: int):
        """Cuts off what is beyond `least` ids less than a batch away."""
        nonlocal held, first, size
        stream, at = pa.concat_arrays(held) if held else None, 0
        while size - at > least:
            n = min(batch - (first + at) % batch, size - at)
            if n < batch - (first + at) % batch and least:
                break
            yield (first + at) // batch, (first + at) % batch, stream.slice(at, n)
            at += n
        held, first, size = [stream.slice(at)] if at < size else [], first + at, size - at

    def out(cut):
        found = list(cut)
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for _, _, x in found)]), pa.int32()), pa.concat_arrays([x for _, _, x in found])) if found else pa.array([], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int64()), ids.cast(pa.list_(pa.int32()))], ["batch", "at", "ids"])

    for rows in batches:
        for start, ids in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            if not len(ids):
                continue
            if start != first + size:
                yield out(pieces(0))
                held, first, size = [], start, 0
            held.append(ids.values)
            size += len(ids)
            if size >= 64 * batch:
                yield out(pieces(batch))
    yield out(pieces(0))


def stream_batches(df: DataFrame, ids: str, *order: str, batch: int = 1000) -> DataFrame:
    """(batch, ids): the arrays of all rows in order as one stream, cut every ``batch`` elements; null arrays are empty.

    The rows are placed in order once and numbered by their partitions' sums. Whole batches are then
    cut out of the arrays where they lie; only the pieces at the ends of what a task reads are
    shuffled, at most two for each task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(ids).cast("array<int>").alias("ids"))
    sized = materialize(placed.mapInArrow(_offsets, "part int, start long, size long, ids array<int>"), "stream")
    first = _before(sized.groupBy(F.col("part").alias("_part")).agg(F.sum("size").alias("n")), "n")
    placed = sized.where("size > 0").join(first, F.col("part") == F.col("_part")).select((F.col("start") + F.col("_first")).alias("start"), "ids")
    cut = materialize(placed.mapInArrow(partial(_cut, batch=batch), "batch long, at long, ids array<int>"), "stream-pieces")
    whole = cut.where(F.size("ids") == batch).select("batch", "ids")
    pieces = cut.where(F.size("ids") < batch).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("_xs"))  # less than a batch in all
    return whole.unionAll(pieces.select("batch", F.flatten(F.transform("_xs", lambda s: s["ids"])).alias("ids")))


def contiguous_chunks(df: DataFrame, chunks: int, *order: str) -> DataFrame:
    """chunk_id = row number div ceil(rows / chunks); the last chunks may be short or missing."""
    numbered = with_row_index(df, *order)  # written once
    size = -(-numbered.count() // chunks) or 1
    return numbered.withColumn("chunk_id", F.floor(F.col("row_index") / size).cast("int"))


def sequential_ids(df: DataFrame, name: str, form: str, *order: str) -> DataFrame:
    """``id`` like name_form_00000 in the order given; rows keep ids that they all have already."""
    return with_row_index(df, *order).withColumn("id", F.format_string(f"{name}_{form}_%05d", "row_index"))


def balanced_answers(df: DataFrame, correct: Column, wrong: Column, seed: int, *order: str) -> DataFrame:
    """choice1..4 and label A to D: the right answer's place is the row number modulo 4.

    ``wrong`` is an array of three; they are placed around it in a seeded order.
    """
    at = F.pmod(F.col("row_index"), F.lit(4)).cast("int")
    mixed = F.transform(F.array_sort(F.transform(wrong, lambda x: F.struct(order_key(seed, correct, x).alias("k"), x.alias("x")))), lambda s: s["x"])
    placed = F.concat(F.slice(mixed, F.lit(1), at), F.array(correct), F.slice(mixed, at + 1, F.lit(3)))
    out = with_row_index(df, *order).withColumn("_choices", placed)
    return out.select("*", *[F.get("_choices", F.lit(i)).alias(f"choice{i + 1}") for i in range(4)], F.substring(F.lit("ABCD"), at + 1, F.lit(1)).alias("label")).drop("_choices")


def groups_of_four(df: DataFrame, *order: str) -> DataFrame:
    """``members``: structs of the rows in runs of four by the order given; a short last run is left out."""
    numbered = with_row_index(df, *order)
    grouped = numbered.groupBy(F.floor(F.col("row_index") / 4).alias("group_id")).agg(F.array_sort(F.collect_list(F.struct("row_index", *df.columns))).alias("members"))
    return grouped.where(F.size("members") == 4)


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key. Aggregates structs, so a hot key is reduced before it is shuffled."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, rank).alias("_row"))
    return best.select("_row.*")


def first_per_group(df: DataFrame, n: int, group: list[str], *order: str) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.select(_row(df).alias("row"), rank.alias("rank")).where(F.col("rank") <= n).select("row.*")
