"""Binary id files: any file system, byte ranges, pushed filters, folders in one job, streams cut in place."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talata import working
from talata.operators import ordering
from talata.sources import idfiles, sinks
from tests.stores import store


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, [rng.randrange(60_000) for _ in range(rng.randrange(6))] or None) for i in range(500)], "id int, ids array<int>").repartition(3)


def test_files_on_another_store(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setenv("TALATA_TEST_STORE", str(tmp_path))  # tasks of local mode see it too
    where = lambda uri, root=str(tmp_path): (__import__("pyarrow.fs").fs.SubTreeFileSystem(root, __import__("pyarrow.fs").fs.LocalFileSystem()), uri.removeprefix("store://"))
    meta = sinks.write_ids(rows, "store://bucket/flat", "ids", "id", opener=where)
    want = [x for r in rows.orderBy("id").collect() for x in r.ids or []]
    assert meta["n_ids"] == len(want) and all(p.startswith("store://bucket/flat/") for p in meta["parts"])
    assert os.listdir(tmp_path) == ["bucket"] and not os.path.exists("bucket")
    options = {"paths": json.dumps(meta["parts"]), "dtype": "uint16", "splitbytes": "200"}
    reader = idfiles.FlatReader(options)
    reader.opener = store
    ranges = reader.partitions()
    assert len(ranges) == sum(-(-os.path.getsize(tmp_path / p.removeprefix("store://")) // 200) for p in meta["parts"])
    assert [x for r in ranges for batch in reader.read(r) for x in batch.column(2).flatten().to_pylist()] == want
    prefixes = sinks.write_indexed(rows, "store://bucket/indexed", "ids", "id", end_id=7, opener=where)
    pairs = idfiles.IndexedReader({"paths": json.dumps(prefixes), "splitbytes": "150"})
    pairs.opener = store
    made = [x.as_py() for r in pairs.partitions() for batch in pairs.read(r) for x in batch.column(2)]
    assert made == [[*(r.ids or []), 7] for r in rows.orderBy("id").collect()] and len(pairs.partitions()) > 5


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    np.arange(300_000, dtype="<u2").tofile(tmp_path / "one.bin")
    df = sinks.read_ids(spark, [f"file://{tmp_path}/one.bin"], width=3, split_bytes=60_000)
    assert df.rdd.getNumPartitions() == 10
    made = df.agg(F.count("*"), F.sum("row"), F.sum(F.expr("aggregate(ids, 0L, (a, x) -> a + x)"))).first()
    assert tuple(made) == (100_000, 100_000 * 99_999 // 2, int(np.arange(300_000, dtype="<u2").astype(np.int64).sum()))
    assert [r.ids for r in df.where("row >= 40000 AND row < 40002").orderBy("row").collect()] == [[x % 65_536 for x in range(3 * r, 3 * r + 3)] for r in (40_000, 40_001)]
    with pytest.raises(Exception, match="are no rows of 7"):
        sinks.read_ids(spark, [f"file://{tmp_path}/one.bin"], width=7).collect()


def test_filters_narrow_the_ranges(tmp_path):
    np.arange(1000, dtype="<u2").tofile(tmp_path / "a.bin")
    np.arange(500, dtype="<u2").tofile(tmp_path / "b.bin")
    options = {"paths": json.dumps([str(tmp_path / "a.bin"), str(tmp_path / "b.bin")]), "splitbytes": "400"}
    ask = lambda *filters: (r := idfiles.FlatReader(options), list(r.pushFilters(list(filters))), [(p.part, p.first, p.end) for p in r.partitions()])[1:]
    row, part = ("row",), ("part",)
    assert ask(idfiles.EqualTo(part, 1), idfiles.GreaterThan(row, 99), idfiles.LessThanOrEqual(row, 310)) == ([], [(1, 100, 300), (1, 300, 311)])
    assert ask(idfiles.LessThan(row, 10)) == ([], [(0, 0, 10), (1, 0, 10)])
    other = idfiles.EqualTo(("ids",), 3)
    left, ranges = ask(other, idfiles.EqualTo(row, 5000))
    assert left == [other] and ranges == [(0, 0, 0)]


def test_a_thousand_files_are_one_job(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03d}.jsonl").write_text("".join(json.dumps({"question": "a" * (j + 1 + i % 3)}) + "\n" for j in range(i % 4)) + ("{broken\n" if i % 100 == 7 else "") + ('{"question": "\U0001f600"}\n' if i == 9 else ""))
    codes = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c))
    spark.sparkContext.setJobGroup("convert", "")
    made = {r.file.rsplit("/", 1)[1]: r for r in sinks.convert_files(spark, f"file://{tmp_path}/*.jsonl", f"file://{tmp_path}/out", codes).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("convert")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20
    assert len(made) == 225 and sum(r.n_failed for r in made.values()) == 4  # the others are empty
    assert made["f007.jsonl"].reason == "no JSON" and made["f007.jsonl"].n_rows == 3 and made["f009.jsonl"].reason == "ids do not fit uint16" and made["f009.jsonl"].n_rows == 1
    for i in (1, 7, 250, 299):
        r = made[f"f{i:03d}.jsonl"]
        sizes = [j + 1 + i % 3 for j in range(i % 4)]
        assert (r.n_rows, r.n_ids, r.longest) == (len(sizes), sum(sizes), max(sizes))
        assert sum(os.path.getsize(p.removeprefix("file://")) for p in r.parts) == 2 * sum(sizes)


@pytest.mark.parametrize("batch", [1, 3, 16, 1000, 5000])
def test_streams_equal_one_list(spark, rows, batch):
    want = [x for r in rows.orderBy("id").collect() for x in r.ids or []]
    made = ordering.stream_batches(rows, "ids", "id", batch=batch).orderBy("batch").collect()
    assert [r.ids for r in made] == [want[i : i + batch] for i in range(0, len(want), batch)] and [r.batch for r in made] == list(range(len(made)))
    assert ordering.stream_batches(rows.limit(0), "ids", "id", batch=batch).collect() == []


def test_only_the_ends_of_partitions_are_shuffled(spark):
    rows = spark.range(4000).select("id", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: (i + F.col("id")).cast("int")).alias("ids"))
    made = ordering.stream_batches(rows, "ids", "id", batch=1000)
    pieces = working.materialize(made, "batches")
    assert pieces.count() == 2000
    sized = ordering.materialize(rows.repartitionByRange("id").sortWithinPartitions("id").select("ids").mapInArrow(ordering._offsets, "part int, start long, size long, ids array<int>"), "sized")
    first = ordering._before(sized.groupBy(F.col("part").alias("_part")).agg(F.sum("size").alias("n")), "n")
    placed = sized.join(first, F.col("part") == F.col("_part")).select((F.col("start") + F.col("_first")).alias("start"), "ids")
    cut = placed.mapInArrow(ordering.partial(ordering._cut, batch=999), "batch long, at long, ids array<int>")
    assert cut.where(F.size("ids") < 999).agg(F.sum(F.size("ids"))).first()[0] < 0.01 * 2_000_000
