"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests on one machine) a temporary folder is made
    and put there; a cluster without the setting raises, as its machines would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/talata-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(conf).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts lineage and survives the loss of executors; later passes read the table instead of
    repeating the work above it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame | None) -> None:
    """Delete a working table that ``materialize`` made and that nothing reads any more."""
    if table is None:
        return
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/talata-" in path:
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
