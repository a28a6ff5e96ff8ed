"""Queries whose SQL the smallest table alone does not tell apart."""

import duckdb
import pytest
from pyspark.sql import functions as F

from talata import catalog
from tests.test_queries import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", ["flat_generative", "nested_generative"])
def test_words_are_as_written(spark, data, duck, name):  # noqa: F811
    made, wanted = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
    assert made[0] == wanted[0] and made[1].equals(wanted[1])


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9, 15, 25, 36])
def test_split_ends_are_rounded(spark, tmp_path, n):
    spark.range(n).select((F.col("id") * 3).alias("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    made, wanted = rows(catalog.QUERIES["range_split"](spark, str(tmp_path)).toPandas()), rows(con.execute(catalog.ORACLES["range_split"]).df())
    assert made[0] == wanted[0] and made[1].values.tolist() == wanted[1].values.tolist()
