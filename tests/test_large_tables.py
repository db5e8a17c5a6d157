"""Tables as large ones are written, over part files, and very long texts."""

import os

import pytest
from pyspark.sql import functions as F

from notelake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_streams_read_a_table_of_part_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    got, want = (sorted(map(tuple, QUERIES["stream_pull"](spark, str(d)).collect())) for d in (tmp_path, SF))
    assert want and got == want


def test_a_long_sealed_text_opens(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(20)
    orders.withColumn("o_orderpriority", F.concat(F.lit("1-"), F.repeat(F.lit("x"), 1_200_000))).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["seal_text"](spark, str(tmp_path)).collect()
    assert len(got) == 20 and any(r.is_sealed for r in got) and all(r.opens for r in got)
