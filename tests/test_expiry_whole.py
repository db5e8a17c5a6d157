"""``stream_expiry`` tells of every announcement of the table, also where its first files have no rows."""

import os

import pyarrow.parquet as pq
import pytest

from notelake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def written(path, tables):
    """A table of part files that came in this order."""
    folder = path / "orders.parquet"
    folder.mkdir()
    for n, part in enumerate(tables):
        file = folder / f"part-{n:03d}.parquet"
        pq.write_table(part, file)
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(path)


def test_every_order_is_told_of(spark):
    want = pq.read_table(f"{SF}/orders.parquet")["o_orderkey"].to_pylist()
    assert sorted(r.memory_id for r in QUERIES["stream_expiry"](spark, SF).collect()) == sorted(want)


def test_a_micro_batch_of_files_without_rows_does_not_end_the_stream(spark, tmp_path):
    orders = pq.read_table(f"{SF}/orders.parquet").slice(0, 90)
    got = QUERIES["stream_expiry"](spark, written(tmp_path, [*[orders.slice(0, 0)] * 32, orders])).collect()
    assert {r.memory_id for r in got} >= {i for i in orders["o_orderkey"].to_pylist() if i % 9 == 0} and len(got) == 90


def test_a_table_without_rows_ends(spark, tmp_path):
    orders = pq.read_table(f"{SF}/orders.parquet")
    assert QUERIES["stream_expiry"](spark, written(tmp_path, [orders.slice(0, 0)] * 20)).count() == 0
