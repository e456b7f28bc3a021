"""The incremental rollup: days touched only, results of a full rebuild, lost runs, changed files."""

import datetime as dt
import glob
import os

import pyspark.sql.functions as F
import pytest

from tessera.operators import sales_days as SD
from tests.helpers import rows

O = "o_orderkey long, o_orderdate timestamp_ntz, r_name string"
L = "l_orderkey long, l_quantity double, revenue double, p_brand string"


def day(n):
    return dt.datetime(2024, 1, n, 12)


@pytest.fixture()
def world(spark, tmp_path):
    class World:
        orders, lines, out = (str(tmp_path / x) for x in ("orders", "lines", "days"))

        def add(self, orders=(), lines=()):
            if orders:
                spark.createDataFrame(orders, O).coalesce(1).write.mode("append").parquet(self.orders)
            if lines:
                spark.createDataFrame(lines, L).coalesce(1).write.mode("append").parquet(self.lines)

        def sales(self, orders):
            return spark.read.parquet(self.lines).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

        def run(self, full=False):
            return SD.refresh_sales_days(spark, self.orders, self.lines, self.sales, self.out, full)

        def files(self):
            return {os.path.basename(os.path.dirname(f)): os.path.basename(f) for f in glob.glob(f"{self.out}/*/*.parquet")}

        def check(self):
            want = SD.day_rows(self.sales(spark.read.parquet(self.orders)))
            assert rows(spark.read.parquet(self.out).select(*want.columns)) == rows(want)

    w = World()
    w.add([(1, day(1), "EU"), (2, day(2), "EU"), (3, day(3), "US"), (4, None, "US")],
          [(1, 1.0, 10.10, "a"), (2, 2.0, 20.20, "b"), (3, 3.0, 30.30, "a"), (4, 1.0, 5.5, None)])
    assert w.run() is None
    w.check()
    return w


def test_a_late_order_changes_only_its_day(world):
    before = world.files()
    assert world.run() == [] and world.files() == before          # nothing new
    world.add([(5, day(2), "US")], [(5, 1.0, 7.07, "c")])
    assert world.run() == [day(2).date()]
    after = world.files()
    assert {k for k in after if before.get(k) != after[k]} == {"day=2024-01-02"}
    world.check()


def test_late_lines_orders_without_date_and_new_days(world):
    world.add([], [(3, 1.0, 1.01, "z"), (4, 2.0, 2.02, "z"), (9, 1.0, 9.0, "z")])     # order 9 is not there yet
    assert set(world.run()) == {day(3).date(), None}
    world.check()
    world.add([(9, day(20), "EU"), (10, day(21), "EU")], [])
    assert set(world.run()) == {day(20).date(), day(21).date()}
    world.check()


def test_totals_equal_a_full_rebuild(spark, world):
    world.add([(5, day(2), "US"), (6, day(9), "EU")], [(5, 1.0, 7.07, "c"), (6, 1.0, 0.03, "c"), (1, 1.0, 0.01, "a")])
    world.run()
    got = rows(SD.sales_totals(spark, world.out))
    assert world.run(full=True) is None
    assert rows(SD.sales_totals(spark, world.out)) == got and len(got) > 10
    assert world.run() == []


def test_a_lost_run_is_done_again(world, monkeypatch):
    world.add([(5, day(2), "US")], [(5, 1.0, 7.07, "c")])
    import pyspark.sql.readwriter as rw
    real = rw.DataFrameWriter.parquet

    def lost(self, path, *a, **k):
        if "-files" in path:
            raise RuntimeError("lost")
        return real(self, path, *a, **k)

    # the days are written, the files seen are not noted
    monkeypatch.setattr(rw.DataFrameWriter, "parquet", lost)
    with pytest.raises(RuntimeError, match="lost"):
        world.run()
    monkeypatch.undo()
    assert world.run() == [day(2).date()]
    world.check()


def test_a_file_that_is_gone_rebuilds(spark, world):
    world.add([(5, day(2), "US")], [(5, 1.0, 7.07, "c")])
    world.run()
    newest = max(glob.glob(f"{world.lines}/*.parquet"), key=os.path.getmtime)
    os.unlink(newest)
    assert world.run() is None
    world.check()
    assert world.run() == []
