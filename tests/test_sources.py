"""Providers as a data source, bucketed tables, written models, and the plans that they lead to."""

import datetime as dt
import json
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quantloom.functions.windows import sma
from quantloom.operators import indicators, ml
from quantloom.plans.adapters import bars, written_once
from quantloom.sources import normalize, provider

SF = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


class Asked:
    """A provider that notes in a folder what it was asked for."""

    def __init__(self, path):
        self.path = path

    def symbols(self):
        return ["A", "B", "C", "D", "E"]

    def bars(self, symbols, start, end):
        import uuid

        with open(f"{self.path}/{uuid.uuid4().hex}", "w") as f:
            json.dump([symbols, str(start), str(end)], f)
        for s in symbols:
            days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(100)]
            days = [d for d in days if (start is None or d >= start) and (end is None or d <= end)]
            x = [float(d.toordinal()) for d in days]
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(days)), pa.array(days, pa.date32()), *[pa.array(x)] * 6], schema=provider.SCHEMA)


def test_provider_gets_the_filters(spark, tmp_path):
    path = str(tmp_path)
    df = provider.read_provider(spark, lambda: Asked(path), 2, push_filters=True)
    got = df.where("symbol in ('B', 'D', 'E', 'Z') and date > '2024-02-01' and date <= '2024-02-10' and close > 0").select("symbol", "date").collect()
    assert {(r.symbol, r.date) for r in got} == {(s, dt.date(2024, 2, d)) for s in "BDE" for d in range(2, 11)} and len(got) == 27
    asked = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(s for a in asked for s in a[0]) == ["B", "D", "E"] and max(len(a[0]) for a in asked) == 2
    assert {(a[1], a[2]) for a in asked} == {("2024-02-02", "2024-02-10")}


def test_provider_whole_and_empty(spark, tmp_path):
    df = provider.read_provider(spark, lambda: Asked(str(tmp_path)), 2)
    assert df.count() == 500 and df.rdd.getNumPartitions() == 3
    assert df.where("symbol = 'none'").count() == 0
    assert df.where("date > '2024-03-01' and date < '2024-02-01'").count() == 0
    assert df.where("symbol = 'A' or close < 0").count() == 100
    both = df.where("symbol = 'A'").union(df.where("symbol in ('B', 'C')"))
    assert {r.symbol: r["count"] for r in both.groupBy("symbol").count().collect()} == {"A": 100, "B": 100, "C": 100}
    pushed = provider.read_provider(spark, lambda: Asked(str(tmp_path)), 2, push_filters=True)
    assert pushed.where("symbol = 'A'").count() == 100
    assert pushed.where("symbol = 'A' or close < 0").count() == 100  # not a filter that can be handed on
    assert pushed.where("date > '2024-03-01' and date < '2024-02-01'").count() == 0 and pushed.count() == 500


def test_folder_provider(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    rows = [("A/B", dt.date(2024, 1, d), 1.0, 2.0, 0.5, float(d), 10.0, 11.0) for d in range(1, 6)] + [("C", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0, 11.0)]
    spark.createDataFrame(rows, provider.COLUMNS).write.partitionBy("symbol").parquet(path)
    df = provider.read_provider(spark, lambda: provider.FolderProvider(path))
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    assert [r.close for r in df.where("symbol = 'A/B' and date = '2024-01-03'").collect()] == [3.0]


def test_bucketed_table_has_no_shuffle_and_prunes(spark, tmp_path):
    b = bars(spark, SF).withColumn("market", F.concat(F.lit("m"), (F.length("symbol")).cast("string")))
    normalize.save_bars(b, "bucketed_bars", f"file://{tmp_path}/t", buckets=4)
    universe = b.select("market", "symbol").distinct().where("symbol like '%3'")
    universe.write.parquet(f"file://{tmp_path}/u")
    wanted = spark.read.parquet(f"file://{tmp_path}/u").where("symbol <> 'Brand#13'")
    df = normalize.of_universe(spark, "bucketed_bars", wanted).select("symbol", "date", sma("close", 5).alias("m"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "hashpartitioning(symbol" not in plan
    want = b.join(wanted, ["market", "symbol"], "left_semi").select("symbol", "date", sma("close", 5).alias("m"))
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    spark.sql("DROP TABLE bucketed_bars")


def test_one_fit_two_loads(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    rows = [(s, d, 10.0, 10.0 + (k * 7 % 13), 9.0 - (k * 5 % 7) / 10, 9.5 + (k * 11 % 17) / 4 + i, 100.0 + k) for i, s in enumerate("XY") for k, d in enumerate(days)]
    data = ml.dataset(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double"))
    model, _, late = ml.train(data, trees=5, depth=3)
    path = f"file://{tmp_path}/model"
    ml.save(model, path)
    one, two = ml.load(path), ml.load(path)
    shown = lambda m: sorted(map(str, ml.predict(m, data).collect()))
    assert shown(model) == shown(one) == shown(two) and ml.importance(model) == ml.importance(two) and ml.evaluate(one, late) == ml.evaluate(two, late)
    with pytest.raises(Exception, match="already exists"):
        ml.save(model, path)


def test_tables_are_written_once_a_query(spark):
    with written_once():
        one, two = bars(spark, SF), bars(spark, SF)
        assert one is two
        plan = indicators.everything(one)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan
    assert "lineitem" in bars(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_query_reads_lineitem_twice_at_most(spark):
    """What is left of the fact table in the plans of queries that use the bars many times."""
    from quantloom.plans.queries import QUERIES

    for name in ("weight_schedule", "bt_portfolio", "factor_composite_avail", "run_coverage_summary", "return_moments"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem") <= 2, name
