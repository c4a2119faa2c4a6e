import math
import shutil

import pytest
from pyspark.sql import functions as F

from tablescope.operators import summary
from tablescope.operators.quantiles import exact_quantiles

SHAPE = "k int, `a.b` double, t string, d date, m map<string,int>"


def rows_of(start, stop):
    return [(i, [None, float("nan"), -0.0, 0.0, i / 7][i % 5], [None, "", "x" * 200, f"v{i % 9}"][i % 4], None, {"a": i % 2})
            for i in range(start, stop)]


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE).withColumn("d", F.date_add(F.lit("2024-01-31").cast("date"), F.col("k") % 17))


def same(a, b):
    def near(x, y):
        return x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9))
    return len(a) == len(b) and all(near(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_deliveries_together_equal_one_run(spark, tmp_path):
    store = summary.SummaryStore(spark, str(tmp_path / "states"))
    assert store.describe().collect() == []
    for name, (start, stop) in {"old": (0, 90), "new": (90, 230), "none": (5, 5)}.items():
        raw = str(tmp_path / name)
        table(spark, rows_of(start, stop)).write.parquet(raw)
        store.add(name, spark.read.parquet(raw))
        shutil.rmtree(raw)  # nothing reads it again
    whole = table(spark, rows_of(0, 230))
    assert store.deliveries() == ["new", "none", "old"]
    got = store.describe().collect()
    assert same(got, summary.describe(summary.summarise(whole)).collect())
    facts = {r["column"]: r for r in got}
    values = sorted([0.0 if i % 5 in (2, 3) else i / 7 for i in range(230) if i % 5 > 1])
    assert (facts["a.b"].rows, facts["a.b"].missing, facts["a.b"].distinct) == (230, 92, len(set(values)))
    expected = exact_quantiles(whole, {"v": F.nanvl(F.col("`a.b`"), F.lit(None).cast("double"))}, {"v": summary.QUARTILES})["v"]
    assert [facts["a.b"].q1, facts["a.b"].median, facts["a.b"].q3] == expected
    assert facts["t"].distinct == 2 + 9 and facts["t"].low is None and facts["m"].distinct == 2
    assert facts["d"].low == 19753.0 and facts["d"].high == 19753.0 + 16


def test_a_delivery_is_replaced_dropped_or_not_there_until_whole(spark, tmp_path):
    store = summary.SummaryStore(spark, str(tmp_path / "states"), ["k"])
    store.add("a", table(spark, rows_of(0, 10)))
    store.add("b", table(spark, rows_of(0, 20)))
    store.add("b", table(spark, rows_of(0, 5)))
    assert store.describe().first().rows == 15 and store.describe().first().distinct == 10
    (tmp_path / "states" / "a" / "_SUCCESS").unlink()
    assert store.deliveries() == ["b"] and store.describe().first().rows == 5
    store.drop("b")
    assert store.describe().collect() == []
    with pytest.raises(ValueError):
        store.add("../b", table(spark, []))


def test_states_are_combined_before_the_shuffle(spark, tmp_path):
    store = summary.SummaryStore(spark, str(tmp_path / "states"))
    store.add("a", table(spark, rows_of(0, 40)))
    plan = summary.summarise(table(spark, rows_of(0, 40)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Python" not in plan
    assert "states" in store.state()._jdf.queryExecution().toString()


def test_a_delivery_is_read_in_small_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(summary, "SCAN_BYTES", 1 << 14)
    (tmp_path / "raw.txt").write_text("".join(f"{i:09}\n" for i in range(40_000)))
    raw = spark.read.text(str(tmp_path / "raw.txt")).select("value", F.spark_partition_id().alias("part"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    store = summary.SummaryStore(spark, str(tmp_path / "states"))
    store.add("a", raw)
    assert {r["column"]: r.distinct for r in store.describe().collect()} == {"part": 25, "value": 40_000}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    seen = []
    monkeypatch.setattr(summary, "describe", lambda state: seen.append(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    store.describe()
    assert seen == [str(1 << 14)] and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_group_states_merge(spark):
    keys = {"month": F.trunc("d", "month")}
    parts = [summary.group_states(table(spark, rows_of(a, b)), keys, F.col("k")) for a, b in ((0, 70), (70, 230))]
    got = summary.merge_groups(parts[0].unionByName(parts[1]), ["month"])
    assert sorted(got.collect()) == sorted(summary.group_states(table(spark, rows_of(0, 230)), keys, F.col("k")).collect())
