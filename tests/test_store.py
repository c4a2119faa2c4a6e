import csv
import os
import time

import pytest
from pyspark.sql import functions as F

import tablescope as ts
from tablescope import store as module
from tablescope.store import AnalysisStore, source_fingerprint


@pytest.fixture
def files(spark, tmp_path, messy_sales):
    path = tmp_path / "sales table.csv"
    path.mkdir()
    with open(path / "part.csv", "w", newline="") as out:
        csv.writer(out).writerows([messy_sales.columns, *map(tuple, messy_sales.collect())])
    return str(path)


def read(spark, path):
    return spark.read.csv(path, header=True)


def test_second_analysis_does_not_read_the_raw_files(spark, files, tmp_path, monkeypatch):
    store = AnalysisStore(spark, str(tmp_path / "store"))
    first = store.build(read(spark, files))
    monkeypatch.setattr(module, "build_analysis", lambda *a, **k: pytest.fail("made again"))
    second = store.build(read(spark, files))
    assert second.cleaning.actions == first.cleaning.actions and second.cleaning.stats == first.cleaning.stats
    assert (second.profile, second.structure, second.quality) == (first.profile, first.structure, first.quality)
    assert second.data.schema == first.data.schema
    assert sorted(second.data.collect(), key=repr) == sorted(first.data.collect(), key=repr)
    plan = second.data._jdf.queryExecution().toString()
    assert "parquet" in plan.lower() and "csv" not in plan.lower()
    assert ts.calculate_kpis(second.data, second.profile).frame(spark).count() > 0


def test_stored_equals_fresh(spark, files, tmp_path):
    kept = AnalysisStore(spark, str(tmp_path / "store")).build(read(spark, files))
    fresh = ts.build_analysis(read(spark, files))
    assert kept.cleaning.plan == fresh.cleaning.plan and kept.quality == fresh.quality and kept.profile == fresh.profile
    assert sorted(kept.data.collect(), key=repr) == sorted(fresh.data.collect(), key=repr)


def test_keys_differ_by_files_plan_and_options(spark, files, tmp_path):
    store = AnalysisStore(spark, str(tmp_path / "store"))
    raw = read(spark, files)
    keys = [store.key(raw), store.key(raw, ts.CleaningOptions(strict_days=True)), store.key(raw, None, {"Status": ("text", "")}),
            store.key(raw.limit(3)), store.key(raw.drop("Status")), store.key(raw, money_column="Quantity")]
    assert None not in keys and len(set(keys)) == len(keys)
    assert store.key(read(spark, files)) == keys[0] == store.key(raw, ts.CleaningOptions())
    part = os.path.join(files, "part.csv")
    with open(part, "a") as out:
        out.write("ORD-1009,2026-05-01,x,y,P-1,z,1,2,0,1%,3,w\n")
    os.utime(part, (time.time(), time.time() + 5))
    assert store.key(read(spark, files)) not in keys


def test_wide_plans_are_told_apart(spark, tmp_path):
    names = [f"c{i}" for i in range(40)]
    spark.range(3).select(*[(F.col("id") + i).alias(n) for i, n in enumerate(names)]).write.parquet(path := str(tmp_path / "wide"))
    wide = spark.read.parquet(path)
    changed = wide.select(*names[:35], *[(F.col(n) * 2).alias(n) for n in names[35:]])
    again = wide.select(*names[:35], *[(F.col(n) * 3).alias(n) for n in names[35:]])
    assert source_fingerprint(changed) != source_fingerprint(again)
    assert source_fingerprint(changed) == source_fingerprint(wide.select(*names[:35], *[(F.col(n) * 2).alias(n) for n in names[35:]]))


def test_tables_not_from_files_are_not_kept(spark, tmp_path, files, messy_sales):
    store = AnalysisStore(spark, str(tmp_path / "store"))
    assert store.key(messy_sales) is None
    assert store.key(read(spark, files).withColumn("draw", F.rand())) is None
    assert store.build(messy_sales).profile.rows == 4
    assert store.entries() == []


def test_eviction_spares_leases(spark, files, tmp_path):
    store = AnalysisStore(spark, str(tmp_path / "store"), keep=1)
    raw = read(spark, files)
    one = store.build(raw)
    two = store.build(raw.where("Quantity > 10"))
    assert len(store.entries()) == 2  # both are leased
    store.release(one)
    assert len(store.evict()) == 1
    assert store.entries() == [store.key(raw.where("Quantity > 10"))]
    assert two.data.count() > 0
    store.release(two)
    assert len(store.evict(keep=0)) == 1 and store.files.names() == []
    store.files.write("given up/data", "")
    assert store.evict() == []
    store.lease_seconds = -1
    assert store.evict() == ["given up"]


def test_the_first_of_two_builders_wins(spark, files, tmp_path):
    store = AnalysisStore(spark, str(tmp_path / "store"))
    raw = read(spark, files)
    key = store.key(raw)
    store._make(key, raw, None, None, {})
    before = store.files.read(f"{key}/manifest.json")
    store._make(key, raw, None, None, {})
    assert store.files.read(f"{key}/manifest.json") == before
    assert sum(n.startswith("data-") for n in store.files.names(key)) == 1
