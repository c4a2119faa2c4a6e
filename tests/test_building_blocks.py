import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import dedupe, distinct, labels, quantiles


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(4)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0, 5.0, 5.0], [-1.0, 0.0, 1.0, None],
    [1e308, -1e308, 0.0, 5e-324, 2.0], [float(i % 7) for i in range(500)],
    [random.Random(1).lognormvariate(3, 4) * (-1) ** i for i in range(3000)],
    [1e12] + [round(i * 0.01, 2) for i in range(5000)],
])
def test_exact_quantiles(spark, values):
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.exact_quantiles(doubles(spark, values), {"v": F.col("v")}, {"v": probabilities})
    expected = pd.Series(values, dtype="float64").quantile(probabilities).tolist()
    np.testing.assert_allclose(got["v"], expected, rtol=1e-12)


def test_quantiles_of_several_columns(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = quantiles.exact_quantiles(
        lines, {"p": F.col("l_extendedprice"), "q": F.col("l_quantity"), "none": F.lit(None).cast("double")},
        {"p": [0.5], "q": [0.25, 0.75], "none": [0.5]})
    frame = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    assert got["p"] == [pytest.approx(statistics.median(frame.l_extendedprice))]
    assert got["q"] == [frame.l_quantity.quantile(0.25), frame.l_quantity.quantile(0.75)]
    assert got["none"] == [None]


def test_distinct_counts(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0, "x" * 100), (1, "b", -0.0, "x" * 100), (2, None, 1.5, "y" * 100),
         (None, "a", None, None)], "i int, s string, d double, t string")
    assert distinct.distinct_counts(df, df.columns) == {"i": 2, "s": 2, "d": 2, "t": 2}
    assert distinct.distinct_counts(df.limit(0), ["i"]) == {"i": 0}


@pytest.fixture
def rows(spark):
    values = [(1, "a", None), (1, "a", None), (1, None, "a"), (2, "b", "c"), (2, "b", "c"), (2, "b", "c"),
              (3, "x", "y")]
    return spark.createDataFrame(values, "i int, s string, t string")


def test_drop_duplicates(rows):
    expected = {(1, "a", None), (1, None, "a"), (2, "b", "c"), (3, "x", "y")}
    kept = [tuple(r) for r in dedupe.drop_duplicates(rows).collect()]
    assert len(kept) == 4 and set(kept) == expected
    assert dedupe.count_duplicates(rows) == 3


def test_no_duplicates_means_no_extra_work(rows):
    unique = rows.filter("i = 3")
    assert dedupe.drop_duplicates(unique) is unique
    assert dedupe.count_duplicates(unique) == 0


def test_rows_are_only_shuffled_where_they_repeat(rows):
    plan = dedupe.drop_duplicates(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_merge_map():
    assert labels.merge_map({"BUILDING": 10, "BUILDINGG": 2, "MACHINERY": 5}) == {"BUILDINGG": "BUILDING"}
    assert labels.merge_map({"30 days": 5, "60 days": 4}) == {}
    assert labels.merge_map({"30 days": 5, "60 days": 4}, literal=True) == {"60 days": "30 days"}
    assert labels.merge_map({"اصفهانن": 1, "اصفهان": 1, "تهران": 2}) == {"اصفهانن": "اصفهان"}
    assert labels.merge_map({"": 5, "nan": 3, "nann": 1}) == {}
    assert labels.merge_map({"AMERICA": 3, "AFRICA": 3}) == {"AMERICA": "AFRICA"}
    assert labels.merge_map({"AMERICA": 3, "AFRICA": 3}, min_ratio=0.8) == {}


def test_replace_labels(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    out = df.select(labels.replace_labels(F.col("s"), {"a": "z"}).alias("s")).collect()
    assert [r.s for r in out] == ["z", "b", None]
