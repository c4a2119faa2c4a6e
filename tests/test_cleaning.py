import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.cleaning import clean_dataset, clean_names, compile_plan
from tablescope.plans import CleaningOptions, CleaningPlan


@pytest.fixture
def cleaned(messy_sales):
    return clean_dataset(messy_sales)


def values(df, column):
    return [r[0] for r in df.select(F.col(f"`{column}`")).collect()]


def test_types(cleaned):
    types = dict(cleaned.data.dtypes)
    for name in ("Total_Amount_USD", "Unit_Price_USD", "Tax_Pct"):
        assert types[name] == "double"
    assert types["Order_Date"] == "timestamp"
    assert dt.datetime(2026, 5, 21) in values(cleaned.data, "Order_Date")


def test_identifiers_stay_text(cleaned):
    assert sorted(values(cleaned.data, "Order_ID")) == ["ORD-1001", "ORD-1002", "ORD-1003", "ORD-1004"]
    assert dict(cleaned.data.dtypes)["Product_Code"] == "string"
    assert set(values(cleaned.data, "Product_Code")) == {"P-104", "P-105", "P-106"}


def test_duplicates(cleaned):
    assert cleaned.duplicate_rows_removed == 1
    assert cleaned.data.count() == 4
    assert cleaned.duplicate_id_rows == 0


def test_text_and_labels(cleaned):
    assert set(values(cleaned.data, "Customer")) == {"پارس صنعت", "فولاد جنوب"}
    assert set(values(cleaned.data, "Status")) == {"تکمیل شده", "لغو شده", "در انتظار پرداخت"}
    assert set(values(cleaned.data, "Province")) == {"تهران", "اصفهان"}


def test_audit(cleaned, spark):
    found = {(a.column, a.action_code): a.affected_rows for a in cleaned.actions}
    assert found == {
        ("Customer", "text"): 2, ("Status", "text"): 1,
        ("Unit_Price_USD", "to_number"): 5, ("Tax_Pct", "to_number"): 5,
        ("Total_Amount_USD", "to_number"): 5, ("Order_Date", "to_date"): 5,
        ("Province", "merge"): 1, ("—", "drop_duplicate"): 1,
    }
    frame = cleaned.actions_frame(spark)
    assert frame.count() == len(cleaned.actions)
    assert "«اصفهانن» → «اصفهان»" in values(frame.filter("action_code = 'merge'"), "detail")[0]


def test_literal_labels_also_merge_ids(messy_sales):
    plan = compile_plan(messy_sales, CleaningOptions(literal_labels=True))[0]
    ids = next(d for d in plan.columns if d.name == "Order_ID")
    assert set(ids.labels.values()) == {"ORD-1004"}


def test_plan_survives_json_and_applies_elsewhere(messy_sales, cleaned):
    plan = CleaningPlan.from_json(cleaned.plan.to_json())
    assert plan == cleaned.plan
    again = plan.apply(messy_sales).dropDuplicates()
    assert sorted(map(str, again.collect())) == sorted(map(str, cleaned.data.collect()))
    with pytest.raises(ValueError):
        plan.apply(messy_sales.drop("Status"))


def test_names():
    assert clean_names(["a ", "a", " a", "b", ""]) == ["a", "a_1", "a_2", "b", ""]
    assert clean_names(["a ", "a", "a_1"]) == ["a", "a_2", "a_1"]


def test_empties(spark):
    df = spark.createDataFrame([("x", None, 1.0), (None, None, float("nan")), ("y", None, 2.0)],
                               " `a b ` string, `none` string, v double")
    result = clean_dataset(df)
    assert result.data.columns == ["a b", "v"]
    assert result.data.count() == 2
    found = [(a.column, a.action_code, a.affected_rows) for a in result.actions]
    assert found == [("a b ", "rename", 1), ("none", "drop_column", 1), ("—", "drop_row", 1)]


def test_rejected_values(spark):
    rows = [(str(i), "2026-01-01") for i in range(95)] + [("bad", "x"), ("worse", "2026-01-01")]
    rows += [("bad", "y"), (None, None)]
    result = clean_dataset(spark.createDataFrame(rows, "amount string, when_date string"))
    assert result.rejected_values == {"amount": ["bad", "worse"], "when_date": ["x", "y"]}
    assert result.rejected_counts == {"amount": 2, "when_date": 2}
    detail = {a.column: a.detail for a in result.actions if a.action_code.startswith("to_")}
    assert " 2 " in detail["amount"] and " 2 " in detail["when_date"]


def test_too_few_parse_stays_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), ("y",)], "v string")
    assert clean_dataset(df).data.dtypes == [("v", "string")]


def test_date_like_by_values(spark):
    df = spark.createDataFrame([(f"2026-01-{i:02d}",) for i in range(1, 29)], "col string")
    assert clean_dataset(df).data.dtypes == [("col", "timestamp")]


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("1a", "x"), ("1a", "y"), ("2b", "z")], "order_id string, v string")
    result = clean_dataset(df)
    assert result.duplicate_id_rows == 1 and result.data.count() == 3
    assert [a.action_code for a in result.actions] == ["duplicate_id"]


def test_unicode_forms(spark):
    df = spark.createDataFrame([("１２３",), ("456",), ("７",)], "v string")
    result = clean_dataset(df)
    assert result.plan.columns[0].unicode_forms
    assert sorted(values(result.data, "v")) == [7.0, 123.0, 456.0]
    plain = clean_dataset(df.filter("v = '456'"))
    assert not plain.plan.columns[0].unicode_forms
    assert "ArrowEvalPython" not in plain.data._jdf.queryExecution().executedPlan().toString()


def test_typos_are_repaired_beyond_the_label_cap(spark):
    rows = [(f"w{chr(97 + i % 26)}{'q' * (i // 26)}",) for i in range(300)] + [("اصفهانن",)]
    result = clean_dataset(spark.createDataFrame(rows, "place string"))
    assert "اصفهان" in values(result.data, "place")
    assert [(a.action_code, a.affected_rows) for a in result.actions] == [("merge", 1)]


def test_empty_frame(spark):
    result = clean_dataset(spark.createDataFrame([], T.StructType([])))
    assert result.data.isEmpty() and result.actions == []
    with pytest.raises(ValueError):
        clean_dataset([1, 2])


def test_stored_equals_lazy(messy_sales, cleaned):
    stored = clean_dataset(messy_sales, store=True)
    assert sorted(map(str, stored.data.collect())) == sorted(map(str, cleaned.data.collect()))
    assert stored.actions == cleaned.actions


def test_result_does_not_depend_on_partitioning(spark, messy_sales, cleaned):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        again = clean_dataset(messy_sales.repartition(5).orderBy(F.rand(7)))
        assert again.actions == cleaned.actions
        assert sorted(map(str, again.data.collect())) == sorted(map(str, cleaned.data.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_order_of_day_and_month_by_counts(spark):
    rows = [("1/2/2026", "1/2/2026"), ("25/2/2026", "2/25/2026"), ("26/2/2026", "2/26/2026"), ("2/27/2026", "27/2/2026"), ("3/4/26", "3/4/26")]
    df = spark.createDataFrame(rows, "Start_Date string, End_Date string")
    for order, first in (("month", [False, False]), ("day", [True, True]), ("counts", [True, False])):
        result = clean_dataset(df, CleaningOptions(day_order=order, merge_labels=False))
        assert [d.day_first for d in result.plan.columns] == first
        assert set(result.plan.columns[0].forms) == {"month_or_day_first", "month_first", "day_first"}
        days = [tuple(v.strftime("%d.%m") for v in r) for r in result.data.collect()]
        assert sorted(days)[0] == tuple("01.02" if f else "02.01" for f in first)
        assert [a.column for a in result.actions if a.action_code == "date_order"] == (["Start_Date", "End_Date"] if order == "counts" else [])
        again = type(result.plan).from_json(result.plan.to_json())
        assert sorted(again.apply(df).collect()) == sorted(result.data.collect())
    with pytest.raises(ValueError):
        clean_dataset(df, CleaningOptions(day_order="year"))
