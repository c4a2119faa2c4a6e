import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators import insights, kpis, profiling, quality, rollups
from tablescope.pipeline import build_analysis
from tablescope.plans import Profile
from tablescope.streaming import clean_stream


@pytest.fixture(scope="module")
def cache():
    return {}


@pytest.fixture
def bundle(messy_sales, cache):
    if "bundle" not in cache:
        cache["bundle"] = build_analysis(messy_sales)
    return cache["bundle"]


@pytest.fixture
def figures(bundle, cache):
    if "figures" not in cache:
        cache["figures"] = kpis.calculate_kpis(bundle.data, bundle.profile)
    return cache["figures"]


def empty(spark):
    return spark.createDataFrame([], T.StructType([]))


def test_roles(bundle):
    p = bundle.profile
    assert (p.money_column, p.quantity_column, p.primary_date) == ("Total_Amount_USD", "Quantity", "Order_Date")
    assert (p.customer_column, p.region_column, p.status_column) == ("Customer", "Province", "Status")
    assert (p.product_column, p.order_id_column) == ("Product", "Order_ID")
    assert "Product_Code" in p.identifier_columns + p.category_columns
    assert p.negative_statuses == ["لغو شده"] and p.pending_statuses == ["در انتظار پرداخت"]
    assert p.percent_columns == ["Discount_Pct", "Tax_Pct"]
    assert Profile.from_json(p.to_json()) == p


def test_unknown_data(spark):
    p = profiling.profile_dataset(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "alpha long, beta string"))
    assert p.primary_measure == "alpha" and p.category_columns == ["beta"]
    with pytest.raises(ValueError):
        profiling.profile_dataset(None)
    assert p.override({"alpha": ("identifier", "id")}).order_id_column == "alpha"
    with pytest.raises(ValueError):
        p.override(no_such_field="x")


def test_many_statuses_are_all_listed(spark, monkeypatch):
    monkeypatch.setattr(profiling, "LOOKED_UP", 1)
    rows = [("Cancelled", 5.0), ("returned", 3.0), ("open", 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "status string, amount double")
    p = profiling.profile_dataset(df)
    assert p.negative_members is None and p.negative_statuses == ["Cancelled", "returned"]
    assert df.filter(p.is_active()).agg(F.sum("amount")).first()[0] == 3.0
    assert kpis.calculate_kpis(df, p).get("total_sales").value == 3.0
    many = spark.range(3000).selectExpr("concat('pending ', id) AS status", "1.0D AS amount")
    found = profiling.profile_dataset(many, {"status": ("category", "status")})
    assert len(found.pending_statuses) == 3000 and not found.has_negative
    figures = kpis.calculate_kpis(many, found)
    assert figures.get("cancellation_rate") is None and figures.get("pending_amount").value == 3000


def test_structure(spark, bundle):
    assert bundle.structure["rows"] == 4 and bundle.structure["columns"] == 12
    assert bundle.structure["duplicate_rows"] == 0
    df = spark.createDataFrame([("Ali", 20), ("Sara", 25), ("Ali", 20)], "Name string, Age long")
    found = quality.analyze_dataset(df)
    assert (found["rows"], found["columns"], found["duplicate_rows"]) == (3, 2, 1)
    assert "Age" in found["numeric_columns"] and "Name" in found["text_columns"]
    assert quality.column_summary_frame(spark, found).count() == 2
    holes = spark.createDataFrame([("Ali", 20.0), (None, 25.0), ("Reza", None)], "Name string, Age double")
    assert quality.analyze_dataset(holes)["total_missing"] == 2
    with pytest.raises(ValueError):
        quality.analyze_dataset(empty(spark))


def test_quality(bundle, spark):
    q = bundle.quality
    assert q.score == 76.0 and q.band == "usable"
    assert q.duplicate_rows == 1 and q.high_severity == 1
    assert [i.issue for i in q.issues] == ["رکورد تکراری"]
    assert q.issues_frame(spark).count() == 1


def test_quality_of_clean_data(spark):
    df = spark.createDataFrame([(10.0, "A"), (20.0, "B"), (30.0, "A")], "Amount double, Region string")
    q = quality.assess_quality(df, df)
    assert q.score >= 95 and q.total_missing == 0 and q.band == "good"


def test_quality_finds_each_issue(spark):
    rows = [(float(i), 5.0, "same", "12") for i in range(60)] + [(1.0, 5.0, "same", "12")]
    rows += [(-1.0, 120.0, "same", "x1"), (900.0, None, "same", "x2"), (None, 7.0, "same", None)]
    raw = spark.createDataFrame(rows, "amount double, tax_pct double, note string, size string")
    result = build_analysis(raw)
    codes = {(i.column, i.code) for i in result.quality.issues}
    assert {("amount", "missing"), ("amount", "negative"), ("amount", "outlier"),
            ("tax_pct", "bad_percent"), ("note", "constant"), ("size", "rejected"),
            ("size", "mixed_numbers"), ("—", "duplicate_rows")} <= codes
    size = next(i for i in result.quality.issues if i.code == "mixed_numbers")
    assert "['x1', 'x2']" in size.description


def test_kpis(figures):
    got = {k: round(v, 2) for k, v in figures.as_dict().items()}
    assert got == {
        "total_rows": 4, "order_count": 4, "total_sales": 132505, "average_order_value": 44168.33,
        "median_sale": 60000, "largest_sale": 60000, "cancelled_value": 16000, "total_quantity": 80,
        "unique_customers": 2, "best_customer": 120000, "best_product": 72505, "best_region": 72505,
        "cancellation_rate": 25.0, "pending_amount": 60000, "mom_growth": 379.81,
    }
    assert figures.get("best_customer").display == "فولاد جنوب"
    assert figures.get("best_product").display == "فروسیلیس"
    assert figures.get("best_region").display == "تهران"
    assert "90.6٪" in figures.get("best_customer").description
    assert [(kpis.month_name(m), v) for m, v in figures.context["months"].sales] == [
        ("2026-01", 12505.0), ("2026-04", 60000.0), ("2026-05", 60000.0)]
    assert figures.context["partial_last_month"]
    assert figures.context["best_product_table"].count() == 2


def test_kpis_without_data(spark):
    assert kpis.calculate_kpis(empty(spark)).as_dict() == {}
    assert kpis.calculate_kpis(spark.createDataFrame([], "a double")).kpis == []


def test_kpis_fall_back(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "x")], "alpha double, beta string")
    got = kpis.calculate_kpis(df)
    assert got.get("primary_measure_total").value == 6 and got.get("primary_measure_average").value == 2
    assert got.get("total_sales") is None


def test_mixed_units(spark):
    df = spark.createDataFrame([(1, "kg", 10.0), (2, "ton", 20.0), (3, "kg", 30.0)],
                               "Quantity long, Unit string, Total_Amount_USD double")
    got = kpis.calculate_kpis(df)
    assert got.get("total_quantity") is None and got.context["quantity_units"] == 2
    assert kpis.calculate_kpis(df.filter("Unit = 'kg'")).get("total_quantity").value == 4


def months(spark, last):
    rows = [(dt.datetime(2026, 1, 15), 100.0), (dt.datetime(2026, 2, 15), 200.0),
            (dt.datetime(2026, 3, 15), 300.0), (last, 5.0)]
    return spark.createDataFrame(rows, "Order_Date timestamp, Total_Amount_USD double")


def test_partial_month(spark):
    got = kpis.calculate_kpis(months(spark, dt.datetime(2026, 4, 1)))
    assert got.context["partial_last_month"] and got.get("mom_growth").value == 50.0
    got = kpis.calculate_kpis(months(spark, dt.datetime(2026, 4, 30)))
    assert not got.context["partial_last_month"]


def test_rollups(bundle):
    found = {r.key: r for r in rollups.create_charts(bundle.data, bundle.profile)}
    assert list(found) == ["trend", "top_Product", "top_Customer", "share_Product", "status"]
    assert [(str(r.bucket)[:7], r.value) for r in found["trend"].data.orderBy("bucket").collect()] == [
        ("2026-01", 12505.0), ("2026-02", 0.0), ("2026-03", 0.0), ("2026-04", 60000.0), ("2026-05", 60000.0)]
    assert all(r.title and r.description for r in found.values())
    assert [r.rows for r in found["status"].data.collect()] == [2, 1, 1]


def test_rollups_without_measure(spark):
    assert rollups.create_charts(empty(spark)) == []
    assert rollups.create_charts(spark.createDataFrame([("a",), ("b",)], "Name string")) == []
    simple = spark.createDataFrame([("East", 100), ("West", 200), ("East", 150), ("North", 300)],
                                   "Region string, Sales long")
    assert {r.key for r in rollups.create_charts(simple)} == {"top_Region", "share_Region"}


def test_share_others(spark):
    df = spark.createDataFrame([(f"r{i:02d}", float(i)) for i in range(1, 12)], "Region string, Sales double")
    p = profiling.profile_dataset(df)
    got = {r.key: (r.value, r.share_pct) for r in rollups.share(df, p, "Region").collect()}
    assert len(got) == 8 and got["سایر"][0] == 1 + 2 + 3 + 4
    assert sum(v[1] for v in got.values()) == pytest.approx(100)
    assert len(rollups.share(df.limit(8), p, "Region").collect()) == 8


@pytest.mark.parametrize("days,grain", [(800, "quarter"), (100, "month"), (30, "week"), (10, "day")])
def test_trend_grains(spark, days, grain):
    start = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(start, 1.0), (start + dt.timedelta(days=days), 2.0)],
                               "when_date timestamp, amount double")
    p = profiling.profile_dataset(df)
    assert rollups.trend_grain(df, p, "amount") == grain
    got = rollups.trend(df, p).orderBy("bucket").collect()
    assert sum(r.value for r in got) == 3.0
    import pandas as pd
    rule = {"quarter": "QS", "month": "MS", "week": "W", "day": "D"}[grain]
    expected = pd.Series([1.0, 2.0], [start, start + dt.timedelta(days=days)]).resample(rule).sum()
    assert [r.bucket for r in got] == [d.date() for d in expected.index]
    assert [r.value for r in got] == expected.tolist()


def test_distribution(spark):
    df = spark.createDataFrame([(float(i),) for i in range(81)] + [(None,)], "amount double")
    got = rollups.distribution(df, profiling.profile_dataset(df)).orderBy("bin").collect()
    assert [r.rows for r in got] == [2] * 39 + [3]
    same = df.filter("amount = 3")
    assert [tuple(r) for r in rollups.distribution(same, profiling.profile_dataset(df)).collect()] == [(1, 3.0, 3.0, 1)]


def test_insights(bundle, figures, spark):
    found = insights.generate_insights(bundle.data, figures, bundle.profile)
    text = " ".join(i.text for i in found)
    for part in ("فروش خالص", "لغو", "وصول نشده", "4 رکورد"):
        assert part in text
    assert [i.rule_id for i in found] == [
        "net_sales", "last_month", "month_range", "share_best_customer", "share_best_product",
        "cancellation", "pending", "discount", "regions", "basis"]
    assert {i.level for i in found} <= {"info", "warning", "positive"}
    assert insights.insights_frame(spark, found).count() == len(found)


def test_insights_without_business_columns(spark):
    assert insights.generate_insights(empty(spark)) == []
    found = insights.generate_insights(spark.createDataFrame([(1,), (2,), (3,)], "alpha long"))
    assert [i.rule_id for i in found] == ["basis"] and "3 رکورد" in found[0].text


def test_pipeline_keeps_raw_and_rejects_empty(bundle, messy_sales, spark):
    assert bundle.raw_data.count() == 5
    assert bundle.structure["rows"] == bundle.data.count()
    with pytest.raises(ValueError):
        build_analysis(empty(spark))


def test_plan_cleans_a_stream(spark, messy_sales, bundle, tmp_path):
    messy_sales.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messy_sales.schema).parquet(str(tmp_path / "in"))
    query = (clean_stream(stream, bundle.cleaning.plan).writeStream.format("memory")
             .queryName("cleaned_rows").trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.table("cleaned_rows")
    assert got.count() == 5
    assert got.schema.simpleString() == bundle.data.schema.simpleString()


def test_names_with_dots_and_signs(spark):
    rows = [(f"c{i % 3}", f"{i % 4},000.50 USD", f"2026-0{i % 9 + 1}-01") for i in range(30)] + [("c0", "0,000.50 USD", "2026-01-01")]
    raw = spark.createDataFrame(rows, "`customer.name` string, `total (usd), net` string, `order date` string")
    bundle = build_analysis(raw)
    assert bundle.profile.money_column == "total (usd), net" and bundle.cleaning.duplicate_rows_removed == 1
    figures = kpis.calculate_kpis(bundle.data, bundle.profile, store=True)
    assert figures.get("unique_customers").value == 3 and figures.get("best_customer") is not None
    assert {"trend", "distribution"} - {r.key for r in rollups.create_charts(bundle.data, bundle.profile)} <= {"distribution"}
    assert insights.generate_insights(None, figures)[-1].rule_id == "basis"
