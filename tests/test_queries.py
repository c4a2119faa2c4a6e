import pytest

import __spark_entry__ as entry
from tablescope.operators import kpis, rollups
from workload import catalog, check, views

SF = "/root/testdata/sf0.01"
QUICK = ["monthly_growth", "kpi_totals", "kpi_best", "kpi_report", "trend_quarter", "trend_week", "top10_product",
         "share_other_nation", "hist_price", "insights", "value_checks_events", "column_summary", "parse_money",
         "parse_dates", "dedupe_documents", "duplicate_ids", "clean_audit", "day_first_by_counts", "csv_lines_in_quotes",
         "flawed_issues", "flawed_insights", "load_with_gaps", "rejected_inputs", "blank_cells", "column_names_and_typos"]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, con, name):
    assert check.compare(spark, con, SF, name) == ""


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["month", "total", "growth_pct"] and found.count() > 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked(spark):
    """Month totals need three of the columns of the fact table."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumnsRenamed(
        {"o_totalprice": "Total_Amount_USD", "o_orderdate": "Order_Date", "o_orderstatus": "Status"})
    plan = plan_of(kpis.monthly_sales(orders, views.orders_profile()))
    columns = plan[plan.index("ReadSchema: "):].split("<")[1].split(">")[0]
    assert {c.split(":")[0] for c in columns.split(",")} == {"o_orderstatus", "o_totalprice", "o_orderdate"}
    pushed = plan[plan.index("PushedFilters: "):].split("\n")[0]
    assert "Not(In(o_orderstatus" in pushed or "Not(EqualTo(o_orderstatus" in pushed


def test_groups_are_combined_before_the_shuffle(spark):
    lines = views.sales_lines(spark, SF)
    plan = plan_of(rollups.top_categories(lines, views.lines_profile(), "Product"))
    assert "TakeOrderedAndProject" in plan
    assert "partial_sum" in plan and "Window" not in plan
    for df in (rollups.trend(lines, views.lines_profile(), grain="month"),
               rollups.share(lines, views.lines_profile(), "Nation"),
               rollups.distribution(lines, views.lines_profile())):
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_a_saved_plan_reads_the_untidy_table_once(spark, sf_dir):
    files = catalog.clean_sales_by_saved_plan(spark, sf_dir).inputFiles()
    assert files and not any("/untidy-" in f for f in files)
