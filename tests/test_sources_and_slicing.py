import datetime as dt

import pytest

from tablescope.operators import profiling, slicing
from tablescope.operators.cleaning import clean_dataset
from tablescope.sources import load, write_csv, write_report


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_comma(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Age\nAli,20\nSara,25\n", encoding="utf-8")
    df = load(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("Name", "string"), ("Age", "bigint")]
    assert rows(df) == [("Ali", 20), ("Sara", 25)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1256"])
def test_semicolon_and_encodings(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_text("نام;مبلغ\nعلي;1,000\nسارا;2,000\n", encoding=encoding)
    df = load(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["نام", "مبلغ"]
    assert rows(df) == sorted([("علي", "1,000"), ("سارا", "2,000")], key=str)
    assert clean_dataset(df).data.dtypes[1][1] == "double"


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separators_quotes_and_missing(spark, tmp_path, separator):
    s = separator
    (tmp_path / "a.csv").write_text(
        f'a{s}a{s}b{s}c{s}none\n1{s}x{s}"q{s}uo""ted"{s}1.5{s}\n2{s}NA{s}plain{s}2{s}null\n{s}{s}{s}{s}\n')
    df = load(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("a", "bigint"), ("a.1", "string"), ("b", "string"), ("c", "double")]
    assert rows(df) == [(1, "x", f'q{s}uo"ted', 1.5), (2, None, "plain", 2.0)]


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert rows(load(spark, str(tmp_path / "a.csv"))) == [(1, "two\nlines"), (2, "x")]


def test_single_column_and_folder(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("a\nx\ny\n")
    (folder / "2.csv").write_text("a;b\nz;1\n")
    df = load(spark, str(folder))
    assert rows(df.select("a", "b")) == [("x", None), ("y", None), ("z", 1)]


def test_known_typos(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Province,v\nاصفهانن,1\nتهران,2\n", encoding="utf-8")
    assert {r.Province for r in load(spark, str(tmp_path / "a.csv")).collect()} == {"اصفهان", "تهران"}


def test_rejected_input(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "empty.csv").write_text("a,b\n")
    (tmp_path / "blank.csv").write_text("a,b\nNA,\n")
    for name in ("a.txt", "empty.csv", "blank.csv"):
        with pytest.raises(ValueError):
            load(spark, str(tmp_path / name))


def test_parquet_and_export(spark, tmp_path, messy_sales):
    messy_sales.write.parquet(str(tmp_path / "in.parquet"))
    result = clean_dataset(load(spark, str(tmp_path / "in.parquet")))
    write_csv(result.data, str(tmp_path / "out.csv"))
    again = load(spark, str(tmp_path / "out.csv"))
    assert again.count() == 4 and again.columns == result.data.columns
    assert {r.Customer for r in again.collect()} == {"پارس صنعت", "فولاد جنوب"}
    write_report(result, str(tmp_path / "report.csv"))
    assert load(spark, str(tmp_path / "report.csv")).count() == len(result.actions)


@pytest.fixture
def table(spark):
    data = [("a", 1.0, dt.datetime(2026, 1, 1, 12)), ("b", 2.0, dt.datetime(2026, 1, 2, 23, 59)),
            ("c", None, None), (None, 4.0, dt.datetime(2026, 1, 3))]
    return spark.createDataFrame(data, "Region string, Amount double, when_date timestamp")


def test_filters(table):
    assert slicing.filter_categories(table, {"Region": ["a", "c"]}).count() == 2
    assert slicing.filter_categories(table, {"Region": []}).count() == 4
    assert slicing.filter_numbers(table, {"Amount": (1, 2)}).count() == 2
    days = {"when_date": (dt.date(2026, 1, 1), dt.date(2026, 1, 2))}
    assert slicing.filter_dates(table, days).count() == 2
    assert slicing.selection_size(table, table.limit(1)) == (1, -3)


def test_filters_reach_the_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for found, filters in (
            (slicing.filter_categories(lines, {"l_returnflag": ["A"]}), ["EqualTo(l_returnflag,A)"]),
            (slicing.filter_numbers(lines, {"l_quantity": (1, 5)}),
             ["GreaterThanOrEqual(l_quantity", "LessThanOrEqual(l_quantity"]),
            (slicing.filter_dates(lines, {"l_shipdate": ("1996-01-01", "1996-12-31")}),
             ["GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate"])):
        plan = found.select("l_extendedprice")._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters"):]
        assert all(f in pushed for f in filters), pushed
        assert "l_tax" not in plan


def test_search_sort_page(table):
    assert slicing.search(table, " A ").count() == 1
    assert slicing.search(table, "2026-01-03").count() == 1
    assert slicing.search(table, "nan").count() == 0
    assert slicing.search(table, " ").count() == 4
    assert [r.Amount for r in slicing.sort_page(table, "Amount", rows=3).collect()] == [4.0, 2.0, 1.0]
    assert [r.Amount for r in slicing.sort_page(table, "Amount", False).collect()] == [1.0, 2.0, 4.0, None]


def test_domains(table):
    got = slicing.filter_domains(table, profiling.profile_dataset(table)).collect()
    assert sorted(r.value for r in got if r.kind == "category") == ["a", "b", "c"]
    assert [(r.low, r.high) for r in got if r.kind == "number"] == [(1.0, 4.0)]
    assert [(r["first"], r["last"]) for r in got if r.kind == "date"] == [(dt.date(2026, 1, 1), dt.date(2026, 1, 3))]


def test_malformed_rows_are_not_lost(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('a,b\n1,5" pipe\n2,x,EXTRA,MORE\n3\n4,"two\nlines"\n')
    with pytest.raises(ValueError, match="2 rows"):
        load(spark, str(path))
    kept = load(spark, str(path), malformed="drop")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, '5" pipe'), (4, "two\nlines")]


def test_paths_of_different_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        load(spark, ["a.csv", "b.parquet"])
