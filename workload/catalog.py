"""Every query: what Spark computes, and the same in plain SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions import dates, numbers, text
from tablescope.operators import dedupe, insights, kpis, profiling, quality, rollups, slicing, summary
from tablescope.operators.cleaning import clean_dataset, compile_plan, duplicate_ids
from tablescope.operators.distinct import distinct_count_frame
from tablescope.operators.quantiles import exact_quantiles
from tablescope.pipeline import build_analysis
from tablescope.plans import CleaningOptions, CleaningPlan
from tablescope.session import materialize, new_path
from tablescope.sources import load, read_csv, write_csv
from tablescope.sources.loader import MALFORMED
from tablescope.store import AnalysisStore
from workload import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def rounded(df, *names, digits=2):
    """Doubles depend on the order of summing in their last digits."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# --- text, numbers, dates ----------------------------------------------------

@query("ascii_digits", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits FROM orders")
def ascii_digits(spark, sf):
    orders = v.table(spark, sf, "orders")
    written = orders.select("o_orderkey", v.persian(F.col("o_orderkey").cast("string")).alias("t"))
    return written.select("o_orderkey", text.to_ascii_digits(F.col("t")).alias("digits"))


@query("normalize_text_documents",
       r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_text_documents(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query("normalize_text_conversations",
       r"SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def normalize_text_conversations(spark, sf):
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.normalize_text(F.col("role")).alias("role"),
        text.normalize_text(F.col("text")).alias("text"))


@query("normalize_names", "SELECT c_custkey, c_name AS name FROM customer")
def normalize_names(spark, sf):
    written = v.table(spark, sf, "customer").select("c_custkey", F.concat(
        F.lit("\u200f"), v.full_width(F.col("c_name")), F.lit("\u00a0\t")).alias("t"))
    return written.select("c_custkey", text.empty_to_null(text.normalize_text(F.col("t"))).alias("name"))


@query("display_forms", """
  SELECT o_orderkey, '$' || CASE WHEN abs(o_totalprice) >= 1000 THEN format('{:,.0f}', o_totalprice)
         ELSE format('{:,.2f}', o_totalprice) END AS money, format('{:,.1f}', o_totalprice / 7) || '٪' AS percent
  FROM orders""")
def display_forms(spark, sf):
    price = F.col("o_totalprice")
    return v.table(spark, sf, "orders").select(
        "o_orderkey", numbers.money_text(price).alias("money"), numbers.percent_text(price / 7).alias("percent"))


@query("parse_money", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def parse_money(spark, sf):
    written = v.table(spark, sf, "orders").select(
        "o_orderkey", v.money_text(F.col("o_orderkey"), F.col("o_totalprice")).alias("t"))
    return written.select("o_orderkey", numbers.parse_number(F.col("t")).alias("amount"))


@query("parse_accounting", "SELECT c_custkey, -abs(c_acctbal) AS balance FROM customer")
def parse_accounting(spark, sf):
    written = v.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("("), F.format_number(F.abs("c_acctbal"), 2), F.lit(")")).alias("t"))
    return written.select("c_custkey", numbers.parse_number(F.col("t")).alias("balance"))


@query("parse_percent", """
  SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100, 0) AS discount,
         round(l_tax * 100, 0) AS tax FROM lineitem""")
def parse_percent(spark, sf):
    def written(name, sign):
        return F.concat(F.round(F.col(name) * 100, 0).cast("int").cast("string"), F.lit(sign))
    lines = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", written("l_discount", "%").alias("d"),
        v.persian(written("l_tax", " ٪")).alias("t"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey",
                        numbers.parse_number(F.col("d")).alias("discount"),
                        numbers.parse_number(F.col("t")).alias("tax"))


@query("reject_codes", """
  SELECT p_partkey, CAST(NULL AS DOUBLE) AS code, p_size + 0.0 AS size FROM part""")
def reject_codes(spark, sf):
    part = v.table(spark, sf, "part")
    return part.select("p_partkey", numbers.parse_number(F.concat(F.lit("P-"), F.col("p_partkey"))).alias("code"),
                       numbers.parse_number(F.concat(F.col("p_size"), F.lit(" cm."))).alias("size"))


@query("numeric_parse_ratio", """
  SELECT 'text' AS column, 0.0 AS ratio UNION ALL
  SELECT 'price', 1.0 UNION ALL
  SELECT 'mixed', count(*) FILTER (o_orderkey % 3 > 0) / count(*) FROM orders""")
def numeric_parse_ratio(spark, sf):
    key = F.col("o_orderkey")
    orders = v.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("text"), v.money_text(key, F.col("o_totalprice")).alias("price"),
        F.when(key % 3 > 0, key.cast("string")).otherwise("none yet").alias("mixed"))
    orders = orders.withColumn("text", F.concat(F.lit("no "), "text"))
    rows = [(c, numbers.numeric_parse_ratio(orders, c)) for c in orders.columns]
    return spark.createDataFrame(rows, "column string, ratio double")


@query("parse_dates", "SELECT o_orderkey, o_orderdate AS day FROM orders")
def parse_dates(spark, sf):
    written = v.table(spark, sf, "orders").select(
        "o_orderkey", v.date_text(F.col("o_orderkey"), F.col("o_orderdate")).alias("t"))
    return written.select("o_orderkey", dates.parse_dates(F.col("t")).alias("day"))


@query("parse_written_dates", """
  SELECT o_orderkey, o_orderdate AS us, o_orderdate AS named, o_orderdate AS compact,
         date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders""")
def parse_written_dates(spark, sf):
    day = F.col("o_orderdate")
    written = v.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(day, "M/d/yyyy").alias("us"), F.date_format(day, "MMMM d, yyyy").alias("named"),
        F.date_format(day, "yyyyMMdd").alias("compact"), F.date_format(day, "yyyy-MM").alias("month"))
    return written.select("o_orderkey", *[dates.parse_dates(F.col(c)).alias(c)
                                          for c in ("us", "named", "compact", "month")])


_WRITTEN_FORMS = (  # pattern, and how much of a moment it keeps
    ("EEE, dd MMM yyyy", "day"), ("EEEE, MMMM d, yyyy", "day"), ("MMM-dd-yyyy", "day"), ("yyyy-MMM-dd", "day"),
    ("yyyy MMM d", "day"), ("ddMMMyyyy", "day"), ("d'th' MMMM yyyy", "day"), ("MMMM yyyy", "month"), ("MMM yyyy", "month"),
    ("M/d/yyyy h a", "hour"), ("h:mm a M/d/yyyy", "minute"), ("MMM d, yyyy, h:mm a", "minute"),
    ("yyyyMMdd'T'HHmmss", "second"), ("yyyyMMddHHmmss", "second"), ("yyyy-MM-dd'T'HH:mm'Z'", "minute"))


@query("written_date_forms", "SELECT event_id, " + ", ".join(
    f"date_trunc('{unit}', ts)::TIMESTAMP AS form{i}" for i, (_, unit) in enumerate(_WRITTEN_FORMS)) + " FROM events")
def written_date_forms(spark, sf):
    """Each moment in fifteen written forms, read back."""
    texts = v.table(spark, sf, "events").select("event_id", *[
        F.date_format("ts", pattern).alias(f"form{i}") for i, (pattern, _) in enumerate(_WRITTEN_FORMS)])
    return texts.select("event_id", *[dates.parse_dates(F.col(c)).alias(c) for c in texts.columns[1:]])


@query("day_first_by_counts", 'SELECT o_orderkey, o_orderdate AS "Paid_Date", o_orderdate AS "Sent_Date" FROM orders')
def day_first_by_counts(spark, sf):
    """A column with the day and one with the month first; which one it is says what only fits one order."""
    texts = v.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("Paid_Date"), F.date_format("o_orderdate", "M/d/yyyy").alias("Sent_Date"))
    plan = compile_plan(texts, CleaningOptions(day_order="counts"))[0]
    return plan.apply(texts)


@query("parse_timestamps", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def parse_timestamps(spark, sf):
    written = v.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy/MM/dd'T'HH:mm:ss")).alias("t"))
    return written.select("event_id", dates.parse_dates(F.col("t")).alias("ts"))


@query("jalali_dates", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS shipped FROM lineitem")
def jalali_dates(spark, sf):
    written = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", v.jalali_text(F.col("l_shipdate").cast("date")).alias("t"))
    return written.select("l_orderkey", "l_linenumber", "l_partkey", dates.parse_jalali(F.col("t")).alias("shipped"))


@query("parse_dates_us", """
  SELECT event_id, date_trunc('day', ts) AS short, date_trunc('day', ts) AS named, date_trunc('minute', ts) AS clock,
         date_trunc('minute', ts) AS iso_clock, date_trunc('minute', ts) AS named_time FROM events""")
def parse_dates_us(spark, sf):
    def form(pattern):
        return F.date_format("ts", pattern)

    written = v.table(spark, sf, "events").select(
        "event_id", form("MM/dd/yy").alias("short"), form("d-MMM-yy").alias("named"), form("M/d/yyyy h:mm a").alias("clock"),
        form("yyyy-MM-dd h:mm a").alias("iso_clock"), form("MMM d yyyy HH:mm").alias("named_time"))
    return written.select("event_id", *[dates.parse_dates(F.col(c)).alias(c) for c in written.columns[1:]])


# Day number by the 2820-year cycle, which agrees with the calendar in these years.
@query("jalali_arithmetic", """
  WITH k AS (SELECT o_orderkey, 1370 + o_orderkey % 33 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 29 AS d FROM orders)
  SELECT o_orderkey, CAST(DATE '1970-01-01' + CAST(
           d + CASE WHEN m <= 7 THEN (m - 1) * 31 ELSE (m - 1) * 30 + 6 END + (y * 682 - 110) // 2816 + (y - 1) * 365
           + 1948320 - 2440588 AS INTEGER) AS TIMESTAMP) AS day FROM k""")
def jalali_arithmetic(spark, sf):
    k = F.col("o_orderkey")
    written = v.table(spark, sf, "orders").select(k, F.concat_ws("/", 1370 + k % 33, 1 + k % 12, 1 + k % 29).alias("t"))
    return written.select("o_orderkey", dates.parse_jalali(F.col("t")).alias("day"))


# --- cleaning ------------------------------------------------------------------

def cleaned(spark, sf):
    return clean_dataset(v.dirty_sales(spark, sf), v.DIRTY_OPTIONS, store=True)


@query("clean_sales", v.WITH_CLEAN + "SELECT * FROM clean_sales")
def clean_sales(spark, sf):
    return cleaned(spark, sf).data


@query("clean_sales_by_saved_plan", v.WITH_CLEAN + "SELECT * FROM clean_sales")
def clean_sales_by_saved_plan(spark, sf):
    dirty = v.dirty_sales(spark, sf)
    saved = clean_dataset(dirty, v.DIRTY_OPTIONS, store=True).plan.to_json()
    return dedupe.drop_duplicates(materialize(CleaningPlan.from_json(saved).apply(dirty), "typed"))  # read more than once


_COPIES = "(CASE WHEN k % 20 = 0 THEN 2 ELSE 1 END)"


@query("clean_audit", v.WITH_ORDERS + f"""
  , c AS (SELECT *, {_COPIES} AS n FROM sales_orders)
  SELECT 'Order_ID ،  Customer' AS column, 'rename' AS action_code, 2::BIGINT AS affected_rows
  UNION ALL SELECT 'Notes', 'drop_column', 1
  UNION ALL SELECT '—', 'drop_row', count(*) FROM c WHERE k % 500 = 0
  UNION ALL SELECT 'Order_ID', 'text', sum(n)::BIGINT FROM c WHERE k % 3 = 0
  UNION ALL SELECT 'Order_Date', 'text', sum(n)::BIGINT FROM c WHERE k % 5 IN (2, 4)
  UNION ALL SELECT 'Customer', 'text', sum(n)::BIGINT FROM c WHERE k % 7 < 2
  UNION ALL SELECT 'Region', 'text', sum(n)::BIGINT FROM c
  UNION ALL SELECT 'Total_Amount_USD', 'text', sum(n)::BIGINT FROM c WHERE k % 97 <> 0 AND k % 5 >= 3
  UNION ALL SELECT 'Status', 'text', sum(n)::BIGINT FROM c
  UNION ALL SELECT 'Discount_Pct', 'to_number', sum(n)::BIGINT FROM c
  UNION ALL SELECT 'Total_Amount_USD', 'to_number', sum(n)::BIGINT FROM c WHERE k % 97 <> 0
  UNION ALL SELECT 'Order_Date', 'to_date', sum(n)::BIGINT FROM c
  UNION ALL SELECT 'Segment', 'merge', sum(n)::BIGINT FROM c WHERE k % 50 = 0 AND Segment = 'BUILDING'
  UNION ALL SELECT '—', 'drop_duplicate', count(*) FROM c WHERE k % 20 = 0""".replace("\n  , c AS", ", c AS"))
def clean_audit(spark, sf):
    return cleaned(spark, sf).actions_frame(spark).select("column", "action_code", "affected_rows")


@query("rejected_values", v.WITH_ORDERS + """
  SELECT 'Total_Amount_USD' AS column, value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS rank,
         count(*) OVER () AS distinct_rejected
  FROM (SELECT DISTINCT 'unknown ' || (k % 3) AS value FROM sales_orders WHERE k % 97 = 0)""")
def rejected_values(spark, sf):
    return cleaned(spark, sf).rejected_frame(spark)


@query("merge_labels", v.WITH_ORDERS + "SELECT Segment, count(*) AS orders FROM sales_orders GROUP BY Segment")
def merge_labels(spark, sf):
    orders = v.sales_orders(spark, sf, with_key=True).select(
        "k", F.when(F.col("k") % 50 == 0, F.concat("Segment", F.lit("G"))).otherwise(F.col("Segment")).alias("Segment"))
    merged = clean_dataset(orders, v.DIRTY_OPTIONS).data
    return merged.groupBy("Segment").agg(F.count("*").alias("orders"))


@query("dedupe_documents", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def dedupe_documents(spark, sf):
    return dedupe.drop_duplicates(v.table(spark, sf, "documents").drop("doc_id"))


@query("dedupe_lines", "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def dedupe_lines(spark, sf):
    return dedupe.drop_duplicates(v.table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("dedupe_events", "SELECT DISTINCT user_id, event_type, props FROM events")
def dedupe_events(spark, sf):
    return dedupe.drop_duplicates(v.table(spark, sf, "events").select("user_id", "event_type", "props"))


@query("duplicate_ids", """
  SELECT 'event_id' AS column, count(event_id) - count(DISTINCT event_id) AS surplus FROM events
  UNION ALL SELECT 'user_id', count(user_id) - count(DISTINCT user_id) FROM events
  UNION ALL SELECT 'conv_id', count(conv_id) - count(DISTINCT conv_id) FROM conversations
  UNION ALL SELECT 'doc_id', count(doc_id) - count(DISTINCT doc_id) FROM documents
  UNION ALL SELECT 'vec_id', count(vec_id) - count(DISTINCT vec_id) FROM embeddings
  UNION ALL SELECT 'item_id', count(item_id) - count(DISTINCT item_id) FROM benchmark
  UNION ALL SELECT 'page_id', count(page_id) - count(DISTINCT page_id) FROM pages""")
def duplicate_id_counts(spark, sf):
    rows = []
    for name in ("events", "conversations", "documents", "embeddings", "benchmark", "pages"):
        rows += duplicate_ids(v.table(spark, sf, name)).items()
    return spark.createDataFrame(rows, "column string, surplus bigint")


@query("csv_round_trip", v.WITH_ORDERS + """
  SELECT Order_ID, CAST(Order_Date AS DATE) AS Order_Date, Customer, Region, Segment, Total_Amount_USD, Status
  FROM sales_orders""")
def csv_round_trip(spark, sf):
    path = new_path(spark, "orders") + ".csv"
    write_csv(v.sales_orders(spark, sf).withColumn("Order_Date", F.to_date("Order_Date")), path)
    back = load(spark, path)
    return back.withColumn("Order_Date", F.to_date("Order_Date"))


@query("csv_lines_in_quotes", """
  SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 0 THEN text END AS text, lang, source, n_chars FROM documents""")
def csv_lines_in_quotes(spark, sf):
    """The documents as CSV with their line ends in quotes, read back by many tasks."""
    path = new_path(spark, "documents") + ".csv"
    docs = v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", nullValue="")
    key, limit = "spark.sql.files.maxPartitionBytes", 1 << 20  # parts of this small file, as a large one has them
    before = spark.conf.get(key)
    spark.conf.set(key, str(limit))
    try:
        back = materialize(read_csv(spark, path).drop(MALFORMED), "records")
    finally:
        spark.conf.set(key, before)
    return back.select(F.col("doc_id").cast("long"), F.when(F.col("text") != "", F.col("text")).alias("text"), "lang", "source",
                       F.col("n_chars").cast("long"))


@query("load_parquet", "SELECT * FROM customer")
def load_parquet(spark, sf):
    v.table(spark, sf, "customer")
    return load(spark, f"{sf}/customer.parquet")


# --- profiling ----------------------------------------------------------------

def _role_sql(name: str, roles) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{role}' AS role, '{subtype}' AS subtype, "
        f"count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS missing FROM {name}"
        for c, role, subtype in roles)


_ROLES = {
    "orders": [("o_orderkey", "measure", "generic"), ("o_custkey", "measure", "generic"),
               ("o_orderstatus", "category", "status"), ("o_totalprice", "measure", "money"),
               ("o_orderdate", "date", ""), ("o_orderpriority", "category", "")],
    "lineitem": [("l_orderkey", "measure", "generic"), ("l_partkey", "measure", "generic"),
                 ("l_suppkey", "measure", "generic"), ("l_linenumber", "measure", "generic"),
                 ("l_quantity", "measure", "quantity"), ("l_extendedprice", "measure", "money"),
                 ("l_discount", "percent", "percent"), ("l_tax", "percent", "percent"),
                 ("l_returnflag", "category", ""), ("l_linestatus", "category", "status"),
                 ("l_shipdate", "date", "")],
    "customer": [("c_custkey", "measure", "generic"), ("c_name", "text", "free_text"),
                 ("c_nationkey", "measure", "generic"), ("c_acctbal", "measure", "generic"),
                 ("c_mktsegment", "category", "channel")],
    "part": [("p_partkey", "measure", "generic"), ("p_name", "category", ""), ("p_brand", "category", ""),
             ("p_type", "category", ""), ("p_size", "measure", "generic"), ("p_retailprice", "measure", "money")],
    "events": [("event_id", "identifier", "id"), ("ts", "date", ""), ("user_id", "measure", "generic"),
               ("event_type", "category", ""), ("value", "measure", "money"), ("props", "category", "")],
    "documents": [("doc_id", "identifier", "id"), ("text", "text", "free_text"), ("lang", "category", ""),
                  ("source", "category", "channel"), ("n_chars", "measure", "generic")],
    "conversations": [("conv_id", "measure", "generic"), ("turn", "measure", "generic"), ("role", "category", ""),
                      ("text", "text", "free_text")],
    "pages": [("page_id", "identifier", "id"), ("url", "text", "free_text"), ("html", "text", "free_text")],
}


def _role_query(name):
    def run(spark, sf):
        df = v.table(spark, sf, name)
        found = profiling.profile_frame(df, profiling.profile_dataset(df))
        return found.select("column", "role", "subtype", "unique_values", "missing")
    return run


for _name, _roles in _ROLES.items():
    query(f"role_profile_{_name}", _role_sql(_name, _roles))(_role_query(_name))


@query("elected_roles", """
  SELECT * FROM (VALUES ('money', 'Total_Amount_USD'), ('quantity', 'Quantity'), ('date', 'Order_Date'),
    ('customer', 'Customer'), ('product', 'Product'), ('region', 'Region'), ('status', 'Status'),
    ('order', ''), ('unit', ''), ('primary_measure', 'Total_Amount_USD'),
    ('dimensions', 'Product Customer Region Status Nation Segment')) t(meaning, "column")""")
def elected_roles(spark, sf):
    p = profiling.profile_dataset(materialize(v.sales_lines(spark, sf), "lines"))
    rows = [("money", p.money_column), ("quantity", p.quantity_column), ("date", p.primary_date),
            ("customer", p.customer_column), ("product", p.product_column), ("region", p.region_column),
            ("status", p.status_column), ("order", p.order_id_column), ("unit", p.unit_column),
            ("primary_measure", p.primary_measure), ("dimensions", " ".join(p.dimension_candidates()))]
    return spark.createDataFrame(rows, "meaning string, column string")


@query("status_values", v.WITH_LINES + """
  SELECT DISTINCT 'negative' AS kind, Status AS value FROM sales_lines WHERE Status = 'returned'
  UNION ALL SELECT DISTINCT 'pending', Status FROM sales_lines WHERE Status = 'pending'""")
def status_values(spark, sf):
    p = profiling.profile_dataset(v.sales_lines(spark, sf).select("Status"))
    rows = [("negative", s) for s in p.negative_statuses] + [("pending", s) for s in p.pending_statuses]
    return spark.createDataFrame(rows, "kind string, value string")


@query("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS unique_values FROM lineitem"
    for c, _, _ in _ROLES["lineitem"]))
def distinct_counts(spark, sf):
    lines = v.table(spark, sf, "lineitem")
    return distinct_count_frame(lines, lines.columns)


# --- structure and quality ------------------------------------------------------

@query("structure_documents", """
  SELECT count(*) AS rows, 7::BIGINT AS columns, (2 * count(*) - count(quality) - count(toxic))::BIGINT AS total_missing,
         0::BIGINT AS duplicate_rows FROM documents LEFT JOIN labels USING (doc_id)""")
def structure_documents(spark, sf):
    s = quality.analyze_dataset(v.labelled_documents(spark, sf))
    row = (s["rows"], s["columns"], s["total_missing"], s["duplicate_rows"])
    return spark.createDataFrame([row], "rows bigint, columns bigint, total_missing bigint, duplicate_rows bigint")


@query("column_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{fv.ROLE_LABELS[r]}' AS role, '{fv.MEANING_LABELS.get(s, fv.NO_COLUMN)}' AS meaning, "
    f"count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS missing, CAST(min({c}) AS VARCHAR) AS sample "
    f"FROM orders" for c, r, s in _ROLES["orders"]))
def column_summary(spark, sf):
    return quality.column_summary_frame(spark, quality.analyze_dataset(v.table(spark, sf, "orders"), duplicate_rows=0))


def _severity(count, total):
    return (f"CASE WHEN {count} / {total} > 0.2 THEN '{fv.HIGH}' WHEN {count} / {total} > 0.01 "
            f"THEN '{fv.MEDIUM}' ELSE '{fv.LOW}' END")


@query("quality_issues", """
  WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS rows FROM d),
  m AS (SELECT 'quality' AS column, count(*) - count(quality) AS affected FROM d
        UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM d),
  q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM d),
  o AS (SELECT count(*) FILTER (n_chars < a - 3 * (b - a) OR n_chars > b + 3 * (b - a)) AS affected FROM d, q)
  SELECT "column", 'missing' AS issue_code, %s AS severity, affected::BIGINT AS affected FROM m, n WHERE affected > 0
  UNION ALL SELECT 'n_chars', 'outlier', '%s', affected FROM o, n WHERE affected > 0 AND affected / rows <= 0.05"""
       % (_severity("affected", "rows"), fv.MEDIUM))
def quality_issues(spark, sf):
    df = v.labelled_documents(spark, sf)
    profile = profiling.profile_dataset(df)
    # Labels are flags; only the text length is a measure.
    profile.override({"quality": ("category", ""), "toxic": ("category", "")})
    found = quality.assess_quality(df, df, profile=profile)
    return found.issues_frame(spark).select("column", "issue_code", "severity", "affected")


@query("quality_score", """
  WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
  q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM d),
  f AS (SELECT count(*) AS n, count(*) - count(quality) AS mq, count(*) - count(toxic) AS mt,
        count(*) FILTER (n_chars < a - 3 * (b - a) OR n_chars > b + 3 * (b - a)) AS o FROM d, q),
  i AS (SELECT *, (CASE WHEN mq / n > 0.2 THEN 1 ELSE 0 END) + (CASE WHEN mt / n > 0.2 THEN 1 ELSE 0 END) AS high,
        (CASE WHEN mq / n BETWEEN 0.010000001 AND 0.2 THEN 1 ELSE 0 END)
        + (CASE WHEN mt / n BETWEEN 0.010000001 AND 0.2 THEN 1 ELSE 0 END)
        + (CASE WHEN o > 0 AND o / n <= 0.05 THEN 1 ELSE 0 END) AS medium FROM f)
  SELECT round(greatest(0, 100 - least((mq + mt) / (7 * n) * 100, 25) - least(4 * high + 2 * medium, 35)), 1) AS score,
         (mq + mt)::BIGINT AS total_missing, 0::BIGINT AS duplicate_rows FROM i""")
def quality_score(spark, sf):
    df = v.labelled_documents(spark, sf)
    profile = profiling.profile_dataset(df)
    profile.override({"quality": ("category", ""), "toxic": ("category", "")})
    q = quality.assess_quality(df, df, profile=profile)
    return spark.createDataFrame([(q.score, q.total_missing, q.duplicate_rows)],
                                 "score double, total_missing bigint, duplicate_rows bigint")


def _checks_sql(name, measures, percents=()):
    parts = [f"""SELECT '{c}' AS column, count({c}) AS filled, count(*) FILTER ({c} < 0) AS negative,
        CASE WHEN count({c}) >= 20 AND max(b - a) > 0
             THEN count(*) FILTER ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) ELSE 0 END AS outliers,
        0::BIGINT AS invalid_percent
        FROM {name}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {name})"""
             for c in measures]
    parts += [f"SELECT '{c}', count({c}), 0, 0, count(*) FILTER ({c} < 0 OR {c} > 100) FROM {name}"
              for c in percents]
    return " UNION ALL ".join(parts)


_CHECKS = {
    "lineitem": (["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]),
    "customer": (["c_acctbal"], []),
    "events": (["value"], []),
    "documents": (["n_chars"], []),
    "part": (["p_retailprice"], ["p_size"]),
}


def _check_query(name, measures, percents):
    def run(spark, sf):
        return quality.value_checks(v.table(spark, sf, name), measures, percents)
    return run


for _name, (_measures, _percents) in _CHECKS.items():
    query(f"value_checks_{_name}", _checks_sql(_name, _measures, _percents))(
        _check_query(_name, _measures, _percents))


@query("exact_quartiles", """
  SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2,
         quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem""")
def exact_quartiles(spark, sf):
    found = exact_quantiles(v.table(spark, sf, "lineitem"), {"p": F.col("l_extendedprice")}, {"p": [0.25, 0.5, 0.75]})
    return spark.createDataFrame([tuple(found["p"])], "q1 double, q2 double, q3 double")


# --- states of deliveries ------------------------------------------------------

def _facts(name, number):
    ranks = ", ".join(f"round(quantile_cont({number}, {p}), 4) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    return f"""SELECT '{name}' AS "column", count(*) AS "rows", count(*) - count({name}) AS missing, count(DISTINCT {name}) AS "distinct",
      round(sum({number}), 2) AS total, min({number}) AS low, max({number}) AS high, {ranks} FROM lineitem"""


@query("summary_of_deliveries", " UNION ALL ".join(
    [_facts(n, f"CAST({n} AS DOUBLE)") for n in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")]
    + [_facts("l_shipdate", "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE)"),
       _facts("l_returnflag", "CAST(NULL AS DOUBLE)")]))
def summary_of_deliveries(spark, sf):
    """Each year shipped is a delivery; only their states are read for the result."""
    lines = v.table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    store = summary.SummaryStore(spark, new_path(spark, "states"), [
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag"])
    first, last = lines.agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    for year in range(first, last + 1):
        store.add(str(year), lines.where(F.col("l_shipdate").between(f"{year}-01-01", f"{year}-12-31")))
    store.add("undated", lines.where("l_shipdate IS NULL"))
    return rounded(rounded(store.describe(), "total"), "q1", "median", "q3", digits=4)


@query("merged_month_states", """
  SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus AS status, count(*) AS "rows",
    count(o_totalprice) AS known, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high
  FROM orders GROUP BY 1, 2""")
def merged_month_states(spark, sf):
    orders = v.table(spark, sf, "orders")
    keys = {"month": F.trunc("o_orderdate", "month"), "status": F.col("o_orderstatus")}
    parts = [summary.group_states(part, keys, F.col("o_totalprice"))
             for part in (orders.where("o_orderpriority < '3'"), orders.where("o_orderpriority >= '3' OR o_orderpriority IS NULL"))]
    return rounded(summary.merge_groups(parts[0].unionByName(parts[1]), list(keys)), "total")


# --- key figures -------------------------------------------------------------

@query("kpi_totals", v.WITH_ORDERS + """
  SELECT count(*) AS total_rows, count(*) FILTER (Status = 'cancelled') AS excluded_rows,
    round(sum(Total_Amount_USD) FILTER (Status <> 'cancelled'), 2) AS total_sales,
    round(avg(Total_Amount_USD) FILTER (Status <> 'cancelled'), 2) AS average_order_value,
    max(Total_Amount_USD) FILTER (Status <> 'cancelled') AS largest_sale,
    round(sum(Total_Amount_USD) FILTER (Status = 'cancelled'), 2) AS cancelled_value,
    round(sum(Total_Amount_USD) FILTER (Status = 'pending'), 2) AS pending_amount FROM sales_orders""")
def kpi_totals(spark, sf):
    found = kpis.totals(v.sales_orders(spark, sf), v.orders_profile())
    names = ("total_sales", "average_order_value", "largest_sale", "cancelled_value", "pending_amount")
    return rounded(found.select("total_rows", "excluded_rows", *names), *names)


@query("kpi_totals_lines", v.WITH_LINES + """
  SELECT count(*) AS total_rows, round(sum(Total_Amount_USD) FILTER (Status <> 'returned'), 2) AS total_sales,
    round(sum(Quantity) FILTER (Status <> 'returned'), 2) AS total_quantity,
    round(avg(Discount_Pct), 4) AS average_discount, count(*) FILTER (Discount_Pct >= 15) AS high_discounts,
    max(CAST(Order_Date AS DATE)) FILTER (Status <> 'returned') AS last_date FROM sales_lines""")
def kpi_totals_lines(spark, sf):
    found = kpis.totals(v.sales_lines(spark, sf), v.lines_profile()).select(
        "total_rows", "total_sales", "total_quantity", "average_discount", "high_discounts", "last_date")
    return rounded(rounded(found, "total_sales", "total_quantity"), "average_discount", digits=4)


@query("kpi_median", v.WITH_LINES + """
  SELECT round(median(Total_Amount_USD), 4) AS median_sale FROM sales_lines WHERE Status <> 'returned'""")
def kpi_median(spark, sf):
    p = v.lines_profile()
    # Several passes over two columns of a join.
    amounts = materialize(v.sales_lines(spark, sf).select(p.money_column, p.status_column), "amounts")
    middle = kpis.median(amounts, p)
    return spark.createDataFrame([(round(middle, 4),)], "median_sale double")


def _best_sql(kind, column):
    return f"""(SELECT '{kind}' AS column, (SELECT count(DISTINCT {column}) FROM sales_lines) AS keys,
      {column} AS best_key, round(total, 2) AS best_total, round(total / sum(total) OVER () * 100, 4) AS share_pct
      FROM (SELECT {column}, sum(Total_Amount_USD) AS total FROM sales_lines WHERE Status <> 'returned' GROUP BY 1)
      ORDER BY total DESC, {column} LIMIT 1)"""


@query("kpi_best", v.WITH_LINES + " UNION ALL ".join(
    _best_sql(k, c) for k, c in (("customer", "Customer"), ("product", "Product"), ("region", "Region"))))
def kpi_best(spark, sf):
    lines, p = v.sales_lines(spark, sf), v.lines_profile()
    groups = kpis.group_totals(lines, {"customer": "Customer", "product": "Product", "region": "Region"},
                               F.col("Total_Amount_USD"), p.is_active())
    share = F.round(F.col("best_total") / F.col("grand_total") * 100, 4).alias("share_pct")
    return rounded(kpis.group_summary(groups).select("column", "keys", "best_key", "best_total", share), "best_total")


@query("kpi_best_table", v.WITH_LINES + """
  SELECT Customer AS key, round(sum(Total_Amount_USD), 2) AS total FROM sales_lines WHERE Status <> 'returned'
  GROUP BY 1""")
def kpi_best_table(spark, sf):
    return rounded(kpis.best_table(v.sales_lines(spark, sf), v.lines_profile(), "Customer"), "total")


_MONTHLY = """SELECT CAST(date_trunc('month', Order_Date) AS DATE) AS month, sum(Total_Amount_USD) AS total
  FROM sales_orders WHERE Status <> 'cancelled' GROUP BY 1"""


@query("kpi_monthly", v.WITH_ORDERS + f"SELECT month, round(total, 2) AS total FROM ({_MONTHLY})")
def kpi_monthly(spark, sf):
    return rounded(kpis.monthly_sales(v.sales_orders(spark, sf), v.orders_profile()), "total")


_FULL_MONTHS = f"""SELECT *, row_number() OVER (ORDER BY month DESC) AS back FROM ({_MONTHLY})
  WHERE (SELECT max(Order_Date) FROM sales_orders WHERE Status <> 'cancelled') >= last_day(month)"""
_GROWTH = f"""SELECT (max(total) FILTER (back = 1) - max(total) FILTER (back = 2))
  / abs(max(total) FILTER (back = 2)) * 100 FROM ({_FULL_MONTHS})"""

_KPI_VALUES = [
    ("total_rows", "SELECT count(*) FROM sales_orders"),
    ("order_count", "SELECT count(DISTINCT Order_ID) FROM sales_orders"),
    ("total_sales", "SELECT sum(Total_Amount_USD) FROM sales_orders WHERE Status <> 'cancelled'"),
    ("average_order_value", "SELECT avg(Total_Amount_USD) FROM sales_orders WHERE Status <> 'cancelled'"),
    ("median_sale", "SELECT median(Total_Amount_USD) FROM sales_orders WHERE Status <> 'cancelled'"),
    ("largest_sale", "SELECT max(Total_Amount_USD) FROM sales_orders WHERE Status <> 'cancelled'"),
    ("cancelled_value", "SELECT sum(Total_Amount_USD) FROM sales_orders WHERE Status = 'cancelled'"),
    ("unique_customers", "SELECT count(DISTINCT Customer) FROM sales_orders"),
    ("best_customer", "SELECT sum(Total_Amount_USD) FROM sales_orders WHERE Status <> 'cancelled' "
                      "GROUP BY Customer ORDER BY 1 DESC LIMIT 1"),
    ("best_region", "SELECT sum(Total_Amount_USD) FROM sales_orders WHERE Status <> 'cancelled' "
                    "GROUP BY Region ORDER BY 1 DESC LIMIT 1"),
    ("cancellation_rate", "SELECT count(*) FILTER (Status = 'cancelled') / count(*) * 100 FROM sales_orders"),
    ("pending_amount", "SELECT sum(Total_Amount_USD) FROM sales_orders WHERE Status = 'pending'"),
    ("mom_growth", _GROWTH),
]


def _report_sql(with_sql, values):
    return with_sql + " UNION ALL ".join(
        f"SELECT '{key}' AS kpi_key, round(CAST(({sql}) AS DOUBLE), 2) AS value" for key, sql in values)


@query("kpi_report", _report_sql(v.WITH_ORDERS, _KPI_VALUES))
def kpi_report(spark, sf):
    found = kpis.calculate_kpis(v.sales_orders(spark, sf), v.orders_profile(), store=True)
    return rounded(found.frame(spark).select("kpi_key", "value"), "value")


@query("kpi_report_lines")
def kpi_report_lines(spark, sf):
    return kpis.calculate_kpis(v.sales_lines(spark, sf), v.lines_profile(), store=True).frame(spark)


@query("kpi_fallback", """
  SELECT 'total_rows' AS kpi_key, CAST(count(*) AS DOUBLE) AS value FROM supplier
  UNION ALL SELECT 'primary_measure_total', round(sum(s_acctbal), 2) FROM supplier
  UNION ALL SELECT 'primary_measure_average', round(avg(s_acctbal), 2) FROM supplier""")
def kpi_fallback(spark, sf):
    df = v.table(spark, sf, "supplier").select("s_name", "s_acctbal")
    found = kpis.calculate_kpis(df, profiling.profile_dataset(df))
    return rounded(found.frame(spark).select("kpi_key", "value"), "value")


@query("kpi_of_slice", v.WITH_ORDERS.replace("JOIN region ON n_regionkey = r_regionkey",
       "JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND o_totalprice >= 10000 "
       "AND o_totalprice <= 400000") + " UNION ALL ".join(
    f"SELECT '{key}' AS kpi_key, round(CAST(({sql}) AS DOUBLE), 2) AS value" for key, sql in _KPI_VALUES))
def kpi_of_slice(spark, sf):
    some = slicing.filter_numbers(slicing.filter_categories(
        v.sales_orders(spark, sf), {"Region": ["ASIA", "EUROPE"]}), {"Total_Amount_USD": (10000, 400000)})
    found = kpis.calculate_kpis(some, v.orders_profile(), store=True)
    return rounded(found.frame(spark).select("kpi_key", "value"), "value")


# --- rollups -------------------------------------------------------------------

def _trend_sql(grain, step, source, date, value, where):
    start = {"week": f"CAST(date_trunc('week', {date}) AS DATE) + 6"}.get(
        grain, f"CAST(date_trunc('{grain}', {date}) AS DATE)")
    return f"""SELECT CAST(b AS DATE) AS bucket, round(coalesce(total, 0), 2) AS value
      FROM (SELECT unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL {step})) AS b
            FROM (SELECT {start} AS d FROM {source} {where}))
      LEFT JOIN (SELECT {start} AS d, sum({value}) AS total FROM {source} {where} GROUP BY 1) ON b = d"""


@query("trend_quarter", v.WITH_ORDERS + _trend_sql(
    "quarter", "3 MONTH", "sales_orders", "Order_Date", "Total_Amount_USD", "WHERE Status <> 'cancelled'"))
def trend_quarter(spark, sf):
    return rounded(rollups.trend(v.sales_orders(spark, sf), v.orders_profile()), "value")


@query("trend_month", v.WITH_ORDERS + _trend_sql(
    "month", "1 MONTH", "sales_orders", "Order_Date", "Total_Amount_USD",
    "WHERE Status <> 'cancelled' AND Order_Date >= '1997-01-01' AND Order_Date < '1998-01-01'"))
def trend_month(spark, sf):
    year = slicing.filter_dates(v.sales_orders(spark, sf), {"Order_Date": ("1997-01-01", "1997-12-31")})
    return rounded(rollups.trend(year, v.orders_profile()), "value")


@query("trend_week", _trend_sql("week", "7 DAY", "events", "ts", "value", ""))
def trend_week(spark, sf):
    return rounded(rollups.trend(v.table(spark, sf, "events"), v.events_profile()), "value")


@query("trend_day", _trend_sql("day", "1 DAY", "events", "ts", "value",
                               "WHERE ts >= '2024-01-05' AND ts < '2024-01-13'"))
def trend_day(spark, sf):
    days = slicing.filter_dates(v.table(spark, sf, "events"), {"ts": ("2024-01-05", "2024-01-12")})
    return rounded(rollups.trend(days, v.events_profile()), "value")


def _top_sql(column):
    return v.WITH_LINES + f"""SELECT {column} AS key, round(sum(Total_Amount_USD), 2) AS value FROM sales_lines
      WHERE Status <> 'returned' GROUP BY 1 ORDER BY sum(Total_Amount_USD) DESC, 1 LIMIT 10"""


@query("top10_product", _top_sql("Product"))
def top10_product(spark, sf):
    return rounded(rollups.top_categories(v.sales_lines(spark, sf), v.lines_profile(), "Product"), "value")


@query("top10_customer", _top_sql("Customer"))
def top10_customer(spark, sf):
    return rounded(rollups.top_categories(v.sales_lines(spark, sf), v.lines_profile(), "Customer"), "value")


def _share_sql(column):
    return v.WITH_LINES + f""", g AS (SELECT {column} AS key, sum(Total_Amount_USD) AS value FROM sales_lines
        WHERE Status <> 'returned' GROUP BY 1 HAVING sum(Total_Amount_USD) > 0),
      r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS rank, count(*) OVER () AS keys,
            sum(value) OVER () AS total FROM g)
      SELECT CASE WHEN keys <= 8 OR rank < 8 THEN key ELSE '{fv.OTHERS}' END AS key, round(sum(value), 2) AS value,
             round(sum(value) / max(total) * 100, 4) AS share_pct FROM r GROUP BY 1"""


def _share(spark, sf, column):
    found = rollups.share(v.sales_lines(spark, sf), v.lines_profile(), column)
    return rounded(rounded(found, "value"), "share_pct", digits=4)


@query("share_region", _share_sql("Region"))
def share_region(spark, sf):
    return _share(spark, sf, "Region")


@query("share_other_nation", _share_sql("Nation"))
def share_other_nation(spark, sf):
    return _share(spark, sf, "Nation")


@query("status_counts", v.WITH_LINES + "SELECT Status AS key, count(*) AS rows FROM sales_lines GROUP BY 1")
def status_counts(spark, sf):
    return rollups.status_counts(v.sales_lines(spark, sf), v.lines_profile())


@query("hist_price", v.WITH_ORDERS + """, a AS (SELECT Total_Amount_USD AS x FROM sales_orders WHERE Status <> 'cancelled'),
  e AS (SELECT min(x) AS lo, max(x) AS hi FROM a),
  c AS (SELECT least(CAST(floor(40 * ((x - lo) / (hi - lo))) AS INTEGER) + 1, 40) AS bin, count(*) AS rows
        FROM a, e GROUP BY 1)
  SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * (hi - lo) / 40, 2) AS low,
         round(lo + b * (hi - lo) / 40, 2) AS high, coalesce(rows, 0) AS rows
  FROM range(1, 41) t(b) CROSS JOIN e LEFT JOIN c ON b = bin""")
def hist_price(spark, sf):
    return rounded(rollups.distribution(v.sales_orders(spark, sf), v.orders_profile()), "low", "high")


@query("chart_selection", """
  SELECT * FROM (VALUES ('trend'), ('top_Product'), ('top_Customer'), ('share_Region'), ('status'), ('distribution')) t(key)""")
def chart_selection(spark, sf):
    p = v.lines_profile()
    lines = materialize(kpis.role_columns(v.sales_lines(spark, sf), p), "roles")
    found = rollups.create_charts(lines, p)
    return spark.createDataFrame([(r.key,) for r in found], "key string")


# --- insights ---------------------------------------------------------------------

def _money_sql(x):
    return f"'$' || CASE WHEN abs({x}) >= 1000 THEN format('{{:,.0f}}', {x}) ELSE format('{{:,.2f}}', {x}) END"


@query("insights", v.WITH_ORDERS + f"""
  , t AS (SELECT count(*) AS n, count(DISTINCT Order_ID) AS orders,
            sum(Total_Amount_USD) FILTER (Status <> 'cancelled') AS net,
            sum(Total_Amount_USD) FILTER (Status = 'cancelled') AS lost,
            sum(Total_Amount_USD) FILTER (Status = 'pending') AS pending,
            count(*) FILTER (Status = 'cancelled') / count(*) * 100 AS rate FROM sales_orders),
  m AS ({_FULL_MONTHS}), g AS (SELECT ({_GROWTH}) AS growth),
  l AS (SELECT strftime(month, '%Y-%m') AS name, total FROM m WHERE back = 1),
  pr AS (SELECT total FROM m WHERE back = 2),
  hi AS (SELECT strftime(month, '%Y-%m') AS name, total FROM m ORDER BY total DESC, month LIMIT 1),
  lo AS (SELECT strftime(month, '%Y-%m') AS name, total FROM m ORDER BY total, month LIMIT 1),
  c AS (SELECT Customer AS name, sum(Total_Amount_USD) AS total FROM sales_orders WHERE Status <> 'cancelled'
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
  r AS (SELECT Region AS name, sum(Total_Amount_USD) AS total FROM sales_orders WHERE Status <> 'cancelled' GROUP BY 1),
  rb AS (SELECT * FROM r ORDER BY total DESC, name LIMIT 1), rw AS (SELECT * FROM r ORDER BY total, name LIMIT 1)
  SELECT 'net_sales' AS rule_id, 'info' AS level, 'فروش خالص دوره ' || {_money_sql('net')} || ' است در '
    || format('{{:,}}', orders) || ' سفارش.' AS text FROM t
  UNION ALL SELECT 'last_month', CASE WHEN growth >= 0 THEN 'positive' ELSE 'warning' END,
    'فروش در ' || name || ' نسبت به ماه قبل ' || format('{{:,.1f}}', abs(growth)) || '٪ '
    || CASE WHEN growth >= 0 THEN 'رشد' ELSE 'افت' END || ' داشته است.'
    || CASE WHEN (SELECT count(*) FROM m) < (SELECT count(*) FROM ({_MONTHLY}))
            THEN ' ماه جاری هنوز کامل نشده و در این مقایسه لحاظ نشده است.' ELSE '' END FROM g, l
  UNION ALL SELECT 'month_range', 'info', 'بهترین ماه ' || hi.name || ' با ' || {_money_sql('hi.total')}
    || ' و ضعیف‌ترین ماه ' || lo.name || ' با ' || {_money_sql('lo.total')} || ' بوده است.' FROM hi, lo
  UNION ALL SELECT 'share_best_customer', 'info', 'مشتری «' || c.name || '» با ' || {_money_sql('c.total')}
    || ' معادل ' || format('{{:,.1f}}', c.total / net * 100) || '٪ از فروش را تشکیل می‌دهد.' FROM c, t
  UNION ALL SELECT 'cancellation', 'warning', format('{{:,.1f}}', rate)
    || '٪ از رکوردها لغو یا مرجوع شده‌اند و از فروش خالص کنار گذاشته شدند.' FROM t
  UNION ALL SELECT 'pending', 'warning', {_money_sql('pending')} || ' از فروش هنوز وصول نشده است.' FROM t
  UNION ALL SELECT 'regions', 'info', 'بیشترین فروش از «' || rb.name || '» (' || {_money_sql('rb.total')}
    || ') و کمترین فروش از «' || rw.name || '» (' || {_money_sql('rw.total')} || ') به دست آمده است.' FROM rb, rw
  UNION ALL SELECT 'basis', 'info', 'این تحلیل بر پایه ' || format('{{:,}}', n)
    || ' رکورد پس از پاک‌سازی و فیلترهای فعال است.' FROM t""")
def insights_orders(spark, sf):
    figures = kpis.calculate_kpis(v.sales_orders(spark, sf), v.orders_profile(), store=True)
    found = insights.generate_insights(None, figures)
    return insights.insights_frame(spark, found).select("rule_id", "level", "text")


@query("insights_lines")
def insights_lines(spark, sf):
    figures = kpis.calculate_kpis(v.sales_lines(spark, sf), v.lines_profile(), store=True)
    found = insights.generate_insights(None, figures)
    return insights.insights_frame(spark, found)


# --- slicing ---------------------------------------------------------------------

@query("filter_categories", "SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'O'")
def filter_categories(spark, sf):
    return slicing.filter_categories(v.table(spark, sf, "lineitem"),
                                     {"l_returnflag": ["A", "N"], "l_linestatus": ["O"]})


@query("filter_numbers", "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def filter_numbers(spark, sf):
    return slicing.filter_numbers(v.table(spark, sf, "orders"), {"o_totalprice": (100000, 200000)})


@query("filter_dates", "SELECT * FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-11'")
def filter_dates(spark, sf):
    return slicing.filter_dates(v.table(spark, sf, "events"), {"ts": ("2024-01-03", "2024-01-10")})


@query("filter_domains", """
  SELECT 'o_orderstatus' AS column, 'category' AS kind, o_orderstatus AS value, NULL::DOUBLE AS low, NULL::DOUBLE AS high,
         NULL::DATE AS first, NULL::DATE AS last FROM orders GROUP BY 3
  UNION ALL SELECT 'o_orderpriority', 'category', o_orderpriority, NULL, NULL, NULL, NULL FROM orders GROUP BY 3
  UNION ALL SELECT 'o_totalprice', 'number', NULL, min(o_totalprice), max(o_totalprice), NULL, NULL FROM orders
  UNION ALL SELECT 'o_orderdate', 'date', NULL, NULL, NULL, min(o_orderdate)::DATE, max(o_orderdate)::DATE FROM orders""")
def filter_domains(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    return slicing.filter_domains(orders, profiling.profile_dataset(orders))


@query("search_rows", """
  SELECT doc_id, text, lang, source, n_chars FROM documents
  WHERE contains(lower(text), 'the') OR contains(CAST(doc_id AS VARCHAR), 'the') OR contains(lang, 'the')
     OR contains(source, 'the')""")
def search_rows(spark, sf):
    return slicing.search(v.table(spark, sf, "documents"), " The ")


@query("sort_page", "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_page(spark, sf):
    return slicing.sort_page(v.table(spark, sf, "orders"), "o_totalprice", rows=100, then=["o_orderkey"])


@query("selection_size", """
  SELECT count(*) FILTER (o_totalprice BETWEEN 100000 AND 200000) AS selected,
         count(*) FILTER (o_totalprice BETWEEN 100000 AND 200000) - count(*) AS difference FROM orders""")
def selection_size(spark, sf):
    orders = v.table(spark, sf, "orders")
    sizes = slicing.selection_size(orders, slicing.filter_numbers(orders, {"o_totalprice": (100000, 200000)}))
    return spark.createDataFrame([sizes], "selected bigint, difference bigint")


# --- the whole pipeline -------------------------------------------------------------

_CLEAN_VALUES = [(k, s.replace("sales_orders", "clean_sales")) for k, s in _KPI_VALUES]


@query("analyse_untidy_sales", _report_sql(v.WITH_CLEAN, _CLEAN_VALUES))
def analyse_untidy_sales(spark, sf):
    bundle = build_analysis(v.dirty_sales(spark, sf), v.DIRTY_OPTIONS)
    found = kpis.calculate_kpis(bundle.data, bundle.profile)
    return rounded(found.frame(spark).select("kpi_key", "value"), "value")


@query("stored_analysis", _report_sql(v.WITH_CLEAN, _CLEAN_VALUES))
def stored_analysis(spark, sf):
    """The key figures of an analysis that was kept and opened again; the untidy table is not read for it."""
    store = AnalysisStore(spark)
    raw = v.dirty_sales(spark, sf)
    store.release(store.build(raw, v.DIRTY_OPTIONS))
    if store.key(raw, v.DIRTY_OPTIONS) not in store.entries():
        raise ValueError("the analysis was not kept")
    bundle = store.build(raw, v.DIRTY_OPTIONS)
    found = kpis.calculate_kpis(bundle.data, bundle.profile)
    return rounded(found.frame(spark).select("kpi_key", "value"), "value")


@query("quality_of_untidy_sales")
def quality_of_untidy_sales(spark, sf):
    return build_analysis(v.dirty_sales(spark, sf), v.DIRTY_OPTIONS).quality.issues_frame(spark)


@query("monthly_growth", v.WITH_ORDERS + f"""
  SELECT month, round(total, 2) AS total, round((total - lag(total) OVER (ORDER BY month))
    / abs(lag(total) OVER (ORDER BY month)) * 100, 2) AS growth_pct FROM ({_MONTHLY})""")
def monthly_growth(spark, sf):
    # One row per month of the timeline is left by now.
    before = F.lag("total").over(W.orderBy("month"))
    months = kpis.monthly_sales(v.sales_orders(spark, sf), v.orders_profile())
    growth = F.round((F.col("total") - before) / F.abs(before) * 100, 2)
    return rounded(months.select("month", "total", growth.alias("growth_pct")), "total")


# --- cases the tables above do not hold ----------------------------------------

@query("many_statuses", """
  WITH s AS (SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN 'open ' WHEN c_custkey % 3 = 1 THEN 'paid ' ELSE 'await ' END, c_custkey) AS status,
                    c_acctbal AS amount FROM customer)
  SELECT count(*) FILTER (status LIKE 'open%' OR status LIKE 'await%') AS pending_spellings, 0 AS negative_spellings,
         round(sum(amount) FILTER (status LIKE 'open%' OR status LIKE 'await%'), 2) AS pending_amount, false AS has_cancellation_rate FROM s""")
def many_statuses(spark, sf):
    kind = F.element_at(F.array(F.lit("open "), F.lit("paid "), F.lit("await ")), (F.col("c_custkey") % 3 + 1).cast("int"))
    df = v.table(spark, sf, "customer").select(F.concat(kind, "c_custkey").alias("status"), F.col("c_acctbal").alias("amount"))
    p = profiling.profile_dataset(df, {"status": ("category", "status"), "amount": ("measure", "money")})
    figures = kpis.calculate_kpis(df, p)
    rows = [(len(p.pending_statuses), len(p.negative_statuses), round(figures.get("pending_amount").value, 2),
             figures.get("cancellation_rate") is not None)]
    return spark.createDataFrame(
        rows, "pending_spellings bigint, negative_spellings int, pending_amount double, has_cancellation_rate boolean")


@query("search_large_amounts", """
  SELECT o_orderkey, o_orderkey * 1000000.0::DOUBLE + 12345678 AS amount FROM orders
  WHERE contains(CAST(CAST(o_orderkey * 1000000 + 12345678 AS BIGINT) AS VARCHAR) || '.0', '2345678')
     OR contains(CAST(o_orderkey AS VARCHAR), '2345678')""")
def search_large_amounts(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.lit(1e6) + 12345678).alias("amount"))
    return slicing.search(df, "2345678")


@query("share_tiny_tail", """
  WITH g AS (SELECT c_nationkey, max(c_custkey) AS top FROM customer GROUP BY 1),
  r AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, CASE WHEN row_number() OVER (ORDER BY c_nationkey) <= 7 THEN 1e17 ELSE 0.25 END AS value FROM g),
  s AS (SELECT CASE WHEN value > 1 THEN key ELSE 'سایر' END AS key, sum(value) AS value FROM r GROUP BY 1)
  SELECT key, value, value / sum(value) OVER () * 100 AS share_pct FROM s""")
def share_tiny_tail(spark, sf):
    # a window over 25 nations at most
    df = (v.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(F.max("c_nationkey").alias("n"))
          .withColumn("amount", F.when(F.row_number().over(W.orderBy("n")) <= 7, F.lit(1e17)).otherwise(F.lit(0.25))))
    p = profiling.Profile.declare({"nation": ("category", "region"), "amount": ("measure", "money")})
    return rollups.share(df.select("nation", "amount"), p, "nation")


@query("blank_customers", """
  SELECT count(DISTINCT c_name) FILTER (c_custkey % 5 <> 0) AS named FROM customer""")
def blank_customers(spark, sf):
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit("\t")).otherwise(F.col("c_name"))
    df = v.table(spark, sf, "customer").select(name.alias("customer"), F.col("c_acctbal").alias("amount"))
    p = profiling.Profile.declare({"customer": ("category", "customer"), "amount": ("measure", "money")})
    figure = kpis.calculate_kpis(df, p).get("unique_customers")
    return spark.createDataFrame([(int(figure.value),)], "named bigint")


@query("regions_all_cancelled", """
  WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS region, sum(c_acctbal) AS total FROM customer GROUP BY 1)
  SELECT (SELECT region FROM g ORDER BY total DESC, region LIMIT 1) AS best, (SELECT region FROM g ORDER BY total, region LIMIT 1) AS worst""")
def regions_all_cancelled(spark, sf):
    df = v.table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("region"), F.col("c_acctbal").alias("amount"), F.lit("cancelled").alias("status"))
    p = profiling.Profile.declare(
        {"region": ("category", "region"), "amount": ("measure", "money"), "status": ("category", "status")}, negative=["cancelled"])
    text = next(i.text for i in insights.generate_insights(df, profile=p) if i.rule_id == "regions")
    best, worst = re.findall("«(.*?)»", text)
    return spark.createDataFrame([(best, worst)], "best string, worst string")


@query("dedupe_maps", """
  SELECT c_custkey % 7 AS a, c_nationkey AS b, count(*) > 0 AS kept FROM customer GROUP BY 1, 2""")
def dedupe_maps(spark, sf):
    both = F.create_map(F.lit("a"), F.col("c_custkey") % 7, F.lit("b"), F.col("c_nationkey").cast("bigint"))
    turned = F.create_map(F.lit("b"), F.col("c_nationkey").cast("bigint"), F.lit("a"), F.col("c_custkey") % 7)
    df = v.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, both).otherwise(turned).alias("m"))
    return dedupe.drop_duplicates(df).select(F.col("m")["a"].alias("a"), F.col("m")["b"].cast("int").alias("b"), F.lit(True).alias("kept"))


@query("csv_malformed_rows", """
  SELECT count(*) FILTER (n_nationkey % 5 <> 0) AS whole, count(*) FILTER (n_nationkey % 5 = 0) AS malformed FROM nation""")
def csv_malformed_rows(spark, sf):
    extra = F.when(F.col("n_nationkey") % 5 == 0, F.lit(",EXTRA")).otherwise(F.lit(""))
    lines = v.table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", F.concat(F.lit('5" '), "n_name"), F.col("n_regionkey")).alias("value"), extra.alias("extra"))
    path = new_path(spark, "lines") + ".csv"
    header = spark.createDataFrame([("key,name,region", 0)], "value string, place int")
    (lines.select(F.concat("value", "extra").alias("value"), F.lit(1).alias("place")).unionAll(header)
     .coalesce(1).sortWithinPartitions("place", "value").select("value").write.text(path))
    return materialize(read_csv(spark, path), "parsed").agg(
        F.count_if(F.col(MALFORMED).isNull()).alias("whole"), F.count(MALFORMED).alias("malformed"))
