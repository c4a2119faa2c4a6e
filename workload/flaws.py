"""Queries over tables with the flaws that the test tables do not have by themselves, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions import numbers, text
from tablescope.operators import insights
from tablescope.operators.cleaning import clean_dataset
from tablescope.pipeline import build_analysis
from tablescope.plans import CleaningOptions
from tablescope.session import materialize, new_path
from tablescope.sources import load
from tablescope.sources.export import write_report
from workload import catalog
from workload import views as v
from workload.catalog import query

_BLANKS = ("nan", "None", "NULL", "-", "n/a", "NA", "   ", "‏", "TRUE")

# --- the untidy table's issues, as text -----------------------------------------

catalog.ORACLES["quality_of_untidy_sales"] = v.WITH_ORDERS + f"""
  , c AS (SELECT *, 1 + CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 500 = 0 THEN 1 ELSE 0 END AS n FROM sales_orders),
  f AS (SELECT sum(n)::BIGINT AS raw_rows, count(*) FILTER (k % 97 = 0) AS missing, count(*) FILTER (k % 20 = 0) AS copies FROM c),
  v AS (SELECT Total_Amount_USD AS x FROM sales_orders WHERE k % 97 <> 0),
  q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v),
  o AS (SELECT count(*) FILTER (x < a - 3 * (b - a) OR x > b + 3 * (b - a)) AS outliers, count(*) AS filled FROM v, q)
  SELECT 'Total_Amount_USD' AS column, 'missing' AS issue_code, '{fv.ISSUES["missing"][0]}' AS issue, {catalog._severity("missing", "raw_rows")} AS severity,
    format('{{:,}} مقدار خالی ({{:,.1f}}٪ رکوردها)', missing, missing / raw_rows * 100) AS description, missing AS affected FROM f
  UNION ALL SELECT '—', 'duplicate_rows', '{fv.ISSUES["duplicate_rows"][0]}', '{fv.HIGH}',
    format('{{:,}} رکورد کاملاً تکراری شناسایی و حذف شد', copies), copies FROM f WHERE copies > 0
  UNION ALL SELECT 'Total_Amount_USD', 'mixed_numbers', '{fv.ISSUES["mixed_numbers"][0]}', '{fv.MEDIUM}',
    'مقادیری مانند [''unknown 0'', ''unknown 1'', ''unknown 2''] در ستون عددی ذخیره شده‌اند', 0
  UNION ALL SELECT 'Total_Amount_USD', 'rejected', '{fv.ISSUES["rejected"][0]}', '{fv.HIGH}',
    'مقادیری مانند [''unknown 0'', ''unknown 1'', ''unknown 2''] قابل تبدیل نبودند و خالی در نظر گرفته شدند', 3
  UNION ALL SELECT 'Total_Amount_USD', 'outlier', '{fv.ISSUES["outlier"][0]}', '{fv.MEDIUM}',
    format('{{:,}} مقدار بسیار دور از دامنه معمول (روش IQR)', outliers), outliers FROM o WHERE outliers > 0 AND outliers / filled <= 0.05""".replace("\n  , c AS", ", c AS")


# --- a table with the other flaws ---------------------------------------------------

def flawed_orders(spark, sf):
    """Customers as orders: repeated ids, negative and giant amounts, a percentage over 100, one source for all."""
    k = F.col("c_custkey")
    raw = v.table(spark, sf, "customer").select(
        F.concat(F.lit("ORD-"), F.when(k % 50 == 0, k - 1).otherwise(k)).alias("Order_ID"), F.col("c_name").alias("Customer"),
        F.when(k % 400 == 0, F.lit("250000")).otherwise(F.format_string("%.2f", "c_acctbal")).alias("Total_Amount_USD"),
        F.when(k % 30 == 0, F.lit("150%")).otherwise(F.concat(k % 20, F.lit("%"))).alias("Discount_Pct"), F.lit("import").alias("Source"))
    return build_analysis(materialize(raw, "flawed"), CleaningOptions(merge_labels=False))


_FLAWED = """WITH d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, c_name AS name,
    CASE WHEN c_custkey % 400 = 0 THEN 250000 ELSE round(c_acctbal, 2) END AS x,
    CASE WHEN c_custkey % 30 = 0 THEN 150 ELSE c_custkey % 20 END AS p FROM customer),
  q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM d),
  f AS (SELECT count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (x < 0) AS negative, count(*) FILTER (p > 100) AS over,
    count(*) FILTER (x < a - 3 * (b - a) OR x > b + 3 * (b - a)) AS outliers,
    sum(x) AS total, avg(x) AS mean, max(x) AS largest, avg(p) AS discount, count(*) FILTER (p >= 15) AS high FROM d, q) """


@query("flawed_issues", _FLAWED + f"""
  SELECT 'Order_ID' AS column, 'duplicate_ids' AS issue_code, '{fv.MEDIUM}' AS severity, n - ids AS affected,
    format('{{:,}} شناسه تکراری است؛ رکوردها حذف نشدند و نیاز به بررسی دارند', n - ids) AS description FROM f
  UNION ALL SELECT 'Total_Amount_USD', 'negative', '{fv.HIGH}', negative,
    format('{{:,}} مقدار منفی در ستونی که انتظار عدد مثبت می‌رود', negative) FROM f
  UNION ALL SELECT 'Total_Amount_USD', 'outlier', '{fv.MEDIUM}', outliers,
    format('{{:,}} مقدار بسیار دور از دامنه معمول (روش IQR)', outliers) FROM f WHERE outliers > 0 AND outliers / n <= 0.05
  UNION ALL SELECT 'Discount_Pct', 'bad_percent', '{fv.HIGH}', over, format('{{:,}} مقدار خارج از بازه ۰ تا ۱۰۰', over) FROM f
  UNION ALL SELECT 'Source', 'constant', '{fv.LOW}', 0, '{fv.ISSUES["constant"][1]}'""")
def flawed_issues(spark, sf):
    return flawed_orders(spark, sf).quality.issues_frame(spark).select("column", "issue_code", "severity", "affected", "description")


@query("flawed_quality", _FLAWED + """, s AS (SELECT round(greatest(0, 100 - least(4 * 2 + 2 * (1
    + CASE WHEN outliers > 0 AND outliers / n <= 0.05 THEN 1 ELSE 0 END), 35)), 1) AS score FROM f)
  SELECT score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'usable' ELSE 'poor' END AS band FROM s""")
def flawed_quality(spark, sf):
    found = flawed_orders(spark, sf).quality
    return spark.createDataFrame([(found.score, found.band)], "score double, band string")


@query("flawed_insights", _FLAWED + f""", best AS (SELECT name, sum(x) AS x FROM d GROUP BY name ORDER BY 2 DESC, 1 LIMIT 1)
  SELECT 'net_sales' AS rule_id, 'info' AS level,
    'فروش خالص دوره ' || {catalog._money_sql("total")} || ' است در ' || format('{{:,}}', ids) || ' سفارش.' AS text FROM f
  UNION ALL SELECT 'share_best_customer', CASE WHEN best.x / total * 100 >= 30 THEN 'warning' ELSE 'info' END,
    'مشتری «' || name || '» با ' || {catalog._money_sql("best.x")} || ' معادل ' || format('{{:,.1f}}', best.x / total * 100)
    || '٪ از فروش را تشکیل می‌دهد.' || CASE WHEN best.x / total * 100 >= 30 THEN '{fv.INSIGHT_TEXTS["share_risk"]}' ELSE '' END FROM best, f
  UNION ALL SELECT 'discount', CASE WHEN discount >= 7.5 THEN 'warning' ELSE 'info' END,
    'میانگین تخفیف ' || format('{{:,.1f}}', discount) || '٪ است. تعداد سفارش با تخفیف 15٪ یا بیشتر: ' || format('{{:,}}', high) FROM f
  UNION ALL SELECT 'giant', 'warning', 'بزرگ‌ترین سفارش (' || {catalog._money_sql("largest")} || ') بیش از ' || format('{{:,.1f}}', largest / mean)
    || ' برابر میانگین است؛ پیش از تصمیم‌گیری صحت آن بررسی شود.' FROM f WHERE largest / mean >= 5
  UNION ALL SELECT 'negative', 'warning', '{fv.INSIGHT_TEXTS["negative"].split("{")[0]}' || format('{{:,}}', negative)
    || '{fv.INSIGHT_TEXTS["negative"].split("}")[1]}' FROM f WHERE negative > 0
  UNION ALL SELECT 'basis', 'info', 'این تحلیل بر پایه ' || format('{{:,}}', n) || ' رکورد پس از پاک‌سازی و فیلترهای فعال است.' FROM f""")
def flawed_insights(spark, sf):
    bundle = flawed_orders(spark, sf)
    found = insights.generate_insights(bundle.data, None, bundle.profile)
    return insights.insights_frame(spark, found).select("rule_id", "level", "text")


# --- loading --------------------------------------------------------------------------

@query("load_with_gaps", """
  SELECT c_custkey AS key, CASE WHEN c_custkey % 9 >= 3 THEN c_name END AS name,
         CASE WHEN c_custkey % 4 < 2 THEN 'اصفهان' ELSE c_mktsegment END AS "Province",
         CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS balance FROM customer WHERE c_custkey % 10 <> 0""")
def load_with_gaps(spark, sf):
    """A CSV file with missing-value words, an empty column, empty rows and known misspellings."""
    k = F.col("c_custkey")
    full = k % 10 != 0
    rows = v.table(spark, sf, "customer").select(
        F.when(full, k.cast("string")).alias("key"),
        F.when(full, F.when(k % 9 == 0, "NA").when(k % 9 == 1, "null").when(k % 9 == 2, "#N/A").otherwise(F.col("c_name"))).alias("name"),
        F.when(full, F.when(k % 4 == 0, "اصفهانن").when(k % 4 == 1, "اصفهان ").otherwise(F.col("c_mktsegment"))).alias("Province"),
        F.lit("N/A").alias("Notes"),
        F.when(full, F.when(k % 5 == 0, "NaN").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))).alias("balance"))
    path = new_path(spark, "gaps") + ".csv"
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False)
    return load(spark, path)


@query("rejected_inputs", f"""
  SELECT * FROM (VALUES ('no rows', '{fv.ERRORS["empty"]}'), ('no columns', '{fv.ERRORS["empty"]}'),
    ('nothing but missing values', '{fv.ERRORS["no_usable_rows"]}'), ('unknown format', '{fv.ERRORS["format"]}'),
    ('no table', '{fv.ERRORS["not_a_dataframe"]}')) AS t ("case", message) WHERE EXISTS (SELECT 1 FROM nation)""")
def rejected_inputs(spark, sf):
    nation = v.table(spark, sf, "nation")
    path = new_path(spark, "missing") + ".parquet"
    nation.select(*[F.lit("N/A").alias(c) for c in nation.columns]).write.parquet(path)
    cases = {"no rows": lambda: build_analysis(nation.where("n_nationkey < 0")), "no columns": lambda: build_analysis(nation.select()),
             "nothing but missing values": lambda: load(spark, path), "unknown format": lambda: load(spark, "table.txt"),
             "no table": lambda: clean_dataset(nation.toPandas())}
    rows = []
    for case, run in cases.items():
        try:
            run()
            rows.append((case, None))
        except ValueError as error:
            rows.append((case, str(error)))
    return spark.createDataFrame(rows, "case string, message string")


@query("report_file", catalog.ORACLES["clean_audit"])
def report_file(spark, sf):
    """The audit of cleaning, written as a CSV file and read back."""
    path = new_path(spark, "audit") + ".csv"
    write_report(catalog.cleaned(spark, sf), path)
    back = spark.read.csv(path, header=True, escape='"')
    return back.select("column", "action_code", F.col("affected_rows").cast("long"))


# --- cells and names --------------------------------------------------------------------

@query("blank_cells", f"""
  SELECT event_id, CASE WHEN event_id % {len(_BLANKS) + 1} = {len(_BLANKS)} THEN CAST(event_id AS DOUBLE) END AS number,
    CASE event_id % {len(_BLANKS) + 1} {" ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BLANKS) if b.strip(" " + chr(0x200f)))}
      WHEN {len(_BLANKS)} THEN CAST(event_id AS VARCHAR) END AS text FROM events""")
def blank_cells(spark, sf):
    """Words for nothing as numbers, and cells that hold nothing visible as text."""
    cells = F.element_at(F.array(*map(F.lit, _BLANKS), F.col("event_id").cast("string")), (F.col("event_id") % (len(_BLANKS) + 1) + 1).cast("int"))
    return v.table(spark, sf, "events").select(
        "event_id", numbers.parse_number(cells).alias("number"), text.empty_to_null(text.normalize_text(cells)).alias("text"))


@query("column_names_and_typos", """
  SELECT * FROM (SELECT 'Label' AS name, 'اصفهان' AS value, count(*) AS rows FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT 'Label', 'تهران', count(*) FROM nation WHERE n_nationkey % 3 <> 0
    UNION ALL SELECT 'Label_1', n_name, 1 FROM nation UNION ALL SELECT 'Label_2', n_name || ' 2', 1 FROM nation)""")
def column_names_and_typos(spark, sf):
    """Three columns whose names come out alike, and labels misspelt in the two known ways."""
    k = F.col("n_nationkey")
    raw = v.table(spark, sf, "nation").select(
        F.when(k % 3 == 0, "اصفهانن").otherwise("تهرانـ"), F.col("n_name"), F.concat("n_name", F.lit(" 2"))).toDF(" Label", "Label ", "‏Label")
    clean = clean_dataset(raw, CleaningOptions(min_label_ratio=0.999)).data
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in clean.columns])).alias("cell")
    return clean.select(named).select("cell.*").groupBy("name", "value").agg(F.count("*").alias("rows"))
