"""Business tables made from the test tables, tidy and untidy.

The tidy views are ordinary equi-joins. The untidy one writes the same orders as
messy text by formulas over the order key, so the right answer after cleaning is
the tidy view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions.dates import jalali_year_start
from tablescope.plans import CleaningOptions, Profile
from tablescope.session import configure, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    def t(name):
        return table(spark, sf_dir, name)
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
    return t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def sales_orders(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "P", "cancelled")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("completed"))
    key = [F.col("o_orderkey").alias("k")] if with_key else []
    return _orders(spark, sf_dir).select(
        *key, F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("Order_ID"),
        F.col("o_orderdate").alias("Order_Date"), F.col("c_name").alias("Customer"),
        F.col("r_name").alias("Region"), F.col("c_mktsegment").alias("Segment"),
        F.col("o_totalprice").alias("Total_Amount_USD"), status.alias("Status"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.when(F.col("l_returnflag") == "R", "returned")
              .when(F.col("l_returnflag") == "N", "pending").otherwise("completed"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("Order_ID"),
                F.col("o_orderdate").alias("Order_Date"), F.col("c_name").alias("Customer"),
                F.col("r_name").alias("Region"), F.col("n_name").alias("Nation"),
                F.col("c_mktsegment").alias("Segment"), F.col("p_name").alias("Product"),
                F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("Total_Amount_USD"),
                F.round(F.col("l_discount") * 100, 0).alias("Discount_Pct"),
                F.round(F.col("l_tax") * 100, 0).alias("Tax_Pct"), status.alias("Status")))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


# The same views for the SQL side.
SALES_ORDERS_SQL = """
  SELECT o_orderkey AS k, 'ORD-' || o_orderkey AS Order_ID, o_orderdate AS Order_Date, c_name AS Customer,
         r_name AS Region, c_mktsegment AS Segment, o_totalprice AS Total_Amount_USD,
         CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'O' THEN 'pending' ELSE 'completed' END AS Status,
         n_name AS Nation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey"""
SALES_LINES_SQL = f"""
  SELECT Order_ID, Order_Date, Customer, Region, Nation, Segment, p_name AS Product, l_quantity AS Quantity,
         l_extendedprice AS Total_Amount_USD, round(l_discount * 100, 0) AS Discount_Pct,
         round(l_tax * 100, 0) AS Tax_Pct,
         CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'N' THEN 'pending' ELSE 'completed' END AS Status
  FROM lineitem JOIN ({SALES_ORDERS_SQL}) ON l_orderkey = k JOIN part ON l_partkey = p_partkey"""
WITH_ORDERS = f"WITH sales_orders AS ({SALES_ORDERS_SQL}) "
WITH_LINES = f"WITH sales_lines AS ({SALES_LINES_SQL}) "


def orders_profile() -> Profile:
    return Profile.declare({
        "Order_ID": ("identifier", "id"), "Order_Date": ("date", ""), "Customer": ("category", "customer"),
        "Region": ("category", "region"), "Segment": ("category", "channel"),
        "Total_Amount_USD": ("measure", "money"), "Status": ("category", "status"),
    }, negative=["cancelled"], pending=["pending"])


def lines_profile() -> Profile:
    return Profile.declare({
        "Order_ID": ("text", ""), "Order_Date": ("date", ""), "Customer": ("category", "customer"),
        "Region": ("category", "region"), "Nation": ("category", ""), "Segment": ("category", "channel"),
        "Product": ("category", "product"), "Quantity": ("measure", "quantity"),
        "Total_Amount_USD": ("measure", "money"), "Discount_Pct": ("percent", "percent"),
        "Tax_Pct": ("percent", "percent"), "Status": ("category", "status"),
    }, negative=["returned"], pending=["pending"])


def events_profile() -> Profile:
    return Profile.declare({"ts": ("date", ""), "event_type": ("category", ""), "value": ("measure", "money")})


# --- the untidy table -------------------------------------------------------

def persian(col: Column) -> Column:
    return F.translate(col, fv.ASCII_DIGITS, fv.PERSIAN_DIGITS)


def full_width(col: Column) -> Column:
    return F.translate(col, fv.ASCII_DIGITS, "０１２３４５６７８９")


def jalali_text(date: Column) -> Column:
    """A Gregorian date written in the Solar Hijri calendar, ``y/m/d``."""
    guess = F.year(date) - 621
    year = F.when(jalali_year_start(guess) > date, guess - 1).otherwise(guess)
    day = F.date_diff(date, jalali_year_start(year))  # from 0
    month = F.when(day < 186, F.floor(day / 31) + 1).otherwise(F.floor((day - 186) / 30) + 7)
    left = F.when(day < 186, day % 31).otherwise((day - 186) % 30)
    return F.concat_ws("/", year, month, left + 1)


def date_text(k: Column, date: Column) -> Column:
    return (F.when(k % 5 == 0, F.date_format(date, "yyyy-MM-dd"))
            .when(k % 5 == 1, F.date_format(date, "yyyy/M/d"))
            .when(k % 5 == 2, persian(F.date_format(date, "yyyy/MM/dd")))
            .when(k % 5 == 3, jalali_text(date.cast("date")))
            .otherwise(persian(jalali_text(date.cast("date")))))


def money_text(k: Column, amount: Column) -> Column:
    grouped = F.format_number(amount, 2)
    return (F.when(k % 5 == 0, F.concat(grouped, F.lit(" USD")))
            .when(k % 5 == 1, F.concat(F.lit("$"), F.replace(grouped, F.lit(","), F.lit(""))))
            .when(k % 5 == 2, F.translate(grouped, ",.", ".,"))
            .when(k % 5 == 3, persian(grouped))
            .otherwise(F.concat(F.lit("  "), grouped, F.lit(" €"))))


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy table as a file, the way a raw export arrives; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        # At least one file per core; a cluster's export has many more.
        rows = _untidy(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        _WRITTEN[key] = materialize(rows, "untidy")
    return _WRITTEN[key]


def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as untidy text, every 20th twice, with empty rows and an empty column."""
    tidy = sales_orders(spark, sf_dir, with_key=True)
    k = F.col("k")
    amount = F.when(k % 97 == 0, F.concat(F.lit("unknown "), k % 3)).otherwise(money_text(k, F.col("Total_Amount_USD")))
    copies = F.when(k % 20 == 0, 2).otherwise(1) + F.when(k % 500 == 0, 1).otherwise(0)
    untidy = tidy.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    # The extra copy of every 500th order becomes an empty row.
    empty = (k % 500 == 0) & (F.col("copy") == copies)

    def cell(value: Column, name: str) -> Column:
        return F.when(~empty, value).alias(name)

    return untidy.select(
        cell(F.concat(F.when(k % 3 == 0, "  ").otherwise(""), "Order_ID"), "Order_ID "),
        cell(date_text(k, F.col("Order_Date")), "Order_Date"),
        cell(F.when(k % 7 == 0, full_width(F.col("Customer")))
             .when(k % 7 == 1, F.concat(F.lit(" "), "Customer", F.lit("  ")))
             .otherwise(F.col("Customer")), " Customer"),
        cell(F.concat(F.lit("\u200f"), "Region"), "Region"),
        cell(F.when((k % 50 == 0) & (F.col("Segment") == "BUILDING"), "BUILDINGG")
             .otherwise(F.col("Segment")), "Segment"),
        F.lit(None).cast("string").alias("Notes"),
        cell(F.concat(k % 10, F.lit("%")), "Discount_Pct"),
        cell(amount, "Total_Amount_USD"),
        cell(F.concat("Status", F.lit("\t")), "Status"))


DIRTY_OPTIONS = CleaningOptions(merge_labels=["Segment"])

# What the untidy table holds once it is clean.
CLEAN_SALES_SQL = f"""
  SELECT Order_ID, Order_Date, Customer, Region, Segment, CAST(k % 10 AS DOUBLE) AS Discount_Pct,
         CASE WHEN k % 97 <> 0 THEN Total_Amount_USD END AS Total_Amount_USD, Status
  FROM ({SALES_ORDERS_SQL})"""
WITH_CLEAN = f"WITH clean_sales AS ({CLEAN_SALES_SQL}) "
