"""Key figures, computed from the roles of columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions.numbers import SPACES, dollars
from tablescope.operators.distinct import long_form, quoted
from tablescope.operators.profiling import measure, profile_dataset
from tablescope.operators.quantiles import exact_quantiles
from tablescope.plans.profile import Profile
from tablescope.session import materialize

KPI_SCHEMA = "kpi_key string, label string, value double, display string, description string"


@dataclass
class Kpi:
    key: str
    label: str
    value: float
    display: str
    description: str = ""


@dataclass
class KpiResult:
    kpis: list[Kpi] = field(default_factory=list)
    context: dict = field(default_factory=dict)

    def get(self, key: str) -> Kpi | None:
        return next((k for k in self.kpis if k.key == key), None)

    def as_dict(self) -> dict[str, float]:
        return {k.key: k.value for k in self.kpis}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k.key, k.label, k.value, k.display, k.description) for k in self.kpis]
        return spark.createDataFrame(rows, KPI_SCHEMA)


def _first_named(names, hints) -> str:
    return next((n for n in names if any(h in n.lower() for h in hints)), "")


def payment_days_column(profile: Profile) -> str:
    return _first_named(profile.measure_columns, fv.PAYMENT_DAY_HINTS)


def discount_column(profile: Profile) -> str:
    return _first_named(profile.percent_columns, fv.DISCOUNT_HINTS)


# --- the three aggregations -------------------------------------------------

def totals(df: DataFrame, profile: Profile) -> DataFrame:
    """Every figure that needs no grouping, as one row from one pass.

    ``active`` figures leave out cancelled and returned rows, the others cover
    all rows.
    """
    active = profile.is_active()
    exprs = [
        F.count("*").alias("total_rows"),
        F.count(F.when(~active, 1)).alias("excluded_rows"),
    ]
    if profile.money_column:
        value = measure(df, profile.money_column)
        net = F.when(active, value)
        exprs += [
            F.count(net).alias("net_count"), F.sum(net).alias("total_sales"),
            F.avg(net).alias("average_order_value"), F.max(net).alias("largest_sale"),
            F.count(value).alias("gross_count"), F.sum(value).alias("gross_sales"),
            F.avg(value).alias("gross_average"), F.max(value).alias("gross_largest"),
            F.count(F.when(value < 0, 1)).alias("negative_count"),
            F.sum(F.when(~active, value)).alias("cancelled_value"),
            F.sum(F.when(profile.is_pending(), value)).alias("pending_amount"),
        ]
    elif profile.measure_columns:
        value = measure(df, profile.measure_columns[0])
        exprs += [F.count(value).alias("measure_count"), F.sum(value).alias("measure_total"),
                  F.avg(value).alias("measure_average")]
    if profile.quantity_column:
        quantity = F.when(active, measure(df, profile.quantity_column))
        exprs += [F.count(quantity).alias("quantity_count"), F.sum(quantity).alias("total_quantity")]
    if payment_days_column(profile):
        exprs.append(F.avg(measure(df, payment_days_column(profile))).alias("payment_days"))
    if discount_column(profile):
        discount = measure(df, discount_column(profile))
        exprs += [F.avg(discount).alias("average_discount"),
                  F.count(F.when(discount >= fv.HIGH_DISCOUNT, 1)).alias("high_discounts")]
    if profile.primary_date:
        exprs.append(F.max(F.when(active, quoted(profile.primary_date))).cast("date").alias("last_date"))
    return df.agg(*exprs)


_SHARE_KEYS = (("best_customer", "customer_column"), ("best_product", "product_column"),
               ("best_region", "region_column"))


def group_totals(df: DataFrame, dimensions: dict[str, str], value, active) -> DataFrame:
    """``column, value, total, filled`` per key of each dimension, in one pass.

    ``filled`` counts the active rows with an amount; keys without any are kept,
    so that the keys themselves can be counted.
    """
    keys = {name: quoted(column).cast("string") for name, column in dimensions.items()}
    net = F.when(active, value)
    return (long_form(df, keys, net).groupBy("column", "value")
            .agg(F.sum("carry0").alias("total"), F.count("carry0").alias("filled")))


def group_summary(groups: DataFrame) -> DataFrame:
    """Per dimension: number of keys, grand total, best and worst key (ties by name)."""
    ranked = F.when(F.col("filled") > 0, F.struct((-F.col("total")).alias("minus"), F.col("value")))
    lowest = F.when(F.col("filled") > 0, F.struct(F.col("total"), F.col("value")))
    return groups.groupBy("column").agg(
        F.count("*").alias("keys"),
        F.count(F.when(F.trim(F.col("value"), F.lit(SPACES)) != "", 1)).alias("named_keys"),
        F.count(F.when(F.col("filled") > 0, 1)).alias("sold_keys"),
        F.sum("total").alias("grand_total"),
        F.min(ranked).alias("best"),
        F.min(lowest).alias("worst"),
    ).select("column", "keys", "named_keys", "sold_keys", "grand_total",
             F.col("best.value").alias("best_key"), (-F.col("best.minus")).alias("best_total"),
             F.col("worst.value").alias("worst_key"), F.col("worst.total").alias("worst_total"))


def best_table(df: DataFrame, profile: Profile, dimension: str) -> DataFrame:
    """Net amount per key of ``dimension``: ``key, total``."""
    value = measure(df, profile.money_column)
    return (df.filter(profile.is_active()).select(quoted(dimension).alias("key"), value.alias("v"))
            .filter("key is not null and v is not null").groupBy("key").agg(F.sum("v").alias("total")))


def monthly_sales(df: DataFrame, profile: Profile) -> DataFrame:
    """``month, total`` of active rows; months without sales are absent."""
    month = F.trunc(quoted(profile.primary_date), "month")
    value = measure(df, profile.money_column)
    return (df.filter(profile.is_active()).select(month.alias("month"), value.alias("v"))
            .filter("month is not null and v is not null").groupBy("month").agg(F.sum("v").alias("total")))


def median(df: DataFrame, profile: Profile) -> float | None:
    net = measure(df, profile.money_column)
    return exact_quantiles(df.filter(profile.is_active()), {"m": net}, {"m": [0.5]})["m"][0]


# --- months -----------------------------------------------------------------

@dataclass
class Months:
    sales: list[tuple[dt.date, float]]
    partial: bool

    @property
    def comparable(self) -> list[tuple[dt.date, float]]:
        return self.sales[:-1] if self.partial else self.sales

    @property
    def growth(self) -> float | None:
        """Last full month against the month seen before it, in percent."""
        if len(self.comparable) < 2 or not self.comparable[-2][1]:
            return None
        (_, previous), (_, last) = self.comparable[-2:]
        return (last - previous) / abs(previous) * 100


def month_name(month: dt.date) -> str:
    return f"{month:%Y-%m}"


def _months(df: DataFrame, profile: Profile, last_date: dt.date | None) -> Months:
    # One row per calendar month: a timeline, however many rows there are.
    sales = sorted((r.month, r.total) for r in monthly_sales(df, profile).collect())
    partial = False
    if sales and last_date is not None:
        first = sales[-1][0]
        next_month = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
        partial = last_date < next_month - dt.timedelta(days=1)
    return Months(sales, partial)


# --- the report -------------------------------------------------------------

def role_columns(df: DataFrame, profile: Profile) -> DataFrame:
    """Only the columns that the figures, rollups and insights look at."""
    wanted = {profile.money_column, profile.quantity_column, profile.primary_date, profile.unit_column,
              profile.order_id_column, profile.primary_measure, payment_days_column(profile),
              discount_column(profile), *profile.dimension_candidates()}
    return df.select(*[quoted(c) for c in df.columns if c in wanted])


def calculate_kpis(df: DataFrame, profile: Profile | None = None, store: bool = False) -> KpiResult:
    """All figures the data can support. Scalars and months come to the driver,
    whole tables (``best_*_table``) stay lazy in the context.

    The figures take several passes. Where ``df`` is costly to compute, such as
    a join, ``store`` first writes its role columns to the shared folder.
    """
    result = KpiResult()
    if not isinstance(df, DataFrame) or not df.columns:
        return result
    if profile is None:
        if df.isEmpty():
            return result
        profile = profile_dataset(df)
    if store:
        df = materialize(role_columns(df, profile), "roles")
    t = totals(df, profile).first().asDict()
    rows, excluded = t["total_rows"], t["excluded_rows"]
    if not rows:
        return result
    money_column = profile.money_column
    statuses = fv.LIST_COMMA.join(profile.negative_statuses)
    result.context.update(
        profile=profile, data=df, totals=t, excluded_rows=excluded, negative_statuses=profile.negative_statuses,
        active_rows=df.filter(profile.is_active()))

    def add(key, value, display, template=None, **values):
        label, description = fv.KPI_TEXTS[key]
        text = description if template is None else template
        result.kpis.append(Kpi(key, label.format(**values), float(value), display, text.format(**values)))

    named = {"order": profile.order_id_column, "customer": profile.customer_column,
             "product": profile.product_column, "region": profile.region_column,
             "unit": profile.unit_column if profile.quantity_column else ""}
    dimensions = {k: c for k, c in named.items() if c}
    value = measure(df, money_column) if money_column else F.lit(None).cast("double")
    groups = {}
    if dimensions:
        summary = group_summary(group_totals(df, dimensions, value, profile.is_active()))
        groups = {r["column"]: r for r in summary.collect()}
    result.context["groups"] = groups

    add("total_rows", rows, f"{rows:,}")
    if profile.order_id_column:
        orders = groups["order"]["keys"] if "order" in groups else 0
        add("order_count", orders, f"{orders:,}", column=profile.order_id_column)

    if money_column:
        if t["net_count"]:
            add("total_sales", t["total_sales"], dollars(t["total_sales"]),
                fv.NET_SALES_EXCLUDING if excluded else None, column=money_column, statuses=statuses)
            add("average_order_value", t["average_order_value"], dollars(t["average_order_value"]))
            middle = median(df, profile)
            add("median_sale", middle, dollars(middle))
            add("largest_sale", t["largest_sale"], dollars(t["largest_sale"]))
        if excluded and t["gross_count"]:
            lost = t["cancelled_value"] or 0.0
            add("cancelled_value", lost, dollars(lost), count=excluded)

    if profile.quantity_column and t["quantity_count"]:
        units = groups["unit"]["keys"] if "unit" in groups else (0 if profile.unit_column else 1)
        if units <= 1:
            add("total_quantity", t["total_quantity"], f"{t['total_quantity']:,.0f}",
                column=profile.quantity_column)
        else:
            result.context["quantity_units"] = units

    customers = groups["customer"].named_keys if "customer" in groups else 0
    if customers:
        add("unique_customers", customers, f"{customers:,}")

    if money_column:
        for key, attribute in _SHARE_KEYS:
            found = groups.get(attribute.split("_")[0])
            if not found or not found.sold_keys:
                continue
            share = found.best_total / found.grand_total * 100 if found.grand_total else 0.0
            add(key, found.best_total, found.best_key, money=dollars(found.best_total), share=share)
            result.context[f"{key}_share"] = share
            result.context[f"{key}_table"] = best_table(df, profile, getattr(profile, attribute))

    if profile.has_negative:
        rate = excluded / rows * 100
        add("cancellation_rate", rate, f"{rate:,.1f}٪", statuses=statuses)
    if profile.has_pending and money_column and t["pending_amount"]:
        add("pending_amount", t["pending_amount"], dollars(t["pending_amount"]),
            statuses=fv.LIST_COMMA.join(profile.pending_statuses))

    if profile.primary_date and money_column:
        months = _months(df, profile, t["last_date"])
        result.context.update(months=months, monthly_sales=monthly_sales(df, profile),
                              partial_last_month=months.partial,
                              comparable_monthly_sales=months.comparable)
        if months.growth is not None:
            (previous, _), (last, _) = months.comparable[-2:]
            add("mom_growth", months.growth, f"{months.growth:,.1f}٪", last=month_name(last),
                previous=month_name(previous), note=fv.PARTIAL_MONTH_NOTE if months.partial else "")

    if not money_column and profile.measure_columns and t["measure_count"]:
        name = profile.measure_columns[0]
        add("primary_measure_total", t["measure_total"], f"{t['measure_total']:,.2f}", column=name)
        add("primary_measure_average", t["measure_average"], f"{t['measure_average']:,.2f}", column=name)
    return result
