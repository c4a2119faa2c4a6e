"""Short sentences for management, from the key figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions.numbers import dollars
from tablescope.operators.kpis import KpiResult, Months, calculate_kpis, group_summary, group_totals, month_name
from tablescope.operators.profiling import measure, profile_dataset
from tablescope.plans.profile import Profile

INSIGHT_SCHEMA = "position int, rule_id string, level string, text string, evidence string"


@dataclass
class Insight:
    rule_id: str
    text: str
    level: str = "info"  # info | positive | warning
    evidence: str = ""


def insights_frame(spark: SparkSession, insights: list[Insight]) -> DataFrame:
    rows = [(i, s.rule_id, s.level, s.text, s.evidence) for i, s in enumerate(insights, 1)]
    return spark.createDataFrame(rows, INSIGHT_SCHEMA)


def _say(key: str, **values) -> str:
    return fv.INSIGHT_TEXTS[key].format(**values)


def _month_insights(months: Months | None):
    if months is None or len(months.comparable) < 2:
        return
    sales = months.comparable
    (_, previous), (last_month, last) = sales[-2:]
    if months.growth is not None:
        up = months.growth >= 0
        yield Insight(
            "last_month",
            _say("month_change", month=month_name(last_month), change=abs(months.growth),
                 direction=_say("month_up" if up else "month_down"),
                 note=_say("month_note") if months.partial else ""),
            "positive" if up else "warning",
            _say("month_evidence", previous=dollars(previous), last=dollars(last)))
    best = max(sales, key=lambda s: s[1])  # the first of equals
    worst = min(sales, key=lambda s: s[1])
    yield Insight("month_range", _say(
        "month_range", best=month_name(best[0]), best_value=dollars(best[1]),
        worst=month_name(worst[0]), worst_value=dollars(worst[1])))


def _concentration(result: KpiResult):
    for key, label in (("best_customer", "share_customer"), ("best_product", "share_product")):
        kpi, share = result.get(key), result.context.get(f"{key}_share")
        if kpi is None or share is None:
            continue
        risky = share >= fv.CONCENTRATION_SHARE
        text = _say("share", label=_say(label), name=kpi.display, money=dollars(kpi.value), share=share)
        yield Insight(f"share_{key}", text + (_say("share_risk") if risky else ""),
                      "warning" if risky else "info")


def _regions(result: KpiResult, profile: Profile):
    """Best and worst region of the active rows, of all rows if there are no active ones."""
    t = result.context["totals"]
    if not profile.region_column or t["excluded_rows"] < t["total_rows"]:
        return result.context["groups"].get("region")
    df = result.context["data"]
    value = measure(df, profile.money_column)
    found = group_summary(group_totals(df, {"region": profile.region_column}, value, F.lit(True))).collect()
    return found[0] if found else None


def _risks(result: KpiResult, profile: Profile):
    t = result.context["totals"]
    cancelled, lost = result.get("cancellation_rate"), result.get("cancelled_value")
    if cancelled:
        yield Insight("cancellation", _say("cancellation", rate=cancelled.display),
                      "warning" if cancelled.value >= fv.CANCELLATION_RATE else "info",
                      lost.display if lost else "")
    pending = result.get("pending_amount")
    if pending:
        text = _say("pending", money=pending.display)
        if t.get("payment_days") is not None:
            text += _say("pending_days", days=t["payment_days"])
        yield Insight("pending", text, "warning")
    if not profile.money_column:
        return
    discount = t.get("average_discount")
    if discount is not None and discount > 0:
        text = _say("discount", mean=discount)
        if t["high_discounts"]:
            text += _say("discount_high", limit=fv.HIGH_DISCOUNT, count=t["high_discounts"])
        yield Insight("discount", text, "warning" if discount >= fv.HIGH_DISCOUNT / 2 else "info")
    mean, largest = t["gross_average"], t["gross_largest"]
    if mean is not None and mean > 0 and largest / mean >= fv.GIANT_ORDER_RATIO:
        yield Insight("giant", _say("giant", largest=dollars(largest), times=largest / mean), "warning")
    if t["negative_count"]:
        yield Insight("negative", _say("negative", count=t["negative_count"]), "warning")
    regions = _regions(result, profile)
    if regions and regions.sold_keys >= 2:
        yield Insight("regions", _say(
            "regions", best=regions.best_key, best_value=dollars(regions.best_total),
            worst=regions.worst_key, worst_value=dollars(regions.worst_total)))


def generate_insights(df: DataFrame, kpi_result: KpiResult | None = None,
                      profile: Profile | None = None) -> list[Insight]:
    """Sentences the data supports; they reuse the figures already computed."""
    if kpi_result is None:
        if not isinstance(df, DataFrame) or not df.columns:
            return []
        if profile is None:
            if df.isEmpty():
                return []
            profile = profile_dataset(df)
        kpi_result = calculate_kpis(df, profile)
    if not kpi_result.kpis:
        return []
    out: list[Insight] = []
    sales, orders = kpi_result.get("total_sales"), kpi_result.get("order_count")
    if sales:
        suffix = _say("net_sales_orders", orders=orders.display) if orders else ""
        out.append(Insight("net_sales", _say("net_sales", total=sales.display, orders=suffix)))
    out.extend(_month_insights(kpi_result.context.get("months")))
    out.extend(_concentration(kpi_result))
    out.extend(_risks(kpi_result, profile or kpi_result.context["profile"]))
    out.append(Insight("basis", _say("basis", rows=kpi_result.context["totals"]["total_rows"])))
    return out
