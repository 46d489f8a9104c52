"""Row metrics of a financial panel as column expressions. Division by zero and null inputs give null."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.config import DEFAULT, SHARES, SIZE_BANDS, STREAM_NAMES, STREAMS

c = F.col


def zero(name: str) -> Column:
    return F.coalesce(c(name), F.lit(0.0))


def liquid() -> Column:
    return zero("cash_non_interest_bearing") + zero("savings_temporary_investments")


def size_bucket(amount: Column, nonpositive: str | None = "null", missing: str | None = None, bands=SIZE_BANDS) -> Column:
    """Band of an amount. nonpositive: 'null' leaves amounts <= 0 without a band, 'band' puts them into the lowest."""
    out = F.when(amount.isNull(), F.lit(missing))
    if nonpositive == "null":
        out = out.when(amount <= 0, F.lit(None))
    for label, low, high in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (amount >= low)
        if high is not None:
            inside = inside & (amount < high)
        out = out.when(inside, F.lit(label))
    return out


def operating_margin() -> Column:
    return F.try_divide(c("total_revenue") - c("total_expenses"), c("total_revenue"))


def runway_months() -> Column:
    return F.try_divide(c("net_assets_eoy"), c("total_expenses") / 12)


def diversification() -> Column:
    any_share = F.coalesce(*SHARES).isNotNull()
    return F.when(any_share, 1 - reduce(add, [zero(p) * zero(p) for p in SHARES]))


def diversification_renormalised() -> Column:
    present = F.filter(F.array(*SHARES), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    scaled = 1 - F.aggregate(present, F.lit(0.0), lambda a, x: a + F.try_divide(x, total) * F.try_divide(x, total))
    return F.when(F.size(present) == 0, F.lit(None)).when(total == 0, F.lit(0.0)).otherwise(scaled)


def shock_months() -> Column:
    return F.try_divide(liquid(), c("total_expenses") / 12)


def deficit_runway(revenue: Column, expenses: Column, cash: Column, cap: float = 120.0) -> Column:
    deficit = expenses - F.coalesce(revenue, F.lit(0.0))
    return F.when(expenses.isNull() | (expenses <= 0) | (deficit <= 0), F.lit(cap)).otherwise(F.least(F.lit(cap), cash / (deficit / 12)))


def largest_source() -> Column:
    """struct(amount, name): the largest stream, the earlier one on ties; null streams count as 0."""
    ranked = F.array_max(F.array(*[F.struct(zero(s).alias("amount"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (s, n) in enumerate(zip(STREAMS, STREAM_NAMES))]))
    return F.struct(ranked["amount"].alias("amount"), ranked["name"].alias("name"))


def with_metrics(df):
    return df.withColumns(
        {
            "size_bucket": size_bucket(c("total_revenue")),
            "operating_margin": operating_margin(),
            "operating_runway_proxy_months": runway_months(),
            "revenue_diversification_index": diversification(),
            "shock_absorption_months": shock_months(),
        }
    )


def with_eligibility(df, cfg=DEFAULT):
    ok = (c("total_revenue") > 0) & c("total_expenses").isNotNull() & c("net_assets_eoy").isNotNull() & c("size_bucket").isNotNull()
    return df.withColumns({"scoring_eligible": F.coalesce(ok, F.lit(False)), "is_scoring_year": c(cfg.year).isin(*cfg.scoring_years)})
