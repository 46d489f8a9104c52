"""Features and target of a next-year risk model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.metrics import deficit_runway, largest_source, liquid, size_bucket

LAGGED = ("operating_margin", "total_revenue", "total_expenses", "shock_absorption_months")


def _by():
    return Window.partitionBy("ein").orderBy("fiscal_year")


def lags(df: DataFrame, columns=LAGGED) -> DataFrame:
    """Values of the previous filing, whatever its year."""
    return df.withColumns({f"{c}_lagged_1y": F.lag(c).over(_by()) for c in columns})


def growth(df: DataFrame) -> DataFrame:
    rate = lambda c: F.try_divide(F.col(c) - F.col(f"{c}_lagged_1y"), F.col(f"{c}_lagged_1y"))
    return df.withColumns({"revenue_growth_yoy": rate("total_revenue"), "expense_growth_yoy": rate("total_expenses"), "margin_change_yoy": F.col("operating_margin") - F.col("operating_margin_lagged_1y")})


def target(df: DataFrame) -> DataFrame:
    """1 if exactly the next year has under three months of reserves and a negative margin, null if that is unknown."""
    next_is = F.lead("fiscal_year").over(_by()) == F.col("fiscal_year") + 1
    margin, months = (F.when(next_is, F.lead(c).over(_by())) for c in ("operating_margin", "shock_absorption_months"))
    known = margin.isNotNull() & months.isNotNull()
    return df.withColumn("target", F.when(known, ((months < 3) & (margin < 0)).cast("int")))


def history(df: DataFrame, least: int = 5) -> DataFrame:
    """years_of_data of each entity; entities with fewer distinct years go."""
    whole = Window.partitionBy("ein")
    return df.withColumn("years_of_data", F.size(F.collect_set("fiscal_year").over(whole))).where(F.col("years_of_data") >= least)


def slope(df: DataFrame) -> DataFrame:
    m = F.col("operating_margin")
    return df.withColumn("margin_3yr_trend", F.when(F.lag("operating_margin", 1).over(_by()).isNotNull(), (m - F.lag("operating_margin", 2).over(_by())) / 2))


def deficit_streak(df: DataFrame) -> DataFrame:
    """Length of the run of negative margins that ends at the row; an unknown margin ends a run."""
    negative = F.coalesce(F.col("operating_margin") < 0, F.lit(False))
    island = F.sum((~negative).cast("int")).over(_by().rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns({"_neg": negative, "_island": island})
    run = F.sum(F.col("_neg").cast("int")).over(Window.partitionBy("ein", "_island").orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("years_of_consecutive_deficits", F.when(F.col("_neg"), run).otherwise(0)).drop("_neg", "_island")


def concentration(df: DataFrame) -> DataFrame:
    pct = F.when(F.abs("total_revenue") > 1e-6, F.least(F.greatest(largest_source()["amount"] / F.col("total_revenue"), F.lit(0.0)), F.lit(1.5)))
    out = df.withColumn("largest_source_pct", pct)
    return out.withColumn("concentration_yoy_delta", F.col("largest_source_pct") - F.lag("largest_source_pct").over(_by()))


def interactions(df: DataFrame) -> DataFrame:
    """Products and flags; needs concentration() and deficit_streak()."""
    sector, c = F.col("ntee_major_category"), F.col
    funded = F.coalesce(sector.isin("L", "B", "P") & (c("pct_contributions") >= 0.7), F.lit(False)) | F.coalesce((sector == "E") & (c("pct_program_revenue") >= 0.8), F.lit(False))
    out = df.withColumns({"cash_runway_months": deficit_runway(c("total_revenue"), c("total_expenses"), liquid()), "is_government_funded": funded.cast("int")})
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return out.withColumns(
        {
            "concentration_x_thin_runway": c("largest_source_pct") / F.greatest(c("cash_runway_months"), F.lit(1.0)),
            "concentration_x_govt_funded": c("largest_source_pct") * c("is_government_funded"),
            "margin_x_runway": c("operating_margin") * c("cash_runway_months"),
            "negative_margin_years_x_concentration": c("years_of_consecutive_deficits") * c("largest_source_pct"),
            "small_and_thin": flag((c("net_assets_eoy") < 2e6) & (c("cash_runway_months") < 6)),
            "large_and_negative_margin": flag((c("net_assets_eoy") > 2e7) & (c("operating_margin") < -0.1)),
        }
    )


def lookups(df: DataFrame, sector_shocks: DataFrame, state_stress: DataFrame, covid=(2020, 2021, 2022), eras=((2013, "pre-2013"), (2020, "2013-2019"), (2023, "covid-era 2020-2022"))) -> DataFrame:
    """Flags from small tables keyed by (sector, year) and (state, year), and an era."""
    out = df.join(sector_shocks.withColumn("sector_budget_shock", F.lit(1)), ["ntee_major_category", "fiscal_year"], "left")
    out = out.join(state_stress.withColumn("state_fiscal_stress", F.lit(1)), ["state", "fiscal_year"], "left").fillna(0, ["sector_budget_shock", "state_fiscal_stress"])
    era: Column | None = None
    for before, name in eras:
        hit = F.col("fiscal_year") < before
        era = F.when(hit, name) if era is None else era.when(hit, name)
    return out.withColumns({"covid_era": F.col("fiscal_year").isin(*covid).cast("int"), "fiscal_year_bucket": era.otherwise("post-covid 2023+")})


def model_frame(df: DataFrame, least: int = 5) -> DataFrame:
    """All features and the target, for rows with metrics."""
    e = F.col("total_expenses")
    out = df.withColumns({"size_bucket": size_bucket(F.col("total_revenue"), "band", "unknown"), "cash_to_expenses": F.try_divide(liquid(), e), "revenue_to_expenses": F.try_divide(F.col("total_revenue"), e), "net_assets_to_expenses": F.try_divide(F.col("net_assets_eoy"), e)})
    return interactions(concentration(deficit_streak(slope(target(growth(lags(history(out, least))))))))


NUMERIC = (
    "operating_margin", "shock_absorption_months", "revenue_diversification_index", "cash_to_expenses", "revenue_to_expenses", "net_assets_to_expenses", "operating_margin_lagged_1y",
    "shock_absorption_months_lagged_1y", "revenue_growth_yoy", "expense_growth_yoy", "margin_change_yoy", "margin_3yr_trend", "years_of_consecutive_deficits", "largest_source_pct", "cash_runway_months",
)
CATEGORICAL = ("size_bucket", "ntee_major_category", "state")
