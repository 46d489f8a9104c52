"""An entity x year panel over the order tables: entity = customer, year = order year, revenue streams from return flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.config import SHARES, STREAMS, PanelConfig

#: Seven years of random orders have no persistent leaders, so here two years in the window are enough.
CONFIG = PanelConfig(ladder=(("3-of-3_2-of-7", 3, 2), ("2-of-3_2-of-7", 2, 2)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str) -> F.Column:
    """Money and rates as whole hundredths, so that sums do not depend on the order of the rows, in machine words."""
    return F.round(F.col(column) * 100).cast("long")


#: Whole-number sums over lines: the unit is 1 / 10^4, of expenses 1 / 10^6, of prices 1 / 100.
SUMS = ("net", "spent", "price", "rebate", "flag_a", "flag_r", "flag_nf", "flag_no")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, o_orderdate and the sums over the order's lines; lines are summed before they meet anything.
    What is dealt by order is five small numbers of each line; the lines of an order seldom lie together."""
    sort = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", 3).when(F.col("l_linestatus") == "O", 4))
    each = {"price": _cents("l_extendedprice"), "discount": _cents("l_discount"), "tax": _cents("l_tax"), "sort": sort}
    dealt = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *[x.alias(n) for n, x in each.items()]).repartition("o_orderkey")
    price, discount, net = F.col("price"), F.col("discount"), F.col("price") * (100 - F.col("discount"))
    of = lambda n: F.when(F.col("sort") == n, net)
    parts = (net, net * (70 + 8 * F.col("tax")), price, price * discount, *map(of, (1, 2, 3, 4)))
    lines = dealt.groupBy("o_orderkey").agg(*[F.sum(x).alias(n) for n, x in zip(SUMS, parts)])
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")


def _with_amounts(spark: SparkSession, sf_dir: str, sums: DataFrame) -> DataFrame:
    """sums by o_custkey and more, with the customer and the amounts of the panel."""
    t = lambda n: table(spark, sf_dir, n)
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = lambda n, unit=1e4: F.col(n) / F.lit(unit)
    return sums.join(who, F.col("o_custkey") == F.col("c_custkey")).withColumns(
        {
            "total_revenue": d("net"),
            "total_expenses": d("spent", 1e6),
            "net_assets_eoy": F.col("price") * _cents("c_acctbal") / F.lit(1e4) / 5000,
            "cash_non_interest_bearing": F.when(F.col("c_custkey") % 13 != 0, d("rebate")),
            "savings_temporary_investments": F.greatest("c_acctbal", F.lit(0.0)) * 40,
            "contributions_grants": d("flag_a"),
            "program_service_revenue": d("flag_r"),
            "investment_income": d("flag_nf"),
            "other_revenue": d("flag_no"),
        }
    )


def _identified(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "ein": F.col("c_custkey").cast("string"),
            "org_name": F.col("c_name"),
            "state": F.upper(F.substring("r_name", 1, 2)),
            "ntee_major_category": F.when(F.col("c_custkey") % 17 != 0, F.substring("c_mktsegment", 1, 1)),
            "return_type": F.lit("990"),
        }
    )
    return df.withColumns({p: F.try_divide(s, F.col("total_revenue")) for p, s in zip(SHARES, map(F.col, STREAMS))})


KEYS = ["ein", "org_name", "state", "ntee_major_category", "return_type", "fiscal_year", "tax_period_end"]
MONEY = ["total_revenue", "total_expenses", "net_assets_eoy", "cash_non_interest_bearing", "savings_temporary_investments", *STREAMS]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer and order year: lines are summed by order, orders by customer and year, and only these meet
    the customers. Orders are dealt by customer, which serves the sums by year as well as the meeting."""
    by_year = _orders(spark, sf_dir).repartition("o_custkey").groupBy("o_custkey", F.year("o_orderdate").alias("fiscal_year")).agg(F.to_date(F.max("o_orderdate")).alias("tax_period_end"), *[F.sum(x).alias(x) for x in SUMS])
    return _identified(_with_amounts(spark, sf_dir, by_year)).select(*KEYS, *MONEY, *SHARES)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order; several filings of an entity may fall into a year."""
    rows = _orders(spark, sf_dir).withColumns({"fiscal_year": F.year("o_orderdate"), "tax_period_end": F.to_date("o_orderdate")})
    return _identified(_with_amounts(spark, sf_dir, rows)).select(F.col("o_orderkey").alias("filing_id"), *KEYS, *MONEY, *SHARES)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir)
    return f.where((F.col("filing_id") % 5 != 0) | (F.col("filing_id") % 10 == 0)).withColumn("submitted_on", F.lit(None).cast("string"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of a second source: later, with some revenues changed and cash not reported."""
    f = filings(spark, sf_dir).where(F.col("filing_id") % 5 == 0)
    changed = F.when(F.col("filing_id") % 20 == 0, F.round(F.col("total_revenue") * 1.01, 2)).otherwise(F.col("total_revenue"))
    return f.withColumns({"total_revenue": changed, "cash_non_interest_bearing": F.lit(None).cast("double"), "submitted_on": F.lit("2002-01-01")})
