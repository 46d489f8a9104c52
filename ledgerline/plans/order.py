"""Places, running sums and order statistics in one order over a whole table or large groups, without sorting a group in
one task: rows are range-partitioned by group and order, each range is sorted alone, and the ranges before it are added
from a table of their totals, which has a row for each range and group that meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.reuse import cut


def running(df: DataFrame, group: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each expression over the rows of the group up to and with this one. order must be total, or equal
    rows alike."""
    dealt = cut(df.withColumns({f"_own_{k}": v for k, v in sums.items()}).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_part").agg(*[F.sum(f"_own_{k}").alias(f"_own_{k}") for k in sums])
    before = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_own_{k}").over(w), F.lit(0)).alias(f"_before_{k}") for k in sums])
    same = F.col("_part") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    near = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumns({k: F.sum(f"_own_{k}").over(near) for k in sums}).join(before, same)
    return met.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).select(*df.columns, *sums)


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share: the exact percentile with linear interpolation between neighbours, as
    percentile() gives it; nulls do not count. Equal values are counted first, so a frequent one is one row; ranges of
    the values are summed, and only ranges in which a share's place falls are ordered."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = cut(n.repartitionByRange(*group, "_v").withColumn("_part", F.spark_partition_id()))
    spans = dealt.groupBy(*group, "_part").agg(F.sum("_n").alias("_all"))
    every, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_part")
    spans = spans.select(*group, "_part", "_all", (F.sum("_all").over(before) - F.col("_all")).alias("_before"), F.sum("_all").over(every).alias("_total"))
    at = {k: F.lit(q) * (F.col("_total") - 1) for k, q in shares.items()}
    held = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_all"))
    wanted = reduce(lambda x, y: x | y, [held(f(x)) for x in at.values() for f in (F.floor, F.ceil)])
    spans = spans.where(wanted).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_before", "_total")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    near = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(spans, same).withColumn("_to", F.col("_before") + F.sum("_n").over(near))
    within = lambda place: (F.col("_to") > place) & (F.col("_to") - F.col("_n") <= place)
    low = {k: F.max(F.when(within(F.floor(x)), F.col("_v"))) for k, x in at.items()}
    high = {k: F.max(F.when(within(F.ceil(x)), F.col("_v"))) for k, x in at.items()}
    ends = placed.groupBy(*group).agg(F.max("_total").alias("_total"), *[x.alias(f"_lo_{k}") for k, x in low.items()], *[x.alias(f"_hi_{k}") for k, x in high.items()])
    part = {k: x - F.floor(x) for k, x in at.items()}
    lo, hi = (lambda k: F.col(f"_lo_{k}")), (lambda k: F.col(f"_hi_{k}"))
    return ends.select(*group, *[F.when(lo(k) == hi(k), lo(k)).otherwise((1 - part[k]) * lo(k) + part[k] * hi(k)).alias(k) for k in shares])


def percentiles_of(df: DataFrame, group: list[str], values: dict[str, str], shares: dict[str, float]) -> DataFrame:
    """group and {prefix}{share} for each of several value columns (column: prefix), all in the same pass over the ranges."""
    long = df.select(*group, F.inline(F.array(*[F.struct(F.lit(v).alias("_of"), F.col(v).cast("double").alias("_x")) for v in values])))
    found = percentiles(long, [*group, "_of"], "_x", shares)
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_of") == v, F.col(k))).alias(f"{prefix}{k}") for v, prefix in values.items() for k in shares])
