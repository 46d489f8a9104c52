"""Profiles, contract checks and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans import order
from ledgerline.plans.reuse import cut


def nulls(df: DataFrame, columns=None) -> DataFrame:
    """field, nulls, share: one pass over df."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls"), F.round(F.try_divide(F.col(c), F.col("_n")), 6).alias("share")) for c in columns]))
    return one.select(rows)


def history_depth(df: DataFrame, entity: str = "ein") -> DataFrame:
    per = df.groupBy(entity).agg(F.count("*").alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean_rows"), F.percentile("n", 0.5).alias("median_rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.count("*").alias("entities"))


def history_histogram(df: DataFrame, entity: str = "ein") -> DataFrame:
    return df.groupBy(entity).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("entities"))


def coverage(df: DataFrame, states, fields) -> DataFrame:
    return df.where(F.col("state").isin(*states)).groupBy("fiscal_year").agg(F.countDistinct("ein").alias("entities"), *[F.round(F.avg(F.col(f).isNotNull().cast("double")), 6).alias(f"has_{f}") for f in fields])


def coverage_delta(before: DataFrame, after: DataFrame, year: str = "fiscal_year") -> DataFrame:
    n = lambda df, name: df.groupBy(year).agg(F.count("*").alias(name))
    out = n(before, "before").join(n(after, "after"), year, "full_outer").fillna(0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: rows for which the check's condition is true."""
    one = df.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])))


def contract(df: DataFrame, required: list[str], numeric: list[str], together: list[str], ranges: dict[str, tuple], source: DataFrame, keys: list[str]) -> DataFrame:
    """check, violations of an output table: required columns that it lacks, nulls in keys, infinite or undefined numbers, rows
    in which only some of the columns of `together` are null, values outside their ranges, and rows and keys that it has
    more or less than source."""
    x = F.col
    odd = lambda n: (F.abs(n) == float("inf")) | F.isnan(n)
    some = F.size(F.filter(F.array(*[x(n).isNull() for n in together]), lambda y: y))
    checks = {
        "null_key": reduce(lambda a, b: a | b, [x(k).isNull() for k in keys]),
        "not_finite": reduce(lambda a, b: a | b, [F.coalesce(odd(x(n)), F.lit(False)) for n in numeric]),
        "partly_null": (some > 0) & (some < len(together)),
        **{f"range_{n}": ~x(n).between(*r) for n, r in ranges.items()},
    }
    rows = violations(df, checks)
    lacks = df.sparkSession.range(1).select(F.lit("missing_columns").alias("check"), F.lit(sum(n not in df.columns for n in required)).cast("long").alias("violations"))
    have = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, "_n", F.lit(1).alias("_df"))
    want = source.groupBy(*keys).agg(F.count("*").alias("_m")).select(*keys, "_m", F.lit(1).alias("_source"))
    both = have.join(want, keys, "full_outer").agg(
        F.abs(F.coalesce(F.sum("_n"), F.lit(0)) - F.coalesce(F.sum("_m"), F.lit(0))).alias("row_count"), F.count_if(x("_df").isNull()).alias("keys_lost"), F.count_if(x("_source").isNull()).alias("keys_added")
    )
    more = both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), x(n).alias("violations")) for n in ("row_count", "keys_lost", "keys_added")])))
    return rows.unionByName(lacks).unionByName(more)


def distribution(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def quantile_sample(latest: DataFrame, quantiles, states) -> DataFrame:
    """For each state and for rows with and without a sector: the rows at positions int(q n) by revenue; positions that are
    taken move up, or down from the end; what a stratum lacks its sibling gives. The positions follow from the strata's
    sizes alone; rows find their places by order.running."""
    rows = latest.where(F.col("state").isin(*states)).withColumn("has_sector", F.col("ntee_major_category").isNotNull()).select("state", "has_sector", "ein", "total_revenue")
    placed = cut(order.running(rows, ["state", "has_sector"], [F.asc_nulls_first("total_revenue"), "ein"], {"place": F.lit(1)}))
    k = len(quantiles)
    n = F.col("n")
    # at most k - 1 positions are taken before, so a free one is within k of the wanted one or of the end
    taken = F.aggregate(
        F.array(*[F.lit(float(q)) for q in quantiles]),
        F.array().cast("array<int>"),
        lambda got, q: F.concat(got, F.slice(_free(F.least(F.floor(q * n).cast("int"), n.cast("int") - 1), n.cast("int"), got, k), 1, 1)),
    )
    strata = placed.groupBy("state", "has_sector").agg(F.count("*").alias("n")).select("state", "has_sector", F.posexplode(taken).alias("rank", "at"))
    picked = placed.join(F.broadcast(strata), ["state", "has_sector"]).where("place = at + 1").drop("at", "place")  # k rows for each stratum
    picked = cut(picked.select("state", "has_sector", "ein", "total_revenue", "rank"))
    own = picked.select("*", F.col("has_sector").alias("sample_has_sector"), F.lit(0).alias("from_sibling"))
    lent = picked.select("*", (~F.col("has_sector")).alias("sample_has_sector"), F.lit(1).alias("from_sibling"))
    w = Window.partitionBy("state", "sample_has_sector").orderBy("from_sibling", "rank")
    return own.unionByName(lent).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).select("state", "sample_has_sector", "ein", "total_revenue")


def _free(want: Column, n: Column, got: Column, k: int) -> Column:
    """Free positions, the nearest from want upwards first, then downwards from the end."""
    up = F.filter(F.sequence(want, F.least(n - 1, want + k)), lambda p: ~F.array_contains(got, p))
    down = F.filter(F.sequence(n - 1, F.greatest(n - 1 - k, F.lit(0))), lambda p: ~F.array_contains(got, p))
    return F.concat(up, down)
