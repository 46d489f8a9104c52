"""Keyed deduplication, upserts and reconciliation of filings."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import DEFAULT, PanelConfig


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a declared order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_filing(df: DataFrame, cfg: PanelConfig = DEFAULT, *ties: Column) -> DataFrame:
    """One filing for each entity and year: the latest period, unknown periods last, then ties."""
    return first_of(df, [cfg.entity, cfg.year], F.desc_nulls_last(cfg.period), *ties)


def fewest_nulls(fields) -> Column:
    return reduce(add, [F.col(f).isNull().cast("int") for f in fields])


def latest_row(df: DataFrame, cfg: PanelConfig = DEFAULT, *ties: Column) -> DataFrame:
    return first_of(df, [cfg.entity], F.desc_nulls_last(cfg.year), F.desc_nulls_last(cfg.period), *ties)


def upsert(spine: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """feed replaces spine on the keys; all other rows of both stay. Key columns alone are shuffled for the comparison."""
    return spine.join(feed.select(*keys).distinct(), keys, "left_anti").unionByName(feed, allowMissingColumns=True)


def merge_by_source(current: DataFrame, batch: DataFrame, keys: list[str], from_feed: Column) -> DataFrame:
    """current's own rows stay; its rows from earlier feeds give way to the batch; the batch's new keys are added."""
    own = current.where(~from_feed)
    old = current.where(from_feed).join(batch.select(*keys).distinct(), keys, "left_anti")
    return own.unionByName(old).unionByName(batch.join(own.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def backfill(df: DataFrame, lookup: DataFrame, keys: list[str], columns: list[str], where: Column, *last: Column) -> DataFrame:
    """columns from lookup where the condition holds and the key is found; of several rows of a key the first by `last`."""
    one = first_of(lookup, keys, *last).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_found"))
    out = df.join(one, keys, "left")
    use = where & F.coalesce("_found", F.lit(False))
    return out.withColumns({c: F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop("_found", *[f"_new_{c}" for c in columns])


def overlap(spine: DataFrame, feed: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys in both, in one only, and the share of common keys whose compared columns differ."""
    side = lambda df, n: df.groupBy(*keys).agg(F.lit(1).alias(n), *[F.max(c).alias(f"{n}_{c}") for c in compared])
    both = side(spine, "s").join(side(feed, "f"), keys, "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col(f"s_{c}").eqNullSafe(F.col(f"f_{c}")) for c in compared])
    common = F.col("s").isNotNull() & F.col("f").isNotNull()
    return both.agg(
        F.count_if(common).alias("overlap_keys"), F.count_if(F.col("s").isNull()).alias("new_keys"), F.count_if(F.col("f").isNull()).alias("spine_only_keys"), F.count_if(common & differs).alias("changed_keys")
    ).withColumn("changed_rate", F.round(F.try_divide("changed_keys", "overlap_keys"), 6))


def _compared(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    pairs = left.select(*keys, *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select(*keys, *[F.col(f).alias(f"r_{f}") for f in fields]), keys)
    long = pairs.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("l"), F.col(f"r_{f}").alias("r")) for f in fields])))
    return long.where("l IS NOT NULL AND r IS NOT NULL")


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], first: int = 5) -> DataFrame:
    """The first mismatches of each field, by key: keys, field, l, r, place."""
    w = Window.partitionBy("field").orderBy(*keys)
    return _compared(left, right, keys, fields).where("l != r").withColumn("place", F.row_number().over(w)).where(F.col("place") <= first)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], least: float = 0.99) -> DataFrame:
    """Per field: keys compared where both report, exact matches, rate, and whether the rate passes."""
    out = _compared(left, right, keys, fields).groupBy("field").agg(F.count("*").alias("compared"), F.count_if(F.col("l") == F.col("r")).alias("matched"))
    rate = F.col("matched") / F.col("compared")
    return out.withColumns({"rate": F.round(rate, 6), "passed": rate >= least})


def enrich(df: DataFrame, registry: DataFrame, key: str, code: str, names: DataFrame) -> DataFrame:
    """Sector letter (upper case) of an entity from a registry and its name from a small table."""
    one = registry.select(key, F.upper(F.left(F.trim(code), F.lit(1))).alias("sector")).where("sector <> ''").groupBy(key).agg(F.min("sector").alias("sector"))
    return df.join(one, key, "left").join(names, "sector", "left")


def match_rate(enriched: DataFrame, key: str, found: str = "sector") -> DataFrame:
    """entities, matched, rate: of the distinct entities, those that the registry knew in any row."""
    each = enriched.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(found).isNotNull().cast("int")).alias("m"))
    n = each.agg(F.count("*").alias("entities"), F.coalesce(F.sum("m"), F.lit(0)).alias("matched"))
    return n.withColumn("rate", F.round(F.try_divide("matched", "entities"), 6))


def hydrate(scored: DataFrame, panel: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of the panel for each scored key, exactly one row each; a key that the panel has twice is an error."""
    one = panel.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    single = one.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("the panel has a key twice"))).otherwise(F.lit(True)))
    return scored.drop(*[c for c in columns if c in scored.columns]).join(single.where("_ok").drop("_n", "_ok"), keys, "left")
