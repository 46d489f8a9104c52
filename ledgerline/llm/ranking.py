"""Gapless numbers within groups, without sorting a group in one task; joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_group(group: str, values: dict, default) -> Column:
    """A CASE over a bounded number of groups."""
    out = None
    for k, v in values.items():
        hit = F.col(group) == F.lit(k)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def root(n: int) -> int:
    return max(1, round(n**0.5))


def numbered(df: DataFrame, group: str, sizes: dict, spread: Column, order: list, out: str) -> DataFrame:
    """df with out: 0, 1, ... within each group, no number left out.

    sizes: the rows of each group (a bounded number of groups). A group's rows are dealt by `spread` to as many chunks as
    the root of its size, each sorted alone; a chunk's first number is the count of rows in the chunks before it. df is
    read twice, so pass a table, not a long plan."""
    chunk = F.pmod(F.xxhash64(spread), by_group(group, {k: root(n) for k, n in sizes.items()}, 1)).cast("int")
    return in_chunks(df.withColumn("_chunk", chunk), [group], ["_chunk"], order, out)


def in_chunks(df: DataFrame, group: list[str], chunk: list[str], order: list, out: str) -> DataFrame:
    """The same for chunks given as columns, which come in the order of those columns."""
    counts = df.groupBy(*group, *chunk).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, *chunk, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*group, *chunk).orderBy(*order))
    return df.join(before, [*group, *chunk]).withColumn(out, F.col("_before") + rank - 1).drop("_before", *chunk)


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 4096, least: int = 10_000, small: int = 200_000) -> DataFrame:
    """rows joined with groups, which has each key once and in `size` its number of rows. Up to `small` groups are
    broadcast. Beyond it, keys of more than `least` rows and of more than 1 / hot of all rows, so fewer than `hot` ones,
    are; a task gets no more rows of any other. Both are read twice, so pass tables."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= small:
        return rows.join(F.broadcast(groups), key)
    many = F.col(size) > max(least, total // hot)
    if not groups.where(many).take(1):
        return rows.join(groups, key)
    hot_keys = F.broadcast(groups.where(many))
    return rows.join(hot_keys, key).unionByName(rows.join(hot_keys.select(key), key, "left_anti").join(groups.where(~many), key))
