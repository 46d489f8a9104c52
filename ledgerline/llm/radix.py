"""Ranks of all rows by a composite key of whole numbers: a least-significant-digit radix sort over the cluster.

Each pass is a stable counting sort by one digit. Rows lie in chunks of consecutive places. A pass counts the rows of each
(digit, chunk); running these counts over the digits, and inside a digit over the chunks, gives the place where the rows of
that digit and chunk go; a row's own place among them is its place before. Only counts are summed across chunks, so no task
holds more than some chunks, whatever the digits are. Each pass is written to the shared folder and the one before it removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.tables import remove, table

DIGIT = 11  # bits
CHUNK = (1 << 10, 1 << 18)  # rows, at least and at most


def unsigned(key: str, low: int, high: int) -> tuple[Column, int]:
    """The key counted from its least value, or where that overflows its bits with the sign turned; and the bits in use."""
    if high - low < 1 << 63:
        return F.col(key) - F.lit(low), (high - low).bit_length()
    return F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 64


def ranked(rows: DataFrame, keys: list[str], out: str, digit: int = DIGIT, chunk: tuple[int, int] = CHUNK) -> tuple[DataFrame, str | None]:
    """rows with `out`: 0, 1, ... in ascending order of the long columns `keys`, the most significant first, nulls after all
    values; rows that are alike in all of them keep some order. Returns the table and its path for remove(). rows should
    be a table; it is read twice."""
    facts = rows.agg(F.count("*").alias("n"), *[x for i, k in enumerate(keys) for x in (F.min(k).alias(f"l{i}"), F.max(k).alias(f"h{i}"), F.count(F.when(F.col(k).isNull(), 1)).alias(f"z{i}"))]).first()
    digits = []
    for i, k in reversed(list(enumerate(keys))):
        if facts[f"l{i}"] is not None:
            value, bits = unsigned(k, facts[f"l{i}"], facts[f"h{i}"])
            digits += [F.shiftrightunsigned(F.coalesce(value, F.lit(0)), at).bitwiseAND(F.lit((1 << digit) - 1)) for at in range(0, bits, digit)]
        if facts[f"z{i}"]:
            digits.append(F.col(k).isNull().cast("long"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(chunk[0], min(chunk[1], facts["n"] // (2 * tasks)))
    names = rows.columns
    now, path = table(rows.withColumn("_place", F.monotonically_increasing_id()), "radix")
    at = F.pmod(F.xxhash64("_place"), F.lit(-(-max(facts["n"], 1) // size)))  # any first order does, if the places are kept
    for value in digits or [F.lit(0).cast("long")]:
        dealt = now.withColumns({"_digit": value.cast("int"), "_chunk": at})
        counts = dealt.groupBy("_digit", "_chunk").agg(F.count("*").alias("_n"))
        whole = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))  # 2^digit rows at most
        base = whole.select("_digit", (F.sum("_all").over(Window.orderBy("_digit")) - F.col("_all")).alias("_base"))
        running = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_chunk")) - F.col("_n")
        first = counts.withColumn("_first", running).join(F.broadcast(base), "_digit").select("_digit", "_chunk", (F.col("_base") + F.col("_first")).alias("_first"))
        own = F.row_number().over(Window.partitionBy("_digit", "_chunk").orderBy("_place")) - 1
        placed = dealt.withColumn("_own", own).join(first, ["_digit", "_chunk"])
        done, old = placed.select(*names, (F.col("_first") + F.col("_own")).cast("long").alias("_place")), path
        now, path = table(done, "radix")
        remove(rows.sparkSession, old)
        at = F.floor(F.col("_place") / size).cast("long")
    return now.withColumnRenamed("_place", out), path
