"""Packing into batches: optimal length buckets from the global histogram, then batches of a token budget inside each.

The histogram has every length that occurs, each with its number of texts, whatever the size of the input: texts of L different
lengths hold L * L / 2 tokens at least, so L is at most the root of twice the corpus's tokens (100,000 of 5 * 10^9). A caller may
set `exact`: more lengths than that are put into bins of 1/512 of their size at most, each with its own largest length as
bound; the padded total is then at most 1/512 above the least. Dynamic programming over it picks at most `buckets` upper bounds with the least padding in total; every text is
padded to its bucket's bound. A batch of a bucket takes floor(budget / bound) texts; a text over the budget is a batch
of its own. No text is cut or dropped.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.ranking import by_group, numbered
from ledgerline.llm.tables import cut


@dataclass(frozen=True)
class PackConfig:
    buckets: int = 16
    budget: int = 16_384  # tokens of a batch, padding included
    exact: int | None = None  # different lengths that come to the driver; None: all, so that no result turns on their number


def n_tokens(text: str = "text"):
    """Runs of characters other than white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def edge(n):
    """The bin of a length: 512 to 1,023 for each doubling."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int") - 9)
    step = F.expr("1L") * F.pow(F.lit(2.0), shift).cast("long")
    return F.ceil(n / step).cast("long") * step


def histogram(lengths: DataFrame, exact: int | None) -> list[tuple[int, int]]:
    """(length, texts) of n_tokens: every length, or if there are more than a given `exact` the largest of each bin."""
    known = cut(lengths.groupBy("n_tokens").count())
    if exact is not None and known.count() > exact:
        known = known.groupBy(edge(F.col("n_tokens"))).agg(F.max("n_tokens").alias("n_tokens"), F.sum("count").alias("count"))
    got = known.select("n_tokens", "count").orderBy("n_tokens").toArrow()
    return list(zip(got["n_tokens"].to_pylist(), got["count"].to_pylist()))


def bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper bounds, ascending, of at most `buckets` buckets with the least sum of count x bound.

    best[i]: least cost of the bins before i. Adding a bucket up to bin j costs min over i of best[i] - C[i] x + C[j+1] x
    with x the bin's length: a lower envelope of lines, walked once in each layer as both slopes and x are monotone."""
    if not histogram:
        return []
    bins = sorted(histogram)
    x, c = [b for b, _ in bins], [0]
    for _, n in bins:
        c.append(c[-1] + n)
    m = len(x)
    best: list = [0] + [None] * m
    froms: list[array] = []
    for _ in range(min(buckets, m)):
        new, back, hull, at = [None] * (m + 1), array("q", bytes(8 * (m + 1))), [], 0
        for j in range(m):
            if best[j] is not None:
                k, b = -c[j], best[j]
                while len(hull) - at >= 2:
                    (k1, b1, _), (k2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (k1 - k2) <= (b2 - b1) * (k1 - k):
                        hull.pop()
                    else:
                        break
                hull.append((k, b, j))
            while len(hull) - at >= 2 and hull[at + 1][0] * x[j] + hull[at + 1][1] <= hull[at][0] * x[j] + hull[at][1]:
                at += 1
            if len(hull) > at:
                k, b, i = hull[at]
                new[j + 1], back[j + 1] = k * x[j] + b + c[j + 1] * x[j], i
        froms.append(back)
        best = new
    # more buckets never cost more, so the last layer is the best
    out, j = [], m
    for back in reversed(froms):
        out.append(x[j - 1])
        j = back[j]
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (the bound), batch (over all buckets, from 0), place (in the batch): one row
    for each row of docs, repeated and null ids included. Null and empty texts have 0 tokens; a text longer than the budget
    is a batch alone. Rows of one length and id may take each other's places. No rows: no rows; other columns are not
    looked at."""
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # parts the rows that have no id
    lens = cut(docs.select("doc_id", n_tokens().alias("n_tokens"), row.alias("_row")))
    lengths = histogram(lens, cfg.exact)
    tops = bounds(lengths, cfg.buckets)
    sizes, room, first, start = {}, {}, {}, 0
    for b, top in enumerate(tops):
        sizes[b] = sum(n for e, n in lengths if e <= top and (b == 0 or e > tops[b - 1]))
        room[b], first[b] = max(1, cfg.budget // max(top, 1)), start
        start += -(-sizes[b] // room[b])
    bucket = None
    for b, top in enumerate(tops):
        hit = F.col("n_tokens") <= top
        bucket = F.when(hit, F.lit(b)) if bucket is None else bucket.when(hit, F.lit(b))
    lens = lens.withColumn("bucket", F.lit(0) if bucket is None else bucket)
    placed = numbered(lens, "bucket", sizes, F.struct("doc_id", "n_tokens", "_row"), ["doc_id", "n_tokens"], "_slot")
    slots = by_group("bucket", room, 1)
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        by_group("bucket", dict(enumerate(tops)), 0).cast("long").alias("bucket_tokens"),
        (by_group("bucket", first, 0) + F.floor(F.col("_slot") / slots)).cast("long").alias("batch"),
        (F.col("_slot") % slots).cast("int").alias("place"),
    )
