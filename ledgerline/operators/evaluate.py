"""Evaluation of scored rows: curves, thresholds, tiers, calibration, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans import order
from ledgerline.plans.reuse import cut


def by_score(df: DataFrame, score: str = "proba", target: str = "target") -> DataFrame:
    """score, tp, fp, positives, negatives: counts at or above each distinct score; p, n: at it."""
    n = df.groupBy(F.col(score).alias("score")).agg(F.sum(target).alias("p"), F.sum(1 - F.col(target)).alias("n"))
    curve = cut(order.running(n, [], [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}))
    every = curve.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return curve.crossJoin(F.broadcast(every))  # one row


def areas(curve: DataFrame) -> DataFrame:
    """ROC area by trapezoids and average precision."""
    tp0 = F.col("tp") - F.col("p")
    roc = F.sum(F.col("n") * (F.col("tp") + tp0) / 2.0) / F.max(F.col("positives") * F.col("negatives"))
    ap = F.sum(F.col("p") / F.col("positives") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return curve.agg(F.round(roc, 6).alias("roc_auc"), F.round(ap, 6).alias("pr_auc"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The score whose use as threshold gives the highest F1; of equals the highest score."""
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    return curve.select("score", F.round(f1, 9).alias("f1")).agg(F.max(F.struct("f1", "score")).alias("b")).select(F.col("b.score").alias("threshold"), F.round("b.f1", 6).alias("f1"))


def confusion(df: DataFrame, threshold: float, score: str = "proba", target: str = "target") -> DataFrame:
    hit, yes = F.col(score) >= threshold, F.col(target) == 1
    n = df.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    return n.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6), "f1": F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})


def tiers(df: DataFrame, threshold: float, score: str = "proba") -> DataFrame:
    """High from the larger of threshold and 80th percentile, Medium from the larger of 0.1 and the median; a medium cut at
    or above the high one is halved."""
    cuts = order.percentiles(df, [], score, {"q80": 0.8, "q50": 0.5})
    cuts = cuts.select(F.greatest(F.lit(threshold), "q80").alias("high_cut"), F.greatest(F.lit(0.1), "q50").alias("m"))
    cuts = cuts.select("high_cut", F.when(F.col("m") >= F.col("high_cut"), F.col("high_cut") / 2).otherwise(F.col("m")).alias("medium_cut"))
    one = cuts.first()  # one row
    return df.withColumn("distress_tier", tier(F.col(score), one.high_cut, one.medium_cut))


def tier(p: Column, high: float = 0.6, medium: float = 0.4) -> Column:
    return F.when(p >= high, "High").when(p >= medium, "Medium").otherwise("Low")


def lift(df: DataFrame, target: str = "target") -> DataFrame:
    n = df.groupBy("distress_tier").agg(F.count("*").alias("n"), F.avg(target).alias("rate"))
    base = df.agg(F.avg(target).alias("base"))
    return n.join(F.broadcast(base)).select("distress_tier", "n", F.round("rate", 6).alias("rate"), F.round(F.try_divide("rate", "base"), 6).alias("lift"))


def yearly_lift(df: DataFrame, target: str = "target") -> DataFrame:
    out = df.groupBy("fiscal_year").pivot("distress_tier", ["High", "Low"]).agg(F.avg(target))
    return out.where((F.col("Low") > 0) & F.col("High").isNotNull()).select("fiscal_year", F.round("High", 6).alias("high_rate"), F.round("Low", 6).alias("low_rate"), F.round(F.col("High") / F.col("Low"), 6).alias("lift"))


def calibration(df: DataFrame, score: str = "proba", target: str = "target", bins: int = 10) -> DataFrame:
    """Equal-width bins, empty ones included."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    n = df.groupBy(at.alias("decile")).agg(F.count("*").alias("count"), F.avg(score).alias("p"), F.avg(target).alias("a"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("decile"))
    return axis.join(n, "decile", "left").select("decile", F.coalesce("count", F.lit(0)).alias("count"), F.round("p", 6).alias("mean_predicted"), F.round("a", 6).alias("actual_rate"))


def calibration_by_rank(df: DataFrame, score: str = "proba", target: str = "target", bins: int = 10) -> DataFrame:
    """Equal-frequency bins: a row belongs to the bin of its score's last place among the ordered scores, so that equal
    scores share a bin; bins that hold none are left out."""
    n = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(target).alias("a"))
    placed = cut(order.running(n, [], ["score"], {"to": F.col("n")}))
    total = placed.agg(F.max("to")).first()[0] or 1  # one number
    at = F.least(F.floor((F.col("to") - 1) * bins / total), F.lit(bins - 1)).cast("int")
    by = placed.groupBy(at.alias("bin")).agg(F.sum("n").alias("count"), F.min("score").alias("range_low"), F.max("score").alias("range_high"), F.sum(F.col("score") * F.col("n")).alias("p"), F.sum("a").alias("a"))
    return by.select("bin", F.round("range_low", 6).alias("range_low"), F.round("range_high", 6).alias("range_high"), "count", F.round(F.col("p") / F.col("count"), 6).alias("mean_predicted"), F.round(F.col("a") / F.col("count"), 6).alias("actual_rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.where(F.col("count") > 0).agg(F.round(F.avg(F.abs(F.col("mean_predicted") - F.col("actual_rate"))), 5).alias("mae"))


def agreement(df: DataFrame, one: str, other: str, threshold: float) -> DataFrame:
    a, b = F.col(one) >= threshold, F.col(other) >= threshold
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"), F.round(F.corr(one, other), 6).alias("correlation"))
