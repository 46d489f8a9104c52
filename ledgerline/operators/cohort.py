"""Peer cohorts: sizes at each level, fallback, benchmarks over a rolling window, resilient peers, gaps, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import BENCHMARKS, DEFAULT, GAPS, METRICS, PanelConfig
from ledgerline.plans import order
from ledgerline.plans.reuse import cut


def key_of(columns) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("unclassified"))) for c in columns])


def sizes(eligible: DataFrame, cfg: PanelConfig = DEFAULT) -> list[DataFrame]:
    """For each level its distinct entities by key; rows with a null in the key are no cohort."""
    return [
        eligible.dropna(subset=list(cols)).groupBy(*cols).agg(F.countDistinct(cfg.entity).alias(f"n{i}"))
        for i, (_, cols) in enumerate(cfg.levels)
    ]


def assign(eligible: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """cohort_level, cohort_key, cohort_size of each row: the first level with enough entities, else the broadest."""
    out = eligible
    for (_, cols), n in zip(cfg.levels, sizes(eligible, cfg)):
        out = out.join(n, list(cols), "left")
    level = key = size = None
    for i, (name, cols) in enumerate(cfg.levels):
        hit = F.col(f"n{i}") >= cfg.min_cohort
        values = (F.lit(name), key_of(cols), F.coalesce(F.col(f"n{i}"), F.lit(0)))
        level, key, size = (F.when(hit, v) if x is None else x.when(hit, v) for x, v in zip((level, key, size), values))
    name, cols = cfg.levels[-1]
    last = F.coalesce(F.col(f"n{len(cfg.levels) - 1}"), F.lit(0))
    out = out.withColumns({"cohort_level": level.otherwise(F.lit(name)), "cohort_key": key.otherwise(key_of(cols)), "cohort_size": size.otherwise(last)})
    return out.drop(*[f"n{i}" for i in range(len(cfg.levels))])


def targets(scored: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    return scored.select("cohort_key", F.col(cfg.year).alias("target_year")).distinct()


def windowed(by_year: DataFrame, wanted: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Rows keyed by cohort and year, once for each target whose window holds the year: an equi-join on exploded years."""
    reach = wanted.select("cohort_key", "target_year", F.explode(F.sequence(F.col("target_year") - (cfg.window - 1), F.col("target_year"))).alias(cfg.year))
    return by_year.join(reach, ["cohort_key", cfg.year])


def yearly_quartiles(rows: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """The upper quartile of each metric by cohort and year, written once: flags and benchmarks read the same. All metrics and
    cohorts go in one pass over ranges of values, so the size of a cohort does not matter."""
    return cut(order.percentiles_of(rows, ["cohort_key", cfg.year], {m: f"{m}_" for m in METRICS}, {"q": 0.75}).select("cohort_key", cfg.year, *[F.col(f"{m}_q").alias(f"q_{m}") for m in METRICS]))


def benchmarks(quartiles: DataFrame, wanted: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Median over the window's years of each year's upper quartile (yearly_quartiles): at most `window` values."""
    w = windowed(quartiles, wanted, cfg)
    return w.groupBy("cohort_key", "target_year").agg(*[F.median(f"q_{m}").alias(b) for m, b in zip(METRICS, BENCHMARKS)])


def flags(rows: DataFrame, quartiles: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Whether each metric reaches its cohort-year's upper quartile, null if either is unknown."""
    return rows.join(quartiles, ["cohort_key", cfg.year]).withColumns({f"top_{m}": F.col(m) >= F.col(f"q_{m}") for m in METRICS})


def resilient(rows: DataFrame, quartiles: DataFrame, wanted: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """step, rule, peers by cohort and target year: the first rule that enough entities meet, else the last."""
    tops = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"top_{m}").cast("int"), F.lit(0)) for m in METRICS])
    met = flags(rows, quartiles, cfg).select("cohort_key", cfg.year, cfg.entity, *[(tops >= n).cast("int").alias(f"m{i}") for i, (_, n, _) in enumerate(cfg.ladder)])
    k = range(len(cfg.ladder))
    per_entity = windowed(met, wanted, cfg).groupBy("cohort_key", "target_year", cfg.entity).agg(*[F.sum(f"m{i}").alias(f"y{i}") for i in k])
    counts = per_entity.groupBy("cohort_key", "target_year").agg(*[F.count_if(F.col(f"y{i}") >= cfg.ladder[i][2]).alias(f"p{i}") for i in k])
    pick = None
    for i, (label, _, _) in enumerate(cfg.ladder):
        v = F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("rule"), F.col(f"p{i}").alias("peers"))
        if i == len(cfg.ladder) - 1:
            pick = v if pick is None else pick.otherwise(v)
        else:
            hit = F.col(f"p{i}") >= cfg.min_references
            pick = F.when(hit, v) if pick is None else pick.when(hit, v)
    return counts.select("cohort_key", "target_year", pick.alias("p")).select("cohort_key", "target_year", "p.*")


def broader(rows: DataFrame, cfg: PanelConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(cohort_key, broader_key) and all eligible rows under the broader keys: rows of all cohorts that match them."""
    names = [n for n, _ in cfg.levels]
    up = None
    for i, name in enumerate(names[:-1]):
        v = key_of(cfg.levels[i + 1][1])
        up = F.when(F.col("cohort_level") == name, v) if up is None else up.when(F.col("cohort_level") == name, v)
    links = rows.select("cohort_key", up.alias("broader_key")).where("broader_key IS NOT NULL").distinct()
    every = F.array_distinct(F.array(*[key_of(cols) for _, cols in cfg.levels[1:]]))
    wide = rows.drop("cohort_key").withColumn("cohort_key", F.explode(every))
    return links, wide


def build(assigned: DataFrame, cfg: PanelConfig = DEFAULT, broaden: bool = True) -> DataFrame:
    """By cohort and target year: benchmarks, step, rule, peers, benchmark_status. With broaden, cohorts without enough
    peers are tried again one level up and take that level's benchmarks if it has enough."""
    wanted = cut(targets(assigned.where("is_scoring_year"), cfg))
    quartiles = yearly_quartiles(assigned, cfg)
    own = cut(resilient(assigned, quartiles, wanted, cfg).join(benchmarks(quartiles, wanted, cfg), ["cohort_key", "target_year"]))
    if broaden:
        links, wide = broader(assigned, cfg)
        poor = cut(own.where(F.col("peers") < cfg.min_references).select("cohort_key", "target_year").join(links, "cohort_key"))
        again = poor.select(F.col("broader_key").alias("cohort_key"), "target_year").distinct()
        wide = cut(wide.join(again.select("cohort_key").distinct(), "cohort_key", "left_semi").select("cohort_key", cfg.year, cfg.entity, *METRICS))
        quartiles = yearly_quartiles(wide, cfg)
        new = resilient(wide, quartiles, again, cfg).join(benchmarks(quartiles, again, cfg), ["cohort_key", "target_year"])
        new = new.select(F.col("cohort_key").alias("broader_key"), "target_year", *[F.col(c).alias(f"b_{c}") for c in ("rule", "peers", *BENCHMARKS)])
        tried = poor.join(new, ["broader_key", "target_year"]).drop("broader_key")
        own = own.join(tried, ["cohort_key", "target_year"], "left")
        better = F.coalesce(F.col("b_peers") >= cfg.min_references, F.lit(False))
        swap = {c: F.when(better, F.col(f"b_{c}")).otherwise(F.col(c)) for c in ("rule", "peers", *BENCHMARKS)}
        own = own.withColumns(swap | {"step": F.when(F.col("b_peers").isNotNull(), F.lit(3)).otherwise(F.col("step"))}).drop(*[f"b_{c}" for c in ("rule", "peers", *BENCHMARKS)])
    return own.withColumn("benchmark_status", F.when(F.col("peers") >= cfg.min_references, "ok").otherwise("insufficient_resilient_refs"))


def gaps(scored: DataFrame, bench: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    out = scored.join(bench.withColumnRenamed("target_year", cfg.year), ["cohort_key", cfg.year], "left")
    return out.withColumns({g: F.col(m) - F.col(b) for g, m, b in zip(GAPS, METRICS, BENCHMARKS)})


def moments(rows: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """For each cohort and year a struct of each metric: n, mean, m2 (the sum of squared deviations from the mean), least and
    most. Two of these merge into that of both without the rows."""
    each = lambda m: F.struct(F.count(m).alias("n"), F.coalesce(F.avg(m), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(m) * F.count(m), F.lit(0.0)).alias("m2"), F.min(m).alias("least"), F.max(m).alias("most"))
    return rows.groupBy("cohort_key", cfg.year).agg(*[each(m).alias(f"s_{m}") for m in METRICS])


def merged(a: Column, b: Column) -> Column:
    """The moments of two sets of rows together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = F.when(n == 0, F.lit(0.0)).otherwise(b["n"] / F.nullif(n, F.lit(0)))
    both = a["m2"] + b["m2"] + apart * apart * a["n"] * share
    return F.struct(n.alias("n"), F.when(a["n"] == 0, b["mean"]).otherwise(a["mean"] + apart * share).alias("mean"), F.when(a["n"] == 0, b["m2"]).otherwise(both).alias("m2"), F.least(a["least"], b["least"]).alias("least"), F.greatest(a["most"], b["most"]).alias("most"))


def window_moments(rows: DataFrame, wanted: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """The same by cohort and target year over the window: every row is read once, by its own year; what the windows copy and
    merge, in the order of the years, is a struct for each cohort and year."""
    years = windowed(moments(rows, cfg), wanted, cfg).groupBy("cohort_key", "target_year").agg(F.sort_array(F.collect_list(F.struct(cfg.year, *[f"s_{m}" for m in METRICS]))).alias("_years"))
    zero = F.expr("named_struct('n', 0L, 'mean', 0.0D, 'm2', 0.0D, 'least', CAST(NULL AS DOUBLE), 'most', CAST(NULL AS DOUBLE))")
    fold = lambda m: F.aggregate(F.transform("_years", lambda y: y[f"s_{m}"]), zero, merged)
    return years.select("cohort_key", "target_year", *[fold(m).alias(f"s_{m}") for m in METRICS])


def z_scores(scored: DataFrame, assigned: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """z of each metric in its cohort's window and resilience_gap, minus their mean. The benchmark cancels out of z. A
    window with fewer than two values or no spread gives 0."""
    stats = window_moments(assigned.select("cohort_key", cfg.year, *METRICS), targets(scored, cfg), cfg)
    out = scored.join(stats.withColumnRenamed("target_year", cfg.year), ["cohort_key", cfg.year], "left")

    def z(m):
        s = F.col(f"s_{m}")
        deviation = F.sqrt(s["m2"] / F.nullif(s["n"], F.lit(0)))
        flat = (s["n"] < 2) | (s["least"] == s["most"]) | (deviation == 0)
        return F.when(flat, F.lit(0.0)).otherwise((F.col(m) - s["mean"]) / deviation)

    out = out.withColumns({f"z_{m}": z(m) for m in METRICS})
    known = F.filter(F.array(*[f"z_{m}" for m in METRICS]), lambda z: z.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, z: a + z) / F.nullif(F.size(known), F.lit(0))
    return out.withColumn("resilience_gap", -mean).drop(*[f"s_{m}" for m in METRICS])


TIERS = ("Low", "Medium", "High")


def confidence(panel: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """For each entity and year: years and share of nulls over its window, data_confidence_tier and its clauses."""
    w = Window.partitionBy(cfg.entity).orderBy(cfg.year).rangeBetween(-(cfg.window - 1), 0)
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cfg.quality_fields])
    out = panel.withColumns({"window_years": F.size(F.collect_set(cfg.year).over(w)), "null_rate": F.sum(missing).over(w) / (F.count("*").over(w) * len(cfg.quality_fields))})
    y, r = F.col("window_years"), F.col("null_rate")
    tier = F.when((y >= 6) & (r < 0.2), "High").when((y <= 3) | (r > 0.2), "Low").otherwise("Medium")
    years, rate = F.concat(y.cast("string"), F.lit(" years in window")), F.concat(F.lit("null rate "), F.round(r * 100).cast("int").cast("string"), F.lit("%"))
    clause = F.when((y >= 6) & (r < 0.2), F.lit(None)).when(y <= 3, years).when(r > 0.2, rate).when(y <= 5, years).otherwise(rate)
    return out.withColumns({"data_confidence_tier": tier, "data_reason": clause})


def overall_confidence(scored: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    rank = lambda c: F.array_position(F.array(*map(F.lit, TIERS)), F.col(c))
    names = [n for n, _ in cfg.levels]
    cohort = F.when(F.col("cohort_level") == names[0], "High").when(F.col("cohort_level") == names[1], "Medium").otherwise("Low")
    out = scored.withColumn("cohort_confidence_tier", cohort)
    least = F.element_at(F.array(*map(F.lit, TIERS)), F.least(rank("data_confidence_tier"), rank("cohort_confidence_tier")).cast("int"))
    fallback = F.when(F.col("cohort_level") != names[0], F.concat(F.lit("fallback cohort: "), "cohort_level"))
    reason = F.nullif(F.concat_ws("; ", "data_reason", fallback), F.lit(""))
    return out.withColumns({"checkpoint1_confidence_tier": least, "confidence_reason": F.coalesce(reason, F.lit("primary data quality; primary cohort"))})
