"""Portfolio views: histories, shortlists, summaries, searches and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.metrics import liquid
from ledgerline.plans import order

c = F.col
#: Points of labels, tiers and urgency in the priority score, and places for each label in the shortlist.
LABEL_POINTS = {"Needs Data Diligence": 4, "Weak Financial Foundation": 3, "Revenue Concentration Risk": 2, "Underinvested Asset Base": 1}
TIER_POINTS = {"High": 3, "Medium": 2, "Low": 1}
URGENCY_POINTS = {"acute": 3, "flagged": 2, "none": 1}
PLACES = {"Needs Data Diligence": 30, "Weak Financial Foundation": 36, "Revenue Concentration Risk": 30, "Underinvested Asset Base": 24}


def points(column: str, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c(column) == k, F.lit(v)) if out is None else out.when(c(column) == k, F.lit(v))
    return out.otherwise(F.lit(0))


def history(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ein").agg(F.countDistinct("fiscal_year").alias("filing_years_observed"), F.min("fiscal_year").alias("first_filing_year"), F.max("fiscal_year").alias("latest_filing_year"))


def income_streak(panel: DataFrame) -> DataFrame:
    """Years in a row back from the latest with investment income; a missing year or no income ends it."""
    w = Window.partitionBy("ein").orderBy(F.desc("fiscal_year"))
    good = F.coalesce(c("investment_income") > 0, F.lit(False)) & (c("fiscal_year") + F.row_number().over(w) - 1 == F.max("fiscal_year").over(Window.partitionBy("ein")))
    broken = F.sum((~c("_good")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = panel.select("ein", "fiscal_year", good.alias("_good")).withColumn("_broken", broken)
    return marked.groupBy("ein").agg(F.max("fiscal_year").alias("fiscal_year"), F.count_if(c("_broken") == 0).alias("streak"))


def financial_history(panel: DataFrame) -> DataFrame:
    z = lambda n: F.round(F.coalesce(n, F.lit(0.0)), 2)
    point = F.struct(c("fiscal_year").alias("fiscalYear"), z("total_revenue").alias("revenue"), z("total_expenses").alias("expenses"), z("net_assets_eoy").alias("netAssets"), F.round(liquid(), 2).alias("liquidReserves"), F.round(F.coalesce("operating_margin", F.lit(0.0)) * 100, 1).alias("operatingMargin"))
    return panel.groupBy("ein").agg(F.sort_array(F.collect_list(point)).alias("history"))


def composition_history(panel: DataFrame) -> DataFrame:
    p = lambda n: F.round(F.coalesce(n, F.lit(0.0)) * 100, 4)
    point = F.struct(c("fiscal_year").alias("fiscalYear"), p("pct_contributions").alias("contributionsPct"), p("pct_program_revenue").alias("programPct"), p("pct_investment_income").alias("investmentPct"), p("pct_other_revenue").alias("otherPct"))
    return panel.groupBy("ein").agg(F.sort_array(F.collect_list(point)).alias("composition"))


def peer_quartiles(panel: DataFrame, keys: DataFrame) -> DataFrame:
    """Margin quartiles of each wanted (state, sector) and year, in one pass over ranges of margins."""
    rows = panel.join(keys, ["state", "ntee_major_category"], "left_semi")
    q = order.percentiles(rows, ["state", "ntee_major_category", "fiscal_year"], "operating_margin", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.select("state", "ntee_major_category", "fiscal_year", *[F.round(n, 6).alias(n) for n in ("q25", "q50", "q75")])


def peer_series(quartiles: DataFrame) -> DataFrame:
    """The same nested: for each state and sector its years in order, with quartiles in percent."""
    pct = lambda n: F.round(c(n) * 100, 1)
    point = F.struct(c("fiscal_year").alias("fiscalYear"), pct("q25").alias("peerMarginQ25"), pct("q50").alias("peerMarginMedian"), pct("q75").alias("peerMarginQ75"))
    return quartiles.groupBy("state", "ntee_major_category").agg(F.sort_array(F.collect_list(point)).alias("series"))


def priority() -> Column:
    gap = lambda n, k=1.0: F.abs(F.coalesce(n, F.lit(0.0))) / k
    return points("action_label", LABEL_POINTS) * 100 + points("risk_tier", TIER_POINTS) * 20 + points("urgency_severity", URGENCY_POINTS) * 10 + F.least(F.coalesce("recovery_analog_count", F.lit(0)), F.lit(3)) + gap("margin_gap") + gap("runway_gap", 10.0) + gap("diversification_gap")


def quotas(rows: DataFrame, places: dict[str, int], label: str = "action_label", kind: str = "constraint") -> DataFrame:
    """label, kind, quota: each kind one place, the others by largest remainders, none above its rows; what a kind cannot
    use goes to the others with room in turn, most frequent first (rounds of one place each)."""
    n = rows.where(c(kind).isNotNull()).groupBy(label, kind).agg(F.count("*").alias("n")).withColumn("places", points(label, places))
    by = Window.partitionBy(label)
    n = n.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("n"), kind)), "kinds": F.count("*").over(by), "total": F.sum("n").over(by)})
    n = n.withColumn("base", (c("rank") <= c("places")).cast("int")).withColumn("left", F.greatest(c("places") - c("kinds"), F.lit(0)))
    want = c("n") / c("total") * c("left")
    n = n.withColumns({"whole": F.floor(want).cast("int"), "rest": F.round(want - F.floor(want), 9)})
    n = n.withColumns({"spare": c("left") - F.sum("whole").over(by), "turn": F.row_number().over(by.orderBy(F.desc("rest"), F.desc("n"), kind))})
    n = n.withColumn("q", c("base") + c("whole") + (c("turn") <= c("spare")).cast("int"))
    n = n.withColumns({"q": F.least(c("q"), c("n").cast("int")), "over": F.sum(F.greatest(c("q") - c("n").cast("int"), F.lit(0))).over(by)})
    # the overflow in rounds: a kind's k-th extra place comes after all kinds' earlier ones
    room = n.where("q < n AND over > 0").select(label, kind, "over", "rank", F.explode(F.sequence(F.lit(1), F.least(c("n").cast("int") - c("q"), c("over").cast("int")))).alias("k"))
    extra = room.withColumn("t", F.row_number().over(Window.partitionBy(label).orderBy("k", "rank"))).where("t <= over").groupBy(label, kind).agg(F.count("*").alias("extra"))
    return n.join(extra, [label, kind], "left").select(label, kind, (c("q") + F.coalesce("extra", F.lit(0))).cast("long").alias("quota"))


def shortlist(rows: DataFrame, places: dict[str, int], label: str = "action_label", kind: str = "constraint") -> DataFrame:
    """Per label and kind the first by priority up to the quota; a label's open places go to its best other rows. So no row
    beyond twice the most places of its label and kind is taken, and only those before it are compared further. `place` is
    the final order of the list, which has as many rows as places at most."""
    by = [F.desc("priority"), F.desc("risk_pct"), F.desc("total_revenue"), "ein"]
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(label, kind).orderBy(*by))).where(c("_k") <= 2 * max(places.values()))
    ranked = ranked.join(quotas(rows, places, label, kind), [label, kind], "left").withColumn("_in", F.coalesce(c("_k") <= c("quota"), F.lit(False)))
    taken = F.sum(c("_in").cast("int")).over(Window.partitionBy(label))
    fill = F.row_number().over(Window.partitionBy(label, "_in").orderBy(*by))
    ranked = ranked.withColumns({"_open": points(label, places) - taken, "_fill": fill})
    chosen = ranked.where("_in OR _fill <= _open").drop("_k", "_in", "_open", "_fill", "quota")
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("risk_pct"), "org_name", "ein")))


def summary(rows: DataFrame) -> DataFrame:
    """kind, value, n: counts by label, tier and confidence and in total, in one pass over grouping sets."""
    g = rows.groupingSets([["action_label"], ["risk_tier"], ["tier"], []], "action_label", "risk_tier", "tier").agg(F.count("*").alias("n"), F.grouping_id("action_label", "risk_tier", "tier").alias("g"))
    kind = F.when(c("g") == 3, "label").when(c("g") == 5, "risk_tier").when(c("g") == 6, "confidence").otherwise("total")
    return g.select(kind.alias("kind"), F.coalesce("action_label", "risk_tier", "tier", F.lit("all")).alias("value"), "n")


def header(rows: DataFrame, probability: Column) -> DataFrame:
    """total, states (in order), baseline_rate (the mean probability) of a portfolio."""
    return rows.agg(F.count("*").alias("total"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"), F.round(F.avg(probability), 6).alias("baseline_rate"))


#: The order in which a facet's options stand; others follow by name.
FACETS = {"action_label": tuple(LABEL_POINTS), "risk_tier": ("High", "Medium", "Low"), "tier": ("High", "Medium", "Low"), "state": ()}


def facets(rows: DataFrame, orders: dict[str, tuple] = FACETS) -> DataFrame:
    """facet, option, n, place: the options of each facet with their rows, in the facet's own order."""
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("facet"), c(f).alias("option")) for f in orders]))).where("option IS NOT NULL")
    n = each.groupBy("facet", "option").agg(F.count("*").alias("n"))
    at = F.lit(len(max(orders.values(), key=len)))
    for f, options in orders.items():
        for i, o in enumerate(options):
            at = F.when((c("facet") == f) & (c("option") == o), F.lit(i)).otherwise(at)
    return n.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(at, "option")))


SEARCHED = ("org_name", "state", "ntee_major_category", "action_label")
_BUCKETS = 64


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_BUCKETS)).cast("int")


def index_texts(rows: DataFrame, path: str, columns=SEARCHED, key: str = "ein") -> None:
    """Writes the posting table of the columns' texts: gram, field and key for each run of three characters, small letters,
    in folders by a hash of the gram and in its order, so that a search reads the row groups of its own grams."""
    texts = rows.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("field"), F.lower(x).alias("text")) for i, x in enumerate(columns)]))).where("text IS NOT NULL")
    posted = texts.select(F.explode(_grams(c("text"))).alias("gram"), "field", key).withColumn("bucket", _bucket(c("gram")))
    posted.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def search(rows: DataFrame, text: str, label: str | None = None, by: str = "score", postings: DataFrame | None = None, columns=SEARCHED, key: str = "ein") -> DataFrame:
    """Rows one of whose columns contains the text, letter case aside, of a label or of all; `by` score (best first),
    score_up or name. With the posting table, only rows in which one field has all of the text's grams are looked at; texts
    under three characters have none and take the scan."""
    wanted = text.strip().lower()
    found = F.lit(not wanted)
    for n in columns:
        found = found | F.coalesce(F.contains(F.lower(n), F.lit(wanted)), F.lit(False))
    if postings is not None and len(wanted) >= 3:
        grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
        mine = postings.where(c("gram").isin(grams) & c("bucket").isin([r[0] for r in rows.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(c("gram"))).distinct().collect()]))
        full = mine.groupBy(key, "field").agg(F.countDistinct("gram").alias("n")).where(c("n") == len(grams))
        rows = rows.join(full.select(key).distinct(), key, "left_semi")
    out = rows.where(found)
    order_by = {"score": [F.desc("fit_score"), "org_name"], "score_up": [F.asc("fit_score"), "org_name"], "name": [F.asc_nulls_last(F.lower("org_name")), "org_name", key]}[by]
    return (out if label is None else out.where(c("action_label") == label)).orderBy(*order_by)


def margin_trend(panel: DataFrame, within: float = 0.01) -> DataFrame:
    """ein, margin_trend: the last filing's margin against the one before; null where one of them is unknown."""
    back = F.row_number().over(Window.partitionBy("ein").orderBy(F.desc("fiscal_year")))
    at = lambda k: F.max(F.when(c("_k") == k, c("operating_margin")))
    two = panel.withColumn("_k", back).where(c("_k") <= 2).groupBy("ein").agg((at(1) - at(2)).alias("move"))
    return two.select("ein", F.when(c("move") > within, "improving").when(c("move") < -within, "declining").when(c("move").isNotNull(), "stable").alias("margin_trend"))


def pipeline(rows: DataFrame, label: str, revenue=(25e4, 1e8), highest: float = 0.5, top: int = 60, trends=("stable", "improving")) -> DataFrame:
    """The first rows of a label within a revenue band, with an index under `highest` and one of these margin trends."""
    s = F.round((highest - c("rdi")) * c("total_revenue"), 2)
    fit = (c("action_label") == label) & c("total_revenue").between(*revenue) & (c("rdi") < highest) & c("margin_trend").isin(*trends)
    return rows.where(fit).withColumn("pipeline_score", s).orderBy(F.desc("pipeline_score"), "ein").limit(top)


def margin_pattern(panel: DataFrame) -> DataFrame:
    m = "operating_margin"  # subtracted first, so that rounding moves no value over a bound
    g = panel.groupBy("ein").agg(((F.max(m) - F.min(m)) * 100).alias("spread"), ((F.max_by(m, "fiscal_year") - F.min_by(m, "fiscal_year")) * 100).alias("move"))
    return g.select("ein", F.when(c("spread") > 120, "variable").when(c("move") > 8, "improving").when(c("move") < -8, "softer").otherwise("steady").alias("pattern"))


def change_since_start(panel: DataFrame, column: str) -> DataFrame:
    first, last = F.min_by(column, "fiscal_year"), F.max_by(column, "fiscal_year")
    p = F.round(F.try_divide(last - first, F.abs(first)) * 100, 6)
    return panel.groupBy("ein").agg(p.alias("change_pct")).withColumn("wording", F.when(F.abs("change_pct") < 2, "roughly flat").when(c("change_pct") > 0, "up").when(c("change_pct") < 0, "down"))


def band_alignment(panel: DataFrame, quartiles: DataFrame) -> DataFrame:
    m = F.round("operating_margin", 6)
    met = panel.join(quartiles, ["state", "ntee_major_category", "fiscal_year"])
    return met.select("ein", "fiscal_year", F.when(m < c("q25"), "below").when(m > c("q75"), "above").otherwise("inside").alias("band"))


def record(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """One nested struct for each organisation: identity, label, risk, benchmark gaps, stress, funding, evidence, histories."""
    return rows.join(financial_history(panel), "ein", "left").join(composition_history(panel), "ein", "left").select(
        F.concat(F.lit("org-"), "ein").alias("id"), "ein", c("org_name").alias("orgName"), "state", c("ntee_major_category").alias("sector"), c("fiscal_year").alias("fiscalYear"), c("action_label").alias("actionLabel"),
        F.struct(c("risk_pct").alias("probability"), c("risk_tier").alias("tier")).alias("distress"), F.struct("margin_gap", "runway_gap", "diversification_gap").alias("benchmark"),
        F.struct("severity25", "burn25", "burn50", "largest_pct").alias("stress"), F.struct("total_revenue", "total_expenses", "net_assets_eoy", "investment_yield").alias("financials"),
        F.struct(c("tier").alias("confidence"), c("completeness").alias("fields"), c("recovery_analog_count").alias("analogs"), c("streak").alias("yearsInvesting")).alias("evidence"), "history", "composition",
    )
