"""De-identification: stable hashes, aliases, jitter, scrubbing, and audits of the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import SIZE_BANDS
from ledgerline.plans.reuse import cut

c = F.col
#: Scale factors of money by case number.
SCALES = (0.73, 1.19, 0.84, 1.31, 0.91, 1.14, 0.78, 1.27, 0.88, 1.22)

HASH_RANGES = 4096


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the characters' codes."""
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")) % F.lit(1 << 32))


def aliases(rows: DataFrame, names: Column, key: str = "ein", word: str = " Case ") -> DataFrame:
    """case_index (in the order of the key's hash) and alias of each row, of which each key has one. Ranges of the hash are numbered each on their own,
    after the count of the rows in the ranges before; only these counts, HASH_RANGES at most, are ordered in one task."""
    hashed = rows.withColumn("_h", fnv1a(c(key))).withColumn("_part", F.floor(c("_h") / ((1 << 32) // HASH_RANGES)).cast("int"))
    sizes = hashed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - c("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)) - 1
    out = hashed.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("case_index", c("_before") + c("_place"))
    return out.withColumn("alias", F.concat(names, F.lit(word), _padded(c("case_index") + 1))).drop("_h", "_part", "_place", "_before")


def _padded(n: Column) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < 2, F.concat(F.lit("0"), s)).otherwise(s)


def peer_aliases(peers: DataFrame, name: str) -> DataFrame:
    """The distinct names of peers, numbered in the order of their hashes."""
    return aliases(peers.where(c(name).isNotNull()).select(name).distinct(), F.lit("Matched"), name, " Peer ")


#: Wordings that would tell how a figure came about, and their public form.
PHRASES = {"largest revenue source": "largest reported revenue category", "25% source shock": "25% reported-category shock", r"\bnan\b": "not available"}
_WORD = r"[\p{L}\p{N}]"
#: Different words, some 40 bytes each in a task, that are broadcast.
ANCHORS = 500_000


def _words(text: Column) -> Column:
    """Runs of letters and digits, small; a number's thousands are not parted."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d{3})", ""), F.lit(f"{_WORD}+"), F.lit(0))


def _anchored(secrets: DataFrame) -> DataFrame:
    """Each run of words once, with `_anchor`: the word of it that the fewest secrets have, and `_at`, its first place there.
    Secrets that begin alike so have different anchors."""
    keyed = secrets.withColumn("_w", _words(c("secret"))).where(F.size("_w") > 0).withColumns({"_run": F.array_join("_w", " "), "_n": F.size("_w")})
    runs = keyed.select("_run", "_w").dropDuplicates(["_run"])
    words = runs.select("_run", F.inline(F.transform("_w", lambda w, i: F.struct(w.alias("_word"), (i + 1).alias("_i")))))
    spread = words.dropDuplicates(["_run", "_word"]).groupBy("_word").agg(F.count("*").alias("_in"))
    anchor = words.join(spread, "_word").groupBy("_run").agg(F.min(F.struct("_in", "_i", "_word")).alias("_a"))
    return cut(keyed.join(anchor.select("_run", c("_a._word").alias("_anchor"), c("_a._i").alias("_at")), "_run"))


def occurrences(texts: DataFrame, key: str, text: str, secrets: DataFrame) -> DataFrame:
    """key and the secret's columns for each secret whose words stand one after another in the text. A text's words meet the
    secrets by one word of each, their anchor, and the words around it are compared there. The anchors, up to ANCHORS
    different ones, go to every task, so that only words that are one leave the scan of the texts; more are joined by a
    shuffle on that word. A text meets only secrets whose anchor it holds, whatever their number and lengths."""
    keyed = _anchored(secrets)
    longest = keyed.agg(F.max("_n")).first()[0]
    if longest is None:
        return texts.select(key).join(keyed.drop("_run", "_anchor", "_at").limit(0), F.lit(True))
    around = longest - 1
    split = texts.select(key, _words(c(text)).alias("_t")).where(F.size("_t") > 0)
    near = lambda w, i: F.struct(w.alias("_anchor"), F.slice("_t", F.greatest(i + 1 - around, F.lit(1)), F.lit(2 * around + 1)).alias("_near"), F.least(i + 1, F.lit(around + 1)).alias("_here"))
    words = split.select(key, F.inline(F.transform("_t", near)))
    anchors = keyed.select("_anchor").distinct()
    if anchors.limit(ANCHORS + 1).count() <= ANCHORS:
        words = words.join(F.broadcast(anchors), "_anchor", "left_semi")
    begin = c("_here") - c("_at") + 1
    met = words.join(keyed, "_anchor").where((begin >= 1) & (F.slice("_near", F.greatest(begin, F.lit(1)), c("_n")) == c("_w")))
    return met.dropDuplicates([key, "_run", *secrets.columns]).drop("_anchor", "_near", "_here", "_at", "_run")


def scrub(texts: DataFrame, key: str, text: str, secrets: DataFrame) -> DataFrame:
    """texts with every secret (secret, replacement), whoever's it is, replaced, letter case and what stands between its
    words aside, those of most words first; then the phrases. key is unique."""
    found = occurrences(texts, key, text, secrets).groupBy(key).agg(F.sort_array(F.collect_set(F.struct((-c("_n")).alias("n"), "_w", "replacement"))).alias("_found"))
    pattern = lambda w: F.concat(F.lit(f"(?iu)(?<!{_WORD})"), F.array_join(w, f"[^\\p{{L}}\\p{{N}}]+"), F.lit(f"(?!{_WORD})"))  # noqa: E731, F541
    out = F.aggregate(F.coalesce("_found", F.array().cast("array<struct<n: int, _w: array<string>, replacement: string>>")), c(text), lambda t, x: F.regexp_replace(t, pattern(x["_w"]), x["replacement"]))
    for old, new in PHRASES.items():
        out = F.regexp_replace(out, f"(?i){old}", new)
    return texts.join(found, key, "left").withColumn(text, out).drop("_found")


def jitter(case: Column, year: Column, channel: str, most: float = 0.04) -> Column:
    unit = fnv1a(F.concat(case.cast("string"), F.lit(":"), year.cast("string"), F.lit(f":{channel}"))) % 2001 / 1000 - 1
    return 1 + unit * most


def money(x: Column, case: Column, year: Column, channel: str) -> Column:
    scale = F.get(F.array(*map(F.lit, SCALES)), (case % len(SCALES)).cast("int"))
    return F.floor(F.round(x * scale * jitter(case, year, channel), 6) + 0.5)


def bucket(revenue: Column, bands=SIZE_BANDS) -> Column:
    """The size band of a published revenue, so that it agrees with the amount beside it; below all bands the least."""
    out = F.when(revenue.isNotNull(), F.lit(bands[0][0]))
    for label, low, _ in bands[1:]:
        out = F.when(revenue >= low, F.lit(label)).otherwise(out)
    return out


def composition(shares: list[Column], case: Column, year: Column) -> list[Column]:
    """Four shares (in %), perturbed, floored to tenths, the last one taking the remainder to 100."""
    key = lambda ch: fnv1a(F.concat(case.cast("string"), F.lit(":"), year.cast("string"), F.lit(f":{ch}")))
    mix, inv = (key("mix") % 61 - 30) / 10, (key("investment") % 17 - 8) / 10
    raw = [F.greatest(x, F.lit(0.0)) for x in (shares[0] + mix, shares[1] - mix * 0.65, shares[2] + inv, shares[3] - mix * 0.35 - inv)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    tenths = [F.floor(F.round(F.coalesce(F.try_divide(x, total), F.lit(0.0)) * 1000, 6)) / 10 for x in raw[:3]]
    return [*tenths, F.round(100 - tenths[0] - tenths[1] - tenths[2], 1)]


def leak_audit(texts: DataFrame, key: str, text: str, secrets: DataFrame, least: int = 5) -> DataFrame:
    """kind, secrets, texts: how many different secrets (kind, secret) of at least `least` characters stand in how many texts:
    names, ids, names of peers, and amounts as whole numbers."""
    found = occurrences(texts, key, text, secrets.where(F.length("secret") >= least).distinct())
    n = found.groupBy("kind").agg(F.countDistinct("secret").alias("secrets"), F.countDistinct(key).alias("texts"))
    kinds = secrets.select("kind").distinct()
    return kinds.join(n, "kind", "left").fillna(0, ["secrets", "texts"])


def amounts(df: DataFrame, columns: list[str], least: float = 1e5) -> DataFrame:
    """The large amounts of these columns as secrets."""
    each = df.select(F.explode(F.array(*[F.round(x).cast("long") for x in columns])).alias("_a")).where(F.abs("_a") >= least).distinct()
    return each.select(F.lit("amount").alias("kind"), F.abs("_a").cast("string").alias("secret"))


def integrity(shares: list[str], margin: str, text: str) -> dict[str, Column]:
    """Conditions that a published row must not meet: a margin that is no ratio, shares (in %) outside 0 to 100 or that do not
    sum to 100, and an unresolved nan in a text."""
    each = [c(x) for x in shares]
    total = reduce(lambda a, b: a + b, each)
    return {
        "bad_margin": F.abs(margin) > 2,
        "share_out_of_range": reduce(lambda a, b: a | b, [(x < 0) | (x > 100) for x in each]),
        "shares_not_100": F.abs(total - 100) > 0.11,
        "nan_label": F.regexp_like(F.lower(text), F.lit(r"\bnan\b")),
    }
