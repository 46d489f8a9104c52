"""URL rules by a Bloom filter cascade, in DataFrame functions only.

A rule has a host and a path; its key is their concatenation. A url's candidate keys are its host's suffixes and path's
prefixes of the shapes (labels of the host, length of the path) that rules have. The corpus's distinct candidate keys
are the universe. Level 1 of a cascade is a Bloom filter of the listed keys; level 2 is one of the universe's other keys
that level 1 lets through; level 3 one of the listed keys that level 2 lets through; and so on until none is left. For any
key of the universe, the number of levels passed then tells whether it is listed: exactly, and without a join. With the
first level's false positive rate near |listed| / |universe| the filters grow with the list, and with the universe only
by its logarithm; they travel inside the expression.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import cut


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, rules) -> Column:
    """An array with the url's key for each shape of rule, null where it has none."""
    labels = F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    return F.array(
        *[F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    )


def _bits(key: Column, level: int, m: int, k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 100 + i), key), F.lit(m)) for i in range(k)]


@dataclass
class Level:
    number: int
    m: int  # bits
    k: int  # hashes
    words: list[int]

    def passes(self, key: Column) -> Column:
        """Whether all bits of the key are set. The filter is one literal, which Spark makes an array of once in a query."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<long>")
        return F.forall(F.array(*_bits(key, self.number, self.m, self.k)), lambda at: F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)


def level_of(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """The Bloom filter of a table of n keys, built by Spark; its words come to the driver (n log2(1 / rate) x 1.44 bits)."""
    k = max(1, round(math.log2(1 / rate)))
    m = 64 * max(1, math.ceil(n * k / math.log(2) / 64))
    bit = keys.select(F.explode(F.array(*_bits(F.col("key"), number, m, k))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    got = bit.groupBy(F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(one).alias("x")).collect()
    words = [0] * (m // 64)
    for w, x in got:
        words[w] = x
    return Level(number, m, k, words)


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].passes(key), out).otherwise(F.lit(i % 2 == 0))
        return F.coalesce(out & key.isNotNull(), F.lit(False))


def cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
    """listed, universe: tables with a column key, distinct."""
    here, there = listed, universe.join(listed, "key", "left_anti")
    n, others = here.count(), there.count()
    levels: list[Level] = []
    while n:
        rate = min(0.5, max(n, 1) * math.sqrt(0.5) / max(others, 1)) if not levels else 0.5
        level = level_of(here, n, rate, seed + len(levels) + 1)
        levels.append(level)
        passed = cut(there.where(level.passes(F.col("key"))))
        here, there = passed, here
        n, others = passed.count(), n
    return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of pages. The longest key among the fitting rules decides (of
    equally long ones the last by name); a key under both verdicts blocks. Where no rule fits, the url is on no list and
    rule is null, verdict the default. Null and repeated page_ids are rows like any other, a null url has empty parts, urls
    of any length are read whole; other columns are not looked at, whatever their names. An empty table has no rows."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = urls.select(F.explode(candidates(F.col("host"), F.col("path"), rules)).alias("key")) if rules else None
    best = F.lit(None).cast("struct<size: int, key: string, verdict: string>")
    if found is not None:
        universe = cut(found.where("key is not null").distinct())
        sides = []
        for i, verdict in enumerate(("block", "allow")):
            keys = sorted({r.key for r in rules if r.verdict == verdict})
            listed = pages.sparkSession.range(1 if keys else 0).select(F.explode(F.array(*map(F.lit, keys or [""]))).alias("key"))
            sides.append((verdict, cascade(listed, universe, seed=50 * i)))
        (_, block), (_, allow) = sides
        keyed = F.transform(
            candidates(F.col("host"), F.col("path"), rules),
            lambda k: F.struct(F.length(k).alias("size"), k.alias("key"), F.when(block.has(k), F.lit("block")).when(allow.has(k), F.lit("allow")).alias("verdict")),
        )
        best = F.array_max(F.filter(keyed, lambda x: x["verdict"].isNotNull()))
    return urls.withColumn("_best", best).select("page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))


def oracle_sql(rules=RULES, default: str = "allow") -> str:
    def fits(r: Rule) -> str:
        return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"

    ordered = sorted(rules, key=lambda r: (-len(r.key), r.verdict != "block"))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.key}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)
    return f"""
    WITH u AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} ELSE '{default}' END AS verdict FROM u"""
