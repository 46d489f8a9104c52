"""Projection, cleaning and conforming of filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.config import SHARES, STREAMS


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def coerce(df: DataFrame, doubles=(), ints=()) -> DataFrame:
    """Text to numbers; what is no number becomes null."""
    return df.withColumns({n: F.col(n).try_cast("double") for n in doubles} | {n: F.col(n).try_cast("double").try_cast("int") for n in ints})


def keep(df: DataFrame, return_type: str = "990", states=None, keys=("ein", "fiscal_year")) -> DataFrame:
    df = df.where(F.col("return_type") == return_type).dropna(subset=list(keys))
    return df if states is None else df.where(F.col("state").isin(*states))


def first_present(*columns: Column, zero_is_missing: bool = False) -> Column:
    """The first alternate that is there; with zero_is_missing a reported 0 falls through to the next one."""
    *front, last = columns
    return F.coalesce(*[F.nullif(x, F.lit(0)) if zero_is_missing else x for x in front], last)


def year_of(period: Column) -> Column:
    return F.left(period, F.lit(4)).try_cast("int")


def normalise(df: DataFrame) -> DataFrame:
    """Upper-case trimmed state, trimmed id, blank sector and submission mark instead of null."""
    return df.withColumns(
        {
            "ein": F.trim("ein"),
            "state": F.upper(F.trim("state")),
            "ntee_major_category": F.coalesce(F.trim("ntee_major_category"), F.lit("")),
            "submitted_on": F.coalesce("submitted_on", F.lit("")),
        }
    )


def residual(total: Column, *known: Column) -> Column:
    out = total
    for x in known:
        out = out - F.coalesce(x, F.lit(0.0))
    return out


def fill_residual(df: DataFrame, name: str, total: str, *known: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), residual(F.col(total), *map(F.col, known))))


def shares(df: DataFrame) -> DataFrame:
    return df.withColumns({p: F.try_divide(F.col(s), F.col("total_revenue")) for p, s in zip(SHARES, STREAMS)})


def caps(df: DataFrame) -> DataFrame:
    """Formation years outside 1700 to 2026 are unknown; employees and board members are capped."""
    year = F.col("formation_year")
    cap = lambda n, top: F.when(F.col(n).isNotNull(), F.least(F.col(n), F.lit(top)))
    return df.withColumns({"formation_year": F.when(year.between(1700, 2026), year), "num_employees": cap("num_employees", 200_000), "num_voting_board_members": cap("num_voting_board_members", 500)})


def union_aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows, with first's columns in first's order: what second lacks is null, what it has beyond is dropped."""
    return first.unionByName(second.select(*[c for c in second.columns if c in first.columns]), allowMissingColumns=True)


#: Earlier names of the action labels.
EARLIER_LABELS = {
    "Amplify": "Underinvested Asset Base",
    "Optimize": "Underinvested Asset Base",
    "Stabilize": "Weak Financial Foundation",
    "Strengthen": "Weak Financial Foundation",
    "Deep Review": "Needs Data Diligence",
    "Review": "Needs Data Diligence",
    "Diversify": "Revenue Concentration Risk",
}


def current_label(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EARLIER_LABELS.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(table, label)), F.lit(0)), label)


def current_wording(text: Column) -> Column:
    text = F.replace(text, F.lit("Deep Review"), F.lit("Needs Data Diligence"))
    for old in ("Amplify", "Stabilize", "Diversify"):
        text = F.regexp_replace(text, rf"\b{old}\b", EARLIER_LABELS[old])
    return text
