"""Text clean-up and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def joined_name(first: Column, second: Column) -> Column:
    return blank_to_null(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))))


def repaired_city(city: Column, state: Column) -> Column:
    """A name that is its own half twice keeps one half; a name ending with its state's code twice loses one."""
    t = F.trim(city)
    half = F.floor(F.length(t) / 2).cast("int")
    doubled = (F.length(t) > 3) & (F.length(t) % 2 == 0) & (F.substring(t, F.lit(1), half) == F.substring(t, half + 1, half))
    twice = F.coalesce((F.length(state) > 0) & F.endswith(t, F.concat(state, state)), F.lit(False))
    return F.when(doubled, F.substring(t, F.lit(1), half)).when(twice, F.substring(t, F.lit(1), F.length(t) - F.length(state))).otherwise(t)


def collapsed(x: Column, size: int = 500) -> Column:
    return F.nullif(F.left(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(size)), F.lit(""))


def fixed(x: Column, digits: int) -> Column:
    """As SQL's format('{:.nf}'): the double's exact value is rounded, ties go to the even digit. Null stays null."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def half_up(x: Column, digits: int) -> Column:
    """The shortest decimal of x is rounded, ties go away from zero: for amounts that SQL rounds before it formats them."""
    return F.format_string(f"%.{digits}f", x)


def compact_currency(x: Column, show=fixed) -> Column:
    a = F.abs(x)
    return (
        F.when(x.isNull(), F.lit(None))
        .when(a >= 1e9, F.concat(F.lit("$"), show(x / 1e9, 1), F.lit("B")))
        .when(a >= 1e6, F.concat(F.lit("$"), show(x / 1e6, 1), F.lit("M")))
        .when(a >= 1e3, F.concat(F.lit("$"), show(x / 1e3, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), show(x, 0)))
    )


def currency(x: Column) -> Column:
    v = F.coalesce(x, F.lit(0.0))
    return F.when(F.abs(v) < 1000, F.lit("Unavailable")).otherwise(F.concat(F.lit("$"), F.format_number(v, 0)))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(F.coalesce(x, F.lit(0.0)) * 100, digits), F.lit("%"))


def signed(x: Column, digits: int = 2, show=fixed) -> Column:
    v = F.coalesce(x, F.lit(0.0)) + 0.0
    return F.concat(F.when(v < 0, "").otherwise("+"), show(v, digits))


def number(x: Column, digits: int = 2, missing: str = "null") -> Column:
    return F.when(x.isNull(), F.lit(missing)).otherwise(fixed(x, digits))


#: Words that stay lower case inside a name, and tokens that are always upper case.
CONNECTORS = ("a", "an", "and", "at", "by", "de", "del", "du", "for", "in", "la", "le", "of", "on", "or", "the", "to")
ALWAYS_UPPER = ("CBCC", "CCH", "EAH", "KAIST", "MP", "RHF", "UB", "UFCW", "US", "VEBA")


def _token(t: Column, first: Column) -> Column:
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    up, low = F.upper(letters), F.lower(letters)
    capital = F.concat(F.regexp_extract(t, "^[^A-Za-z]*", 0), F.initcap(F.regexp_extract(t, "[A-Za-z]+", 0)), F.regexp_replace(t, "^[^A-Za-z]*[A-Za-z]+", ""))
    return (
        F.when((t == "&") | (letters == ""), t)
        .when(up.isin(*ALWAYS_UPPER), up)
        .when(up.rlike("^[IVXLCDM]{1,5}$"), up)
        .when(F.length(letters) == 1, up)
        .when(low.isin(*CONNECTORS) & ~first, low)
        .when(letters.rlike("^[A-Z]{2}$"), up)
        .otherwise(capital)
    )


def title_case(name: Column) -> Column:
    """An organisation's name: connectors lower, acronyms, numerals and two-letter tokens upper, parts around - and / apart."""

    def composite(word: Column, i: Column) -> Column:
        parts = F.split(F.regexp_replace(word, "([-/])", "\u0001$1\u0001"), "\u0001")
        return F.array_join(F.transform(parts, lambda p, k: F.when(p.isin("-", "/"), p).otherwise(_token(p, (i == 0) & (k == 0)))), "")

    return F.array_join(F.transform(F.split(name, r"\s+"), composite), " ")
