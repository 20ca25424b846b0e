"""Numbers as printed: parsing with the decimal convention, printed precision, tolerances. Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions.let import let

#: Thresholds below which differences are floating-point noise: metres (or square metres), and degrees.
LINEAR_EPS, ANGLE_EPS = 1e-4, 1e-8
#: Spaces used as thousands separators: plain, no-break, figure, narrow no-break, thin, hair.
SPACES = " \u00a0\u2007\u202f\u2009\u200a"
#: The first numeric run of a text, with its sign (U+2212 is the typographic minus).
_RUN = "([-+\u2212]?)(\\d[\\d.,\\s" + SPACES + "]*)"

#: What most cells hold: digits alone, or with a decimal comma that no convention reads otherwise.
_PLAIN = "^(?:\\d{1,15}|\\d{1,12}(?:\\.\\d{3})*,(?:\\d{1,2}|\\d{4,9})|\\d{1,3}(?:\\.\\d{3})+,\\d{3})$"


def strip_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _after(text: Column, mark: str) -> Column:
    """Characters after the last mark; the whole length if there is none."""
    return F.length(F.substring_index(text, mark, -1))


def decimal_mark(body: Column, convention: Column) -> Column:
    """',' or '.', or null where every mark groups thousands.

    Of two kinds of marks the last one is decimal. A repeated mark groups thousands. A single mark before exactly three
    digits is decided by the convention.
    """
    dots, commas = _count(body, "."), _count(body, ",")
    three = lambda mark: _after(body, mark) == 3
    return (
        F.when((dots > 0) & (commas > 0), F.when(_after(body, ",") < _after(body, "."), ",").otherwise("."))
        .when(commas == 1, F.when(~(three(",") & (convention == "us")), ","))
        .when(dots == 1, F.when(~(three(".") & convention.isin("br", "ambiguous")), "."))
    )


def parse_number(raw: Column, convention: Column | str = "br") -> Column:
    """struct<value double, decimals int, halfwidth double> of the first number in raw, null without one."""
    convention = F.lit(convention) if isinstance(convention, str) else convention

    def read(x: Column) -> Column:
        decimals = F.when(x["mark"].isNull(), 0).otherwise(F.when(x["mark"] == ",", _after(x["body"], ",")).otherwise(_after(x["body"], "."))).cast("int")
        plain = F.translate(x["body"], ".,", "")
        return F.struct(x["sign"].alias("sign"), plain.alias("plain"), decimals.alias("decimals"))

    def value(x: Column) -> Column:
        whole = F.substr(x["plain"], F.lit(1), F.length(x["plain"]) - x["decimals"])
        digits = F.when(x["decimals"] == 0, x["plain"]).otherwise(F.concat(whole, F.lit("."), F.substr(x["plain"], F.length(x["plain"]) - x["decimals"] + 1)))
        return F.struct((digits.try_cast("double") * F.when(x["sign"].isin("-", "\u2212"), -1.0).otherwise(1.0)).alias("value"), x["decimals"].alias("decimals"), halfwidth(x["decimals"]).alias("halfwidth"))

    body = F.regexp_replace(strip_spaces(F.regexp_replace(F.regexp_extract(raw, _RUN, 2), "\\s", "")), "[.,]+$", "")
    start = F.struct(F.regexp_extract(raw, _RUN, 1).alias("sign"), body.alias("body"), convention.alias("convention"))
    marked = let(start, lambda x: F.struct(x["sign"].alias("sign"), x["body"].alias("body"), decimal_mark(x["body"], x["convention"]).alias("mark")))
    told = let(let(let(marked, read), value), lambda x: F.when(x["value"].isNotNull(), x))
    # plain ones need no lambdas, which Spark interprets
    comma = F.instr(raw, ",")
    decimals = F.when(comma == 0, 0).otherwise(F.length(raw) - comma)
    plain = F.struct(F.translate(raw, ",.", ".").try_cast("double").alias("value"), decimals.alias("decimals"), halfwidth(decimals).alias("halfwidth"))
    return F.when(raw.rlike(_PLAIN), plain).when(raw.isNotNull(), told)


def halfwidth(decimals: Column) -> Column:
    """Half of the last printed digit."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals)


def decimals_of(width: Column) -> Column:
    """Printed decimals from a half-width; null where there is none."""
    return F.when(width > 0, F.greatest(F.lit(0), F.rint(-F.log10(2 * width)).cast("int")))


def convention_vote(token: Column) -> Column:
    """'br', 'us' or null: what one number token tells of the decimal convention."""
    text = strip_spaces(token)
    dots, commas = _count(text, "."), _count(text, ",")
    return (
        F.when((dots > 0) & (commas > 0), F.when(_after(text, ",") < _after(text, "."), "br").otherwise("us"))
        .when(commas > 1, "us")
        .when((commas == 1) & (_after(text, ",") != 3), "br")
        .when((commas == 0) & (dots > 1), "br")
        .when((commas == 0) & (dots == 1) & (_after(text, ".") != 3), "us")
    )


def format_br(value: Column, decimals: int = 3) -> Column:
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def quantum(*widths: Column, eps: float = LINEAR_EPS) -> Column:
    """The largest positive half-width, eps without one."""
    positive = [F.when(w > 0, w) for w in widths]
    return F.coalesce(F.greatest(*positive) if len(positive) > 1 else positive[0], F.lit(eps))


def exceeds(delta: Column, tolerance: Column) -> Column:
    return F.abs(delta) > F.when(tolerance > 0, tolerance).otherwise(F.lit(LINEAR_EPS))


def _rounded_equal(a: pd.Series, b: pd.Series, decimals: pd.Series) -> pd.Series:
    """Python rounds the exact binary value; no built-in of Spark does."""

    def one(x: float, y: float, d: float) -> bool | None:
        if pd.isna(x) or pd.isna(y):
            return None
        return abs(x - y) <= LINEAR_EPS if pd.isna(d) else round(x, int(d)) == round(y, int(d))

    return pd.Series([one(*row) for row in zip(a, b, decimals)], dtype=object)


def values_equal(a: Column, b: Column, *widths: Column) -> Column:
    """Equal as printed: both rounded to the finest source's decimals; without sources, within LINEAR_EPS."""
    all_ = [decimals_of(w).cast("double") for w in widths]
    return F.pandas_udf(_rounded_equal, "boolean")(a, b, F.greatest(*all_) if len(all_) > 1 else all_[0] if all_ else F.lit(None).cast("double"))
