"""Text and number normalisers as built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim all Unicode white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def normal(c: Column) -> Column:
    """Stripped, upper case, inner white space as single spaces."""
    return F.regexp_replace(F.upper(strip(c)), r"(?U)\s+", " ")


def number(c: Column) -> Column:
    """Double where the whole text is a plain number, else null."""
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def whole_number(c: Column) -> Column:
    return number(c).try_cast("long")


def report_date(c: Column) -> Column:
    return F.try_to_date(strip(c), "yyyyMMdd")


def mentions(name: Column, ingredient: Column, terms) -> Column:
    """Whether either text names one of ``terms`` by itself: what stands next to it is no letter or digit, or nothing."""
    aside = "[^A-Z0-9]"
    own = f"(^|{aside})({'|'.join(re.escape(t) for t in sorted(terms))})({aside}|$)"
    return name.rlike(own) | ingredient.rlike(own)


def truth(c: Column | str) -> Column:
    """A flag with null as false."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def feature_mask(column: str, value) -> Column:
    """Rows whose column has a value: flags null-safe, others as trimmed text."""
    if isinstance(value, bool):
        return truth(column) == F.lit(value)
    return strip(F.col(column)) == F.lit(str(value))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def age_years(age: Column, unit: Column) -> Column:
    """Years from an age and its unit code; null for other units."""
    code = F.upper(strip(unit))
    per_year = {"YR": 1.0, "MON": 12.0, "WK": 52.0, "DY": 365.0, "HR": 24.0 * 365.0, "DEC": 0.1}
    years = F.lit(None).cast("double")
    for name, units in per_year.items():
        value = age * F.lit(10.0) if name == "DEC" else age / F.lit(units)
        years = F.when(code == name, value).otherwise(years)
    return years


def age_group(years: Column) -> Column:
    return F.when(years < 65, None).when(years < 75, "65-74").when(years < 85, "75-84").when(years >= 85, ">=85")


def age_order(group: Column) -> Column:
    return F.when(group == "65-74", 0).when(group == "75-84", 1).when(group == ">=85", 2)


def clean_sex(sex: Column, fallback: Column) -> Column:
    first, second = F.upper(strip(sex)), F.upper(strip(fallback))
    return F.when(first.isin("F", "M"), first).when(second.isin("F", "M"), second).otherwise("UNK")
