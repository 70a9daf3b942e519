"""Scalar building blocks shared by the plans.

Long CASE chains are built as one SQL expression, so they are parsed in a
single call instead of one call per branch; their inputs are therefore column
names or SQL expressions given as text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from brickledger.functions import fixed_values as fv


def literal(value) -> str:
    """A fixed value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def case_sql(branches: Iterable[tuple[str, object]], otherwise=None) -> str:
    """CASE over (test, value) pairs; the first true test decides."""
    whens = " ".join(f"WHEN {test} THEN {literal(value)}" for test, value in branches)
    last = "" if otherwise is None else f" ELSE {literal(otherwise)}"
    return f"CASE {whens}{last} END"


def decode_sql(code: str, labels: Mapping, default=None) -> str:
    """Lookup in a constant map. A chain of string comparisons would say the
    same, but a plan with many of them outgrows what the JVM still compiles."""
    entries = ", ".join(f"{literal(key)}, {literal(label)}" for key, label in labels.items())
    found = f"try_element_at(map({entries}), {code})"
    return found if default is None else f"coalesce({found}, {literal(default)})"


def decode(code: str, labels: Mapping, default=None) -> Column:
    """Code to label; an unlisted code gives the default, or NULL."""
    return F.expr(decode_sql(code, labels, default))


def equals_flag(column: Column, value) -> Column:
    return column.eqNullSafe(F.lit(value)).cast("int")


def clean_name(column: Column) -> Column:
    return F.upper(F.trim(column))


def clamp(column: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def ratio(part: Column, whole: Column) -> Column:
    """Double division that yields NULL on a zero divisor."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    return ratio(new, old) * 100 - 100


def to_long(column: Column) -> Column:
    return column.cast("bigint")


def half_up(column: Column, digits: int = 0) -> Column:
    return F.round(column, digits)


def half_even(column: Column, digits: int = 0) -> Column:
    return F.bround(column, digits)


def commute_band(minutes: str) -> Column:
    """Inclusive upper bounds; an unknown commute falls into the last band."""
    return F.expr(case_sql(((f"{minutes} <= {top}", label) for top, label in fv.COMMUTE_BANDS), fv.COMMUTE_BAND_ABOVE))


def commute_cut(minutes: str) -> Column:
    """Left-open, right-closed intervals; values outside every interval are NULL."""
    return F.expr(case_sql((f"{minutes} > {lo} AND {minutes} <= {hi}", label) for lo, hi, label in fv.COMMUTE_CUTS))


def accuracy_band(pct: str) -> Column:
    return F.expr(case_sql(((f"{pct} <= {top}", label) for top, label in fv.ACCURACY_BANDS), fv.ACCURACY_BAND_ABOVE))


def error_band(pct: str) -> Column:
    widest = fv.ERROR_BANDS[-1][0]
    near = [(f"{pct} BETWEEN -{reach} AND {reach}", label) for reach, label in fv.ERROR_BANDS]
    return F.expr(case_sql([*near, (f"{pct} > {widest}", fv.ERROR_BAND_OVER)], fv.ERROR_BAND_UNDER))


def importance_band(pct: str) -> Column:
    return F.expr(case_sql(((f"{pct} >= {low}", label) for low, label in fv.IMPORTANCE_BANDS), fv.IMPORTANCE_BAND_BELOW))


def chart_class(pct: str) -> Column:
    return F.expr(case_sql([(f"{pct} > 15", "Critical (>15%)"), (f"{pct} > 5", "High (5–15%)")], "Medium (<5%)"))


def age_band_sql(build_year: str) -> str:
    return case_sql(
        (f"{build_year} IS NOT NULL" if end is None else f"{build_year} < {end}", label) for label, end in fv.AGE_BAND_END
    )


def age_band(build_year: str) -> Column:
    return F.expr(age_band_sql(build_year))


def pretty_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def is_london(region: Column) -> Column:
    return region.contains("London")


def thousands_text(amount: Column) -> Column:
    """£ text in whole thousands, e.g. ``£482k``."""
    return F.concat(F.lit("£"), F.bround(amount.cast("double") / 1000, 0).cast("bigint"), F.lit("k"))


def pounds_text(amount: Column) -> Column:
    """£ text with thousands separators, e.g. ``£482,000``."""
    return F.concat(F.lit("£"), F.format_number(F.bround(amount.cast("double"), 0), 0))


def digest(key: Column, salt) -> Column:
    """Hex digest used for every draw: it depends on the row's key only, so
    splits and samples do not change when partitions do."""
    return F.md5(F.concat_ws("-", F.lit(str(salt)), key))


def digest_int(hexdigest: Column) -> Column:
    """First 32 bits of a digest as a whole number."""
    return F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("bigint")
