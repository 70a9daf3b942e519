"""Rule-based price of a property from its attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brickledger.functions import fixed_values as fv
from brickledger.functions.scalar import decode_sql

_FLOOR_GBP = 50_000
_FACTORS = (
    ("property_type", fv.TYPE_FACTOR), ("tenure", fv.TENURE_FACTOR), ("condition", fv.CONDITION_FACTOR),
    ("epc_rating", fv.EPC_FACTOR), ("nearest_school_ofsted", fv.SCHOOL_FACTOR),
)


def _factor(column: str, values: dict) -> str:
    return decode_sql(column, {key: float(value) for key, value in values.items()})


def price_level_sql() -> str:
    """Regional base price grown to the sale year and adjusted for it; NULL for a region or year outside the tables."""
    growth = f"pow(1 + {_factor('region', fv.YEARLY_GROWTH)}, sale_year - {fv.BASE_YEAR})"
    return f"({_factor('region', fv.BASE_PRICE)} * {growth} * {_factor('sale_year', fv.YEAR_FACTOR)})"


def attribute_factor_sql(level: str) -> str:
    """The level times one factor per attribute; a category outside the tables gives NULL."""
    parts = [
        level,
        *[_factor(column, values) for column, values in _FACTORS],
        "(1 + (bedrooms - 3) * 0.08D)",
        "(1 + (floor_area_sqm - 100) / 1000.0D)",
        "greatest(0.70D, 1 - commute_mins * 0.003D)",
        *[f"CASE WHEN {owned} = 1 THEN {factor}D ELSE 1.0D END"
          for owned, factor in (("has_garden", 1.06), ("has_parking", 1.03), ("has_garage", 1.04))],
        "(1 - crime_index * 0.001D)",
        _factor("flood_risk", fv.FLOOD_FACTOR),
        "CASE WHEN age_band = 'Pre-1900' THEN 1.04D WHEN property_age > 50 THEN 0.96D ELSE 1.0D END",
    ]
    return " * ".join(parts)


def with_valuation(properties: DataFrame, name: str = "valuation_gbp", wobble: str = "1.0D") -> DataFrame:
    """Attach the valuation: floored, in whole thousands (ties to even).

    ``wobble`` is an SQL factor applied before rounding. A region, year or
    category outside the tables gives NULL.
    """
    kept = [c for c in properties.columns if c != name]
    valued = properties.selectExpr(
        *[f"`{c}`" for c in kept], f"{attribute_factor_sql(price_level_sql())} * {wobble} AS _value"
    )
    # a step of its own, so that the long product is computed once
    price = f"CASE WHEN _value IS NOT NULL THEN CAST(bround(greatest({_FLOOR_GBP}.0D, _value) / 1000, 0) * 1000 AS BIGINT) END"
    return valued.selectExpr(*[f"`{c}`" for c in kept], f"{price} AS `{name}`")
