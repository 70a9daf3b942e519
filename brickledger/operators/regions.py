"""Region of a sale from its county, district and postcode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brickledger.functions import fixed_values as fv
from brickledger.functions.regions import clean_name_sql, place_name_sql, place_region_sql, start_rank_region_sql, start_rank_sql

_LONGEST_START = 3


def _postcode_keys(mode: str) -> list[str]:
    """Postcode texts to look up, most decisive first.

    Areas are the letters before the first digit; a London district adds its
    number. Prefix mode tries plain starts of one to three characters, and a
    missing postcode reads as the text NAN.
    """
    if mode == "area":
        # without the inward part, a digit and two letters, which may follow without a space
        code = f"regexp_replace({clean_name_sql('postcode')}, ' *[0-9][A-Z][A-Z]$', '')"
        return [f"regexp_extract({code}, '^([A-Z]{{1,2}}[0-9]{{1,2}})', 1)", f"regexp_extract({code}, '^([A-Z]{{1,2}})[0-9]', 1)"]
    code = clean_name_sql("coalesce(postcode, 'nan')")
    return [f"substring({code}, 1, {size})" for size in range(1, _LONGEST_START + 1)]


def with_region(sales: DataFrame, mode: str = "area") -> DataFrame:
    """Attach ``region``: county first, then district, then postcode.

    Each step is a lookup in a constant map of at most 121 entries, taken only
    if the one before found nothing. All of it is one expression: joins with the
    fixed tables would copy each wide row several times. ``mode="area"``
    reads whole postcode areas; ``mode="prefix"`` keeps the ordered prefix
    semantics, where the earliest region with a matching start wins and a
    one-letter start also claims longer areas (NG goes to N).
    """
    if mode not in ("area", "prefix"):
        raise ValueError(f"unknown region mode: {mode}")
    ranks = ", ".join(start_rank_sql(key) for key in _postcode_keys(mode))
    # a district code only decides where it is listed itself (inner London);
    # otherwise its area does. Prefixes of any length compete by rank.
    rank = f"coalesce({ranks})" if mode == "area" else f"least({ranks})"
    named = ", ".join(place_region_sql(place_name_sql(name)) for name in ("county", "district"))
    region = f"coalesce({named}, {start_rank_region_sql(rank)}, '{fv.UNRESOLVED_REGION}') AS region"
    return sales.selectExpr(*[f"`{c}`" for c in sales.columns if c != "region"], region)
