"""Model features: encodings, interactions, composites and logs, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brickledger.functions import fixed_values as fv
from brickledger.functions.regions import lookup_table
from brickledger.functions.scalar import decode_sql, literal
from brickledger.operators.distribution import PRICE, median_by

REGION_INDEX = "region_price_index"
TARGET = "log_price"

ORDINAL_SCORES = {
    "epc_score": decode_sql("epc_rating", fv.EPC_SCORE),
    "school_score": decode_sql("nearest_school_ofsted", fv.SCHOOL_SCORE),
    "condition_score": decode_sql("condition", fv.CONDITION_SCORE),
    "flood_score": decode_sql("flood_risk", fv.FLOOD_SCORE),
    "age_band_score": decode_sql("age_band", fv.AGE_BAND_SCORE),
}

# an unknown type or tenure counts as 0
INDICATOR_FLAGS = {
    **{"type_" + kind.lower().replace("-", "_"): f"CAST(property_type <=> {literal(kind)} AS INT)"
       for kind in fv.PROPERTY_TYPES},
    "is_freehold": "CAST(tenure <=> 'Freehold' AS INT)",
}

_URBAN = "CAST(density <=> 'urban' AS INT)"
_SOFTENED_BEDS = "(bedrooms + 0.1D)"  # never zero for real room counts
INTERACTIONS = {
    "bed_area": "bedrooms * floor_area_sqm",
    "school_x_density": f"school_score * {_URBAN}",
    "commute_x_urban": f"commute_mins * {_URBAN}",
    "age_x_condition": "property_age * condition_score",
    "epc_x_age": "epc_score * age_band_score",
    "bath_bed_ratio": f"bathrooms / {_SOFTENED_BEDS}",
    "area_per_bed": f"floor_area_sqm / {_SOFTENED_BEDS}",
}

COMPOSITES = {
    "amenity_score": "has_garden * 3 + has_parking * 2 + has_garage * 2 + school_score + epc_score",
    "location_score": f"{REGION_INDEX} / 100 - commute_mins / 60 - dist_to_centre_km / 30 - crime_index / 100 "
                      "- flood_score * 0.1D",
}

LOGS_AND_TIME = {
    TARGET: f"log1p(CAST({PRICE} AS DOUBLE))",
    "log_floor_area": "log1p(CAST(floor_area_sqm AS DOUBLE))",
    "log_dist_centre": "log1p(dist_to_centre_km)",
    "log_dist_station": "log1p(dist_to_station_km)",
    "years_from_2019": f"sale_year - {fv.BASE_YEAR}",
}


def _add(df: DataFrame, *groups: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{text} AS {name}" for group in groups for name, text in group.items()])


#: Regions up to which the index is put into the plan as fixed rows.
FEW_REGIONS = 10_000


def region_index(fitted_on: DataFrame) -> DataFrame:
    """Median price in thousands of every region found in the data, and of the 12 known ones.

    A known region without sales has a NULL index. Sales without a region count for none.
    """
    domain = lookup_table(fitted_on.sparkSession, "region", [(r,) for r in fv.REGIONS])
    medians = median_by(fitted_on.where("region IS NOT NULL"), ["region"], name="_median")
    return domain.join(medians, "region", "full").selectExpr("region", f"_median / 1000 AS {REGION_INDEX}")


def with_region_index(df: DataFrame, fitted_on: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Attach the regional index: ``index`` as stored, or fitted on ``fitted_on`` (or on ``df`` itself).

    The index is worked out first. Up to ``FEW_REGIONS`` of its rows go into the
    plan as fixed rows, so the large table is not shuffled to meet them; with more
    regions Spark joins the two tables as their sizes demand.
    """
    if index is None:
        index = region_index(df if fitted_on is None else fitted_on)
    rows = [tuple(r) for r in index.select("region", REGION_INDEX).limit(FEW_REGIONS + 1).collect()]
    if len(rows) <= FEW_REGIONS:
        index = lookup_table(df.sparkSession, f"region, {REGION_INDEX}", rows).selectExpr("region", f"CAST({REGION_INDEX} AS DOUBLE) AS {REGION_INDEX}")
        return df.join(F.broadcast(index), "region", "left")
    return df.join(index, "region", "left")


def engineer(df: DataFrame, fitted_on: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """All feature columns and the log target next to the input columns.

    The regional index is worked out at once, the features when they are read. ``fitted_on`` should be the training rows; leaving it out fits the regional
    index on every row, test rows included. A stored ``index`` is used as it is.
    """
    encoded = _add(with_region_index(df, fitted_on, index), ORDINAL_SCORES, INDICATOR_FLAGS)
    return _add(encoded, INTERACTIONS, COMPOSITES, LOGS_AND_TIME)


def feature_matrix(engineered: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The features in training order as doubles; missing values become 0 here, and only here."""
    filled = [f"coalesce(CAST({name} AS DOUBLE), 0.0D) AS {name}" for name in fv.FEATURES]
    return engineered.selectExpr(*(keep or []), *filled)
