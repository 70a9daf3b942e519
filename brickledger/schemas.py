"""Explicit schemas: nothing in the library infers types."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

PRICE_PAID = _schema(
    ("transaction_id", S), ("price", L), ("date_of_transfer", S), ("postcode", S),
    ("property_type", S), ("new_build", S), ("tenure", S), ("paon", S), ("saon", S),
    ("street", S), ("locality", S), ("town", S), ("district", S), ("county", S),
    ("ppd_category", S), ("record_status", S),
)

PROPERTIES = _schema(
    ("property_id", S), ("postcode", S), ("region", S), ("property_type", S), ("tenure", S),
    ("bedrooms", I), ("bathrooms", I), ("floor_area_sqm", I), ("build_year", I),
    ("property_age", I), ("age_band", S), ("condition", S), ("epc_rating", S),
    ("nearest_school_ofsted", S), ("has_garden", I), ("has_parking", I), ("has_garage", I),
    ("commute_mins", I), ("dist_to_station_km", D), ("dist_to_centre_km", D),
    ("crime_index", D), ("flood_risk", S), ("sale_year", I), ("density", S), ("price_gbp", L),
)

# Columns that only cleaned transaction files carry.
TRANSACTION_EXTRAS = _schema(
    ("sale_month", I), ("sale_quarter", I), ("is_new_build", I), ("town", S), ("county", S),
)

CLEANED = T.StructType(PROPERTIES.fields + TRANSACTION_EXTRAS.fields)

PREDICTIONS = _schema(
    ("actual_price", L), ("predicted_price", L), ("region", S), ("property_type", S),
    ("bedrooms", I), ("floor_area_sqm", I), ("sale_year", I), ("error_gbp", L),
    ("error_pct", D), ("abs_error", L),
)

FEATURE_IMPORTANCE = _schema(("feature", S), ("importance", D), ("importance_pct", D))

REGIONAL = _schema(
    ("region", S), ("mae", D), ("count", L), ("median_actual", D),
    ("median_predicted", D), ("mae_pct", D),
)

MODEL_COMPARISON = _schema(("model", S), ("r2", D), ("rmse", D), ("mae", D), ("mape", D))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order and cast; a missing column becomes NULL."""
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])
