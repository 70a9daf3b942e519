"""From raw transactions to the property table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from brickledger import schemas
from brickledger.functions import fixed_values as fv
from brickledger.functions.scalar import age_band_sql, decode_sql
from brickledger.operators.regions import with_region


def standard_sales(raw: DataFrame) -> DataFrame:
    """Residential, standard-category sales inside the price limits."""
    return raw.where(
        F.col("property_type").isin(*fv.RESIDENTIAL_CODES)
        & (F.col("ppd_category") == fv.STANDARD_CATEGORY)
        & F.col("price").between(fv.PRICE_FLOOR, fv.PRICE_CEILING)
    )


def transfer_date_sql(raw: DataFrame) -> str:
    """Text dates are parsed leniently: unreadable ones become NULL instead of
    failing the job. Typed dates are used as they are."""
    is_text = isinstance(raw.schema["date_of_transfer"].dataType, T.StringType)
    return "try_to_timestamp(date_of_transfer)" if is_text else "date_of_transfer"


def transfer_date(raw: DataFrame) -> Column:
    return F.expr(transfer_date_sql(raw))


def new_build_sql() -> str:
    return "CAST(new_build <=> 'Y' AS INT)"


def condition_sql(raw: DataFrame) -> str:
    given = "condition" if "condition" in raw.columns else "CAST(NULL AS STRING)"
    return f"CASE WHEN new_build <=> 'Y' THEN 'New Build' ELSE {given} END"


def to_properties(raw: DataFrame, region_mode: str = "area") -> DataFrame:
    """Labels, dates, region and flags; attributes the input lacks stay NULL.

    The identifier is taken from the transaction's own key: unique and stable
    without numbering rows across partitions.
    """
    date = transfer_date_sql(raw)
    derived = {
        "property_id": "concat('LR', transaction_id)",
        "property_type": decode_sql("property_type", fv.TYPE_LABELS),
        "tenure": decode_sql("tenure", fv.TENURE_LABELS, "Unknown"),
        "price_gbp": "price",
        "sale_year": f"year({date})",
        "sale_month": f"month({date})",
        "sale_quarter": f"quarter({date})",
        "is_new_build": new_build_sql(),
        "condition": condition_sql(raw),
        "has_garden": "CAST(coalesce(property_type IN ('D', 'S', 'T'), false) AS INT)",
        "has_parking": "CAST(coalesce(property_type IN ('D', 'S'), false) AS INT)",
        "density": decode_sql("region", fv.DENSITY),
    }
    if "build_year" in raw.columns:
        derived["property_age"] = f"year({date}) - build_year"
        derived["age_band"] = age_band_sql("build_year")
    placed = with_region(raw, region_mode).where(F.col("region") != fv.UNRESOLVED_REGION)
    columns = [
        f"CAST({derived.get(f.name) or (f.name if f.name in placed.columns else 'NULL')} AS {f.dataType.simpleString()}) "
        f"AS {f.name}"
        for f in schemas.CLEANED.fields
    ]
    return placed.selectExpr(*columns)


def clean(raw: DataFrame, region_mode: str = "area", years=None) -> DataFrame:
    properties = to_properties(standard_sales(raw), region_mode)
    if years is not None:
        properties = properties.where(F.col("sale_year").isin(*years))
    return properties
