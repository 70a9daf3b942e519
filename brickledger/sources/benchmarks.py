"""Published benchmark tables: 12 regions each, given as fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brickledger.functions import fixed_values as fv
from brickledger.functions.regions import lookup_table


def house_price_index(spark: SparkSession) -> DataFrame:
    """Wide form: one row per region, one average price column per year."""
    rows = zip(fv.REGIONS, *[fv.HPI_AVERAGE[y] for y in fv.HPI_YEARS], fv.HPI_CHANGE_2024_PCT)
    columns = [f"avg_price_{year}" for year in fv.HPI_YEARS]
    wide = lookup_table(spark, ", ".join(["region", *columns, "hpi_annual_change_2024_pct"]), rows)
    return wide.selectExpr("region", *[f"CAST({c} AS BIGINT) AS {c}" for c in columns], "hpi_annual_change_2024_pct")


def house_price_index_long(spark: SparkSession) -> DataFrame:
    """(region, sale_year, benchmark_price), 72 rows."""
    columns = [f"avg_price_{year}" for year in fv.HPI_YEARS]
    long = house_price_index(spark).unpivot("region", columns, "column_name", "benchmark_price")
    return long.selectExpr(
        "region", "CAST(substring_index(column_name, '_', -1) AS INT) AS sale_year", "benchmark_price")


def school_outcomes(spark: SparkSession) -> DataFrame:
    rows = zip(fv.REGIONS, *[fv.SCHOOL_SHARES[band] for band in fv.SCHOOL_BANDS])
    names = ["pct_" + band.lower().replace(" ", "_") for band in fv.SCHOOL_BANDS]
    return lookup_table(spark, ", ".join(["region", *names]), rows)


def school_outcomes_long(spark: SparkSession) -> DataFrame:
    """(region, nearest_school_ofsted, published_pct), 48 rows."""
    rows = [
        (region, band, fv.SCHOOL_SHARES[band][position])
        for position, region in enumerate(fv.REGIONS)
        for band in fv.SCHOOL_BANDS
    ]
    return lookup_table(spark, "region, nearest_school_ofsted, published_pct", rows)
