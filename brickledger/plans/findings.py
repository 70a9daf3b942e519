"""Headline figures and run summaries, each from one scan over the sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickledger.functions.scalar import half_even, half_up, pounds_text, ratio
from brickledger.operators.distribution import PRICE, mean, price_counts, quantile, rows, segment_medians

c = F.col


def _only(column: str, *values) -> Column:
    return F.when(c(column).isin(*values), c(column))


def headline_findings(properties: DataFrame) -> DataFrame:
    """One row of gaps, ratios and changes between segment medians.

    The segments are counted in a single scan; the sixteen medians are then
    spread to columns.
    """
    segments = {
        "commute": F.when(c("commute_mins") <= 15, "near").when(c("commute_mins") > 75, "far"),
        "epc": _only("epc_rating", "A", "G"),
        "school": _only("nearest_school_ofsted", "Outstanding", "Inadequate"),
        "type": _only("property_type", "Detached", "Flat"),
        "year": _only("sale_year", 2019, 2022, 2023, 2024),
        "region": _only("region", "London - Inner", "North East"),
    }
    medians = segment_medians(properties, segments)

    def m(dimension: str, segment) -> Column:
        hit = (c("dimension") == dimension) & (c("segment") == str(segment))
        return F.max(F.when(hit, c("median_price")))

    def change(new, old) -> Column:
        return half_up((ratio(m("year", new), m("year", old)) - 1) * 100, 1)

    return medians.agg(
        m("commute", "near").alias("median_within_15_min"),
        m("commute", "far").alias("median_beyond_75_min"),
        (m("epc", "A") - m("epc", "G")).alias("epc_a_minus_g"),
        (m("school", "Outstanding") - m("school", "Inadequate")).alias("school_best_minus_worst"),
        m("type", "Detached").alias("median_detached"),
        m("type", "Flat").alias("median_flat"),
        half_up(ratio(m("type", "Detached"), m("type", "Flat")), 1).alias("detached_to_flat"),
        m("year", 2022).alias("median_2022"),
        change(2022, 2019).alias("pct_2022_vs_2019"),
        m("year", 2023).alias("median_2023"),
        change(2023, 2022).alias("pct_2023_vs_2022"),
        m("year", 2024).alias("median_2024"),
        change(2024, 2023).alias("pct_2024_vs_2023"),
        m("region", "London - Inner").alias("median_inner_london"),
        m("region", "North East").alias("median_north_east"),
        half_up(ratio(m("region", "London - Inner"), m("region", "North East")), 1).alias("inner_london_to_north_east"),
    )


def ingest_summary(properties: DataFrame) -> DataFrame:
    """Row count, years, regions and medians by region and type, as (section, item, ...) rows."""
    medians = segment_medians(properties, {
        "total": F.lit("all"), "year": c("sale_year"), "region": c("region"), "type": c("property_type"),
    })
    return medians.select(
        c("dimension").alias("section"), c("segment").alias("item"), "transactions", "median_price",
        pounds_text(c("median_price")).alias("median_text"),
    )


def distinct_levels(properties: DataFrame) -> DataFrame:
    """Number of regions and the sorted years."""
    levels = properties.select("region", "sale_year").distinct()
    return levels.agg(
        F.countDistinct("region").alias("regions"),
        F.array_join(F.sort_array(F.collect_set("sale_year")), ",").alias("years"),
    )


def regional_statistics(properties: DataFrame) -> DataFrame:
    """Count, median, mean, minimum and maximum per region in whole pounds."""
    return price_counts(properties, ["region"]).groupBy("region").agg(
        rows().alias("count"), half_even(quantile(0.5)).alias("median"), half_even(mean()).alias("mean"),
        F.min(PRICE).alias("min"), F.max(PRICE).alias("max"),
    ).orderBy("region")
