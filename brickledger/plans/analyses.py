"""The twelve market analyses.

Every window here runs after an aggregation, over tens of rows; medians go
through price counts (see ``operators.distribution``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brickledger.functions.scalar import (
    accuracy_band, commute_band, decode, error_band, half_up, importance_band, pct_change, ratio,
)
from brickledger.operators.distribution import (
    PRICE, mean, mean_of, percentiles, price_counts, quantile, quantiles, rows, shared, stddev_by, total,
)

c = F.col


def regional_summary(properties: DataFrame) -> DataFrame:
    counted = shared(price_counts(properties, ["region"]))
    stats = counted.groupBy("region").agg(
        rows().alias("transactions"),
        F.min(PRICE).alias("min_price"),
        quantiles([0.25, 0.5, 0.75]).alias("_q"),
        mean().alias("_mean"),
        F.max(PRICE).alias("max_price"),
    )
    spread = stddev_by(counted, ["region"], name="_std").withColumnRenamed("region", "_region")
    return stats.join(spread, c("region").eqNullSafe(c("_region")), "left").select(
        "region", "transactions", "min_price",
        half_up(c("_q")[0]).alias("p25_price"), half_up(c("_q")[1]).alias("median_price"),
        half_up(c("_mean")).alias("mean_price"), half_up(c("_q")[2]).alias("p75_price"),
        "max_price", half_up(c("_std")).alias("price_stddev"),
    ).orderBy(c("median_price").desc())


def type_by_region(properties: DataFrame) -> DataFrame:
    kinds = {"Detached": "detached", "Semi-Detached": "semi", "Terraced": "terraced", "Flat": "flat"}
    averages = properties.groupBy("region").agg(*[
        F.avg(F.when(c("property_type") == kind, c(PRICE))).alias(name) for kind, name in kinds.items()
    ])
    return averages.select(
        "region", *[half_up(c(name)).alias(f"{name}_avg") for name in kinds.values()],
        half_up(ratio(c("detached"), c("flat")), 2).alias("detached_to_flat_ratio"),
    ).orderBy(c("detached_avg").desc_nulls_last())


def epc_premium(properties: DataFrame) -> DataFrame:
    """Bands against the overall mean; the mean is added up from the band sums,
    so the table is read once."""
    bands = properties.groupBy("epc_rating").agg(
        F.count(F.lit(1)).alias("properties"), F.sum(PRICE).alias("_sum"), F.count(PRICE).alias("_n"),
        F.avg("floor_area_sqm").alias("_area"), F.avg("commute_mins").alias("_commute"),
    )
    everything = Window.partitionBy()  # seven bands
    overall = ratio(F.sum("_sum").over(everything), F.sum("_n").over(everything))
    avg_price = ratio(c("_sum"), c("_n"))
    return bands.select(
        "epc_rating", "properties", half_up(avg_price).alias("avg_price"),
        half_up(pct_change(avg_price, overall), 1).alias("pct_premium_vs_avg"),
        half_up(c("_area")).alias("avg_floor_area"), half_up(c("_commute")).alias("avg_commute_mins"),
    ).orderBy("epc_rating")


def school_effect(properties: DataFrame) -> DataFrame:
    bands = price_counts(properties, ["nearest_school_ofsted"]).groupBy("nearest_school_ofsted").agg(
        rows().alias("properties"), mean().alias("_avg"), quantile(0.5).alias("_median")
    )
    rank = decode("nearest_school_ofsted",
                  {"Outstanding": 1, "Good": 2, "Requires Improvement": 3, "Inadequate": 4})
    better = F.lag("_avg").over(Window.orderBy(rank.asc_nulls_last()))
    return bands.select(
        "nearest_school_ofsted", "properties", half_up(c("_avg")).alias("avg_price"),
        half_up(c("_median")).alias("median_price"),
        half_up(c("_avg") - better).alias("price_diff_from_better_band"),
    ).orderBy(c("avg_price").desc())


def commute_prices(properties: DataFrame) -> DataFrame:
    banded = properties.withColumn("commute_band", commute_band("commute_mins"))
    counted = banded.groupBy("commute_band", PRICE).agg(
        F.count(F.lit(1)).alias("n"), F.min("commute_mins").alias("_first"),
        F.sum("floor_area_sqm").alias("sum_floor_area_sqm"), F.count("floor_area_sqm").alias("n_floor_area_sqm"),
    )
    return counted.groupBy("commute_band").agg(
        rows().alias("properties"), half_up(mean()).alias("avg_price"),
        half_up(quantile(0.5)).alias("median_price"), half_up(mean_of("floor_area_sqm")).alias("avg_floor_area"),
        F.min("_first").alias("_first"),
    ).orderBy("_first").drop("_first")


def yearly_growth(properties: DataFrame) -> DataFrame:
    years = price_counts(properties, ["sale_year"]).groupBy("sale_year").agg(
        rows().alias("transactions"), mean().alias("_avg"), quantile(0.5).alias("_median"), total().alias("_sum")
    )
    previous = F.lag("_avg").over(Window.orderBy("sale_year"))
    return years.select(
        "sale_year", "transactions", half_up(c("_avg")).alias("avg_price"),
        half_up(c("_median")).alias("median_price"),
        half_up(pct_change(c("_avg"), previous), 1).alias("yoy_pct_change"),
        half_up(c("_sum") / 1e9, 2).alias("total_market_value_bn"),
    ).orderBy("sale_year")


def bedroom_value(properties: DataFrame, min_sales: int = 10) -> DataFrame:
    cells = properties.groupBy("property_type", "bedrooms").agg(
        half_up(F.avg(PRICE)).alias("avg_price"), F.count(F.lit(1)).alias("n")
    ).where(c("n") >= min_sales)
    fewer = F.lag("avg_price").over(Window.partitionBy("property_type").orderBy("bedrooms"))
    return cells.withColumn("marginal_bedroom_value", half_up(c("avg_price") - fewer)).orderBy(
        "property_type", "bedrooms"
    )


def accuracy_by_region(regional: DataFrame) -> DataFrame:
    return regional.select(
        "region",
        half_up(c("median_actual")).alias("median_actual_price"),
        half_up(c("median_predicted")).alias("median_predicted_price"),
        half_up(c("mae")).alias("mean_abs_error"),
        c("mae_pct").alias("mae_as_pct_of_price"),
        c("count").alias("test_transactions"),
        accuracy_band("mae_pct").alias("accuracy_band"),
    ).orderBy("mae_as_pct_of_price")


def error_distribution(predictions: DataFrame) -> DataFrame:
    bands = predictions.groupBy(error_band("error_pct").alias("error_band")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("actual_price").alias("_avg"),
        F.min(F.abs("error_pct")).alias("_nearest"),
    )
    share = ratio(c("predictions"), F.sum("predictions").over(Window.partitionBy())) * 100
    return bands.select(
        "error_band", "predictions", half_up(share, 1).alias("pct_of_total"),
        half_up(c("_avg")).alias("avg_actual_price"), "_nearest",
    ).orderBy("_nearest").drop("_nearest")


def top_decile_profile(properties: DataFrame) -> DataFrame:
    """Both segments from counts and sums per price, so sales are read and shuffled once; sales without a price are in neither."""
    marked = properties.where(c(PRICE).isNotNull()).withColumns({
        "good_epc": F.when(c("epc_rating").isin("A", "B", "C"), 1).otherwise(0),
        "good_school": F.when(c("nearest_school_ofsted").isin("Outstanding", "Good"), 1).otherwise(0),
    })
    counted = shared(price_counts(marked, [], also=[
        "bedrooms", "floor_area_sqm", "commute_mins", "good_epc", "good_school", "has_garden", "has_garage"]))
    cut = percentiles(counted, [], [0.9]).select(c("percentiles")[0].alias("p90"))  # one row
    segment = F.when(c(PRICE) >= c("p90"), "Top 10% Properties").otherwise("Bottom 90% Properties")
    return (
        counted.crossJoin(F.broadcast(cut))
        .groupBy(segment.alias("segment"))
        .agg(
            rows().alias("count"),
            half_up(mean()).alias("avg_price"),
            half_up(mean_of("bedrooms"), 1).alias("avg_bedrooms"),
            half_up(mean_of("floor_area_sqm")).alias("avg_floor_area"),
            half_up(mean_of("commute_mins")).alias("avg_commute_mins"),
            half_up(mean_of("good_epc") * 100, 1).alias("pct_good_epc"),
            half_up(mean_of("good_school") * 100, 1).alias("pct_good_school"),
            half_up(mean_of("has_garden"), 2).alias("pct_with_garden"),
            half_up(mean_of("has_garage"), 2).alias("pct_with_garage"),
        )
        .orderBy(c("segment").desc())
    )


def flood_discount(properties: DataFrame) -> DataFrame:
    counted = price_counts(properties, ["flood_risk"], also=["floor_area_sqm", "commute_mins"])
    return counted.groupBy("flood_risk").agg(
        rows().alias("properties"), half_up(mean()).alias("avg_price"),
        half_up(quantile(0.5)).alias("median_price"), half_up(mean_of("floor_area_sqm")).alias("avg_floor_area"),
        half_up(mean_of("commute_mins")).alias("avg_commute_mins"),
    ).orderBy(c("avg_price").desc())


def importance_ranking(features: DataFrame, top: int = 20) -> DataFrame:
    """Equal importances share one cumulative value (range frame)."""
    by_share = Window.orderBy(c("importance_pct").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return features.select(
        "feature", "importance_pct",
        half_up(F.sum("importance_pct").over(by_share), 1).alias("cumulative_importance_pct"),
        importance_band("importance_pct").alias("importance_band"),
    ).orderBy(c("importance_pct").desc(), "feature").limit(top)
