"""Residuals, accuracy measures and accuracy by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickledger.functions.scalar import accuracy_band, half_even, ratio, to_long
from brickledger.operators.distribution import percentiles, price_counts, shared

ATTRIBUTES = ("region", "property_type", "bedrooms", "floor_area_sqm", "sale_year")


def prediction_table(scored: DataFrame, actual: Column, predicted: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole-pound prices with their residuals; attributes travel with the row, so nothing is joined back."""
    priced = scored.select(
        *keep, to_long(half_even(actual)).alias("actual_price"), to_long(half_even(predicted)).alias("predicted_price"),
        *ATTRIBUTES,
    )
    error = F.col("predicted_price") - F.col("actual_price")
    return priced.withColumns({
        "error_gbp": error,
        "error_pct": half_even(ratio(error, F.col("actual_price")) * 100, 1),
        "abs_error": F.abs(error),
    })


def model_measures(scored: DataFrame, actual: Column, predicted: Column, *by: str) -> DataFrame:
    """R², RMSE, MAE and MAPE in one pass, as one row, or one per group."""
    a, p = actual.cast("double"), predicted.cast("double")
    error = a - p
    mse = F.avg(error * error)
    return scored.groupBy(*by).agg(
        (1 - mse / F.nullif(F.var_pop(a), F.lit(0.0))).alias("r2"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(ratio(error, a))) * 100).alias("mape"),
    )


def rounded_measures(measures: DataFrame) -> DataFrame:
    digits = {"r2": 4, "rmse": 0, "mae": 0, "mape": 2}
    kept = [c for c in measures.columns if c not in digits]
    return measures.select(*kept, *[half_even(F.col(c), d).alias(c) for c, d in digits.items()])


def regional_accuracy(predictions: DataFrame) -> DataFrame:
    """MAE, count and medians per region.

    Actual and predicted prices are stacked and counted in one pass. Predicted
    prices have no limits, so the medians are selected by rank.
    """
    c = F.col
    kinds = F.array(
        F.struct(F.lit(True).alias("sold"), c("actual_price").alias("price"), c("abs_error")),
        F.struct(F.lit(False).alias("sold"), c("predicted_price").alias("price"), F.when(F.lit(False), c("abs_error")).alias("abs_error")),
    )
    stacked = predictions.where(c("region").isNotNull()).select("region", F.explode(kinds).alias("kind")).select("region", "kind.*")
    counted = shared(price_counts(stacked, ["region", "sold"], "price", also=["abs_error"]))
    sums = counted.groupBy("region").agg(
        ratio(F.sum("sum_abs_error"), F.sum("n_abs_error")).alias("mae"),
        F.sum(F.when(c("sold") & c("price").isNotNull(), c("n"))).alias("count"),
    )
    middle = percentiles(counted, ["region", "sold"], [0.5], "price").groupBy("region").agg(
        F.max(F.when(c("sold"), c("percentiles")[0])).alias("median_actual"),
        F.max(F.when(~c("sold"), c("percentiles")[0])).alias("median_predicted"),
    )
    return sums.join(middle, "region", "left").withColumn(
        "mae_pct", half_even(ratio(F.col("mae"), F.col("median_actual")) * 100, 1))


def filter_predictions(predictions: DataFrame, region: str | None = None, property_type: str | None = None,
                       band: str | None = None) -> DataFrame:
    """Prediction rows by region, type and accuracy band; a NULL argument does not filter."""
    banded = predictions.withColumn("accuracy_band", accuracy_band("abs(error_pct)"))
    for column, wanted in (("region", region), ("property_type", property_type), ("accuracy_band", band)):
        if wanted is not None:
            banded = banded.where(F.col(column) == wanted)
    return banded
