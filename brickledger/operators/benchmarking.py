"""Sales against published regional benchmarks.

The benchmark tables are fixed values of 72 and 48 rows, so they are always
broadcast; the sales are aggregated before they meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brickledger.functions.scalar import half_up, pct_change, ratio
from brickledger.functions import fixed_values as fv
from brickledger.sources.benchmarks import house_price_index, house_price_index_long, school_outcomes_long


def against_price_index(properties: DataFrame) -> DataFrame:
    """Each sale with the index average of its region and year."""
    index = F.broadcast(house_price_index_long(properties.sparkSession))
    joined = properties.join(index, ["region", "sale_year"], "left")
    premium = half_up(pct_change(F.col("price_gbp"), F.col("benchmark_price")), 1)
    return joined.withColumn("pct_vs_benchmark", premium)


def price_index_gap(properties: DataFrame) -> DataFrame:
    """Average price per region and year next to the index average.

    Every published region and year has a row: without a sale it counts 0.
    """
    index = house_price_index_long(properties.sparkSession)
    observed = properties.groupBy("region", "sale_year").agg(
        F.count(F.lit(1)).alias("transactions"), F.avg("price_gbp").alias("_avg")
    )
    return observed.join(index, ["region", "sale_year"], "full").select(
        "region", "sale_year", F.coalesce("transactions", F.lit(0)).alias("transactions"), half_up(F.col("_avg")).alias("avg_price"), "benchmark_price",
        half_up(pct_change(F.col("_avg"), F.col("benchmark_price")), 1).alias("pct_vs_benchmark"),
    )


def annual_change_gap(properties: DataFrame, year: int = fv.HPI_YEARS[-1]) -> DataFrame:
    """Change of each region's average price on the year before next to the published change.

    ``index_change_pct`` is the change of the published averages, which rounding
    and revisions keep from being the published change itself. Every published
    region has a row; without sales in either year the observed change is NULL.
    """
    c = F.col
    columns = [f"avg_price_{year - 1}", f"avg_price_{year}"]
    published = house_price_index(properties.sparkSession).select("region", *columns, c(f"hpi_annual_change_{year}_pct").cast("double").alias("published_change_pct"))
    observed = properties.where(c("sale_year").isin(year - 1, year)).groupBy("region").agg(
        *[F.avg(F.when(c("sale_year") == y, c("price_gbp"))).alias(f"_avg_{y}") for y in (year - 1, year)])
    change = pct_change(c(f"_avg_{year}"), c(f"_avg_{year - 1}"))
    return observed.join(published, "region", "full").select(
        "region", half_up(c(f"_avg_{year - 1}")).alias("avg_before"), half_up(c(f"_avg_{year}")).alias("avg_price"),
        half_up(change, 1).alias("observed_change_pct"), half_up(pct_change(c(columns[1]), c(columns[0])), 1).alias("index_change_pct"),
        "published_change_pct", half_up(change - c("published_change_pct"), 1).alias("gap_points"))


def school_mix_gap(properties: DataFrame) -> DataFrame:
    """Observed share of each school band per region next to the published share.

    Every published region and band has a row: without a sale it counts 0.
    """
    published = school_outcomes_long(properties.sparkSession)
    cells = properties.groupBy("region", "nearest_school_ofsted").agg(F.count(F.lit(1)).alias("properties"))
    totals = cells.groupBy("region").agg(F.sum("properties").alias("_all"))
    share = ratio(F.col("properties"), F.col("_all")) * 100
    return (
        cells.join(published, ["region", "nearest_school_ofsted"], "full")
        .withColumn("properties", F.coalesce("properties", F.lit(0)))
        .join(totals, "region", "left")
        .select("region", "nearest_school_ofsted", "properties", half_up(share, 1).alias("observed_pct"),
                "published_pct", half_up(share - F.col("published_pct"), 1).alias("gap_points"))
    )
