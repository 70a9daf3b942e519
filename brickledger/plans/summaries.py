"""Small summaries of the sales that are stored once and merged at query time.

One row per region and year holds the counts and limits of the price, its
moments, a quantile sketch of it and a sketch of its distinct places. Rows of
any set of regions and years merge into one, so a question about a region, a
year or the whole market reads a few hundred small rows and no sales.

Counts, limits and moments are exact. Quantiles have a rank error of at most
``RANK_ERROR`` and distinct counts a relative error of at most ``DISTINCT_ERROR``,
each in 99 of 100 cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickledger.operators.distribution import PRICE, deviation_of, merge_moments, moment_states, price_counts, shared
from brickledger.sources.tables import write_table

KEYS = ["region", "sale_year"]
SKETCH_SIZE = 800
RANK_ERROR = 0.006
LOG_REGISTERS = 13
DISTINCT_ERROR = 0.03


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables with one row per group each; NULL is a group like any other."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])


def price_summaries(properties: DataFrame, keys: list[str] | None = None, place: str = "postcode") -> DataFrame:
    """One row per group: ``transactions``, ``low``, ``high``, ``n``, ``mean``, ``m2``, ``prices`` and ``places`` (sketches).

    Sales without a price count in ``transactions`` only.
    """
    keys = KEYS if keys is None else keys
    basics = properties.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transactions"), F.min(PRICE).alias("low"), F.max(PRICE).alias("high"),
        F.kll_sketch_agg_bigint(PRICE, F.lit(SKETCH_SIZE)).alias("prices"), F.hll_sketch_agg(place, F.lit(LOG_REGISTERS)).alias("places"))
    counted = shared(price_counts(properties, keys))
    return _joined(basics, merge_moments(moment_states(counted, keys), keys), keys)


def write_summaries(summaries: DataFrame, path: str) -> str:
    return write_table(summaries.coalesce(1), path)  # a row a region and year


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of larger groups, of the same columns; the order of the rows does not matter."""
    basics = summaries.groupBy(*keys).agg(
        F.sum("transactions").alias("transactions"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_bigint("prices", F.lit(SKETCH_SIZE)).alias("prices"), F.hll_union_agg("places").alias("places"))
    return _joined(basics, merge_moments(summaries.where("n > 0"), keys), keys)


def figures(summaries: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """Readable figures per group: count, limits, mean, deviation, approximate quantiles (array) and distinct places."""
    c = F.col
    return summaries.select(
        *keys, "transactions", c("low").alias("min_price"), c("high").alias("max_price"), c("mean").alias("mean_price"),
        deviation_of(c("n"), c("m2")).alias("price_stddev"),
        F.when(c("n") > 0, F.array(*[F.kll_sketch_get_quantile_bigint("prices", F.lit(p)) for p in ps])).alias("quantiles"),
        F.hll_sketch_estimate("places").alias("places"))


def rank_errors(figured: DataFrame, properties: DataFrame, ps: list[float], keys: list[str]) -> DataFrame:
    """(keys, quantile, rank_error): how far each approximate quantile lies from its place among the sales, as a share of them."""
    c = F.col
    listed = figured.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), c("quantiles").alias("q"))).alias("e")).select(
        *keys, c("e.p").alias("quantile"), c("e.q").alias("found"))
    counted = price_counts(properties.where(c(PRICE).isNotNull()), keys)
    # a row a group and quantile on one side, counts per price on the other
    both = counted.join(F.broadcast(listed), keys)
    placed = both.groupBy(*keys, "quantile").agg(
        F.sum("n").alias("_n"), F.sum(F.when(c(PRICE) < c("found"), c("n")).otherwise(0)).alias("_below"),
        F.sum(F.when(c(PRICE) <= c("found"), c("n")).otherwise(0)).alias("_up_to"))
    off = F.greatest(F.lit(0.0), c("_below") / c("_n") - c("quantile"), c("quantile") - c("_up_to") / c("_n"))
    return placed.select(*keys, "quantile", off.alias("rank_error"))
