"""The tables the registered queries run on, all derived from the given ones."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brickledger.functions import fixed_values as fv
from brickledger.functions.regions import lookup_table
from brickledger.functions.scalar import digest, digest_int
from brickledger.functions.valuation import with_valuation
from brickledger.operators import gram
from brickledger.operators.cleaning import clean
from brickledger.operators.features import engineer, feature_matrix
from brickledger.operators.prediction_errors import prediction_table
from brickledger.plans.mart import read_properties, write_properties
from brickledger.plans.training import importance_shares
from brickledger.session import Scratch, scratch_path
from brickledger.sources.star_schema import transactions

YEARS = fv.HPI_YEARS
_marts: dict[tuple[str, str], str] = {}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir)


def store_properties(spark: SparkSession, sf_dir: str) -> str:
    """Write the mart; later ``properties`` calls of this session read it."""
    path = write_properties(_planned(spark, sf_dir), scratch_path(spark, "properties"))
    _marts[(spark.sparkContext.applicationId, sf_dir)] = path
    return path


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw(spark, sf_dir))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _marts.get((spark.sparkContext.applicationId, sf_dir))
    return read_properties(spark, stored) if stored else _planned(spark, sf_dir)


@lru_cache(maxsize=8)
def _properties_once(application: str, sf_dir: str) -> DataFrame:
    spark = SparkSession.active()
    return Scratch(spark).store(_planned(spark, sf_dir), "properties-rows")


def properties_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``properties``, written once a session unless the mart is, for queries that read them many times."""
    application = spark.sparkContext.applicationId
    return properties(spark, sf_dir) if (application, sf_dir) in _marts else _properties_once(application, sf_dir)


def _draw(salt: str) -> Column:
    return digest_int(digest(F.col("property_id"), salt))


def predictions(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("property_id",), table: DataFrame | None = None) -> DataFrame:
    """Predicted prices between 75% and 125% of the actual price, drawn from the row key, for ``table`` or all properties."""
    predicted = F.col("price_gbp") * (75 + _draw("predict") % 51) / 100
    table = properties(spark, sf_dir) if table is None else table
    return prediction_table(table, F.col("price_gbp"), predicted, keep=keep)


def valued(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    """Properties priced by the valuation rule, within ±6% drawn from the row key.

    The given prices do not depend on the attributes, so models and premiums
    are shown on these.
    """
    draw = "CAST(conv(substring(md5(concat('noise-', property_id)), 1, 8), 16, 10) AS BIGINT)"
    return with_valuation(properties(spark, sf_dir) if table is None else table, "price_gbp", f"(1 + ({draw} % 12001 - 6000) / 100000.0D)")


@lru_cache(maxsize=8)
def _valued_once(application: str, sf_dir: str, mart: str | None) -> DataFrame:
    spark = SparkSession.active()
    return Scratch(spark).store(valued(spark, sf_dir), "valued")


def valued_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``valued``, written once a session, for queries that read it more than once: the joins behind it run a single time."""
    application = spark.sparkContext.applicationId
    return _valued_once(application, sf_dir, _marts.get((application, sf_dir)))


def importances(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    """Squared correlation of each feature with log price, as importance and share of the top 20.

    Correlations come from one pass over the cross-products; six digits are kept.
    ``table`` holds the valued rows, stored ones if it is left out.
    """
    rows = valued_stored(spark, sf_dir) if table is None else table
    matrix = feature_matrix(engineer(rows), ["log_price"])
    strengths = gram.products(matrix, [*fv.FEATURES, "log_price"]).squared_correlations("log_price")
    found = lookup_table(spark, "feature, importance", strengths.items())  # a row a feature
    return importance_shares(found.withColumn("importance", F.bround("importance", 6)))
