"""Incremental ingest: transaction files that were already taken in are skipped.

The cleaning plan has no state, so it runs unchanged on a stream of files. The
file source remembers processed files in its checkpoint; each run takes in what
is new and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brickledger.operators.cleaning import clean
from brickledger.schemas import PRICE_PAID
from brickledger.sources.price_paid import CSV_OPTIONS


def stream_price_paid(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PRICE_PAID).options(**CSV_OPTIONS, pathGlobFilter="*.csv").csv(folder)


def ingest_new_files(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                     region_mode: str = "area", years=None) -> StreamingQuery:
    """Append the properties of all unseen files to a table partitioned by sale year."""
    properties = clean(stream_price_paid(spark, folder), region_mode, years)
    return (
        properties.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("sale_year")
        .trigger(availableNow=True)
        .start()
    )
