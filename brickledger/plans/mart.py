"""The property table as a stored mart.

Analyses and training all start from the same cleaned table. Writing it once,
partitioned by sale year, spares every later run the joins behind it; readers
then get column pruning and year pruning from the file layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from brickledger import schemas
from brickledger.sources.tables import read_table, write_table


def write_properties(properties: DataFrame, path: str) -> str:
    """Rebalancing evens out file sizes and splits oversized years."""
    return write_table(properties.hint("rebalance", "sale_year"), path, partition_by=["sale_year"])


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    stored = T.StructType(sorted(schemas.CLEANED.fields, key=lambda f: f.name == "sale_year"))
    return read_table(spark, path, stored)
