"""Column tables: headered CSV or parquet in, parquet/CSV/JSON directories out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T


CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header="true", **CSV_OPTIONS)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite", header: bool = True) -> str:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=str(header).lower(), **CSV_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def register_tables(tables: Mapping[str, DataFrame]) -> None:
    """Make tables visible to ``spark.sql`` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
