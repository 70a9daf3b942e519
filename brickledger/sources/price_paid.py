"""Transaction files: headerless CSV with a fixed set of 16 columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from brickledger.schemas import PRICE_PAID

CSV_OPTIONS = {"header": "false", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


YEAR_FILE = "pp-{year}.csv"


def yearly_paths(spark: SparkSession, folder: str, years: Iterable[int], pattern: str = YEAR_FILE) -> list[str]:
    """The yearly files (or directories) that exist; absent years are skipped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    present = []
    for year in years:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern.format(year=year)}")
        if path.getFileSystem(conf).exists(path):
            present.append(path.toString())
    return present


def read_price_paid(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One scan over all given files, so filters apply inside every split."""
    if not paths:
        raise FileNotFoundError("no transaction files for the requested years")
    return spark.read.schema(PRICE_PAID).options(**CSV_OPTIONS).csv(paths)


def read_years(spark: SparkSession, folder: str, years: Iterable[int], pattern: str = YEAR_FILE) -> DataFrame:
    return read_price_paid(spark, yearly_paths(spark, folder, years, pattern))
