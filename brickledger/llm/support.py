"""What the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brickledger.session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it lies.

    Same effect as ``spark.executorEnv.PYTHONPATH``. On a cluster the package is
    passed with ``--py-files`` or installed on the nodes.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if spark.sparkContext.master.startswith("local") and ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, width: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if the measured sum of ``width`` (bytes a row) is within the limit.

    Beyond it there is no hint: Spark sorts and merges, and splits hot keys.
    """
    total = df.agg(F.sum(width.cast("bigint"))).collect()[0][0] or 0
    return F.broadcast(df) if total <= limit else df


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` with ``work`` called on small record batches.

    Spark hands over up to ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows
    at once; ``work`` gets slices of at most 512 rows, so what it holds besides
    the batch stays small however the session is set.
    """
    reach_workers(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield from work(batch.slice(start, 512))

    return df.mapInArrow(run, schema)


def rows_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def bit_count(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)
