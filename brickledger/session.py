"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


# The JVM never compiles methods above 8,000 bytes of bytecode. Wide projections
# fused into one method exceed that and then run interpreted, so such stages are
# left to per-operator code generation, which splits its methods.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def keep_methods_compiled(spark: SparkSession) -> None:
    """Apply the method limit to a session built elsewhere."""
    spark.conf.set(*METHOD_LIMIT)


def build_session(app: str = "brickledger", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with adaptive execution on; ``conf`` wins over the defaults.

    Shuffle width is left to the cluster: with adaptive execution a generous
    ``spark.sql.shuffle.partitions`` is coalesced at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, METHOD_LIMIT[0]: METHOD_LIMIT[1], **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose executors run in the driver's own process may go
    without that setting: then a temporary folder is set, and deleted at the end.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="brickledger-")
        _file_system(spark, _own_folders[application], lambda fs, path: fs.deleteOnExit(path))
    return _own_folders[application]


def _file_system(spark: SparkSession, path: str, call):
    """``call`` with the Hadoop file system that holds ``path``, whatever store that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return call(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten. It is deleted when the driver ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path, lambda fs, at: fs.deleteOnExit(at))
    return path


class Scratch:
    """Tables that one run writes to the shared folder and reads again.

    ``store`` cuts the lineage of a table by writing it; ``drop`` deletes a table
    as soon as everything that reads it has been written. The ``with`` block
    deletes what is left. Tables behind a result that is returned unwritten stay
    until the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def path(self, name: str) -> str:
        """The path of a new table; one of the same name must have been dropped."""
        if name in self.paths:
            raise ValueError(f"scratch table {name} is still held")
        self.paths[name] = scratch_path(self.spark, name)
        return self.paths[name]

    def store(self, df: DataFrame, name: str, *spent: str) -> DataFrame:
        """Write ``df`` and read it back; the tables named in ``spent``, which only ``df`` still read, go."""
        path = self.path(name)
        df.write.parquet(path)
        self.drop(*spent)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _file_system(self.spark, self.paths.pop(name), lambda fs, at: fs.delete(at, True))


def use_checkpoints(spark: SparkSession) -> None:
    """Give iterative fits a reliable checkpoint folder, unless one is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def storage_bytes(spark: SparkSession) -> int:
    """Memory for cached rows on all executors together."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    total = 0
    while status.hasNext():
        total += int(status.next()._1())
    return total
