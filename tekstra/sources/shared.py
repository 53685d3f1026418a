"""Tables that cut lineage: written to the folder that all machines share, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none, a local master gets a temporary one, as in tests; on a cluster that is an error, as machines don't share theirs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tekstra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """The table, computed once, however many branches use it; later stages survive lost executors."""
    path = new_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str = "tekstra") -> str:
    """A path in the shared folder that ``forget`` will delete."""
    _STORED.append(f"{shared(spark)}/{name}-{uuid.uuid4().hex}")
    return _STORED[-1]


def stored_since(mark: list[str] | None = None) -> list[str]:
    """The tables stored now; or those of them that aren't in an earlier such list."""
    return [path for path in _STORED if path not in (mark or ())]


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes these tables of the process, or all that it has stored; results that were made of them must be written by then."""
    for path in paths or tuple(_STORED):
        _STORED.remove(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
