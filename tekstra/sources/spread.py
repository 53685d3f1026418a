"""Reading tables so that all cores have work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a table that comes in fewer splits than there are cores and is small enough for that.

    A small file often is one row group, which one task reads. The plan's estimate of the table's bytes
    over ``maxPartitionBytes`` says how many splits a large table has anyway; such a table, of many files
    or of few, stays as it is and no byte of it is moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = df._jdf.queryExecution().sparkSession().sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    splits = max(len(df.inputFiles()), -(-size // split))
    return df.repartition(cores) if splits < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
