"""Tables in partition folders: a write replaces the partitions it holds rows of, and no others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "batch_id"


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Dynamic partition overwrite: one job for all partitions, whose files adaptive rebalancing sizes.

    Partitions without rows in ``df`` are neither read nor rewritten. New files are staged and moved when the job ends.
    """
    (df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one micro-batch as its own partition; a replayed batch replaces it and nothing else."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch}")


def read_partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows, partition columns included; no rows where nothing was written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; grouped maximum, so repeats meet before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")
