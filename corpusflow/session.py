"""Session construction and the shared folder used for lineage cuts and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusflow", cpus: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session the cluster gives you."""
    cpus = cpus or os.cpu_count() or 1
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "8g",
        **(conf or {}),
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a folder that one
    machine sees cannot survive the loss of that machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="corpusflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def spread_small(df: DataFrame, path: str) -> DataFrame:
    """Rows of a small input dealt out to all cores, for row-wise work that costs more than a shuffle of it.

    A small file is one scan task however many cores there are. An input of at least one full split per core
    already keeps them all busy and is returned as it is, as is one of at least one file per core: large text is never
    shuffled for this.
    """
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    held = files.getContentSummary(folder)
    return df.repartition(cores) if held.getFileCount() < cores and held.getLength() < cores * split else df


def text_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Rows go to Python in batches of at most so many bytes: the other setting counts rows, however long their texts.

    A worker's memory then follows this bound, and not how many rows a task has.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(str(spark.conf.get(name)).strip()) <= most_bytes:
        spark.conf.set(name, str(most_bytes))


def _bytes(size: str) -> int:
    digits = size.lower().rstrip("bkmgt")
    return int(digits) * {"": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}[size.lower().rstrip("b")[len(digits):]]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result is read back from the shared folder, also after an executor is lost."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/corpusflow/{name}-{uuid.uuid4().hex}"
