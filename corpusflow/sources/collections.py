"""Chunk collections: upsert, prune, diff, and versioned publication.

A stored collection is hashed by key into buckets. A write adds a folder with the buckets it changes, and a
commit record that names the folder of every bucket. Readers follow the newest readable record, so a
collection can be queried while it is rewritten, a job that dies leaves it as it was, and an upsert rewrites
only the buckets its keys fall into.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import MIN_SUCCESS_RATIO
from corpusflow.session import cut_lineage

BUCKETS = 64
BUCKET = "_bucket"


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str] = ("id",), order: str | None = None) -> DataFrame:
    """Rows of `target` replaced or extended by `source`; applying it twice changes nothing.

    A key that `source` repeats is stored once: its row with the greatest `order`, or one of its rows without it.
    """
    if order is None:
        source = source.dropDuplicates(list(keys))
    else:
        newest = source.groupBy(*keys).agg(F.max_by(F.struct(*source.columns), order).alias("_row"))
        source = newest.select("_row.*")
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def prune(target: DataFrame, live: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows whose key is live."""
    return target.join(live.select(*keys), list(keys), "left_semi")


def stale(target: DataFrame, live: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows that `prune` removes."""
    return target.join(live.select(*keys), list(keys), "left_anti")


def corpus_diff(old: DataFrame, new: DataFrame, key: str = "id", content: str = "hash") -> DataFrame:
    """State of every id between two snapshots: added, removed, changed or kept."""
    before = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_was"))
    after = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_is"))
    state = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "kept").otherwise("changed")
    )
    return before.join(after, key, "full_outer").select(key, state.alias("state"))


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    return hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _commits(spark: SparkSession, root: str) -> list[str]:
    fs, hadoop = _file_system(spark, root)
    log = hadoop.fs.Path(f"{root}/_commits")
    return sorted(s.getPath().toString() for s in fs.listStatus(log)) if fs.exists(log) else []


def _state(spark: SparkSession, root: str, commits: list[str]) -> dict | None:
    """Newest readable commit record; a record cut off by a crash does not count."""
    fs, hadoop = _file_system(spark, root)
    for path in reversed(commits):
        stream = fs.open(hadoop.fs.Path(path))
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            continue
        finally:
            stream.close()
    return None


def _commit(spark: SparkSession, root: str, seen: list[str], state: dict) -> None:
    """Add the next record. If another writer added one since `seen` was listed, creating it fails."""
    fs, hadoop = _file_system(spark, root)
    number = int(seen[-1].rsplit("/", 1)[1].split(".")[0]) + 1 if seen else 1
    out = fs.create(hadoop.fs.Path(f"{root}/_commits/{number:012d}.json"), False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stage(df: DataFrame, root: str, keys: Sequence[str], buckets: int) -> tuple[str, list[int]]:
    """Write rows by bucket into a new folder; adaptive rebalancing sizes the files. Returns folder and buckets."""
    version = f"v-{uuid.uuid4().hex}"
    placed = df.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", BUCKET)
    placed.write.partitionBy(BUCKET).parquet(f"{root}/{version}")
    fs, hadoop = _file_system(df.sparkSession, root)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop.fs.Path(f"{root}/{version}"))]
    return version, [int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")]


def _read(spark: SparkSession, root: str, state: dict, only: Sequence[int] | None = None) -> DataFrame:
    wanted = state["where"] if only is None else {b: v for b, v in state["where"].items() if int(b) in set(only)}
    schema = state["schema"]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{v}/{BUCKET}={b}" for b, v in wanted.items()])


def read_collection(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, or None for a collection that was never written."""
    state = _state(spark, root, _commits(spark, root))
    return _read(spark, root, state) if state else None


def _schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _replace_all(df: DataFrame, root: str, keys, buckets, seen, staged) -> None:
    version, written = staged
    state = {"buckets": buckets, "schema": _schema_text(df), "where": {str(b): version for b in written}}
    _commit(df.sparkSession, root, seen, state)


def write_collection(df: DataFrame, root: str, keys: Sequence[str] = ("id",), buckets: int = BUCKETS) -> None:
    """Replace the whole collection."""
    seen = _commits(df.sparkSession, root)
    _replace_all(df, root, keys, buckets, seen, _stage(df, root, keys, buckets))


def publish(
    df: DataFrame,
    root: str,
    attempted: int,
    min_ratio: float = MIN_SUCCESS_RATIO,
    keys: Sequence[str] = ("id",),
    buckets: int = BUCKETS,
) -> dict:
    """Stage `df`, and switch to it only if staged rows / attempted reaches min_ratio.

    The rows are counted from the staged files, so the pipeline runs once. A refused version stays
    unreferenced and the current one stays live.
    """
    spark = df.sparkSession
    seen = _commits(spark, root)
    staged = _stage(df, root, keys, buckets)
    written = spark.read.schema(df.schema).parquet(f"{root}/{staged[0]}").count()
    ratio = written / attempted if attempted else 0.0
    published = written > 0 and ratio >= min_ratio
    if published:
        _replace_all(df, root, keys, buckets, seen, staged)
    return {"written": written, "attempted": attempted, "ratio": ratio, "published": published}


def _rewrite(spark, root, seen, state, touched: list[int], rows: DataFrame, keys) -> None:
    """Replace the touched buckets by `rows`; a touched bucket without rows disappears."""
    version, written = _stage(rows, root, keys, state["buckets"])
    kept = {b: v for b, v in state["where"].items() if int(b) not in set(touched)}
    _commit(spark, root, seen, {**state, "where": {**kept, **{str(b): version for b in written}}})


def _buckets_of(df: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    # at most `buckets` numbers
    return [r[0] for r in df.select(_bucket(keys, buckets)).distinct().collect()]


def upsert_collection(
    source: DataFrame, root: str, keys: Sequence[str] = ("id",), buckets: int = BUCKETS
) -> None:
    """Insert or replace rows by key; only the buckets of the source's keys are rewritten."""
    spark = source.sparkSession
    seen = _commits(spark, root)
    state = _state(spark, root, seen)
    if state is None:
        return _replace_all(source, root, keys, buckets, seen, _stage(source, root, keys, buckets))
    source = cut_lineage(source)
    touched = _buckets_of(source, keys, state["buckets"])
    merged = upsert(_read(spark, root, state, touched), source, keys)
    _rewrite(spark, root, seen, state, touched, merged, keys)


def prune_collection(live: DataFrame, root: str, keys: Sequence[str] = ("id",)) -> int:
    """Delete rows whose key is not live and return how many; only buckets with such rows are rewritten."""
    spark = live.sparkSession
    seen = _commits(spark, root)
    state = _state(spark, root, seen)
    if state is None:
        return 0
    gone = cut_lineage(stale(_read(spark, root, state), live, keys).select(*keys))
    touched = _buckets_of(gone, keys, state["buckets"])
    if touched:
        kept = _read(spark, root, state, touched).join(gone, list(keys), "left_anti")
        _rewrite(spark, root, seen, state, touched, kept, keys)
    return gone.count()


def expire(spark: SparkSession, root: str) -> list[str]:
    """Delete version folders the newest commit does not use. Run it when no reader holds an older version."""
    state = _state(spark, root, _commits(spark, root))
    fs, hadoop = _file_system(spark, root)
    used = set(state["where"].values()) if state else set()
    folders = [s.getPath() for s in fs.listStatus(hadoop.fs.Path(root)) if s.getPath().getName().startswith("v-")]
    gone = [p for p in folders if p.getName() not in used]
    for path in gone:
        fs.delete(path, True)
    return [p.getName() for p in gone]
