"""An inverted-file index for approximate vector search.

Every collection key gets coarse centroids, fitted by k-means on a bounded sample of its rows; each row is stored in the
cell of its nearest centroid, all rows of the collection. A question probes its nearest cells until they hold about
``share`` of its key's rows, and the probed cells are scored exactly, through the blocks and grids of the exact search
(``retrieval``), with the cell as one more key. So scores are exact, and only the share of the rows looked at is less.

Sample: some ``SAMPLE_PER_LIST`` rows a list, chosen by a hash of the id, and at most ``MOST_LISTS`` lists a key; one
task fits one key's sample, some 260,000 rows at most. Centroids travel as a broadcast variable while their counted bytes
stay below ``BROADCAST_BYTES``; above that rows and centroids meet on a grid of key and hash, as many cells as the key's
rows demand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.fixed_values import SCORE_FLOOR, TOP_K
from corpusflow.operators.retrieval import (
    BROADCAST_BYTES, BROADCAST_KEYS, CELL_ROWS, _arrow, _grid, _matrix, _rank, _result_schema, _rows_by_key, _scan_with_broadcast)
from corpusflow.session import cut_lineage

LISTS_PER_ROOT = 4.0
MOST_LISTS = 4_096
SAMPLE_PER_LIST = 64
SHARE = 0.32
PRUNED_CELLS = 2_000
_ROUNDS = 8


def _directions(x: np.ndarray, space: str) -> np.ndarray:
    """Vectors as they are clustered: of unit length, but for the l2 spaces."""
    if space not in ("cosine", "ip"):
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1.0, length)


def _nearness(x: np.ndarray, centres: np.ndarray, space: str) -> np.ndarray:
    """Larger is nearer; only the order along a row counts."""
    raw = x @ centres.T
    return raw if space in ("cosine", "ip") else raw - (centres**2).sum(axis=1)[None, :] / 2


def fit_centroids(x: np.ndarray, lists: int, space: str) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of some rows and the share of the rows in each; cells that stay empty are left out.

    Starts are drawn with chances that grow with the distance to those before (k-means++), by a fixed seed.
    """
    x = _directions(x, space)
    rng = np.random.default_rng(7)
    size = (x**2).sum(axis=1)
    centres, gap = [x[0]], None
    while len(centres) < min(lists, len(x)):
        last = np.maximum(size + (centres[-1] ** 2).sum() - 2 * (x @ centres[-1]), 0.0)
        gap = last if gap is None else np.minimum(gap, last)
        if gap.max() <= 1e-12:
            break  # every row equals a start
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
    centres = np.array(centres)
    for _ in range(_ROUNDS):
        own = _nearness(x, centres, space).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        cells, begin = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        centres = _directions(sums / np.diff(begin, append=len(x))[:, None], space)
    own = _nearness(x, centres, space).argmax(axis=1)
    count = np.bincount(own, minlength=len(centres))
    return centres[count > 0], count[count > 0] / len(x)


def fit_index(collection: DataFrame, *, keys: Sequence[str] = ("platform",), space: str = "cosine",
              lists_per_root: float = LISTS_PER_ROOT, most_lists: int = MOST_LISTS) -> DataFrame:
    """Centroids: keys, cell int, centroid array<double>, weight double (the cell's share of its key's sample)."""
    keys = list(keys)
    rows = collection.select("id", *keys, "vec").dropna(subset=["id", "vec", *keys])
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    lists = F.least(F.ceil(F.sqrt("_n") * lists_per_root), F.lit(most_lists), F.col("_n")).cast("int")
    counts = counts.select(*keys, lists.alias("_lists"), (F.lit(SAMPLE_PER_LIST) * lists / F.col("_n")).alias("_rate"))
    few = counts.limit(BROADCAST_KEYS + 1).collect()
    if len(few) <= BROADCAST_KEYS:
        counts = F.broadcast(collection.sparkSession.createDataFrame(few, counts.schema))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = rows.join(counts, keys).withColumn("_place", place).where(F.col("_place") < F.col("_rate") * (1 << 30))
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("cell", T.IntegerType()),
                           T.StructField("centroid", T.ArrayType(T.DoubleType())), T.StructField("weight", T.DoubleType())])
    out = _arrow(schema)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_place", "ascending"), ("id", "ascending")])
        centres, weight = fit_centroids(_matrix(group["vec"]), group["_lists"][0].as_py(), space)
        n = len(centres)
        return pa.table([*(pa.array([group[c][0].as_py()] * n, out.field(c).type) for c in keys), pa.array(np.arange(n, dtype=np.int32)),
                         pa.array(list(centres), out.field("centroid").type), pa.array(weight)], schema=out)

    return sample.select(*keys, "id", "vec", "_lists", "_place").groupBy(*keys).applyInArrow(fit, schema)


def _collected(centroids: DataFrame) -> pa.Table | None:
    """The centroids, if they are few enough to travel with the tasks."""
    first = centroids.select(F.size("centroid")).head()
    most = BROADCAST_BYTES // (8 * max(1, first[0] if first else 1))
    held = centroids.limit(most + 1).toArrow()
    return held if held.num_rows <= most else None


def _meet(df: DataFrame, vec: str, by: str, centroids: DataFrame, held: pa.Table | None, keys: list[str], cells_of: Callable) -> DataFrame:
    """Rows with ``cell``, once for each cell that ``cells_of`` (vectors, centroids, weights -> row numbers, cells) names."""
    columns = df.columns
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("cell", T.IntegerType())])
    out = _arrow(schema)

    def dealt(part, centres: np.ndarray, cells: np.ndarray, weights: np.ndarray):
        row, found = cells_of(_matrix(part.column(vec)), centres, weights)
        taken = part.take(pa.array(row))
        arrays = [taken.column(c).cast(out.field(c).type) for c in columns]
        return [*arrays, pa.array(cells[found], pa.int32())]

    if held is not None:
        of_key: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*[held[c].to_pylist() for c in keys])):
            of_key.setdefault(key, []).append(i)
        matrix, cell, weight = _matrix(held["centroid"]), held["cell"].to_numpy(), held["weight"].to_numpy()
        shared = df.sparkSession.sparkContext.broadcast({k: (matrix[i], cell[i], weight[i]) for k, i in of_key.items()})

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for key, part in _rows_by_key(batch, keys, known):
                    yield pa.RecordBatch.from_arrays(dealt(part, *known[key]), schema=out)

        return df.mapInArrow(scan, schema)
    side = [f"_k{i}" for i in range(len(keys))]
    shape = df.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_R"))
    tall = df.join(shape, keys).withColumn("_r", F.pmod(F.xxhash64(by), F.col("_R")).cast("int")).select(*columns, "_r")
    wide = centroids.join(shape, keys).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_R") - 1)))
    wide = wide.select(*[F.col(c).alias(s) for c, s in zip(keys, side)], "_at", F.col("cell").alias("_cell"), "centroid", "weight")

    def met(rows: pa.Table, near: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or near.num_rows == 0:
            return out.empty_table()
        return pa.table(dealt(rows.combine_chunks(), _matrix(near["centroid"]), near["_cell"].to_numpy(), near["weight"].to_numpy()), schema=out)

    return tall.groupBy(*keys, "_r").cogroup(wide.groupBy(*side, "_at")).applyInArrow(met, schema)


@dataclass
class VectorIndex:
    """Centroids of every key, and all rows with their cell."""

    centroids: DataFrame
    rows: DataFrame
    keys: list[str]
    space: str

    @cached_property
    def held(self) -> pa.Table | None:
        return _collected(self.centroids)

    def save(self, path: str) -> None:
        """Centroids, and rows ordered by key and cell, so that a search reads the row groups of its cells only."""
        self.centroids.write.parquet(f"{path}/centroids")
        ordered = self.rows.repartitionByRange(*self.keys, "cell").sortWithinPartitions(*self.keys, "cell")
        ordered.write.parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: Sequence[str] = ("platform",), space: str = "cosine") -> VectorIndex:
        return cls(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/rows"), list(keys), space)

    def probes(self, questions: DataFrame, share: float = SHARE) -> DataFrame:
        """Questions with each ``cell`` they probe: the nearest ones, one at least, up to the share of their key's rows."""
        space = self.space

        def nearest(vectors: np.ndarray, centres: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row, cell = [], []
            step = max(1, 4_000_000 // max(1, len(centres)))
            for at in range(0, len(vectors), step):
                order = np.argsort(-_nearness(vectors[at : at + step], centres, space), axis=1, kind="stable")
                fits = np.cumsum(weights[order], axis=1) <= share
                fits[:, 0] = True
                r, c = np.nonzero(fits)
                row.append(r + at)
                cell.append(order[r, c])
            return (np.concatenate(row), np.concatenate(cell)) if row else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        asked = questions.select("qid", *self.keys, "qvec").dropna(subset=["qvec", *self.keys])
        return _meet(asked, "qvec", "qid", self.centroids, self.held, self.keys, nearest)

    def search(self, questions: DataFrame, *, k: int = TOP_K, floor: float = SCORE_FLOOR, share: float = SHARE,
               skip_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES, **grid) -> DataFrame:
        """The k best rows of the probed cells: (qid, id, score, rank)."""
        asked, rows, by = self.probes(questions, share), self.rows, [*self.keys, "cell"]
        schema = _result_schema(asked, rows, False)
        first = self.centroids.select(F.size("centroid")).head() if self.held is None else None
        dims = first[0] if first else len(self.held["centroid"][0]) if self.held else 0
        if broadcast_bytes and dims:
            most = broadcast_bytes // (8 * dims)
            held = asked.limit(most + 1).toArrow()
            if held.num_rows <= most:
                cells = held["cell"].unique().to_pylist()
                if len(cells) <= PRUNED_CELLS:
                    rows = rows.where(F.col("cell").isin(cells))
                return _rank(_scan_with_broadcast(asked, held, rows, by, schema, k, floor, self.space, skip_self, False), k)
        shape = {"cell_rows": CELL_ROWS, "cell_questions": 4_096, **grid}
        return _rank(_grid(asked, rows, by, schema, k, floor, self.space, skip_self, False, **shape), k)


def build_index(collection: DataFrame, *, keys: Sequence[str] = ("platform",), space: str = "cosine",
                lists_per_root: float = LISTS_PER_ROOT, most_lists: int = MOST_LISTS) -> VectorIndex:
    """Fit the centroids, then put every row into a cell. ``collection``: id, keys, vec. Rows without a vector or key are left out."""
    keys = list(keys)
    # written once: both the rows and every later question meet them
    centroids = cut_lineage(fit_index(collection, keys=keys, space=space, lists_per_root=lists_per_root, most_lists=most_lists))
    rows = collection.select("id", *keys, "vec").dropna(subset=["id", "vec", *keys])

    def nearest(vectors: np.ndarray, centres: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, 4_000_000 // max(1, len(centres)))
        own = [_nearness(_directions(vectors[a : a + step], space), centres, space).argmax(axis=1) for a in range(0, len(vectors), step)]
        return np.arange(len(vectors)), np.concatenate(own) if own else np.zeros(0, np.int64)

    index = VectorIndex(centroids, rows, keys, space)
    index.rows = _meet(rows, "vec", "id", centroids, index.held, keys, nearest)
    return index
