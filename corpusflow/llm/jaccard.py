"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles; equal sets are one vertex, so copies cost nothing further. Each set is embedded as
64 MinHash tokens (place, value). A run walks down a tree: at every node each of a set's tokens is chosen by a hash of
the path so far with probability 1 / (threshold x 64), and the set goes on to one child per chosen token. Sets that
share most tokens share most choices; others part quickly. Nodes of at most ``bucket`` sets are compared whole, larger
ones split further, and what is still larger at the greatest depth is compared block by block, all of it. The number
of runs follows from the target recall and from the chance that a pair at the threshold stays together to that depth.

Comparing a node yields edges from each group of similar embeddings to its smallest member, never all pairs. The groups
that these candidate edges span are then compared exactly, on the shingle sets themselves, in blocks of about ``block`` sets and ``block_shingles`` shingles at most:
every pair of a group, so a link found in no run is still found when its group is. Links are counted there and never
listed; classes are the components of exact links.

Defined results: null and empty texts have no words; texts without words are alike when the whole texts are equal,
null counting as empty. A text of fewer words than the shingle is one shingle. Repeated rows are copies of each other.
The class id is the smallest doc_id of the class, null when all are null. All columns of the input stay; new columns
replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import components, give_back, query, stored, table

TOKENS = 64
CHARS = 1 << 19  # characters of text that are hashed at once
_U = np.uint64


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted per text and concatenated, and their number per text."""
    hashed, counts = W.word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    full = W.runs(hashed, width)
    inside = owner[: len(full)] == owner[width - 1 : width - 1 + len(full)]
    values, owners = [full[inside]], [owner[: len(full)][inside]]
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        values.append(W.runs(hashed[starts[i] : starts[i] + counts[i]], int(counts[i])))
        owners.append(np.array([i]))
    value, of = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.bincount(of[fresh], minlength=len(texts))


def _embed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """MinHash values, texts x TOKENS."""
    out = np.zeros((len(size), TOKENS), np.uint32)
    some = np.flatnonzero(size)
    if len(some):
        at = (np.cumsum(size) - size)[some]
        for k in range(TOKENS):
            factor = _U((0x9E3779B97F4A7C15 * (2 * k + 1) + 0x632BE59BD9B4E019 * k * k) & (1 << 64) - 1 | 1)
            out[some, k] = np.minimum.reduceat((value * factor) >> _U(32), at)
    return out


_SET = "struct<key: binary, n: int, sketch: binary>"


def _sets(width: int):
    """Per text: 12 bytes that name its shingle set, the set's size, and its embedding."""

    @F.pandas_udf(_SET)
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            texts = batch.tolist()
            keys, sizes, sketches = [], [], []
            for a, b in W.blocks(texts, CHARS):
                value, size = shingle_sets(texts[a:b], width)
                sketch = _embed(value, size)
                ends = np.cumsum(size)
                for i, (end, n) in enumerate(zip(ends.tolist(), size.tolist())):
                    content = value[end - n : end].tobytes() if n else b"text" + (texts[a + i] or "").encode()
                    keys.append(hashlib.blake2b(content, digest_size=12).digest())
                    sketches.append(sketch[i].tobytes())
                sizes += size.tolist()
            yield pd.DataFrame({"key": keys, "n": sizes, "sketch": sketches})
        give_back()

    return sets


def _sketches(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(len(batch), TOKENS)


def _choices(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths: the tokens that a hash of path and token chooses."""
    place = W.mix((np.arange(TOKENS, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
    child = W.mix(W.mix(sketch.astype(np.uint64) ^ place) ^ path[:, None])
    row, token = np.nonzero(W.mix(child ^ _U(0x5851F42D4C957F2D)) < _U(int((1 << 64) / (threshold * TOKENS))))
    return row, child[row, token]


def _roots(reps: DataFrame, runs: int, threshold: float) -> DataFrame:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = W.mix(np.arange(1, runs + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))
        for batch in batches:
            for a in range(0, len(batch), 2000):
                some = batch.iloc[a : a + 2000]
                sketch, keys = _sketches(some), some["key"].to_numpy()
                for seed in seeds:
                    row, path = _choices(np.full(len(some), seed), sketch, threshold)
                    yield pd.DataFrame({"path": path.view(np.int64), "key": keys[row]})

    return reps.select("key", "sketch").mapInPandas(walk, "path long, key binary")


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 5000):
                some = batch.iloc[a : a + 5000]
                row, path = _choices(some["path"].to_numpy().view(np.uint64), _sketches(some), threshold)
                yield pd.DataFrame({"path": path.view(np.int64), "key": some["key"].to_numpy()[row]})

    return rows.select("path", "key", "sketch").mapInPandas(walk, "path long, key binary")


def _groups_of(similar: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index of each row's component."""
    label = np.arange(len(similar))
    while True:
        lower = np.where(similar, label[None, :], len(label)).min(axis=1)
        lower = np.minimum(label, lower)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _bucket_edges(sketch: np.ndarray, n: np.ndarray, least: int, threshold: float) -> np.ndarray:
    same = np.zeros((len(n), len(n)), np.uint8)
    for k in range(TOKENS):
        same += sketch[:, k][:, None] == sketch[:, k][None, :]
    close = (np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])) & (same >= least)
    np.fill_diagonal(close, True)
    return _groups_of(close)


def _streamed(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by a column; many small groups at once."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch.to_pandas()
        if rest is not None:
            rows = pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        group = rows[by].to_numpy()
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
        if cut:
            yield rows.iloc[:cut]
        rest = rows.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate edges (a, b) of all nodes; a node's rows share a path and are few."""
    least = max(1, math.floor(TOKENS * threshold - 3.5 * math.sqrt(TOKENS * threshold * (1 - threshold))))

    def compared(batches) -> Iterator[pa.RecordBatch]:
        for rows in _streamed(batches, "path"):
            path, keys, n, sketch = rows["path"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy(), _sketches(rows)
            edges = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
            size = np.diff(edges)
            found = []
            two = edges[:-1][size == 2]
            close = ((sketch[two] == sketch[two + 1]).sum(axis=1) >= least) & (
                np.minimum(n[two], n[two + 1]) >= threshold * np.maximum(n[two], n[two + 1]))
            found.append((two[close], two[close] + 1))
            for at, m in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
                lead = _bucket_edges(sketch[at : at + m], n[at : at + m], least, threshold)
                own = np.flatnonzero(lead != np.arange(m))
                found.append((at + lead[own], at + own))
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys[a], pa.binary()), pa.array(keys[b], pa.binary())], ["a", "b"])

    return rows.select("path", "key", "n", "sketch").repartition("path").sortWithinPartitions("path").mapInArrow(compared, "a binary, b binary")


def _blocked(rows: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Groups of several ``_parts`` as pairs of blocks: each row goes to every pair that its block is part of."""
    parts = F.col("_parts")
    own = F.pmod(F.xxhash64("key"), parts.cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    wide = rows.join(sizes.select(by, "_parts"), by).withColumn("_pair", F.explode(pair))
    return wide.withColumn("_own", own).withColumn("_node", F.when(parts > 1, F.xxhash64(by, "_pair.i", "_pair.j")).otherwise(F.xxhash64(by)))


def candidate_groups(reps: DataFrame, threshold: float, recall: float, bucket: int, depth: int, block: int) -> DataFrame:
    """(v, label): sets that chosen paths bring together, by group. Sets without a candidate are missing."""
    stay = 1.0
    for _ in range(depth):
        stay = 1 - math.exp(-stay)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - stay))
    light, edges = reps.select("key", "n", "sketch"), None
    paths = stored(_roots(light, runs, threshold), "paths")
    for level in range(1, depth + 1):
        sizes = stored(paths.groupBy("path").agg(F.count("*").alias("_size")).where("_size > 1"), "nodes")
        rows = paths.join(sizes, "path").join(light, "key")
        found = _compare(rows.where(F.col("_size") <= bucket), threshold)
        large = sizes.where(F.col("_size") > bucket)
        if level == depth:
            wide = _blocked(paths.join(light, "key"), large.withColumn("_parts", F.ceil(F.col("_size") / block).cast("int")), "path")
            found = found.union(_compare(wide.select(F.col("_node").alias("path"), "key", "n", "sketch"), threshold))
        elif large.limit(1).count():
            paths = stored(_children(rows.where(F.col("_size") > bucket), threshold), "paths")
        else:
            level = depth
        found = stored(found.distinct(), "edges")
        edges = found if edges is None else edges.union(found)
        if level == depth:
            break
    return components(edges, "candidates")


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """Per node: links of each set (weighted by copies) and an edge to the smallest set linked with it, directly or not.

    ``kind`` 0 is a node that holds its group alone, 1 a block against itself, 2 two blocks, where only pairs across count.
    """

    def compared(batches) -> Iterator[pa.RecordBatch]:
        for part in _streamed(batches, "_node"):
            for _, rows in part.groupby("_node", sort=False):
                own, weight, keys = rows["_own"].to_numpy(), rows["copies"].to_numpy(), rows["key"].to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
                size = np.array([len(x) for x in sets])
                _, token = np.unique(np.concatenate(sets), return_inverse=True)
                at, ends = np.cumsum(size) - size, np.cumsum(size)
                mark, across = np.zeros(token.max() + 1, np.int64), bool(rows["_pair"].iloc[0])
                links, close = np.zeros(len(rows), np.int64), np.eye(len(rows), dtype=bool)
                for i in range(len(rows)):
                    mark[token[at[i] : ends[i]]] = 1
                    shared = np.add.reduceat(mark[token], at)
                    mark[token[at[i] : ends[i]]] = 0
                    close[i] = shared >= threshold * (size + size[i] - shared) - 1e-9
                    if across:
                        close[i] &= own != own[i]
                    close[i, i] = False
                    links[i] = weight[close[i]].sum()
                lead = _groups_of(close | np.eye(len(rows), dtype=bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(keys[lead], pa.binary()), pa.array(links)], ["a", "b", "links"])
        give_back()

    wanted = rows.select("_node", "_own", (F.col("_pair.i") != F.col("_pair.j")).alias("_pair"), "key", "copies", "shingles")
    return wanted.repartition("_node").sortWithinPartitions("_node").mapInArrow(compared, "a binary, b binary, links long")


def _shingles(width: int):
    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = batch.tolist(), []
            for a, b in W.blocks(texts, CHARS):
                value, size = shingle_sets(texts[a:b], width)
                ends = np.cumsum(size)
                out += [value[end - n : end].tobytes() for end, n in zip(ends.tolist(), size.tolist())]
            yield pd.Series(out)
        give_back()

    return shingles


def jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5, threshold: float = 0.8,
    recall: float = 0.999, bucket: int = 256, depth: int = 3, block: int = 1024, block_shingles: int = 1 << 19,
) -> DataFrame:
    """The documents with ``class_key`` (names the class), ``class_id`` and ``n_links``: the number of other rows with a
    Jaccard likeness of at least the threshold, copies included."""
    light = stored(
        docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), _sets(width)(F.col(text)).alias("s"))
        .select("id", "t1", "t2", "s.key", "s.n", "s.sketch"), "sets")
    reps = stored(light.groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("low"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch")), "vertices")
    groups = candidate_groups(reps.where("n > 0"), threshold, recall, bucket, depth, block)
    live = groups.select(F.col("v").alias("key"), "label").join(reps.select("key", "copies", "t"), "key")
    texts = docs.select(F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), F.col(text).alias("text"))
    found = live.select("key", "label", "copies", "t.t1", "t.t2").join(texts, ["t1", "t2"]).dropDuplicates(["key"])
    sets = stored(found.select("key", "label", "copies", _shingles(width)(F.col("text")).alias("shingles")), "shingles")
    held = F.greatest(F.count("*") / block, F.sum(F.octet_length("shingles")) / (8 * block_shingles))
    sizes = sets.groupBy("label").agg(F.ceil(held).cast("int").alias("_parts"))
    exact = stored(_exact(_blocked(sets, sizes, "label"), threshold), "links")
    links = exact.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(exact.where("a != b").select("a", "b"), "classes").withColumnRenamed("v", "key")
    vertices = reps.select("key", "copies", "low").join(links, "key", "left").join(roots, "key", "left")
    vertices = vertices.select("key", "low", F.coalesce("label", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = vertices.groupBy("root").agg(F.min("low").alias("class_id"))
    classes = stored(vertices.join(ids, "root").select(F.col("key").alias("_key"), F.col("root").alias("class_key"), "class_id", "n_links"), "classes")
    keyed = docs.drop("class_key", "class_id", "n_links").withColumns({"_t1": F.xxhash64(text), "_t2": F.hash(text)})
    by_text = light.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("key").alias("_key")).distinct()
    return keyed.join(by_text.join(classes, "_key").drop("_key"), ["_t1", "_t2"]).drop("_t1", "_t2")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each class: the one with the smallest id (one row of it, if it occurs more than once)."""
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select([F.col(f"`{c}`").alias(k) for c, k in names.items()])
    classed = jaccard_classes(held, names[doc_id], names[text], **settings)
    keep = classed.where(F.col("class_id").isNull() | (F.col(names[doc_id]) == F.col("class_id")))
    return keep.dropDuplicates(["class_key"]).select([F.col(k).alias(c) for c, k in names.items()])


@query("op3_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
