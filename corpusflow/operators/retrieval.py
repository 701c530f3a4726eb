"""Exact vector top-k retrieval; `vector_index` has the approximate search.

Scores come from dense blocks: a NumPy matrix product of some questions with some collection rows that
keeps only each question's best k rows (or a count), so pairs never become DataFrame rows. Two ways to
bring the blocks together:

* few questions (a checked number of bytes): they travel to the tasks as a broadcast variable and the
  collection is scanned in place, without a shuffle;
* many questions: both sides are hashed onto an R x S grid per collection key. R and S follow from counted
  rows, so a cell is bounded however many rows share one key.

Either way a window keeps the k best of each question's block winners. Scores are compared at nine
decimals, finer than float32 vectors resolve, so equal vectors tie exactly and the id decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.functions.fixed_values import NO_CONTEXT, SCORE_FLOOR, TOP_K
from corpusflow.functions.text import strip

BROADCAST_BYTES = 32 * 1024 * 1024
CELL_ROWS = 65_536
CELL_QUESTIONS = 4_096
BROADCAST_KEYS = 50_000
_SCORES_AT_ONCE = 4_000_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """n x d double matrix of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _similarities(rows: np.ndarray, questions: np.ndarray, space: str) -> np.ndarray:
    """Similarity in [0, 1] of every row with every question."""
    raw = rows @ questions.T
    if space == "cosine":
        lengths = np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(questions, axis=1))
        raw = raw / np.where(lengths == 0, 1.0, lengths)
    elif space != "ip":
        squared = (rows**2).sum(axis=1)[:, None] + (questions**2).sum(axis=1)[None, :] - 2 * raw
        raw = 1.0 - squared / 2.0
    return np.round(np.clip(raw, 0.0, 1.0), 9)


class _Best:
    """The k best (score desc, id asc) rows per question seen so far, as three flat arrays."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.question = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.row = np.zeros(0, dtype=object)

    def add(self, question: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        question = np.concatenate([self.question, question])
        score = np.concatenate([self.score, score])
        row = np.concatenate([self.row, row]) if len(self.row) else row
        order = np.lexsort((row, -score, question))
        question, score, row = question[order], score[order], row[order]
        starts = np.r_[True, question[1:] != question[:-1]] if len(question) else np.zeros(0, dtype=bool)
        position = np.arange(len(question)) - np.maximum.accumulate(np.where(starts, np.arange(len(question)), 0))
        keep = position < self.k
        self.question, self.score, self.row = question[keep], score[keep], row[keep]


def _block_scores(rows, row_ids, questions, question_ids, space, skip_self):
    """Yield (first question, similarity block) with at most _SCORES_AT_ONCE scores; -1 marks the row itself."""
    step = max(1, _SCORES_AT_ONCE // max(1, len(rows)))
    for at in range(0, len(questions), step):
        block = _similarities(rows, questions[at:at + step], space)
        if skip_self:
            block[row_ids[:, None] == question_ids[None, at:at + step]] = -1.0
        yield at, block


def _merge_best(best: _Best, rows, row_ids, questions, question_ids, codes, k, floor, space, skip_self) -> None:
    for at, block in _block_scores(rows, row_ids, questions, question_ids, space, skip_self):
        if len(rows) > k:
            # the k-th best score of each question; everything at or above it stays, so ties are kept whole
            bar = np.partition(block, len(rows) - k, axis=0)[len(rows) - k]
            hit = (block >= floor) & (block >= bar[None, :])
        else:
            hit = block >= floor
        r, q = np.nonzero(hit)
        if len(r):
            best.add(codes[at + q], block[r, q], row_ids[r])


def _by_key(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, dict]:
    """Question ids, and per collection key the positions and vectors of its questions."""
    vectors = _matrix(table["qvec"])
    members: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[table[c].to_pylist() for c in keys])):
        members.setdefault(key, []).append(i)
    return table["qid"].to_numpy(), {key: (np.array(at), vectors[at]) for key, at in members.items()}


def _rows_by_key(batch: pa.RecordBatch, keys: Sequence[str], wanted) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch whose collection key is wanted; a batch of one key is passed on uncopied."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for name in keys:
        encoded = batch.column(name).dictionary_encode()
        n = len(encoded.dictionary)
        code = code * (n + 1) + encoded.indices.fill_null(n).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    for where in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        key = tuple(batch.column(name)[int(where[0])].as_py() for name in keys) if len(where) else None
        if key in wanted:
            yield key, batch if len(where) == batch.num_rows else batch.take(pa.array(where))


def _result_schema(questions: DataFrame, rows: DataFrame, counting: bool) -> T.StructType:
    qid = T.StructField("qid", questions.schema["qid"].dataType)
    if counting:
        return T.StructType([qid, T.StructField("n", T.LongType())])
    return T.StructType([qid, T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _scan_with_broadcast(questions, held: pa.Table, rows, keys, schema, k, floor, space, skip_self, counting):
    shared = rows.sparkSession.sparkContext.broadcast(_by_key(held, keys))
    out = _arrow(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of_key = shared.value
        best, counts = _Best(k), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for key, part in _rows_by_key(batch, keys, of_key):
                codes, vectors = of_key[key]
                row_ids, matrix = part.column("id").to_numpy(zero_copy_only=False), _matrix(part.column("vec"))
                if counting:
                    for at, block in _block_scores(matrix, row_ids, vectors, ids[codes], space, skip_self):
                        counts[codes[at:at + block.shape[1]]] += (block >= floor).sum(axis=0)
                else:
                    _merge_best(best, matrix, row_ids, vectors, ids[codes], codes, k, floor, space, skip_self)
        if counting:
            some = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], out.field(0).type), pa.array(counts[some])], schema=out)
        else:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[best.question], out.field(0).type), pa.array(best.row, out.field(1).type), pa.array(best.score)],
                schema=out,
            )

    return rows.mapInArrow(scan, schema)


def _grid(questions, rows, keys, schema, k, floor, space, skip_self, counting, cell_rows, cell_questions):
    shape = (
        questions.groupBy(*keys).agg(F.count("*").alias("_nq"))
        .join(rows.groupBy(*keys).agg(F.count("*").alias("_nr")), list(keys))
        .select(
            *keys,
            F.ceil(F.col("_nr") / cell_rows).cast("int").alias("_R"),
            F.ceil(F.col("_nq") / cell_questions).cast("int").alias("_S"),
        )
    )
    # collection keys are few as a rule; then both sides learn their grid without a shuffle
    few = shape.limit(BROADCAST_KEYS + 1).collect()
    if len(few) <= BROADCAST_KEYS:
        shape = F.broadcast(rows.sparkSession.createDataFrame(few, shape.schema))
    # fresh column names keep the two sides apart when both come from one table
    left, right = [f"_c{i}" for i in range(len(keys))], [f"_q{i}" for i in range(len(keys))]
    renamed = lambda names: [F.col(c).alias(n) for c, n in zip(keys, names)]
    tall = (
        rows.join(shape, list(keys))
        .withColumn("_r", F.pmod(F.xxhash64("id"), F.col("_R")).cast("int"))
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_S") - 1)))
        .select(*renamed(left), F.col("_r").alias("_cr"), F.col("_s").alias("_cs"), "id", "vec")
    )
    wide = (
        questions.join(shape, list(keys))
        .withColumn("_s", F.pmod(F.xxhash64("qid"), F.col("_S")).cast("int"))
        .withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_R") - 1)))
        .select(*renamed(right), F.col("_r").alias("_qr"), F.col("_s").alias("_qs"), "qid", "qvec")
    )
    out = _arrow(schema)

    def cell(held: pa.Table, asking: pa.Table) -> pa.Table:
        if held.num_rows == 0 or asking.num_rows == 0:
            return out.empty_table()
        row_ids, matrix = held["id"].to_numpy(), _matrix(held["vec"])
        asked, vectors = asking["qid"].to_numpy(), _matrix(asking["qvec"])
        if counting:
            counts = np.zeros(len(asked), dtype=np.int64)
            for at, block in _block_scores(matrix, row_ids, vectors, asked, space, skip_self):
                counts[at:at + block.shape[1]] += (block >= floor).sum(axis=0)
            return pa.table([pa.array(asked, out.field(0).type), pa.array(counts)], schema=out)
        best = _Best(k)
        _merge_best(best, matrix, row_ids, vectors, asked, np.arange(len(asked)), k, floor, space, skip_self)
        return pa.table(
            [pa.array(asked[best.question], out.field(0).type), pa.array(best.row, out.field(1).type),
             pa.array(best.score)],
            schema=out,
        )

    return (
        tall.groupBy(*left, "_cr", "_cs").cogroup(wide.groupBy(*right, "_qr", "_qs")).applyInArrow(cell, schema)
    )


def _winners(questions, rows, keys, *, k, floor, space, skip_self, counting, broadcast_bytes,
             cell_rows=CELL_ROWS, cell_questions=CELL_QUESTIONS):
    keys = list(keys)
    # a null key finds nothing, whichever way the sides meet
    questions = questions.select("qid", *keys, "qvec").dropna(subset=["qvec", *keys])
    rows = rows.select("id", *keys, "vec").dropna(subset=["vec", *keys])
    schema = _result_schema(questions, rows, counting)
    args = (k, floor, space, skip_self, counting)
    first = questions.select(F.size("qvec")).head() if broadcast_bytes else None
    if first is not None:
        most = broadcast_bytes // (8 * max(1, first[0]))
        held = questions.limit(most + 1).toArrow()
        if held.num_rows <= most:
            return _scan_with_broadcast(questions, held, rows, keys, schema, *args)
    return _grid(questions, rows, keys, schema, *args, cell_rows, cell_questions)


def retrieve(
    questions: DataFrame,
    collection: DataFrame,
    *,
    k: int = TOP_K,
    floor: float = SCORE_FLOOR,
    space: str = "cosine",
    keys: Sequence[str] = ("platform",),
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    **grid,
) -> DataFrame:
    """Top-k collection rows per question within its collection key: (qid, id, score, rank).

    `questions` has qid, the keys and qvec; `collection` has id, the keys and vec. Hits score at least
    `floor`. The floor is monotone in the score, so floor-then-top-k equals over-fetch-then-floor.
    """
    hits = _winners(questions, collection, keys, k=k, floor=floor, space=space, skip_self=skip_self,
                    counting=False, broadcast_bytes=broadcast_bytes, **grid)
    return _rank(hits, k)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def count_above_floor(
    questions: DataFrame,
    collection: DataFrame,
    *,
    floor: float = SCORE_FLOOR,
    space: str = "cosine",
    keys: Sequence[str] = ("platform",),
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    **grid,
) -> DataFrame:
    """Number of collection rows at or above the floor per question, zero included: (qid, n)."""
    counts = _winners(questions, collection, keys, k=1, floor=floor, space=space, skip_self=skip_self,
                      counting=True, broadcast_bytes=broadcast_bytes, **grid)
    none = questions.select("qid", F.lit(0).cast("long").alias("n"))
    return counts.unionByName(none).groupBy("qid").agg(F.sum("n").alias("n"))


def rag_sources(hits: DataFrame, source: str = "source") -> DataFrame:
    """Ordered (source, score) list per question. A question has at most k hits, so the list is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(source).alias("source"), "score")))
    return hits.groupBy("qid").agg(
        F.transform(ordered, lambda h: F.struct(h["source"].alias("source"), h["score"].alias("score"))).alias("sources")
    )


def build_context(questions: DataFrame, hits: DataFrame, most: int = TOP_K) -> DataFrame:
    """One text block per question from its best `most` hits; a fixed sentence without hits: (qid, context).

    `hits` has qid, rank, source, score and content.
    """
    block = F.concat(
        F.format_string("[Source: %s | Score: %.2f]\n", "source", "score"), strip(F.col("content")), F.lit("\n")
    )
    per_question = (
        hits.where(F.col("rank") <= most)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))).alias("blocks"))
        .select("qid", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("context"))
    )
    return questions.select("qid").join(per_question, "qid", "left").select(
        "qid", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")
    )
