"""Caps, latest values, neighbours, dense ids and ranks that stay spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.fixed_values import MAX_TURNS
from corpusflow.session import cut_lineage


# up to this cap Catalyst limits ranks before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold)
_RANK_LIMIT = 1000
_SALTS = 64
_VALUES_PER_BLOCK = 4096


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group in a total order; 0 keeps all.

    A small cap is applied in every task before the shuffle, so a crowded group sends n rows per task. A large
    one is first applied to slices of each group, which spreads a crowded group over many tasks.
    """
    if not n:
        return df
    first = lambda rows, *by: rows.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).where(F.col("_rn") <= n).drop("_rn")
    if n > _RANK_LIMIT:
        # a hash of the row, not a random number: a task that runs again must slice the same way
        hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*hashable), F.lit(_SALTS)))
        df = first(sliced, *keys, "_slice").drop("_slice")
    return first(df, *keys)


def latest_per_key(
    keys: DataFrame, events: DataFrame, by: Sequence[str], order: Sequence[str], value: str, default: str
) -> DataFrame:
    """`value` of the newest event per key; `default` for keys without events. Partial max before the shuffle."""
    newest = events.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))
    return keys.join(newest, list(by), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def session_window(messages: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Last 2 x max_turns user and assistant messages per conversation, oldest first: (conv_id, messages)."""
    kept = cap_per_group(
        messages.where(F.col("role").isin("user", "assistant")), ["conv_id"], [F.col("turn").desc()], 2 * max_turns
    )
    return kept.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    )


def with_next(df: DataFrame, group: str, order: str, columns: Sequence[str], block_rows: int = 4096) -> DataFrame:
    """Add next_<column> of the following row in the group, as `lead` would, without one task per group.

    `order` is an ordinal from 0. The group is cut into blocks of it; `lead` runs inside a block, and the last
    row of a block takes the head of the next block that has rows, found among the blocks only. A group of one
    block has neither next block nor head, so for short groups that side is empty.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    row = F.struct(*columns)
    by_block = Window.partitionBy(group).orderBy("_block")
    steps = cut.select(group, "_block").distinct().withColumn("_to", F.lead("_block").over(by_block))
    heads = cut.where(F.col(order) >= block_rows).groupBy(group, F.col("_block").alias("_to")).agg(F.min_by(row, order).alias("_after"))
    after = steps.where(F.col("_to").isNotNull()).join(heads, [group, "_to"]).drop("_to")
    inside = Window.partitionBy(group, "_block").orderBy(order)
    paired = cut.withColumn("_next", F.lead(row).over(inside)).join(after, [group, "_block"], "left")
    following = F.coalesce("_next", "_after")
    return paired.select(*df.columns, *[following[c].alias(f"next_{c}") for c in columns])


def pair_turns(messages: DataFrame) -> DataFrame:
    """A user message and the assistant message right after it: (conv_id, turn, query, response)."""
    spoken = messages.select("conv_id", "turn", "role", "text")
    return (
        with_next(spoken, "conv_id", "turn", ["role", "text"])
        .where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
        .select("conv_id", "turn", F.col("text").alias("query"), F.col("next_text").alias("response"))
    )


def dense_ids(df: DataFrame, order: Sequence[str], start: int | Column = 0, name: str = "id") -> DataFrame:
    """Consecutive ids start+1, start+2, ... in the given total order, without a single-task window.

    Rows are range-partitioned and checkpointed once, so that every row keeps its (partition, position); a
    running total over the partition sizes turns positions into ids.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    first = F.lit(start) if isinstance(start, int) else start
    # one row per partition of `placed`
    return placed.join(F.broadcast(offsets), "_part").select(
        (first + F.col("_offset") + F.col("_pos") + 1).alias(name), *df.columns
    )


def rank_values(
    df: DataFrame, key: str, value: str, picks: dict[str, Column], sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Order statistics of an integer per group: for each pick, the value at a 1-based rank, an expression of `n`.

    Rows are first counted per distinct value, before the shuffle. The running total then runs inside blocks of
    values, on top of the total of the blocks before. `sums` are summed along the way, in the same pass over the
    rows.
    """
    sums = dict(sums or {})
    counts = (
        df.groupBy(key, value).agg(F.count("*").alias("_c"), *[F.sum(c).alias(n) for n, c in sums.items()])
        .withColumn("_block", F.floor(F.col(value) / _VALUES_PER_BLOCK))
    )
    group = Window.partitionBy(key)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(key, "_block").agg(F.sum("_c").alias("_b")).select(
        key, "_block", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_before"), F.sum("_b").over(group).alias("n")
    )
    inside = Window.partitionBy(key, "_block").orderBy(value)
    ranked = counts.withColumn("_in", F.sum("_c").over(inside)).join(blocks, [key, "_block"])
    reached = F.col("_before") + F.col("_in")
    found = [F.min(F.when(reached >= rank, F.col(value))).alias(name) for name, rank in picks.items()]
    return ranked.groupBy(key).agg(F.max("n").alias("n"), *found, *[F.sum(n).alias(n) for n in sums])
