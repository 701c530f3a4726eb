"""Reachability over an edge table, by bitset frontiers.

Seeds are numbered and stand for bits of long words. The walk's rows are (node, word, bits), 64 seeds a row where they
meet, and not pairs of seed and node; a hop carries the newest bits along the edges and joins equal rows with
``bit_or``, so parallel paths collapse, and one grouping with the levels before takes out what they hold. Every hop
writes its new bits and no others. The rows of a hop are dealt out to as many tasks as their number asks for. The walk is
bounded by its hops; totals over all hops are counted from the bits, and only on request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.windows import cap_per_group
from corpusflow.session import cut_lineage

TASK_ROWS = 1 << 20


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    direction = (direction or "UPSTREAM").upper()
    if direction not in ("UPSTREAM", "DOWNSTREAM"):
        raise ValueError(f"unknown direction: {direction}")
    src, dst = ("src", "dst") if direction == "DOWNSTREAM" else ("dst", "src")
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def number_seeds(seeds: DataFrame) -> DataFrame:
    """Distinct seeds with their place: (seed, word, bit). Numbers follow partitions, so they are written once and kept."""
    place = F.monotonically_increasing_id()
    distinct = seeds.where("seed IS NOT NULL").select("seed").distinct().withColumn("_at", place)
    return cut_lineage(distinct.select("seed", F.shiftright("_at", 6).alias("word"), (F.col("_at") % 64).cast("int").alias("bit")))


def _bit(place: Column | str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place) if isinstance(place, str) else place)


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: no fewer than the session's, and no more than about `TASK_ROWS` rows in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def walk(edges: DataFrame, numbered: DataFrame, direction: str, max_hops: int | None) -> list[DataFrame]:
    """One table (node, word, bits) per hop: the seeds of a word that reach the node first at this distance.

    ``numbered``: see `number_seeds`. Without a bound the walk ends when a hop brings nothing new. The last bounded
    hop stays lazy. A seed does not reach itself again.
    """
    ways = _oriented(edges, direction)
    rows = ways.count()
    fresh = numbered.groupBy(F.col("seed").alias("node"), "word").agg(F.bit_or(_bit("bit")).alias("bits"))
    levels, none = [fresh], F.lit(0).cast("long")
    while max_hops is None or len(levels) <= max_hops:
        found = fresh.withColumnRenamed("node", "src").join(ways, "src").select(F.col("dst").alias("node"), "word", F.col("bits").alias("found"), none.alias("seen"))
        before = [x.select("node", "word", none.alias("found"), F.col("bits").alias("seen")) for x in levels]
        met = reduce(DataFrame.unionByName, before, found).repartition(_tasks(edges.sparkSession, rows), "node", "word")
        fresh = met.groupBy("node", "word").agg(
            F.bit_or("found").bitwiseAND(F.bitwise_not(F.bit_or("seen"))).alias("bits")).where("bits <> 0")
        if len(levels) != max_hops:
            fresh = cut_lineage(fresh)
            new = fresh.count()
            if not new:
                break
            rows += new
        levels.append(fresh)
    return levels[1:]


def _places(levels: DataFrame) -> DataFrame:
    """Rows of one bit each: the level's columns, word and bit."""
    kept = [c for c in levels.columns if c != "bits"]
    every = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(_bit(i)) != 0)
    # most words of a sparse walk hold one bit, whose place is the number of bits below it
    lone = F.when(F.col("bits") < 0, 63).otherwise(F.bit_count(F.col("bits") - F.when(F.col("bits") < 0, 0).otherwise(1)))
    places = F.when(F.bit_count("bits") == 1, F.array(lone.cast("int"))).otherwise(every)
    return levels.select(*kept, F.explode(places).alias("bit"))


def _one_hop(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """A single hop meets each edge once: pairs need no bits."""
    ways = _oriented(edges, direction).withColumnRenamed("src", "seed")
    met = seeds.where("seed IS NOT NULL").select("seed").distinct().join(ways, "seed").where("seed <> dst")
    met = met.select("seed", F.col("dst").alias("node")).repartition(_tasks(edges.sparkSession, ways.count()), "seed", "node")
    return met.distinct().withColumn("degree", F.lit(1))


def _marked(levels: list[DataFrame], numbered: DataFrame) -> DataFrame:
    """(node, word, bit, degree) of the levels."""
    none = numbered.select(F.col("seed").alias("node"), "word", F.lit(0).cast("long").alias("bits")).where("false")
    levels = levels or [none]
    return _places(reduce(DataFrame.unionByName, [x.withColumn("degree", F.lit(hop)) for hop, x in enumerate(levels, 1)]))


def _named(marked: DataFrame, numbered: DataFrame) -> DataFrame:
    return marked.join(numbered, ["word", "bit"]).drop("word", "bit")


def lineage(edges: DataFrame, seeds: DataFrame, direction: str = "UPSTREAM", max_hops: int | None = 1) -> DataFrame:
    """Nodes within max_hops of each seed and their smallest distance: (seed, node, degree).

    edges: src, dst, pointing downstream; seeds: seed. A node is expanded once per seed, so cycles end.
    """
    if max_hops == 1:
        return _one_hop(edges, seeds, direction)
    numbered = number_seeds(seeds)
    return _named(_marked(walk(edges, numbered, direction, max_hops), numbered), numbered).select("seed", "node", "degree")


def lineage_all(edges: DataFrame, seeds: DataFrame, direction: str = "UPSTREAM") -> DataFrame:
    """`lineage` without a bound on the hops; it stops when a hop finds nothing new."""
    return lineage(edges, seeds, direction, None)


def _totals(levels: list[DataFrame], numbered: DataFrame) -> DataFrame:
    """(word, bit, total_all_hops): bits counted per place, without node names; 0 for seeds that reach nothing."""
    everywhere = reduce(DataFrame.unionByName, [numbered.select("word", _bit("bit").alias("bits")), *[x.select("word", "bits") for x in levels]])
    return _places(everywhere).groupBy("word", "bit").agg((F.count("*") - 1).alias("total_all_hops"))


def lineage_totals(edges: DataFrame, seeds: DataFrame, direction: str = "UPSTREAM") -> DataFrame:
    """How many nodes each seed reaches over all hops: (seed, total_all_hops)."""
    numbered = number_seeds(seeds)
    return _named(_totals(walk(edges, numbered, direction, None), numbered), numbered).select("seed", "total_all_hops")


def capped_lineage(
    edges: DataFrame, seeds: DataFrame, direction: str = "UPSTREAM", max_hops: int = 1, count: int = 50, totals: bool = False
) -> DataFrame:
    """Per seed the `count` nearest nodes within max_hops: (seed, node, degree). The walk goes no further than max_hops.

    With ``totals`` the walk goes on over all hops and adds total_all_hops.
    """
    order = [F.col("degree"), F.col("node")]
    if not totals:
        return cap_per_group(lineage(edges, seeds, direction, max_hops), ["seed"], order, count)
    numbered = number_seeds(seeds)
    levels = walk(edges, numbered, direction, None)
    # a seed is capped as its place, so that only what is left gets its name
    near = cap_per_group(_marked(levels[:max_hops], numbered), ["word", "bit"], order, count).join(_totals(levels, numbered), ["word", "bit"])
    return _named(near, numbered).select("seed", "node", "degree", "total_all_hops")
