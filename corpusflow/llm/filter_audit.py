"""Filter interaction audit: what each filter removes in every order, read off decision diagrams of failure masks.

Spark counts the rows of every part by failure mask, one bit a filter. From these counts, at most two to the number
of filters a part however many rows it has, each part builds a count-weighted decision diagram: one level a filter,
nodes that share equal rests, every node with the counts of the rows below it. One diagram serves all orders: two
neighbouring filters change places by a swap of their two levels, and a walk through all orders by such swaps (plain
changes) never builds a second one. In each order the path of rows that pass gives the steps: the node reached has the
rows kept, its failing child the rows removed.

Copies are found by the text's SHA-256: rows of equal text are counted by id before they are shuffled, so a text with a
third of all rows is a few counts, and no text leaves its row. Labels meet narrow rows by id; rows without an id are
spread by their text.

Defined results: null texts are empty; the empty text has no words, fails A and no other filter but E. A null part is
the empty string. A null id is neither smaller nor larger than any other: such rows fail E never and have no labels.
Rows that repeat an id count each; of equal texts under the smallest id all stay. An id with several labels has the
largest of each kind. An empty table has no parts and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


class Diagram:
    """A decision diagram over weighted masks whose levels can be reordered.

    ``order`` names the filter of each level. A node of level i is a pair (passing, failing) of nodes of level i + 1;
    no level is skipped, so a node's weights are the sums of its children's. Equal nodes are one node.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int) -> None:
        self.order = list(range(filters))
        width = len(next(iter(counts.values()), (0,)))
        ends: dict[tuple[int, ...], int] = {}
        at = []  # the node of every prefix of decisions, first filter first
        for path in range(1 << filters):
            mask = sum(1 << i for i in range(filters) if path >> (filters - 1 - i) & 1)
            at.append(ends.setdefault(counts.get(mask, (0,) * width), len(ends)))
        self.nodes: list[list[tuple[int, int]]] = []
        self.weights: list[list[tuple[int, ...]]] = [list(ends)]
        for _ in range(filters):
            known: dict[tuple[int, int], int] = {}
            at = [known.setdefault(pair, len(known)) for pair in zip(at[::2], at[1::2])]
            self.nodes.insert(0, list(known))
            self.weights.insert(0, self._sums(known, self.weights[0]))

    @staticmethod
    def _sums(pairs: Iterable[tuple[int, int]], below: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        return [tuple(map(sum, zip(below[a], below[b]))) for a, b in pairs]

    def swap(self, i: int) -> None:
        """Levels i and i + 1 change places; only their own nodes change, nodes above keep what they point at."""
        lower = self.nodes[i + 1]
        known: dict[tuple[int, int], int] = {}
        upper = []
        for passed, failed in self.nodes[i]:
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            upper.append((known.setdefault((pp, fp), len(known)), known.setdefault((pf, ff), len(known))))
        self.nodes[i], self.nodes[i + 1] = upper, list(known)
        self.weights[i + 1] = self._sums(known, self.weights[i + 2])
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def failing(self) -> dict[int, int]:
        """How many rows fail each filter, whatever else they fail."""
        out, ways = {}, {0: 1}  # ways: paths from the top to a node
        for level, name in enumerate(self.order):
            out[name] = sum(n * self.weights[level + 1][self.nodes[level][node][1]][0] for node, n in ways.items())
            below: dict[int, int] = {}
            for node, n in ways.items():
                for child in self.nodes[level][node]:
                    below[child] = below.get(child, 0) + n
            ways = below
        return out

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
        """Along the path of passing rows: filter, weights kept, weights removed, rows that fail this filter only."""
        node = 0
        for level, name in enumerate(self.order):
            node, failed = self.nodes[level][node]
            alone = failed
            for rest in range(level + 1, len(self.order)):
                alone = self.nodes[rest][alone][0]
            yield name, self.weights[level + 1][node], self.weights[level + 1][failed], self.weights[-1][alone][0]


def plain_changes(n: int) -> Iterator[int]:
    """Places i whose swaps with i + 1 lead through all orders of n things, each once."""
    if n < 2:
        return
    down = True
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the last thing stands in front after a way down
        down = not down


def _through(diagram: Diagram, orders: list[list[int]] | None) -> Iterator[None]:
    """Bring the diagram into each of the orders, all of them if none are given."""
    if orders is None:
        yield
        for i in plain_changes(len(diagram.order)):
            diagram.swap(i)
            yield
        return
    for order in orders:
        for place, name in enumerate(order):
            for i in range(diagram.order.index(name) - 1, place - 1, -1):
                diagram.swap(i)
        yield


def audit(counts: DataFrame, names: str | list[str], orders: list[str] | None = None) -> DataFrame:
    """What each filter does in each order: one row per part, order and step.

    ``counts``: part string, mask int (bit i: fails the filter names[i]), n, good, toxic long. ``orders``: strings of
    filter names; by default all orders of the filters, of which there should then be eight at most.
    """
    names = list(names)
    wanted = None if orders is None else [[names.index(x) for x in order] for order in orders]

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        diagram = Diagram({r.mask: (r.n, r.good, r.toxic) for r in rows.itertuples()}, len(names))
        fails, out, removed_by = diagram.failing(), [], [0] * len(names)
        for _ in _through(diagram, wanted):
            order = "".join(names[i] for i in diagram.order)
            for step, (name, kept, removed, alone) in enumerate(diagram.steps(), 1):
                removed_by[name] += removed[0]
                out.append((key[0], order, step, names[name], kept[0], removed[0], fails[name] - removed[0], alone, removed[1], removed[2], name))
        table = pd.DataFrame(out, columns=[
            "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        table["shapley"] = [removed_by[i] for i in table["shapley"]]
        return table

    schema = "part string, filter_order string, step int, filter string, " + ", ".join(
        f"{x} long" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    summed = counts.groupBy("part", "mask").agg(*[F.sum(x).cast("long").alias(x) for x in ("n", "good", "toxic")])
    return summed.groupBy("part").applyInPandas(of_part, schema)


def text_failures(text: Column) -> list[Column]:
    """Filters A to D: too few words, too few different words, too many capitals, a sign of markup."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    return [
        n < 200,
        100 * different.cast("long") < 50 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def mask_counts(docs: DataFrame, labels: DataFrame, failures=text_failures, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows per part and failure mask, with those labelled good and toxic: the failures of the text are the first bits,
    equality with the text of a smaller id is the last."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bits = failures(whole)
    narrow = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(whole, 256).alias("text"),
        sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(bits)), F.lit(0)).cast("int").alias("mask"))
    rows = narrow.groupBy("id", "part", "text", "mask").agg(F.count("*").alias("n"))
    labelled = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))  # null ids meet no label, wherever they are
    rows = rows.withColumn("place", spread).join(labelled.withColumn("place", F.lit(0).cast("long")), ["id", "place"], "left").drop("place")
    rows = rows.select("part", "text", "mask", "id", "n", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])
    # few rows a text from here on: one per part, pair of labels
    alike = rows.groupBy("part", "text", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = alike.groupBy("text").agg(F.min("least.id").alias("first"))
    unlike = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("without")
    both = alike.join(first, "text").withColumn("unlike", unlike)
    sided = both.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("unlike").alias("n")),
        F.struct((F.col("mask") + (1 << len(bits))).alias("mask"), (F.col("n") - F.col("unlike")).alias("n")))).alias("s"))
    n = F.col("s.n")
    return sided.where("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), failed AS (
  SELECT doc_id, part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT substr('ABCDE', i::INT + 1, 1) AS x, (1 << i)::INT AS bit FROM range(5) AS r(i)
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, list_sum(bits[1:s])::INT - bits[s] AS before FROM orders, range(1, 6) AS r(s)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


@query("op13_filter_audit", _SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    counts = mask_counts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return audit(counts, FILTERS).drop("filter")
