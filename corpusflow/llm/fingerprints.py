"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame expressions alone.

A text's digests stand for its distinct non-blank lines: 44 bits of a hash and 20 bits that check them. Each digest is
added to one cell in each of three parts of the sketch: the cell counts, and keeps the exclusive or of its digests. Two
sketches of one size subtract cell by cell; a cell left with a single digest of either side gives it up, is removed from
its other cells, and so on until nothing is left. If something is, the attempt is repeated with sketches four times
larger. Only occupied cells are kept, sorted, so the work of a pair follows its number of lines.

Defined results: null counts as empty; a text without non-blank lines has an empty sketch, and two empty sketches are
alike (1.0). Repeated lines of a text count once. Equal texts have equal sketches. A pair that no attempt resolves
(less than one in 10^9) has a null difference and likeness 0.0. All columns of the input stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, table

ROUNDS = 14
ATTEMPTS = 5


def _once(value: Column, body) -> Column:
    """The body with the value bound to a name, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _checked(key: Column) -> Column:
    """The 44 upper bits of a hash with 20 bits computed from them."""
    upper = F.shiftright(key, 20)
    return F.shiftleft(upper, 20).bitwiseOR(F.xxhash64(upper).bitwiseAND(F.lit((1 << 20) - 1)))


def digests(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: _checked(F.xxhash64(x)))))


def _places(key: Column, cells: Column) -> list[Column]:
    """A digest's cell in each part."""
    return [F.shiftrightunsigned(key, at).bitwiseAND(cells - 1) + cells * part for part, at in enumerate((20, 34, 44))]


def _entries(keys: Column, cells: Column, sign: int) -> Column:
    """A digest's three cells: (cell, count, digest)."""
    return F.flatten(F.transform(keys, lambda k: F.array(*[
        F.struct(at.alias("cell"), F.lit(sign).alias("n"), k.alias("x")) for at in _places(k, cells)])))


def _merge(entries: Column) -> Column:
    """Entries of the same cell added up; empty cells go."""

    def merged(s):
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1)["cell"] != F.get(s, i)["cell"]))

        def runs(h):
            def total(a, j):
                n = F.coalesce(F.get(h, j + 1), F.size(s)) - a
                first = F.get(s, a)
                return F.when(n == 1, first).otherwise(F.aggregate(
                    F.slice(s, a + 2, n - 1), first, lambda t, e: F.struct(
                        t["cell"].alias("cell"), (t["n"] + e["n"]).alias("n"), t["x"].bitwiseXOR(e["x"]).alias("x"))))

            return F.filter(F.transform(h, total), lambda c: (c["n"] != 0) | (c["x"] != 0))

        return F.when(F.size(s) == 0, s).otherwise(_once(heads, runs))

    return _once(F.sort_array(entries), merged)


def sketch(keys: Column, cells: Column) -> Column:
    """Occupied cells of the digests' sketch with three parts of so many cells (a power of two, at most 2^20)."""
    return _merge(_entries(keys, cells.cast("bigint"), 1))


def subtract(a: Column, b: Column) -> Column:
    negated = F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["x"].alias("x")))
    return _merge(F.concat(a, negated))


def peel(difference: Column, cells: Column) -> Column:
    """The digests in the difference, first text's and second text's; null when some cannot be told apart."""
    cells = cells.cast("bigint")

    def alone(left, sign):
        """Digests of the cells that hold a single one: it checks, and belongs where it is."""
        def single(c):
            at = _places(c["x"], cells)
            here = (c["cell"] == at[0]) | (c["cell"] == at[1]) | (c["cell"] == at[2])
            return (c["n"] == sign) & here & (_checked(c["x"]) == c["x"])

        return F.array_distinct(F.transform(F.filter(left, single), lambda c: c["x"]))

    def step(state, _):
        def remove(f):
            gone = F.concat(_entries(f["mine"], cells, -1), _entries(f["other"], cells, 1))
            return F.struct(
                _merge(F.concat(state["left"], gone)).alias("left"), F.concat(state["mine"], f["mine"]).alias("mine"),
                F.concat(state["other"], f["other"]).alias("other"))

        pure = F.struct(alone(state["left"], 1).alias("mine"), alone(state["left"], -1).alias("other"))
        return F.when(F.size(state["left"]) == 0, state).otherwise(_once(pure, remove))

    none = F.array().cast("array<bigint>")
    start = F.struct(difference.alias("left"), none.alias("mine"), none.alias("other"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _once(end, lambda e: F.when(F.size(e["left"]) == 0, F.struct(e["mine"].alias("mine"), e["other"].alias("other"))))


def first_size(a: Column, b: Column) -> Column:
    """Cells of each part on the first attempt: a power of two, at least both texts' digests and 8."""
    need = F.greatest(F.size(a) + F.size(b), F.lit(8))
    return F.least(F.pow(F.lit(2), F.ceil(F.log2(need))), F.lit(1 << 20)).cast("bigint")


def difference(a: Column, b: Column) -> Column:
    """The digests in which two texts differ, recovered from their sketches: a struct of arrays, mine and other."""
    tries = []
    for attempt in range(ATTEMPTS):
        size = F.least(first_size(a, b) * 4**attempt, F.lit(1 << 20).cast("bigint"))
        tries.append(_once(size, lambda m: peel(subtract(sketch(a, m), sketch(b, m)), m)))
    return F.coalesce(*tries)


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Shared digests over all digests of two texts."""

    def share(found):
        both, d = F.size(a) + F.size(b), F.size(found["mine"]) + F.size(found["other"])
        return F.when(both == 0, 1.0).when(found.isNull(), 0.0).otherwise((both - d) / (both + d)).cast("double")

    return _once(apart, share)


def fingerprint(keys: Column) -> Column:
    """The sketch of a text by itself as text: its SHA-256."""
    return F.sha2(F.to_json(F.struct(_once(first_size(keys, keys), lambda m: sketch(keys, m)).alias("cells"))), 256)


def compare(docs: DataFrame, left: str, right: str, output: str) -> DataFrame:
    """The rows with ``output``: a struct of the recovered digests of either side and the likeness of two text columns."""
    a, b = f"_{output}_a", f"_{output}_b"
    rows = docs.withColumns({a: digests(F.col(left)), b: digests(F.col(right))}).withColumn(f"_{output}_d", difference(F.col(a), F.col(b)))
    found = F.struct(F.col(f"_{output}_d").alias("differing"), likeness(F.col(a), F.col(b), F.col(f"_{output}_d")).alias("likeness"))
    return rows.withColumn(output, found).drop(a, b, f"_{output}_d")


def with_next_text(docs: DataFrame, doc_id: str, text: str, output: str, blocks: int | None = None) -> DataFrame:
    """Every row with the text of the next row by ascending id (ties by text, nulls first); after the last, the first.

    Rows are dealt into ranges of ids, each sorted by one task; the first row of every range follows the range before.
    """
    spark = docs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.select(F.percentile_approx(doc_id, F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 100_000)).first()[0] if blocks > 1 else []
    edges = sorted(set(edges or []))
    block = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(doc_id))) if edges else F.lit(0)
    rows = docs.withColumn("_block", F.when(F.col(doc_id).isNull(), -1).otherwise(block).cast("int"))
    heads = rows.groupBy("_block").agg(F.min(F.struct(F.col(doc_id), F.col(text))).alias("head")).select("_block", F.col(f"head.{text}").alias("_head"))
    starts = [r["_block"] for r in heads.select("_block").orderBy("_block").collect()]
    before = dict(zip(starts[1:] + starts[:1], starts))  # block -> the block that it follows
    heads = heads.withColumn("_block", F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_block")]) if before else heads
    order = Window.partitionBy("_block").orderBy(F.col(doc_id).asc_nulls_first(), F.col(text).asc_nulls_first())
    ahead = rows.withColumn("_next", F.lead(F.struct(F.col(text).alias("t"))).over(order))
    return ahead.join(heads, "_block").withColumn(output, F.when(F.col("_next").isNull(), F.col("_head")).otherwise(F.col("_next.t"))).drop("_block", "_next", "_head")


@query("op8_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next_text(docs, "doc_id", "text", "next").withColumn("n_chars", F.length("text").cast("bigint"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - part).cast("int")), F.left("next", part))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *[digests(F.col(c)).alias(c) for c in ("text", "edited", "next")])
    for c in ("edited", "next"):
        rows = rows.withColumn(f"near_{c}", likeness(F.col("text"), F.col(c), difference(F.col("text"), F.col(c))))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "near_edited", "near_next")
