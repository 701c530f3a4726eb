"""Secret scans: candidate strings judged by a random forest. Everything here is DataFrame expressions and Spark ML.

A candidate is a run of at least 12 letters, digits and ``+/_-`` that holds a digit or stands behind ``=`` or ``:``.
A forest trained on labelled findings tells secrets from look-alikes by the candidate's length, its transitions
between kinds of characters, the share of it that the corpus uses as words, its path and the words beside it. The
word counts behind the dictionary cover all texts; the forest is fitted on at most ``train_rows`` labelled findings of
each kind, those with the smallest hashes. Where no labelled findings are given, as in the query and the pipeline, rules
over the forest's own features label the findings that they settle (``weak_labels``).

Defined results: null and empty texts have no candidates, a null path counts as empty. Equal rows (id, path and text)
share one set of findings. Without labelled findings of both kinds there is no forest: a finding is what its own label says, and no secret without one. The control
character U+0001 counts as a blank. In ``redact`` all columns stay and only texts with a secret change.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, stored, table

CANDIDATE = r"""(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}|(?<=[=:]["']?)[A-Za-z+/_\-]{12,})={0,2}"""
# Published shapes of issued keys, and the words that announce a secret or a plain identifier.
ISSUED = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,})"
ANNOUNCED = r"""(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|credentials?|auth)["']?\s*[=:]\s*["']?$"""
PLAIN = r"""(?i)(commit|sha1?|sha256|md5|checksum|digest|uuid|guid|isbn|doi|version|revision)["']?\s*[=: ]\s*["']?$"""
BENIGN = r"^([0-9+/_\-]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|.*(.)\2{7,}.*)$"
SIDE = 64  # characters of context
MARK = "[SECRET]"

FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "changes", "class_changes", "variety", "hex", "dictionary", "path_depth",
    "path_is_test", "announced", "announced_near", "plain_near", "after_equals", "quoted", "inside_address", "left_is_word", "right_is_word",
)


def _pieces(text: Column) -> Column:
    """The text cut at its candidates: plain, candidate, plain, candidate, ..., plain."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u0001", " "), CANDIDATE, "\u0001$0\u0001")
    return F.split(marked, "\u0001")


def _key(docs: DataFrame, doc_id: str, text: str, path: str | None) -> list[Column]:
    parts = [F.col(doc_id).cast("string"), F.col(path) if path else F.lit(None), F.col(text)]
    whole = F.to_json(F.struct(*[F.coalesce(x, F.lit("\u0000")).alias(f"c{i}") for i, x in enumerate(parts[:2])]))
    return [F.xxhash64(whole, parts[2]).alias("k1"), F.hash(whole, parts[2]).alias("k2")]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """k1, k2 (the row), nth, doc_id, path, secret, first (character), length, left, right: one row per candidate."""
    cut = docs.select(
        *_key(docs, doc_id, text, path), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path) if path else F.lit(""), F.lit("")).alias("path"),
        _pieces(F.col(text)).alias("p")).where(F.size("p") > 1)
    each = F.transform(F.sequence(F.lit(1), ((F.size("p") - 1) / 2).cast("int")), lambda i: F.struct(
        i.alias("nth"), F.length(F.get("p", i * 2 - 2)).alias("gap"), F.get("p", i * 2 - 1).alias("secret"),
        F.right(F.get("p", i * 2 - 2), F.lit(SIDE)).alias("left"), F.left(F.get("p", i * 2), F.lit(SIDE)).alias("right")))
    rows = cut.select("k1", "k2", "doc_id", "path", F.explode(each).alias("c")).select("k1", "k2", "doc_id", "path", "c.*").dropDuplicates(["k1", "k2", "nth"])
    so_far = Window.partitionBy("k1", "k2").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("secret")).over(so_far)
    return rows.withColumn("first", end - F.length("secret")).withColumn("length", F.length("secret").cast("bigint")).drop("gap")


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def with_features(found: DataFrame, docs: DataFrame, text: str = "text", least_docs: int = 3) -> DataFrame:
    """The candidates with the forest's features. A word of the dictionary occurs in at least so many texts."""
    found = stored(found, "candidates")
    s, n = F.col("secret"), F.length("secret").cast("double")
    runs = F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z]+"), lambda x: F.length(x) >= 3))
    left_word = F.lower(F.regexp_extract("left", r"([A-Za-z]{3,})[^A-Za-z]*$", 1))
    right_word = F.lower(F.regexp_extract("right", r"^[^A-Za-z]*([A-Za-z]{3,})", 1))
    wanted = found.select(F.explode(F.concat(runs, F.array(left_word, right_word))).alias("word")).where("word != ''").distinct()
    used = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z]+"))).alias("word"))
    known = stored(
        used.join(stored(wanted, "wanted"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_docs).select("word"), "dictionary")
    values = found.select("secret").distinct().select("secret", F.explode(runs).alias("word")).join(known, "word")
    covered = values.groupBy("secret").agg((F.sum(F.length("word")) / F.first(F.length("secret"))).alias("dictionary"))
    kind = F.translate(s, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    out = found.join(covered, "secret", "left").withColumns({"left_word": left_word, "right_word": right_word})
    out = out.join(known.select(F.col("word").alias("left_word"), F.lit(1.0).alias("left_is_word")), "left_word", "left")
    out = out.join(known.select(F.col("word").alias("right_word"), F.lit(1.0).alias("right_is_word")), "right_word", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return out.withColumns({
        "digits": _count(s, "[^0-9]") / n, "uppers": _count(s, "[^A-Z]") / n, "lowers": _count(s, "[^a-z]") / n, "signs": _count(s, "[A-Za-z0-9]") / n,
        "changes": _count(F.regexp_replace(s, r"(.)\1*", "x"), "") / n, "class_changes": _count(F.regexp_replace(kind, r"(.)\1*", "x"), "") / n,
        "variety": F.size(F.array_distinct(F.split(s, ""))) / n, "hex": flag(s.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "dictionary": F.coalesce("dictionary", F.lit(0.0)), "path_depth": F.size(F.split("path", "/")).cast("double"),
        "path_is_test": flag(F.lower("path").rlike("test|example|sample|fixture|doc")), "announced": flag(F.col("left").rlike(ANNOUNCED)),
        "announced_near": flag(F.lower("left").rlike("pass|secret|token|key|credential|auth")), "plain_near": flag(F.col("left").rlike(PLAIN)),
        "after_equals": flag(F.col("left").rlike(r"""[=:]\s*["']?$""")), "quoted": flag(F.col("left").rlike("""["'`]$""")),
        "inside_address": flag(
            F.col("left").rlike(r"[@./]$") | (F.col("left").rlike(":$") & ~F.col("left").rlike(ANNOUNCED)) | F.col("right").rlike(r"^[@.][A-Za-z0-9]")),
        "left_is_word": F.coalesce("left_is_word", F.lit(0.0)), "right_is_word": F.coalesce("right_is_word", F.lit(0.0)),
    })


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings with a label where their shape or announcement settles it: 1 secret, 0 not, else null."""
    s = F.col("secret")
    secret = s.rlike(ISSUED) | ((F.col("announced") > 0) & (F.col("digits") > 0) & (F.col("dictionary") < 0.5))
    plain = s.rlike(BENIGN) | (F.col("plain_near") > 0) | (F.col("inside_address") > 0) | (F.col("dictionary") >= 0.5)
    return found.withColumn("label", F.when(plain & ~s.rlike(ISSUED), 0).when(secret, 1))


def _vectors(found: DataFrame) -> DataFrame:
    rows = found.withColumns({f"_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})
    return VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="_features").transform(rows).drop(*[f"_{f}" for f in FEATURES])


def train(labelled: DataFrame, *, train_rows: int = 20_000, trees: int = 30, depth: int = 6) -> RandomForestClassificationModel | None:
    """A forest from findings with features and a label 0 or 1, at most ``train_rows`` of each; None unless both occur."""
    rows = labelled.where("label in (0, 1)").withColumn("label", F.col("label").cast("double"))
    counted = rows.groupBy("label").count().collect()
    if len(counted) < 2:
        return None
    share = {r["label"]: min(train_rows, r["count"]) for r in counted}
    weight = F.when(F.col("label") == 1, 1.0 / share[1.0]).otherwise(1.0 / share[0.0]) * sum(share.values()) / 2
    of = lambda kind: rows.where(F.col("label") == kind).orderBy(F.xxhash64("secret", "left", "right"), "secret", "left", "right").limit(train_rows)
    sample = of(0.0).unionByName(of(1.0))
    data = stored(_vectors(sample).select("label", "_features", weight.alias("weight")), "findings")
    return RandomForestClassifier(
        featuresCol="_features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=7).fit(data)


def judge(found: DataFrame, model: RandomForestClassificationModel | None, limit: float = 0.5) -> DataFrame:
    """The findings with ``score`` and ``is_secret``. Without a forest a finding is what its column ``label`` says, if it has
    one; all others are no secrets."""
    if model is None:
        known = F.coalesce(F.col("label").cast("double"), F.lit(0.0)) if "label" in found.columns else F.lit(0.0)
        return found.withColumn("score", known).withColumn("is_secret", F.col("score") >= limit)
    model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
    scored = model.transform(_vectors(found)).withColumn("score", vector_to_array("_p")[1])
    return scored.withColumn("is_secret", F.col("score") >= limit).drop("_p", "_r", "_y", "_features")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """All candidates with their features and verdicts; labelled findings default to those that rules settle."""
    found = stored(with_features(candidates(docs, doc_id, text, path), docs, text), "featured")
    ruled = weak_labels(found) if labelled is None else found
    return judge(ruled, train(ruled if labelled is None else labelled)).drop("label")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """The documents with every secret replaced by a mark."""
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    doc_id, text, path = names[doc_id], names[text], names[path] if path else None
    held = docs.select([F.col(f"`{c}`").alias(k) for c, k in names.items()])
    secrets = stored(
        scan(held, doc_id, text, path).where("is_secret").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("nth")).alias("_nth")), "secrets")
    keyed = held.withColumns(dict(zip(("k1", "k2"), _key(held, doc_id, text, path))))
    some = F.coalesce(F.col(text), F.lit("")).rlike(CANDIDATE)
    judged = keyed.where(some).join(secrets, ["k1", "k2"], "left")
    hidden = F.transform(_pieces(F.col(text)), lambda x, i: F.when((i % 2 == 1) & F.array_contains("_nth", ((i + 1) / 2).cast("int")), F.lit(MARK)).otherwise(x))
    judged = judged.withColumn(text, F.when(F.col("_nth").isNotNull(), F.array_join(hidden, "")).otherwise(F.col(text)))
    whole = keyed.where(~some).select(*held.columns).union(judged.select(*held.columns))
    return whole.select([F.col(k).alias(c) for c, k in names.items()])


@query("op2_secrets")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "nth", F.col("first").cast("bigint").alias("first"), "length", F.sha2("secret", 256).alias("secret_sha256"), "score", "is_secret")
