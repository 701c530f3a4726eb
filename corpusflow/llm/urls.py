"""URL filter: explicit rules first, else a tree of path templates per host with smoothed labelled purity.

Level by level a path segment stays literal when enough urls of its node have it; else its shape (digits as ``{n}``)
does; else it becomes ``*``. Sibling branches whose share of labelled-unwanted urls, of paths that end there and of
numeric continuations do not differ from those of the other siblings (two-proportion tests) are merged into ``+``.
Each template with labelled urls is judged by their unwanted share, smoothed towards its host's and that towards the
whole; one without any is allowed. Work is done on distinct (host, path) pairs with counts, so repeated urls and hot hosts weigh no more than
their different paths, and every group is a sum.

Defined results: a null url or one without ``://`` has empty host and path and is judged as that one template. Without
any label nothing is rejected. Repeated rows get equal verdicts. Paths deeper than ``depth`` are alike from there on
(``**``). All columns of the input stay; new columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, stored, table

#: (verdict, host, path) as in "block net/".
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null when none does. Rules are few and stand in the plan."""
    text = verdict = F.lit(None).cast("string")
    for kind, of, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(below))
        text, verdict = F.when(fits, of + below).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _differs(part: Column, whole: Column, all_part: Column, all_whole: Column, z: float) -> Column:
    """Two-proportion test of a branch against its siblings. Cases on one side only count as different, none as alike."""
    rest_part, rest = all_part - part, all_whole - whole
    pooled = all_part / F.nullif(all_whole, F.lit(0))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(whole, F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
    gap = F.abs(part / F.nullif(whole, F.lit(0)) - rest_part / F.nullif(rest, F.lit(0)))
    return F.when((whole > 0) != (rest > 0), True).otherwise(F.coalesce(gap > z * spread + 1e-12, F.lit(False)))


def templates(urls: DataFrame, *, depth: int = 4, least: int = 5, share: float = 0.01, z: float = 2.0) -> DataFrame:
    """(host, path, template, bad, good) for distinct (host, path) rows with counts n, bad and good."""
    rows = stored(urls.select(
        "host", "path", "n", "bad", "good", F.lit("").alias("node"), F.split(F.regexp_replace("path", "^/", ""), "/").alias("s")), "urls")
    for level in range(depth):
        seg = F.coalesce(F.get("s", F.lit(level)), F.lit(""))
        here = rows.withColumns({
            "seg": seg, "shape": F.regexp_replace(seg, "[0-9]+", "{n}"), "more": F.size("s") > level,
            "ends": F.when(F.size("s") <= level + 1, F.col("n")).otherwise(0),
            "numeric": F.when(F.coalesce(F.get("s", F.lit(level + 1)), F.lit("")).rlike("[0-9]"), F.col("n")).otherwise(0)})
        sums = [F.sum(c).alias(c) for c in ("n", "bad", "good", "ends", "numeric")]
        segs = stored(here.where("more").groupBy("host", "node", "seg", "shape").agg(*sums), "segments")
        of_node = segs.groupBy("host", "node").agg(F.sum("n").alias("node_n"))
        of_shape = segs.groupBy("host", "node", "shape").agg(F.sum("n").alias("shape_n"))
        frequent = lambda c: (F.col(c) >= least) & (F.col(c) >= share * F.col("node_n"))
        named = segs.join(of_node, ["host", "node"]).join(of_shape, ["host", "node", "shape"]).withColumn(
            "token", F.when(frequent("n"), F.col("seg")).when(frequent("shape_n"), F.col("shape")).otherwise("*"))
        tokens = named.groupBy("host", "node", "token").agg(*sums)
        whole = tokens.groupBy("host", "node").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good", "ends", "numeric")])
        c = F.col
        alone = (
            _differs(c("bad"), c("bad") + c("good"), c("all_bad"), c("all_bad") + c("all_good"), z)
            | _differs(c("ends"), c("n"), c("all_ends"), c("all_n"), z) | _differs(c("numeric"), c("n"), c("all_numeric"), c("all_n"), z)
            | (c("n") == c("all_n")))
        merged = tokens.join(whole, ["host", "node"]).select("host", "node", "token", F.when(alone, F.col("token")).otherwise("+").alias("branch"))
        branch = stored(named.join(merged, ["host", "node", "token"]).select("host", "node", "seg", "branch"), "branches")
        rows = stored(
            here.join(branch, ["host", "node", "seg"], "left")
            .withColumn("node", F.when(F.col("more"), F.concat("node", F.lit("/"), "branch")).otherwise(F.col("node")))
            .select("host", "path", "n", "bad", "good", "node", "s"), "urls")
    return rows.select("host", "path", F.when(F.size("s") > depth, F.concat("node", F.lit("/**"))).otherwise(F.col("node")).alias("template"), "n", "bad", "good")


def judge(
    urls: DataFrame, url: str = "url", label: str | None = None, rules=RULES, *, smoothing: float = 5.0, limit: float = 0.5, **tree,
) -> DataFrame:
    """The rows with host, path, rule, template, purity (smoothed unwanted share) and verdict (allow or block).

    ``label``: 1 unwanted, 0 wanted, else unlabelled; without it the rules' own verdicts are the labels.
    """
    names = ("host", "path", "rule", "template", "purity", "verdict")
    base = urls.drop(*names).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "_by_rule": by_rule})
    mark = F.col(label) if label else F.when(F.col("_by_rule") == "block", 1).when(F.col("_by_rule") == "allow", 0)
    counts = base.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(F.when(mark == 1, 1)).alias("bad"), F.count(F.when(mark == 0, 1)).alias("good"))
    tree_rows = stored(templates(counts, **tree), "templates")
    total = tree_rows.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    labelled = (total["bad"] or 0) + (total["good"] or 0)
    overall = F.lit((total["bad"] or 0) / labelled if labelled else 0.0)
    smooth = lambda prior: (F.sum("bad") + smoothing * prior) / (F.sum("bad") + F.sum("good") + smoothing)
    hosts = tree_rows.groupBy("host").agg(smooth(overall).alias("host_share"))
    judged = tree_rows.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).join(hosts, "host").select(
        "host", "template", (F.col("bad") + F.col("good")).alias("labelled"), ((F.col("bad") + smoothing * F.col("host_share")) / (F.col("bad") + F.col("good") + smoothing)).alias("purity"))
    found = stored(tree_rows.select("host", "path", "template").join(judged, ["host", "template"]), "judged")
    verdict = F.coalesce("_by_rule", F.when((F.col("purity") >= limit) & (F.col("labelled") > 0), "block").otherwise("allow"))
    return base.join(found, ["host", "path"]).withColumn("verdict", verdict).drop("_by_rule", "labelled")


@query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
