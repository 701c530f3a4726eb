"""Retrieval queries. `embeddings` is the collection, `label` its platform, every vector also a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.embedding import embed
from corpusflow.functions.vectors import distance, dot, l2_normalize, norm, similarity
from corpusflow.operators.idf import embed_idf, fit_idf, load_idf, save_idf
from corpusflow.operators.retrieval import build_context, count_above_floor, rag_sources, retrieve
from corpusflow.operators.vector_index import build_index
from corpusflow.plans.ask import ask
from corpusflow.plans.workloads.base import Tables, query
from corpusflow.plans.workloads.routing import LANGUAGE_VALUES, LANGUAGES
from corpusflow.session import scratch_path

DIMS = 64


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings.withColumnRenamed("label", "platform")
    return (
        e.select(F.col("vec_id").alias("qid"), "platform", F.col("embedding").alias("qvec")),
        e.select(F.col("vec_id").alias("id"), "platform", F.col("embedding").alias("vec")),
    )


_PAIRS = """
    unit AS (
        SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v
        FROM embeddings
    ),
    pairs AS (
        SELECT q.vec_id AS qid, c.vec_id AS id, round(greatest(0, list_dot_product(q.v, c.v)), 9) AS s
        FROM unit q JOIN unit c ON q.label = c.label AND q.vec_id <> c.vec_id
    ),
    hits AS (
        SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM pairs WHERE s >= 0.30
    )
"""


@query("retrieve_topk", f"WITH {_PAIRS} SELECT qid, id AS vec_id, round(s, 6) AS score, rank::INTEGER AS rank FROM hits WHERE rank <= 5")
def retrieve_topk(t: Tables) -> DataFrame:
    hits = retrieve(*_sides(t), skip_self=True)
    return hits.select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("retrieve_topk_grid", f"WITH {_PAIRS} SELECT qid, id AS vec_id, round(s, 6) AS score, rank::INTEGER AS rank FROM hits WHERE rank <= 5")
def retrieve_topk_grid(t: Tables) -> DataFrame:
    """The path for more questions than may be broadcast."""
    hits = retrieve(*_sides(t), skip_self=True, broadcast_bytes=0)
    return hits.select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("knn_floor", f"""
    WITH {_PAIRS}
    SELECT e.vec_id AS qid, count(p.id) AS n_above_floor
    FROM embeddings e LEFT JOIN pairs p ON p.qid = e.vec_id AND p.s >= 0.30 GROUP BY 1
""")
def knn_floor(t: Tables) -> DataFrame:
    return count_above_floor(*_sides(t), skip_self=True).withColumnRenamed("n", "n_above_floor")


@query("similarity_spaces", """
    WITH parts AS (
        SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
    ),
    means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2),
    centres AS (
        SELECT label, list(m / sqrt(length) ORDER BY pos) AS c
        FROM means JOIN (SELECT label, sum(m * m) AS length FROM means GROUP BY 1) USING (label) GROUP BY 1
    ),
    spaces AS (SELECT unnest(['cosine', 'ip', 'l2', 'hamming']) AS space),
    distances AS (
        SELECT vec_id, space, CASE space
            WHEN 'cosine' THEN 1 - list_dot_product(e, c) / sqrt(list_dot_product(e, e) * list_dot_product(c, c))
            WHEN 'ip' THEN -list_dot_product(e, c)
            ELSE list_dot_product(e, e) + list_dot_product(c, c) - 2 * list_dot_product(e, c) END AS dist
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) JOIN centres USING (label), spaces
    )
    SELECT vec_id, space, round(greatest(0.0, least(1.0, CASE space
        WHEN 'cosine' THEN 1 - dist WHEN 'ip' THEN -dist ELSE 1 - dist / 2 END)), 6) AS score
    FROM distances
""")
def similarity_spaces(t: Tables) -> DataFrame:
    """Similarity of every vector to its platform's centre, converted from the distance of each metric space."""
    means = (
        t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    # one entry per dimension
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms")).select(
        "label", l2_normalize(F.transform("ms", lambda p: p["m"])).alias("centre")
    )
    spaces = ("cosine", "ip", "l2", "hamming")
    scored = F.array(*[
        F.struct(F.lit(s).alias("space"), F.round(similarity(distance("embedding", "centre", s), s), 6).alias("score"))
        for s in spaces
    ])
    return t.embeddings.join(centres, "label").select("vec_id", F.inline(scored))


@query("l2_normalize", """
    SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm_before,
           round(sqrt(list_dot_product(u, u)), 6) AS norm_after, round(u[1], 6) AS first
    FROM (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
          FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 3 * x) AS v FROM embeddings))
""")
def normalize(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3).alias("v"))
    u = v.withColumn("u", l2_normalize("v"))
    return u.select(
        "vec_id", F.round(norm("v"), 6).alias("norm_before"), F.round(norm("u"), 6).alias("norm_after"),
        F.round(F.col("u")[0], 6).alias("first"),
    )


@query("index_cells", """
    SELECT label AS platform, count(*) AS n_rows, count(*) AS n_ids, sum(vec_id)::BIGINT AS id_sum,
           true AS cells_fit, true AS weights_fit
    FROM embeddings GROUP BY 1
""")
def index_cells(t: Tables) -> DataFrame:
    """The inverted-file index itself: every row lies in one cell, and the centroids' weights are the cells' shares."""
    index = build_index(_sides(t)[1])
    cells = index.rows.groupBy("platform", "cell").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("id").alias("sum"))
    both = cells.join(index.centroids.select("platform", "cell", "weight"), ["platform", "cell"], "left")
    return both.groupBy("platform").agg(
        F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), F.sum("sum").alias("id_sum"),
        (F.count("*") <= F.ceil(F.sqrt(F.sum("n")) * 4)).alias("cells_fit"),
        (F.abs(F.sum("weight") - 1) < 1e-6).alias("weights_fit"),
    )


@query("retrieve_approx", f"""
    WITH {_PAIRS}
    SELECT count(DISTINCT e.vec_id) AS questions, count(h.id) AS n_exact, true AS recall_ok, true AS scores_exact, true AS third
    FROM embeddings e LEFT JOIN hits h ON h.qid = e.vec_id AND h.rank <= 5
""")
def approx(t: Tables) -> DataFrame:
    """The index against the exact search: recall over all platforms, exact scores, and the share of the rows scored."""
    questions, rows = _sides(t)
    index = build_index(rows)
    exact = retrieve(questions, rows, skip_self=True).select("qid", "id", F.col("score").alias("true_score"))
    found = index.search(questions, skip_self=True).select("qid", "id", "score")
    side = lambda name: t.embeddings.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"{name}_v"))
    true = F.greatest(F.lit(0.0), dot("qid_v", "id_v") / (norm("qid_v") * norm("id_v")))
    wrong = found.join(side("qid"), "qid").join(side("id"), "id").groupBy("qid").agg(
        F.max(F.abs(F.col("score") - true)).alias("gap"))
    hits = exact.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("n_exact"), F.count("score").alias("hit"))
    cells = index.rows.groupBy("platform", "cell").agg(F.count("*").alias("n"))
    scored = index.probes(questions).join(cells, ["platform", "cell"]).groupBy("qid").agg(F.sum("n").alias("scored"))
    asked = questions.select("qid", "platform")
    for part in (hits, wrong, scored):
        asked = asked.join(part, "qid", "left")
    per_platform = asked.groupBy("platform").agg(
        F.count("*").alias("n"), F.sum("n_exact").alias("n_exact"), F.sum("hit").alias("hit"), F.max("gap").alias("gap"),
        (F.sum("scored") <= F.count("*") * F.count("*") / 3).alias("third"))
    return per_platform.agg(
        F.sum("n").alias("questions"), F.sum("n_exact").alias("n_exact"), (F.sum("hit") >= 0.9 * F.sum("n_exact")).alias("recall_ok"),
        (F.max("gap") < 1e-6).alias("scores_exact"), F.min("third").alias("third"))


def _hits_with_documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    questions, rows = _sides(t)
    docs = t.documents.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    return questions, retrieve(questions, rows, skip_self=True).join(docs, "id")


@query("rag_context", f"""
    WITH {_PAIRS},
    blocks AS (
        SELECT qid, string_agg(printf('[Source: %s | Score: %.2f]', source, s) || chr(10)
               || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10), chr(10) ORDER BY rank) AS context
        FROM hits JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY 1
    )
    SELECT vec_id AS qid, coalesce(context, 'No relevant documentation retrieved.') AS context
    FROM embeddings LEFT JOIN blocks ON qid = vec_id
""")
def rag_context(t: Tables) -> DataFrame:
    return build_context(*_hits_with_documents(t))


@query("rag_sources", f"""
    WITH {_PAIRS}
    SELECT qid, string_agg(source || '=' || printf('%.4f', s), ';' ORDER BY rank) AS sources
    FROM hits JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY 1
""")
def sources(t: Tables) -> DataFrame:
    _, hits = _hits_with_documents(t)
    shown = F.transform("sources", lambda s: F.concat(s["source"], F.lit("="), F.format_string("%.4f", s["score"])))
    return rag_sources(hits).select("qid", F.array_join(shown, ";").alias("sources"))


_EMBED = """
    words AS (
        SELECT kind, id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w
        FROM texts
    ),
    counts AS (SELECT kind, id, ('0x' || left(md5(w), 8))::BIGINT % 64 AS b, count(*) AS c FROM words GROUP BY ALL),
    weights AS (
        SELECT kind, id, b, (c / sqrt(sum(c * c) OVER (PARTITION BY kind, id)))::FLOAT::DOUBLE AS w FROM counts
    )
"""


@query("embed_docs", f"""
    WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents), {_EMBED}
    SELECT doc_id, 64 AS dims, count(b)::INTEGER AS filled, coalesce(round(sum(w * w), 4), 0) AS length,
           coalesce(round(sum(w * (b + 1)), 2), 0) AS weighted
    FROM documents LEFT JOIN weights ON id = doc_id GROUP BY 1
""")
def embed_docs(t: Tables) -> DataFrame:
    return _described(t.spread("documents").select("doc_id", embed(F.col("text"), DIMS).alias("v")))


def _described(v: DataFrame) -> DataFrame:
    position = F.sequence(F.lit(1), F.size("v"))
    return v.select(
        "doc_id", F.size("v").alias("dims"), F.size(F.filter("v", lambda x: x != 0)).alias("filled"),
        F.round(dot("v", "v"), 4).alias("length"), F.round(dot("v", position.cast("array<double>")), 2).alias("weighted"),
    )


@query("embed_docs_idf", f"""
    WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents),
    words AS (
        SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w FROM texts
    ),
    idf AS (SELECT w, ln((1 + (SELECT count(*) FROM texts)) / (1.0 + count(DISTINCT id))) + 1 AS f FROM words GROUP BY 1),
    sums AS (SELECT id, ('0x' || left(md5(w), 8))::BIGINT % 64 AS b, sum(f) AS s FROM words JOIN idf USING (w) GROUP BY ALL),
    weights AS (SELECT id, b, (s / sqrt(sum(s * s) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w FROM sums)
    SELECT doc_id, 64 AS dims, count(b)::INTEGER AS filled, coalesce(round(sum(w * w), 4), 0) AS length,
           coalesce(round(sum(w * (b + 1)), 2), 0) AS weighted
    FROM documents LEFT JOIN weights ON id = doc_id GROUP BY 1
""")
def embed_with_idf(t: Tables) -> DataFrame:
    """Fit the weights over the documents, store them, and embed the documents with the stored model."""
    path = scratch_path(t.spark, "idf")
    docs = t.spread("documents").select("doc_id", "text")
    save_idf(fit_idf(docs), path)
    return _described(embed_idf(docs, load_idf(t.spark, path), "doc_id", dims=DIMS).withColumnRenamed("embedding", "v"))


@query("ask", f"""
    WITH texts AS (
        SELECT 'q' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents
    ), {_EMBED},
    dictionary(label, keyword, weight) AS (VALUES {LANGUAGE_VALUES}),
    scores AS (
        SELECT item_id, label, sum(CASE WHEN contains(lower(text), keyword) THEN weight ELSE 0 END) AS score
        FROM benchmark, dictionary GROUP BY ALL
    ),
    tops AS (SELECT item_id, max(score) AS top FROM scores GROUP BY 1),
    routed AS (
        SELECT item_id, CASE WHEN count(*) = 1 AND any_value(top) > 0 THEN any_value(label) ELSE 'ambiguous' END AS platform
        FROM scores JOIN tops USING (item_id) WHERE score = top GROUP BY 1
    ),
    pairs AS (
        SELECT q.id AS qid, d.id AS id, round(least(1.0, sum(q.w * d.w)
               / sqrt(any_value(qn.n) * any_value(dn.n))), 9) AS s
        FROM weights q JOIN weights d ON q.b = d.b AND q.kind = 'q' AND d.kind = 'd'
        JOIN (SELECT kind, id, sum(w * w) AS n FROM weights GROUP BY ALL) qn ON qn.kind = 'q' AND qn.id = q.id
        JOIN (SELECT kind, id, sum(w * w) AS n FROM weights GROUP BY ALL) dn ON dn.kind = 'd' AND dn.id = d.id
        JOIN routed ON routed.item_id = q.id JOIN documents ON doc_id = d.id AND lang = platform
        GROUP BY 1, 2
    ),
    hits AS (
        SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM pairs WHERE s >= 0.30
    ),
    found AS (SELECT qid, string_agg('doc/' || id, ' ' ORDER BY rank) AS sources, count(*) AS n FROM hits WHERE rank <= 5 GROUP BY 1)
    SELECT item_id AS qid, platform, coalesce(sources, '') AS sources,
           coalesce(n, 0)::INTEGER AS n FROM routed LEFT JOIN found ON qid = item_id
""")
def ask_benchmark(t: Tables) -> DataFrame:
    """Route every benchmark question by language, then search the documents of that language."""
    questions = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    path = F.concat(F.lit("doc/"), "doc_id")
    docs = t.spread("documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), embed(F.col("text"), DIMS).alias("embedding"),
        path.alias("source"), F.col("lang").alias("platform"),
    )
    answered = ask(questions, docs, LANGUAGES, dims=DIMS)
    listed = F.transform(F.coalesce("sources", F.expr("array()")), lambda s: s["source"])
    return answered.select("qid", "platform", F.array_join(listed, " ").alias("sources"), F.size(listed).alias("n"))
