"""Catalog queries. Parts are datasets, suppliers dashboards, nations glossary terms, regions domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import dataset_urn, kv_to_map, parse_dataset_urn
from corpusflow.operators.catalog import (
    add_tags, current_version, dataset_detail, facet, filter_attrs, flatten_nested, object_rollup, search_entities,
    search_glossary, summarize_entities,
)
from corpusflow.operators.lineage import capped_lineage, lineage, lineage_totals
from corpusflow.plans.workloads.base import Tables, query
from corpusflow.plans.workloads.web import DOMAIN_SQL, with_source

_PART_URN_SQL = "'urn:li:dataset:(urn:li:dataPlatform:' || lower(p_type) || ',shop.part_' || p_partkey || ',PROD)'"


def _part_urn() -> Column:
    return dataset_urn(F.lower("p_type"), F.concat(F.lit("shop.part_"), "p_partkey"))


def _properties(**fields) -> Column:
    names = ("name", "displayName", "description", "definition")
    return F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names]).alias("properties")


def _entities(t: Tables) -> DataFrame:
    """Raw entities whose names and descriptions are partly missing, so the fallbacks matter."""
    none = F.lit(None).cast("string")
    parts = t.part.select(
        _part_urn().alias("urn"), F.lit("DATASET").alias("type"), F.col("p_brand").alias("name"), F.lower("p_type").alias("platform"),
        _properties(
            name=F.when(F.col("p_size") > 20, F.col("p_name")).otherwise(""),
            displayName=F.when(F.col("p_size") > 10, F.concat(F.lit("Shown "), "p_name")),
            description=F.when(F.col("p_retailprice") > 950, F.concat("p_type", F.lit(" goods"))),
        ),
    )
    suppliers = t.supplier.select(
        F.concat(F.lit("urn:li:dashboard:(looker,"), "s_suppkey", F.lit(")")).alias("urn"), F.lit("DASHBOARD").alias("type"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.lit("looker").alias("platform"), _properties(),
    )
    nations = t.nation.select(
        F.concat(F.lit("urn:li:glossaryTerm:"), "n_name").alias("urn"), F.lit("GLOSSARY_TERM").alias("type"), none.alias("name"),
        none.alias("platform"), _properties(name=F.col("n_name"), definition=F.concat(F.lit("Nation of region "), "n_regionkey")),
    )
    regions = t.region.select(
        F.concat(F.lit("urn:li:domain:"), "r_name").alias("urn"), F.lit("DOMAIN").alias("type"), none.alias("name"),
        none.alias("platform"), _properties(),
    )
    return parts.unionByName(suppliers).unionByName(nations).unionByName(regions)


_ENTITIES_SQL = f"""
    entities AS (
        SELECT {_PART_URN_SQL} AS urn, 'DATASET' AS type,
               CASE WHEN p_size > 20 THEN p_name WHEN p_size > 10 THEN 'Shown ' || p_name ELSE p_brand END AS name,
               lower(p_type) AS platform, CASE WHEN p_retailprice > 950 THEN p_type || ' goods' ELSE '' END AS description FROM part
        UNION ALL SELECT 'urn:li:dashboard:(looker,' || s_suppkey || ')', 'DASHBOARD',
               CASE WHEN s_acctbal > 0 THEN s_name ELSE 'urn:li:dashboard:(looker,' || s_suppkey || ')' END, 'looker', '' FROM supplier
        UNION ALL SELECT 'urn:li:glossaryTerm:' || n_name, 'GLOSSARY_TERM', n_name, '', 'Nation of region ' || n_regionkey FROM nation
        UNION ALL SELECT 'urn:li:domain:' || r_name, 'DOMAIN', 'urn:li:domain:' || r_name, '', '' FROM region
    )
"""


@query("entity_summary", f"WITH {_ENTITIES_SQL} SELECT * FROM entities")
def summaries(t: Tables) -> DataFrame:
    return summarize_entities(_entities(t))


@query("entity_search", f"""
    WITH {_ENTITIES_SQL} SELECT * FROM entities
    WHERE type = 'DATASET' AND (contains(lower(name), 'gear') OR contains(lower(description), 'gear') OR contains(lower(urn), 'gear'))
    ORDER BY name, urn LIMIT 10
""")
def search(t: Tables) -> DataFrame:
    return search_entities(summarize_entities(_entities(t)), "GEAR", "dataset")


@query("glossary_search", f"""
    WITH {_ENTITIES_SQL} SELECT urn, name, description AS definition FROM entities WHERE type = 'GLOSSARY_TERM' ORDER BY name, urn LIMIT 20
""")
def glossary(t: Tables) -> DataFrame:
    return search_glossary(summarize_entities(_entities(t)))


@query("attr_filter", "SELECT p_partkey, p_type, p_brand FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_brand IN ('Brand#4', 'Brand#7', 'Brand#17')")
def attributes(t: Tables) -> DataFrame:
    filters = [{"Name": "p_type", "Values": ["PROMO", "SMALL"]}, {"Name": "p_brand", "Values": ["Brand#4", "Brand#7", "Brand#17"]}]
    return filter_attrs(t.part.select("p_partkey", "p_type", "p_brand"), filters)


@query("platform_facets", """
    SELECT p_brand AS urn, p_brand AS name, count(*) AS entity_count FROM part GROUP BY 1
""")
def facets(t: Tables) -> DataFrame:
    return facet(t.part, "p_brand")


@query("object_rollup", f"""
    SELECT {DOMAIN_SQL} AS bucket, count(*) AS object_count, sum(length(html))::BIGINT AS total_size_bytes
    FROM pages WHERE starts_with(url, 'https://') GROUP BY 1
""")
def objects(t: Tables) -> DataFrame:
    inventory = with_source(t.pages).select(
        F.col("source").alias("bucket"), F.col("url").alias("key"), F.length("html").cast("long").alias("size")
    )
    return object_rollup(inventory, "https://")


def _edges(t: Tables) -> DataFrame:
    node = lambda kind, column: F.concat(F.lit(f"{kind}/"), column)
    lines = t.lineitem
    return (
        t.orders.select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst"))
        .unionByName(lines.select(node("order", "l_orderkey").alias("src"), node("part", "l_partkey").alias("dst")))
        .unionByName(lines.select(node("part", "l_partkey").alias("src"), node("supplier", "l_suppkey").alias("dst")))
    )


_EDGES_SQL = """
    edges AS (
        SELECT 'customer/' || o_custkey AS src, 'order/' || o_orderkey AS dst FROM orders
        UNION SELECT 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem
        UNION SELECT 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem
    )
"""


@query("lineage_hops", f"""
    WITH {_EDGES_SQL},
    one AS (SELECT 'customer/' || c_custkey AS seed, dst AS node FROM customer JOIN edges ON src = 'customer/' || c_custkey),
    two AS (SELECT DISTINCT seed, dst AS node FROM one JOIN edges ON src = node)
    SELECT seed, node, 1 AS degree FROM one UNION ALL SELECT seed, node, 2 FROM two
""")
def hops(t: Tables) -> DataFrame:
    """Orders and parts downstream of every customer."""
    seeds = t.customer.select(F.concat(F.lit("customer/"), "c_custkey").alias("seed"))
    return lineage(_edges(t), seeds, "DOWNSTREAM", 2)


@query("lineage_capped", f"""
    WITH {_EDGES_SQL},
    seeds AS (SELECT 'part/' || p_partkey AS seed FROM part),
    one AS (SELECT seed, src AS node, 1 AS degree FROM seeds JOIN edges ON dst = seed),
    two AS (SELECT DISTINCT seed, src AS node, 2 AS degree FROM one JOIN edges ON dst = node),
    reached AS (SELECT * FROM one UNION ALL SELECT * FROM two),
    totals AS (SELECT seed, count(*) AS total_all_hops FROM reached GROUP BY 1)
    SELECT seed, node, degree, total_all_hops FROM (
        SELECT *, row_number() OVER (PARTITION BY seed ORDER BY degree, node) AS rn FROM reached WHERE degree <= 1
    ) JOIN totals USING (seed) WHERE rn <= 20
""")
def capped(t: Tables) -> DataFrame:
    """The first 20 orders one hop upstream of every part, and how many nodes there are over all hops."""
    seeds = t.part.select(F.concat(F.lit("part/"), "p_partkey").alias("seed"))
    return capped_lineage(_edges(t), seeds, "UPSTREAM", 1, 20, totals=True)


@query("lineage_totals", f"""
    WITH {_EDGES_SQL},
    seeds AS (SELECT 'part/' || p_partkey AS seed FROM part),
    one AS (SELECT seed, src AS node FROM seeds JOIN edges ON dst = seed),
    two AS (SELECT seed, src AS node FROM one JOIN edges ON dst = node)
    SELECT seed, count(node) AS total_all_hops FROM seeds LEFT JOIN (SELECT * FROM one UNION SELECT * FROM two) USING (seed) GROUP BY 1
""")
def totals(t: Tables) -> DataFrame:
    """How many orders and customers stand upstream of every part over all hops."""
    seeds = t.part.select(F.concat(F.lit("part/"), "p_partkey").alias("seed"))
    return lineage_totals(_edges(t), seeds, "UPSTREAM")


@query("dataset_detail", """
    WITH shown AS (
        SELECT l_orderkey AS urn, string_agg(path || ':' || type, ';' ORDER BY pos, path) AS fields FROM (
            SELECT l_orderkey, l_linenumber AS pos, path, l_returnflag AS type,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, path) AS rn
            FROM (SELECT *, l_partkey || '/' || l_suppkey || '/' || l_extendedprice::INTEGER AS path FROM
                  (SELECT * REPLACE (floor(l_extendedprice) AS l_extendedprice) FROM lineitem))
        ) WHERE rn <= 5 GROUP BY 1
    ),
    counts AS (
        SELECT l_orderkey AS urn, count(*) AS field_count, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags,
               string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS terms
        FROM lineitem GROUP BY 1
    )
    SELECT o_orderkey AS urn, coalesce(fields, '') AS fields, coalesce(field_count, 0) AS field_count,
           CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_custkey || '=' || CASE WHEN c_acctbal >= 0 THEN c_name ELSE '' END END AS owners,
           coalesce(tags, '') AS tags, coalesce(terms, '') AS terms,
           CASE WHEN o_orderstatus <> 'P' THEN n_name END AS domain
    FROM orders LEFT JOIN shown ON shown.urn = o_orderkey LEFT JOIN counts ON counts.urn = o_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
""")
def detail(t: Tables) -> DataFrame:
    """An order as dataset: line items are fields (first five shown), the customer owns it, the nation is its domain."""
    urn = F.col("l_orderkey").alias("urn")
    path = F.concat_ws("/", "l_partkey", "l_suppkey", F.floor("l_extendedprice").cast("int"))
    fields = t.spread("lineitem").select(
        urn, F.col("l_linenumber").alias("pos"), path.alias("path"), F.col("l_returnflag").alias("type"),
        F.lit(None).cast("string").alias("description"),
    )
    owned = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    owners = owned.select(
        F.col("o_orderkey").alias("urn"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("owner"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
    )
    domains = (
        owned.where("o_orderstatus <> 'P'").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("urn"), F.struct(F.col("n_nationkey").alias("urn"), F.col("n_name").alias("name")).alias("domain"))
    )
    rows = dataset_detail(
        t.orders.select(F.col("o_orderkey").alias("urn")), fields, owners,
        t.lineitem.select(urn, F.col("l_returnflag").alias("tag")), t.lineitem.select(urn, F.col("l_linestatus").alias("term")),
        domains, most_fields=5,
    )
    text = lambda column, one=lambda x: x, sep=",": F.coalesce(F.array_join(F.transform(column, one), sep), F.lit(""))
    return rows.select(
        "urn", text("fields", lambda f: F.concat_ws(":", f["path"], f["type"]), ";").alias("fields"), "field_count",
        text("owners", lambda o: F.concat_ws("=", o["owner"], o["name"])).alias("owners"),
        text("tags").alias("tags"), text("glossary_terms").alias("terms"), F.col("domain.name").alias("domain"),
    )


@query("current_version", """
    WITH defaults AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT o.o_custkey AS id, v AS version_id, o_totalprice AS document FROM defaults d JOIN orders o ON o.o_custkey = d.o_custkey AND o_orderkey = v
""")
def versions(t: Tables) -> DataFrame:
    """A customer is a policy, its orders the versions, the newest finished one the default."""
    finished = t.orders.where("o_orderstatus <> 'P'")
    items = finished.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("default_version_id"))
    return current_version(
        items, t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("document"))
    )


@query("flatten_nested", """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS outer_pos FROM documents
    )
    SELECT doc_id, outer_pos::INTEGER AS outer_pos, (generate_subscripts(string_split(line, '. '), 1) - 1)::INTEGER AS inner_pos,
           unnest(string_split(line, '. ')) AS item FROM lines
""")
def nested(t: Tables) -> DataFrame:
    """Documents as an array of lines of an array of sentences, flattened over both levels."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(F.split(line, r"\. ").alias("sentences")))
    shaped = t.spread("documents").select("doc_id", lines.alias("lines"))
    return flatten_nested(shaped, F.col("lines"), lambda line: line["sentences"]).drop("lines")


@query("kv_to_map", """
    SELECT event_id, CASE WHEN value > 20 THEN 'large' ELSE event_type END AS kind, json_extract_string(props, '$.k') AS k,
           CASE WHEN value > 20 THEN 2 ELSE 2 END AS n
    FROM events
""")
def key_values(t: Tables) -> DataFrame:
    """A key that is listed twice keeps its last value."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    base = [pair("kind", F.col("event_type")), pair("k", F.get_json_object("props", "$.k"))]
    pairs = F.when(F.col("value") > 20, F.array(*base, pair("kind", F.lit("large")))).otherwise(F.array(*base))
    return t.spread("events").select("event_id", kv_to_map(pairs).alias("m")).select(
        "event_id", F.element_at("m", "kind").alias("kind"), F.element_at("m", "k").alias("k"), F.size("m").alias("n")
    )


@query("parse_urn", f"""
    SELECT urn, regexp_extract(urn, '^urn:li:dataset:\\(urn:li:dataPlatform:([^,]+),(.*),([^,)]+)\\)$', 1) AS platform,
           regexp_extract(urn, '^urn:li:dataset:\\(urn:li:dataPlatform:([^,]+),(.*),([^,)]+)\\)$', 2) AS name,
           regexp_extract(urn, '^urn:li:dataset:\\(urn:li:dataPlatform:([^,]+),(.*),([^,)]+)\\)$', 3) AS env
    FROM (SELECT {_PART_URN_SQL} AS urn FROM part UNION ALL SELECT 'urn:li:dashboard:(looker,' || s_suppkey || ')' FROM supplier)
""")
def urns(t: Tables) -> DataFrame:
    parsed = summarize_entities(_entities(t)).where(F.col("type").isin("DATASET", "DASHBOARD")).select(
        "urn", parse_dataset_urn(F.col("urn")).alias("u")
    )
    return parsed.select("urn", *[F.coalesce(f"u.{c}", F.lit("")).alias(c) for c in ("platform", "name", "env")])


@query("add_tags", f"""
    SELECT {_PART_URN_SQL} AS resource_urn, 'urn:li:tag:' || p_brand AS tag_urn FROM part
    UNION SELECT {_PART_URN_SQL}, CASE WHEN p_size > 25 THEN 'urn:li:tag:' || p_brand ELSE 'urn:li:tag:PII' END FROM part
""")
def tags(t: Tables) -> DataFrame:
    """Every part has its brand as tag; large ones get it once more, small ones get a bare tag name."""
    urn = _part_urn().alias("resource_urn")
    brand = F.concat(F.lit("urn:li:tag:"), "p_brand")
    return add_tags(
        t.part.select(urn, brand.alias("tag_urn")),
        t.part.select(urn, F.when(F.col("p_size") > 25, brand).otherwise("PII").alias("tag_urn")),
    )
