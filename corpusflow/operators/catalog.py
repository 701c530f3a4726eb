"""Catalog metadata: entity search, summaries, facets, dataset detail, inventories, tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import MAX_FIELDS
from corpusflow.functions.text import first_present, icontains, with_prefix
from corpusflow.operators.windows import cap_per_group

TAG_PREFIX = "urn:li:tag:"


def summarize_entities(df: DataFrame) -> DataFrame:
    """(urn, type, name, platform, description) of raw entities.

    df: urn, type, name, platform, properties struct<name, displayName, description, definition>. The name
    falls back from properties.name over displayName and name to the urn; empty text counts as missing.
    """
    return df.select(
        F.coalesce("urn", F.lit("")).alias("urn"),
        F.coalesce("type", F.lit("")).alias("type"),
        first_present(F.col("properties.name"), F.col("properties.displayName"), F.col("name"), F.col("urn")).alias("name"),
        F.coalesce("platform", F.lit("")).alias("platform"),
        first_present(F.col("properties.description"), F.col("properties.definition")).alias("description"),
    )


def matching_entities(entities: DataFrame, query: str | None = "*", entity_type: str | None = None) -> DataFrame:
    """Entities of a type whose name, description or urn contains the query; '*' or '' matches all."""
    kept = entities.where(F.col("type") == entity_type.upper()) if entity_type else entities
    if query and query != "*":
        hits = [icontains(F.col(c), F.lit(query)) for c in ("name", "description", "urn")]
        kept = kept.where(reduce(Column.__or__, hits))
    return kept


def search_entities(entities: DataFrame, query: str | None = "*", entity_type: str | None = None, count: int = 10) -> DataFrame:
    """First `count` matching entities by (name, urn)."""
    return matching_entities(entities, query, entity_type).orderBy("name", "urn").limit(count)


def search_glossary(entities: DataFrame, query: str | None = "*", count: int = 20) -> DataFrame:
    """Glossary terms: (urn, name, definition)."""
    return search_entities(entities, query, "GLOSSARY_TERM", count).select(
        "urn", "name", F.col("description").alias("definition")
    )


def filter_attrs(df: DataFrame, filters: Sequence[Mapping]) -> DataFrame:
    """[{Name, Values}]: every name must match one of its values."""
    return df.where(reduce(lambda kept, f: kept & F.col(f["Name"]).isin(list(f["Values"])), filters, F.lit(True)))


def facet(df: DataFrame, key: str, name: Column | None = None) -> DataFrame:
    """Entities per key, with a display name that falls back to the key: (urn, name, entity_count)."""
    shown = F.max(name) if name is not None else F.lit(None).cast("string")
    return df.groupBy(F.col(key).alias("urn")).agg(shown.alias("_name"), F.count("*").alias("entity_count")).select(
        "urn", first_present(F.col("_name"), F.col("urn")).alias("name"), "entity_count"
    )


def object_rollup(df: DataFrame, prefix: str = "", keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """Objects and bytes per bucket below a key prefix; the literal prefix reaches the Parquet scan."""
    kept = df.where(F.col("key").startswith(prefix)) if prefix else df
    return kept.groupBy(*keys).agg(
        F.count("*").alias("object_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes")
    )


def current_version(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Each item's default version document; items: id, default_version_id; versions: id, version_id, ..."""
    return items.withColumnRenamed("default_version_id", "version_id").join(versions, ["id", "version_id"])


MOST_VALUES = 1000  # owners, tags or terms listed per dataset


def dataset_detail(
    datasets: DataFrame,
    fields: DataFrame,
    owners: DataFrame,
    tags: DataFrame,
    terms: DataFrame,
    domains: DataFrame,
    most_fields: int = MAX_FIELDS,
    most_values: int = MOST_VALUES,
) -> DataFrame:
    """One nested row per dataset: fields (first 50) and field_count, owners, tags, glossary terms, domain.

    datasets: urn, ...; fields: urn, pos, path, type, description; owners: urn, owner, name; tags: urn, tag;
    terms: urn, term; domains: urn, domain struct<urn, name>. Owners without owner are dropped; the domain is
    null when there is none. Of owners, tags and terms the first `most_values` are listed; they stand in one table of
    (urn, kind, a, b), which is capped and gathered once before it meets the parent.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    value = lambda df, kind, name, second: df.where(F.col(name).isNotNull()).select(
        "urn", F.lit(kind).cast("byte").alias("kind"), F.col(name).cast("string").alias("a"), second.alias("b"))
    values = (
        value(owners, 0, "owner", text(F.col("name"))).unionByName(value(tags, 1, "tag", F.lit("")))
        .unionByName(value(terms, 2, "term", F.lit("")))
    )
    values = cap_per_group(values.distinct(), ["urn", "kind"], [F.col("a"), F.col("b")], most_values)
    # three times most_values at most
    listed = values.groupBy("urn").agg(F.array_sort(F.collect_list(F.struct("kind", "a", "b"))).alias("_values"))

    def of(kind: int, made, name: str) -> Column:
        found = F.transform(F.filter("_values", lambda v: v["kind"] == kind), made)
        return F.when(F.size(found) > 0, found).alias(name)

    gathered = listed.select(
        "urn", of(0, lambda v: F.struct(v["a"].alias("owner"), v["b"].alias("name")), "owners"),
        of(1, lambda v: v["a"], "tags"), of(2, lambda v: v["a"], "glossary_terms"))
    field = F.struct("path", text(F.col("type")).alias("type"), text(F.col("description")).alias("description"))
    shown = cap_per_group(fields, ["urn"], [F.col("pos"), F.col("path")], most_fields)
    shown = shown.groupBy("urn").agg(F.array_sort(F.collect_list(F.struct("pos", "path", field.alias("_item")))).alias("_fields"))
    shown = shown.select("urn", F.transform("_fields", lambda f: f["_item"]).alias("fields"))
    counts = fields.groupBy("urn").agg(F.count("*").alias("field_count"))
    detail = datasets
    for part in (shown, counts, gathered, domains):
        detail = detail.join(part, "urn", "left")
    return detail.withColumn("field_count", F.coalesce("field_count", F.lit(0)))


def flatten_nested(df: DataFrame, outer: Column, inner) -> DataFrame:
    """Explode an array and, per element, the array `inner(element)`: adds outer_pos, inner_pos and item."""
    first = df.select("*", F.posexplode(outer).alias("outer_pos", "_outer"))
    return first.select(
        *df.columns, "outer_pos", F.posexplode(inner(F.col("_outer"))).alias("inner_pos", "item")
    )


def add_tags(associations: DataFrame, new: DataFrame) -> DataFrame:
    """Associations (resource_urn, tag_urn) with new ones added once; bare tag names get the tag prefix."""
    prefixed = new.select("resource_urn", with_prefix(F.col("tag_urn"), TAG_PREFIX).alias("tag_urn"))
    return associations.select("resource_urn", "tag_urn").unionByName(prefixed).distinct()
