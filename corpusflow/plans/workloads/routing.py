"""Routing queries: conversations by language terms, and questions made from `part` by platform terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import words
from corpusflow.operators.routing import keyword_hits, route, weighted
from corpusflow.plans.workloads.base import Tables, query

# terms that occur in the texts of the tables
LANGUAGES = weighted(
    {
        "en": ["the", "and", "tion", "of ", "wh"],
        "de": ["der", "sch", "ein", "lich", "ung"],
        "fr": ["eau", "eux", "è", "ç", "oi"],
        "es": ["ción", "ando", "para", "ó", "ñ"],
    },
    {"en": ["the", "wh"], "de": ["sch", "lich"], "fr": ["eau", "ç"], "es": ["ción", "ñ"]},
)


def _values(dictionary) -> str:
    return ", ".join(f"('{l}', '{k}', {w})" for l, k, w in dictionary)


LANGUAGE_VALUES = _values(LANGUAGES)


def _route_sql(source: str, keys: str, values: str, override: str = "NULL") -> str:
    return f"""
        WITH questions AS ({source}),
        dictionary(label, keyword, weight) AS (VALUES {values}),
        scores AS (
            SELECT {keys}, label, sum(CASE WHEN contains(lower(text), keyword) THEN weight ELSE 0 END) AS score
            FROM questions, dictionary GROUP BY ALL
        ),
        tops AS (SELECT {keys}, max(score) AS top FROM scores GROUP BY ALL),
        routed AS (
            SELECT {keys}, CASE WHEN count(*) = 1 AND any_value(top) > 0 THEN any_value(scores.label) ELSE 'ambiguous' END AS label
            FROM scores JOIN tops USING ({keys}) WHERE score = top GROUP BY ALL
        )
        SELECT {keys}, coalesce({override}, label) AS label FROM routed JOIN questions USING ({keys})
    """


@query("keyword_hits", f"""
    WITH dictionary(label, keyword, weight) AS (VALUES {LANGUAGE_VALUES})
    SELECT conv_id, turn, label, keyword, weight FROM conversations JOIN dictionary ON contains(lower(text), keyword)
""")
def hits(t: Tables) -> DataFrame:
    return keyword_hits(t.spread("conversations").select("conv_id", "turn", "text"), "text", LANGUAGES)


@query("route_keywords", _route_sql("SELECT conv_id, turn, text FROM conversations", "conv_id, turn", LANGUAGE_VALUES))
def route_keywords(t: Tables) -> DataFrame:
    return route(t.spread("conversations"), "text", LANGUAGES).select("conv_id", "turn", "label")


_LONG_DICTIONARY = """
    dictionary AS (
        SELECT left(keyword, 1) AS label, keyword, (length(keyword) % 3 + 1)::INTEGER AS weight FROM (
            SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS keyword FROM benchmark)
    )
"""


def _long_dictionary(t: Tables) -> list[tuple[str, str, int]]:
    """The words of the benchmark's texts, thousands: a dictionary too long for the plan, within the automaton's bound."""
    found = t.benchmark.select(F.explode(F.filter(words("text"), lambda w: F.length(w) >= 4)).alias("keyword")).distinct()
    return [(r.keyword[0], r.keyword, len(r.keyword) % 3 + 1) for r in found.orderBy("keyword").collect()]


@query("keyword_dictionary", f"""
    WITH {_LONG_DICTIONARY}
    SELECT conv_id, turn, label, keyword, weight FROM conversations JOIN dictionary ON contains(lower(text), keyword)
""")
def long_hits(t: Tables) -> DataFrame:
    return keyword_hits(t.spread("conversations").select("conv_id", "turn", "text"), "text", _long_dictionary(t), literals=0)


@query("route_dictionary", f"""
    WITH {_LONG_DICTIONARY},
    found AS (
        SELECT conv_id, turn, label, sum(weight) AS score FROM conversations JOIN dictionary ON contains(lower(text), keyword) GROUP BY ALL
    ),
    best AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM (
        SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS top FROM found) WHERE score = top)
    SELECT conv_id, turn, coalesce(max(CASE WHEN n = 1 THEN label END), 'ambiguous') AS label
    FROM conversations LEFT JOIN best USING (conv_id, turn) GROUP BY 1, 2
""")
def long_route(t: Tables) -> DataFrame:
    return route(t.spread("conversations"), "text", _long_dictionary(t), literals=0).select("conv_id", "turn", "label")


_QUESTION = """
    CASE p_type
        WHEN 'ECONOMY' THEN 'List my S3 buckets for ' || p_name
        WHEN 'STANDARD' THEN 'Explain Delta Lake time travel of ' || p_name
        WHEN 'LARGE' THEN 'Use Cortex to summarize ' || p_name
        WHEN 'MEDIUM' THEN 'Show lineage for urn:li:dataset:(urn:li:dataPlatform:snowflake,' || p_name || ',PROD)'
        WHEN 'PROMO' THEN 'Is ' || p_name || ' a diamond?'
        ELSE 'How many ' || p_name || ' are there?'
    END
"""
_OVERRIDE = "CASE WHEN p_size > 45 THEN 'snowflake' END"


@query("route_platforms", _route_sql(
    f"SELECT p_partkey, p_size, {_QUESTION} AS text FROM part", "p_partkey", _values(weighted()), _OVERRIDE
))
def route_platforms(t: Tables) -> DataFrame:
    questions = t.part.select("p_partkey", "p_size", F.expr(_QUESTION).alias("text"))
    return route(questions, "text", override=F.expr(_OVERRIDE)).select("p_partkey", "label")
