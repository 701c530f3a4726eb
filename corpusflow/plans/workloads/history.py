"""Turn history queries over `conversations`; `events` supplies time, platform and tool text of a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import decode_args, iso_seconds
from corpusflow.operators.history import (
    build_index, daily_entries, decode_turns, get_turn, query_history, recent, render_turns, search_like, turn_count,
)
from corpusflow.operators.search import build_postings, search_turns
from corpusflow.operators.windows import latest_per_key, pair_turns, session_window
from corpusflow.plans.workloads.base import Tables, query
from corpusflow.session import scratch_path
from corpusflow.sources.turnlog import append_turns, write_index

_TURNS = """
    turns AS (
        SELECT conv_id, turn, text AS query, next_text AS response FROM (
            SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
        ) WHERE role = 'user' AND next_role = 'assistant'
    )
"""
KEYS = ["conv_id", "turn"]


@query("turn_pairs", f"WITH {_TURNS} SELECT * FROM turns")
def turns(t: Tables) -> DataFrame:
    return pair_turns(t.conversations)


SESSION_SQL = """
    SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
        FROM conversations WHERE role IN ('user', 'assistant')
    ) WHERE rn <= 4 GROUP BY 1
"""


def joined_messages() -> Column:
    return F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")


@query("session_window", SESSION_SQL)
def sessions(t: Tables) -> DataFrame:
    """Two turns of memory, fewer than the longest conversations have."""
    return session_window(t.conversations, max_turns=2).select("conv_id", joined_messages().alias("messages"))


@query("history_recent", f"WITH {_TURNS} SELECT * FROM turns ORDER BY conv_id DESC, turn DESC LIMIT 10")
def newest(t: Tables) -> DataFrame:
    return recent(turns(t), 10, KEYS)


@query("history_get", f"WITH {_TURNS} SELECT * FROM turns WHERE conv_id = 3 AND turn = 2")
def one_turn(t: Tables) -> DataFrame:
    return get_turn(turns(t), conv_id=3, turn=2)


@query("turn_count", f"WITH {_TURNS} SELECT count(*) AS n FROM turns")
def count(t: Tables) -> DataFrame:
    return turn_count(turns(t))


@query("like_search", f"""
    WITH {_TURNS} SELECT * FROM turns WHERE query ILIKE '%TION_th%' OR response ILIKE '%TION_th%'
    ORDER BY conv_id DESC, turn DESC LIMIT 20
""")
def like(t: Tables) -> DataFrame:
    return search_like(turns(t), "TION_th", 20, KEYS)


_WORDS = "list_filter(regexp_split_to_array(lower(query || ' ' || response), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("inverted_index", f"WITH {_TURNS} SELECT DISTINCT unnest({_WORDS}) AS token, conv_id, turn FROM turns")
def index(t: Tables) -> DataFrame:
    return build_index(turns(t), KEYS)


def _phrase(column: str, phrase: str) -> str:
    return f"contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ', ' {phrase} ')"


_EAU = "len(list_filter(ws, lambda w: starts_with(w, 'eau'))) > 0"
#: name: (search, the same as a condition on a turn and its words ws)
_CASES = {
    "terms": ("The and", "list_contains(ws, 'the') AND list_contains(ws, 'and')"),
    "prefix": ("eau*", _EAU),
    "phrase": ('"of the"', f"{_phrase('query', 'of the')} OR {_phrase('response', 'of the')}"),
    "either": ('"of the" OR la NOT que', f"{_phrase('query', 'of the')} OR {_phrase('response', 'of the')} OR (list_contains(ws, 'la') AND NOT list_contains(ws, 'que'))"),
    "grouped": ("(eau* OR der) AND query : die", f"({_EAU} OR list_contains(ws, 'der')) AND {_phrase('query', 'die')}"),
    "start": ("^ in + die OR ^the", "regexp_matches(lower(query), '^[^\\p{L}\\p{N}]*(in[^\\p{L}\\p{N}]+die|the)([^\\p{L}\\p{N}]|$)')"
              " OR regexp_matches(lower(response), '^[^\\p{L}\\p{N}]*(in[^\\p{L}\\p{N}]+die|the)([^\\p{L}\\p{N}]|$)')"),
    "sign": ("the.", "query ILIKE '%the.%' OR response ILIKE '%the.%'"),
    "operator": ("the OR", "query ILIKE '%the OR%' OR response ILIKE '%the OR%'"),
    "quote": ('of "the', """query ILIKE '%of "the%' OR response ILIKE '%of "the%'"""),
    "blank": ("  ", "false"),
}
_SEARCHES = {name: search for name, (search, _) in _CASES.items()}
_FOUND_SQL = f"""
    WITH {_TURNS},
    quoted AS (SELECT conv_id, turn, query, replace(response, 'of the', 'of "the') AS response FROM turns),
    worded AS (SELECT *, {_WORDS} AS ws FROM quoted),
    hits AS ({" UNION ALL ".join(f"SELECT '{name}' AS search, * FROM worded WHERE {held}" for name, (_, held) in _CASES.items())})
    SELECT search, conv_id, turn, query, response FROM (
        SELECT *, row_number() OVER (PARTITION BY search ORDER BY conv_id DESC, turn DESC) AS rn FROM hits) WHERE rn <= 20
"""


def _quoted(t: Tables) -> DataFrame:
    """Turns, some with a quotation mark in the response."""
    return turns(t).withColumn("response", F.replace("response", F.lit("of the"), F.lit('of "the')))


@query("fts_search", _FOUND_SQL)
def full_text(t: Tables) -> DataFrame:
    """Match expressions, and three searches that are none and compare as LIKE patterns."""
    pairs = _quoted(t)
    return search_turns(pairs, build_postings(pairs, KEYS), _SEARCHES, 20, KEYS)


@query("stored_index_search", _FOUND_SQL)
def stored_index(t: Tables) -> DataFrame:
    """The same searches on an index that was written in token order."""
    root = scratch_path(t.spark, "index")
    pairs = _quoted(t)
    write_index(build_postings(pairs, KEYS), root, KEYS)
    return search_turns(pairs, t.spark.read.parquet(root), _SEARCHES, 20, KEYS)


@query("turn_append", f"""
    WITH {_TURNS}
    SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id, turn, 'unknown' AS platform,
           CASE WHEN length(response) >= 200 THEN '[{{"name":"lookup","args":{{"chars":"' || length(query) || '"}},"result":"ok"}}]'
                ELSE '[]' END AS tools_json,
           '[{{"source":"conv/' || conv_id || '","score":0.5}}]' AS rag_sources_json,
           CASE WHEN length(query) >= 100 THEN length(query) ELSE 0 END::INTEGER AS latency_ms
    FROM turns
""")
def appended(t: Tables) -> DataFrame:
    call = F.struct(
        F.lit("lookup").alias("name"), F.create_map(F.lit("chars"), F.length("query").cast("string")).alias("args"),
        F.lit("ok").alias("result"),
    )
    hit = F.struct(F.concat(F.lit("conv/"), "conv_id").alias("source"), F.lit(0.5).alias("score"))
    results = turns(t).withColumns({
        "platform": F.lit(None).cast("string"),
        "tool_calls_made": F.when(F.length("response") >= 200, F.array(call)),
        "rag_sources": F.array(hit),
        "latency_ms": F.when(F.length("query") >= 100, F.length("query")),
    })
    return append_turns(results, KEYS).select("id", *KEYS, "platform", "tools_json", "rag_sources_json", "latency_ms")


_TOOLS_SQL = """
    CASE event_type WHEN 'click' THEN '[{"name": "lookup", "args": ' || props || ', "result": ' || props || '}]'
        WHEN 'view' THEN '[]' WHEN 'purchase' THEN '{"name": "lookup"}' WHEN 'error' THEN '[{"name": "look' END
"""
_SOURCES_SQL = """
    CASE event_type WHEN 'purchase' THEN '[{"source": "docs\\\\a' || event_id || '.md", "score": 0.5}, {"source": "b.md", "score": 0.25}]'
        WHEN 'error' THEN 'none' ELSE '[]' END
"""


def _logged(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    tools = (
        F.when(kind == "click", F.concat(F.lit('[{"name": "lookup", "args": '), "props", F.lit(', "result": '), "props", F.lit("}]")))
        .when(kind == "view", "[]").when(kind == "purchase", '{"name": "lookup"}').when(kind == "error", '[{"name": "look')
    )
    sources = (
        F.when(kind == "purchase", F.concat(
            F.lit('[{"source": "docs\\\\a'), "event_id", F.lit('.md", "score": 0.5}, {"source": "b.md", "score": 0.25}]')))
        .when(kind == "error", "none").otherwise("[]")
    )
    return t.spread("events").withColumns({
        "tools_json": tools, "rag_sources_json": sources,
        "latency_ms": F.when(kind != "signup", F.floor(F.col("value") * 10).cast("int")),
    })


@query("decode_turns", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN 'lookup(k=' || json_extract_string(props, '$.k') || ')' ELSE '' END AS tools,
           CASE WHEN event_type = 'purchase' THEN 'docs\\a' || event_id || '.md=0.5;b.md=0.25' ELSE '' END AS sources,
           CASE WHEN event_type = 'signup' THEN 0 ELSE floor(value * 10) END::INTEGER AS latency_ms
    FROM events
""".replace("\\\\", "\\"))
def decoded(t: Tables) -> DataFrame:
    turns = decode_turns(_logged(t).select("event_id", "tools_json", "rag_sources_json", "latency_ms"))
    call = lambda c: F.concat(c["name"], F.lit("(k="), F.element_at(c["args"], "k"), F.lit(")"))
    hit = lambda s: F.concat_ws("=", s["source"], s["score"].cast("string"))
    return turns.select(
        "event_id", F.array_join(F.transform("tools", call), ";").alias("tools"),
        F.array_join(F.transform("rag_sources", hit), ";").alias("sources"), "latency_ms",
    )


@query("decode_args", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN json_extract_string(props, '$.k') END AS k,
           CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS n_args
    FROM events
""")
def arguments(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.left("props", F.lit(4))).when(kind == "purchase", " ").when(kind == "signup", None)
        .otherwise(F.col("props"))
    )
    return t.events.select("event_id", decode_args(raw).alias("args")).select(
        "event_id", F.element_at("args", "k").alias("k"), F.size("args").alias("n_args")
    )


def _log_sql() -> str:
    return f"""
        {_TURNS},
        log AS (
            SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS platform, query, response,
                   {_TOOLS_SQL} AS tools_json, props, CASE WHEN event_type = 'signup' THEN 0 ELSE floor(value * 10) END::BIGINT AS latency_ms
            FROM turns JOIN events ON event_id = conv_id * 8 + turn
        )
    """


def _turn_log(t: Tables) -> DataFrame:
    logged = _logged(t).select(
        F.col("event_id").alias("id"), iso_seconds(F.col("ts")).alias("ts"),
        F.col("event_type").alias("platform"), "tools_json", "rag_sources_json", "latency_ms",
    )
    return turns(t).withColumn("id", F.col("conv_id") * 8 + F.col("turn")).join(logged, "id")


@query("daily_markdown", f"""
    WITH {_log_sql()}
    SELECT left(ts, 10) AS date, id,
           CASE WHEN id = min(id) OVER (PARTITION BY left(ts, 10)) THEN '# Turn history — ' || left(ts, 10) || chr(10) || chr(10) ELSE '' END
           || '---' || chr(10) || chr(10) || '## #' || id || ' · ' || ts || ' · ' || platform || ' · ' || latency_ms || 'ms'
           || chr(10) || chr(10) || '**Q:** ' || query || chr(10) || chr(10) || '**A:**' || chr(10) || chr(10)
           || response || chr(10) || chr(10) AS text
    FROM log
""")
def daily(t: Tables) -> DataFrame:
    return daily_entries(_turn_log(t))


@query("render_turn", f"""
    WITH {_log_sql()}
    SELECT id, '---' || chr(10) || 'timestamp: ' || ts || chr(10) || 'platform: ' || platform || chr(10)
        || 'latency_ms: ' || latency_ms || chr(10)
        || 'tools: [' || CASE WHEN platform = 'click' THEN 'lookup' ELSE '' END || ']' || chr(10)
        || CASE WHEN platform = 'purchase' THEN 'rag_sources:' || chr(10) || '  - docs/a' || id || '.md (score=0.50)' || chr(10)
                || '  - b.md (score=0.25)' ELSE 'rag_sources: []' END || chr(10)
        || 'query: |' || chr(10) || '  ' || replace(query, chr(10), chr(10) || '  ') || chr(10) || '---' || chr(10) || chr(10)
        || '# Query' || chr(10) || chr(10) || query || chr(10) || chr(10)
        || '# Response' || chr(10) || chr(10) || response || chr(10)
        || CASE WHEN platform = 'click' THEN chr(10) || '## Tool calls' || chr(10) || chr(10) || '### 1. `lookup`' || chr(10) || chr(10)
                || '**Args:** `' || props || '`' || chr(10) || chr(10) || '**Result:**' || chr(10) || chr(10) || '```json' || chr(10)
                || '{{' || chr(10) || '  ' || trim(props, '{{}}') || chr(10) || '}}' || chr(10) || '```' || chr(10) ELSE '' END AS markdown
    FROM log
""")
def rendered(t: Tables) -> DataFrame:
    return render_turns(_turn_log(t))


@query("query_history", """
    SELECT event_id AS query_id, event_type AS status, CASE WHEN event_type = 'signup' THEN 0 ELSE floor(value * 10) END::INTEGER AS duration_ms
    FROM events ORDER BY ts DESC, event_id DESC LIMIT 10
""")
def queries(t: Tables) -> DataFrame:
    return query_history(_logged(t), 10, "event_id", "ts", "event_type", "latency_ms")


LATEST_SQL = """
    SELECT user_id, event_type, coalesce(arg_max(
        CASE WHEN value >= 20 THEN 'SUCCESS' ELSE 'FAILURE' END, (ts, event_id)) FILTER (json_extract_string(props, '$.k')::INT >= 80), 'NO_RUNS') AS last_result
    FROM events GROUP BY 1, 2
"""


def complete_runs(events: DataFrame) -> DataFrame:
    """Runs that ended: those with a property k of 80 or more."""
    done = F.get_json_object("props", "$.k").cast("int") >= 80
    return events.where(done).withColumn("last_result", F.when(F.col("value") >= 20, "SUCCESS").otherwise("FAILURE"))


@query("latest_assertion", LATEST_SQL)
def latest(t: Tables) -> DataFrame:
    """Every (user, event type) is an assertion, its events are the runs."""
    assertions = t.events.select("user_id", "event_type").distinct()
    return latest_per_key(
        assertions, complete_runs(t.events), ["user_id", "event_type"], ["ts", "event_id"], "last_result", "NO_RUNS"
    )
