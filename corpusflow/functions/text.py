"""Small text, map, JSON, URN and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_present(*candidates: Column) -> Column:
    """First value that is neither null nor the empty string; '' when there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def icontains(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (`trim` alone removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def url_filename(url: Column, base: str) -> Column:
    """File-system-safe name from the part of the URL after `base`, at most 120 characters plus .txt."""
    if base:
        first_hit = F.instr(url, base)
        rest = F.when(first_hit > 0, F.substring(url, first_hit + len(base), F.length(url))).otherwise(url)
    else:
        rest = url
    path = F.regexp_replace(rest, "^/+|/+$", "")
    named = F.when(path == "", "index").otherwise(path)
    safe = F.regexp_replace(named, "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.left(safe, F.lit(120)), F.lit(".txt"))


# date, optional time with up to six fractional digits, optional zone
_ISO = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)(Z|[+-]\d{2}:\d{2})?$"


def iso_timestamp(text: Column) -> Column:
    """Instant of an ISO-8601 text; without a zone it is read as UTC; null when it does not parse."""
    stamp, zone = F.regexp_extract(text, _ISO, 1), F.regexp_extract(text, _ISO, 2)
    clock = F.when(F.length(stamp) == 10, F.concat(stamp, F.lit("T00:00"))).otherwise(stamp)
    return F.when(
        stamp != "",
        F.concat(clock, F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp"),
    )


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def kv_to_map(pairs: Column) -> Column:
    """Map of an array of (key, value) structs; the last value of a repeated key wins."""
    placed = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value")))

    def last_of_each(s):
        kept = F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["key"] != e["key"], F.lit(True)))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))

    # bound by a lambda, the sorted entries are evaluated once
    return F.get(F.transform(F.array(F.array_sort(placed)), last_of_each), F.lit(0))


def decode_args(arguments: Column) -> Column:
    """JSON object text to map<string,string>; blank or malformed text gives an empty map."""
    return F.coalesce(
        F.from_json(arguments, "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )


def decode_list(text: Column, element: str) -> Column:
    """JSON list text to array<element>; null, malformed and non-list JSON give an empty array.

    from_json wraps a lone object when an array of structs is asked for, hence the test for a bracket.
    """
    looks_like_list = F.ltrim(text).startswith("[")
    return F.coalesce(
        F.when(looks_like_list, F.from_json(text, f"array<{element}>")),
        F.array().cast(f"array<{element}>"),
    )


_DATASET_URN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),(.*),([^,)]+)\)$"


def dataset_urn(platform: Column, name: Column, env: Column | str = "PROD") -> Column:
    env = F.lit(env) if isinstance(env, str) else env
    return F.format_string("urn:li:dataset:(urn:li:dataPlatform:%s,%s,%s)", platform, name, env)


def parse_dataset_urn(urn: Column) -> Column:
    """Struct (platform, name, env) of a dataset URN; null when the text is not one."""
    parts = [F.regexp_extract(urn, _DATASET_URN, i).alias(n) for i, n in ((1, "platform"), (2, "name"), (3, "env"))]
    return F.when(urn.rlike(_DATASET_URN), F.struct(*parts))


def with_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def words(text: Column | str) -> Column:
    """Lower-cased letter/digit runs in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
