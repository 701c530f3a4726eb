"""Service API definitions: JSON to one row per operation, and to one readable document per service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import API_DOC_CHARS
from corpusflow.functions.html import html_strip_each
from corpusflow.functions.text import strip

_OPERATIONS = "map<string, struct<documentation:string, http:struct<method:string,requestUri:string>, input:struct<shape:string>>>"
DEFINITION = f"metadata map<string,string>, operations {_OPERATIONS}, shapes map<string, struct<required:array<string>>>"


def _parsed(df: DataFrame) -> DataFrame:
    return df.select("service", F.from_json("json", DEFINITION).alias("d")).where(F.col("d").isNotNull())


def _shortened(doc: Column) -> Column:
    return F.when(F.length(doc) > API_DOC_CHARS, F.concat(F.left(doc, F.lit(API_DOC_CHARS)), F.lit("..."))).otherwise(doc)


def _operations(df: DataFrame) -> DataFrame:
    """Rows with ``ops``: the row's operations by name (operation, method, uri, required, doc)."""
    listed = df.withColumn("_ops", F.array_sort(F.map_entries(F.coalesce("d.operations", F.create_map().cast(_OPERATIONS)))))
    docs = html_strip_each(F.transform("_ops", lambda o: F.coalesce(o["value"]["documentation"], F.lit(""))))

    def described(o: Column, i: Column) -> Column:
        op = o["value"]
        required = F.try_element_at(F.col("d.shapes"), op["input"]["shape"])["required"]
        return F.struct(
            o["key"].alias("operation"), F.coalesce(op["http"]["method"], F.lit("")).alias("method"),
            F.coalesce(op["http"]["requestUri"], F.lit("")).alias("uri"),
            F.coalesce(required, F.array().cast("array<string>")).alias("required"),
            _shortened(strip(F.get("_docs", i))).alias("doc"),
        )

    return listed.withColumn("_docs", docs).withColumn("ops", F.transform("_ops", described)).drop("_ops", "_docs")


def api_def_ops(df: DataFrame) -> DataFrame:
    """(service, operation, method, uri, required, doc) from (service, json); unreadable JSON gives no row.

    `required` comes from the operation's input shape; `doc` is the text of the HTML documentation, cut to
    400 characters plus '...'.
    """
    return _operations(_parsed(df)).select("service", F.inline("ops"))


def api_def_docs(df: DataFrame, title: str = "API Reference") -> DataFrame:
    """One document per definition: header, then its operations by name: (service, text).

    A definition is one JSON value and stays one row: nothing is shuffled, and two definitions of one service are two
    documents.
    """
    line = lambda column, text: F.when(column, text).otherwise("")
    entry = lambda o: F.concat(
        F.lit("## "), o["operation"], F.lit("\n"),
        line(o["method"] != "", F.concat(F.lit("HTTP: "), o["method"], F.lit(" "), o["uri"], F.lit("\n"))),
        line(F.size(o["required"]) > 0, F.concat(F.lit("Required params: "), F.array_join(o["required"], ", "), F.lit("\n"))),
        line(o["doc"] != "", F.concat(o["doc"], F.lit("\n"))),
    )
    meta = lambda key, default: F.coalesce(F.element_at("d.metadata", F.lit(key)), default)
    header = F.concat(
        F.lit("# "), F.upper("service"), F.lit(f" - {title}\n\n"),
        F.when(
            F.size("d.metadata") > 0,
            F.concat(
                F.lit("Service:    "), meta("serviceFullName", F.col("service")),
                F.lit("\nProtocol:   "), meta("protocol", F.lit("?")),
                F.lit("\nAPI version:"), meta("apiVersion", F.lit("?")), F.lit("\n\n"),
            ),
        ).otherwise(""),
    )
    return _operations(_parsed(df)).select("service", F.concat(header, F.array_join(F.transform("ops", entry), "\n")).alias("text"))
