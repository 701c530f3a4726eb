"""SQL statements, samples and profiles of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_ROWS = 100
SAMPLE_ROWS = 5


def sql_capped(spark: SparkSession, statement: str, limit: int | None = SQL_ROWS, **views: DataFrame) -> DataFrame:
    """Rows of a SQL statement, at most `limit` (none or 0 = all). Views are passed as {name} placeholders."""
    rows = spark.sql(statement, **views)
    return rows.limit(limit) if limit else rows


def sample_table(df: DataFrame, n: int = SAMPLE_ROWS, order: Sequence[Column | str] = ()) -> DataFrame:
    """First n rows; give an order for a repeatable sample."""
    return (df.orderBy(*order) if order else df).limit(n)


def table_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column: position, type, rows, non-null rows, optionally an approximate distinct count - in one pass."""
    stats = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    if approx_distinct:
        stats += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)]
    once = df.agg(F.count("*").alias("rows"), *stats)
    described = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows").alias("n_rows"), F.col(f"n{i}").alias("non_null"),
            *([F.col(f"d{i}").alias("approx_distinct")] if approx_distinct else []),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    return once.select(F.inline(described))
