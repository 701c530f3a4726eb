"""SQL, sample and profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusflow.plans.workloads.base import Tables, query
from corpusflow.sources.tables import sample_table, sql_capped, table_profile

_STATEMENT = """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM {orders}
    GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey
"""


@query("sql_capped", _STATEMENT.format(orders="orders") + " LIMIT 100")
def statement(t: Tables) -> DataFrame:
    return sql_capped(t.spark, _STATEMENT, orders=t.orders)


@query("table_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def sample(t: Tables) -> DataFrame:
    return sample_table(t.orders, order=["o_orderkey"])


@query("table_profile", """
    SELECT 0 AS position, 'doc_id' AS "column", 'bigint' AS type, count(*) AS n_rows, count(doc_id) AS non_null FROM documents
    UNION ALL SELECT 1, 'text', 'string', count(*), count(text) FROM documents
    UNION ALL SELECT 2, 'lang', 'string', count(*), count(lang) FROM documents
    UNION ALL SELECT 3, 'source', 'string', count(*), count(source) FROM documents
    UNION ALL SELECT 4, 'n_chars', 'bigint', count(*), count(n_chars) FROM documents
""")
def profile(t: Tables) -> DataFrame:
    return table_profile(t.documents)
