"""Input tables of the registered queries: the plain tables of a folder, and views derived from them.

A view's text is plain SQL that Spark and DuckDB both read, so a query and its
check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for now in all queries.
AS_OF = "2000-02-01"

VIEWS = {
    # price facts
    "odds": """SELECT l_partkey AS fixture_id, l_suppkey % 10 AS bookmaker,
        CASE l_returnflag WHEN 'R' THEN 'HOME' WHEN 'A' THEN 'DRAW' ELSE 'AWAY' END AS selection,
        CASE l_linestatus WHEN 'F' THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category,
        1 + l_quantity / CAST(10 AS DOUBLE) AS price, l_orderkey * 10 + l_linenumber AS source_odd_id,
        CASE WHEN l_linenumber = 7 THEN 'OU' ELSE '1X2' END AS market_code, 'MoneyLine' AS market_name,
        CAST(1 AS DOUBLE) AS confidence_score, CAST(l_shipdate AS DATE) AS updated_at,
        CAST(l_shipdate AS DATE) + CAST(l_orderkey % 5 AS INTEGER) AS last_seen_at FROM lineitem""",
    "fixtures": """SELECT p_partkey AS fixture_id, CAST(p_size AS BIGINT) AS league_id, split_part(p_name, ' ', 1) AS home_team, split_part(p_name, ' ', 2) AS away_team,
        p_type AS league_name, p_brand AS status, DATE '2000-01-01' + CAST(p_partkey % 90 AS INTEGER) AS starts_at,
        DATE '2000-01-01' + CAST(p_partkey % 90 AS INTEGER) AS date_key, DATE '1999-01-01' + CAST(p_partkey % 300 AS INTEGER) AS updated_at FROM part""",
    "leagues": """SELECT DISTINCT CAST(p_size AS BIGINT) AS league_id, p_size % 5 <> 0 AS enabled, DATE '1999-06-01' + p_size AS updated_at FROM part""",
    "links": """SELECT o_custkey AS fixture_id, o_orderkey % 10 AS bookmaker, o_orderkey AS external_event_id,
        CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'https://feed/api/e/' || CAST(o_orderkey AS VARCHAR(20))
             ELSE 'https://feed/e/' || CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20)) END AS source_url,
        CAST(o_orderdate AS DATE) AS updated_at FROM orders""",
    "bookmakers": """SELECT DISTINCT s_suppkey % 10 AS bookmaker, 'B' || CAST(s_suppkey % 10 AS VARCHAR(20)) AS name, 'https://home/' || CAST(s_suppkey % 10 AS VARCHAR(20)) AS home_url FROM supplier""",
    "blocks": """SELECT DISTINCT l_partkey AS fixture_id, l_suppkey % 10 AS bookmaker, CASE WHEN l_partkey % 2 = 0 THEN 'EVENTO' ELSE 'PARCIAL' END AS scope,
        CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'COM_PA' END AS pa_category, CAST(l_partkey % 5 AS INTEGER) AS attempts, l_partkey % 3 = 0 AS blocked,
        'r' || CAST(l_partkey % 4 AS VARCHAR(20)) AS rejected FROM lineitem WHERE l_partkey % 7 < 3""",
    "stream": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS lane, event_type, value, props FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain table, or a derived view by its name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = re.search(r"FROM (\w+)", VIEWS[name])[1]
    return spark.sql(re.sub(rf"FROM {source}\b", "FROM {source}", VIEWS[name]), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def spread(df: DataFrame, column: str) -> DataFrame:
    """``df`` dealt out by a column, four tasks a core: a file of some MB is one or two tasks, however much is made of its rows.

    A condition is moved through a repartition, so what it parses would be parsed
    in the file's task; it isn't moved through a generator whose columns it reads.
    """
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, column)
    others = [c for c in df.columns if c != column]
    return dealt.select(column, F.inline(F.array(F.struct(*others)))).select(*df.columns)
