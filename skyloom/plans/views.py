"""Views of the star-schema tables in the shapes the operators take: pixels, sky positions, cubes.

Each view is one projection over a scan, so filters and column pruning reach the Parquet reader.
``SQL`` has the same views for engines that take SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view: (table, select list)
_VIEWS = {
    "pix": ("lineitem", ["CAST(l_orderkey % 16 AS INT) AS image_id", "CAST(l_partkey % 32 AS INT) AS i", "CAST(l_suppkey % 32 AS INT) AS j", "l_extendedprice AS v", "l_quantity AS area"]),
    "sky": ("supplier", ["s_suppkey AS cntr", "(s_suppkey * 137.50776405e0) % 360e0 AS ra", "degrees(asin(2e0 * ((s_suppkey * 0.61803398875e0) % 1e0) - 1e0)) AS dec", "s_acctbal AS flux"]),
    "stars": ("customer", ["c_custkey AS cntr", "(c_custkey * 137.50776405e0) % 360e0 AS ra", "degrees(asin(2e0 * ((c_custkey * 0.61803398875e0) % 1e0) - 1e0)) AS dec", "c_acctbal AS flux"]),
}
SQL = {name: f"SELECT {', '.join(columns)} FROM {table}" for name, (table, columns) in _VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = _VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def sql(body: str) -> str:
    """``body`` with the views it names as common table expressions."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in SQL.items()) + " " + body
