"""Fields from the tables that queries run on, the same as SQL, and the registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import explode_vectors, field_long

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rnd(c: Column, digits: int) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def R(expression: str, digits: int) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return field_long(table(spark, d, "events"), F.col("event_type"), F.col("event_id"), F.col("value"))


def priced(spark: SparkSession, d: str) -> DataFrame:
    return field_long(table(spark, d, "lineitem"), F.concat("l_returnflag", "l_linestatus"), F.col("l_orderkey"), F.col("l_extendedprice"), F.col("l_quantity"))


def balances(spark: SparkSession, d: str) -> DataFrame:
    return field_long(table(spark, d, "customer"), F.col("c_mktsegment"), F.col("c_custkey"), F.col("c_acctbal"))


def vectors(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Vectors as rows; dealt: by vec_id and before they are taken apart, so that windows and sums of a vector shuffle no rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return explode_vectors(e.repartition("vec_id") if dealt else e, "vec_id", "embedding")


def plane(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Vectors as 8 x 8 grids: (vec_id, i, i0, i1, x)."""
    long = vectors(spark, d, dealt)
    return long.select("vec_id", F.col("i").cast("long").alias("i"), F.floor(F.col("i") / 8).cast("long").alias("i0"), (F.col("i") % 8).cast("long").alias("i1"), "x")


def cube(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Vectors as 4 x 4 x 4 grids."""
    long = vectors(spark, d, dealt)
    return long.select("vec_id", F.col("i").cast("long").alias("i"), F.floor(F.col("i") / 16).cast("long").alias("i0"), F.floor(F.col("i") % 16 / 4).cast("long").alias("i1"), (F.col("i") % 4).cast("long").alias("i2"), "x")


def vector_cube(spark: SparkSession, d: str) -> DataFrame:
    """Three vectors that follow each other as the components u, v, w of one 4 x 4 x 4 grid: (k, i, i0, i1, i2, u, v, w).
    Defined result, the same in SQL: a vector that is not there, at the end or at a gap in vec_id, is all zeros."""
    part = lambda r: F.max(F.when(F.col("vec_id") % 3 == r, F.col("embedding")))
    grouped = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("k")).agg(part(0).alias("u"), part(1).alias("v"), part(2).alias("w"))
    zeros = F.transform(F.coalesce("u", "v", "w"), lambda x: F.lit(0).cast("float"))
    whole = grouped.withColumns({n: F.coalesce(F.col(n), zeros) for n in "uvw"})
    long = whole.select("k", F.posexplode(F.arrays_zip("u", "v", "w")).alias("i", "c")).select("k", F.col("i").cast("long").alias("i"), *(F.col(f"c.{n}").cast("float").alias(n) for n in "uvw"))
    return long.select("k", "i", F.floor(F.col("i") / 16).cast("long").alias("i0"), F.floor(F.col("i") % 16 / 4).cast("long").alias("i1"), (F.col("i") % 4).cast("long").alias("i2"), "u", "v", "w")


EVENTS = "SELECT event_type AS field_id, event_id AS i, CAST(value AS FLOAT) AS x FROM events"
PRICED = "SELECT l_returnflag || l_linestatus AS field_id, l_orderkey AS i, CAST(l_extendedprice AS FLOAT) AS x, CAST(l_quantity AS FLOAT) AS w FROM lineitem"
BALANCES = "SELECT c_mktsegment AS field_id, c_custkey AS i, CAST(c_acctbal AS FLOAT) AS x FROM customer"
_LONG = "SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings"
PLANE = f"SELECT vec_id, i, i // 8 AS i0, i % 8 AS i1, x FROM ({_LONG})"
CUBE = f"SELECT vec_id, i, i // 16 AS i0, i % 16 // 4 AS i1, i % 4 AS i2, x FROM ({_LONG})"
VECTOR_CUBE = f"""SELECT vec_id // 3 AS k, i, i // 16 AS i0, i % 16 // 4 AS i1, i % 4 AS i2, coalesce(max(x) FILTER (vec_id % 3 = 0), 0) AS u, coalesce(max(x) FILTER (vec_id % 3 = 1), 0) AS v,
 coalesce(max(x) FILTER (vec_id % 3 = 2), 0) AS w FROM ({_LONG}) GROUP BY vec_id // 3, i"""
D = lambda c: f"CAST({c} AS DOUBLE)"
