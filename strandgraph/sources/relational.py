"""Tables as facts: a row declares ``table:key``, a foreign key is a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: table -> key column, and foreign keys (column, target table).
TABLES = {
    "region": ("r_regionkey", ()),
    "nation": ("n_nationkey", (("n_regionkey", "region"),)),
    "customer": ("c_custkey", (("c_nationkey", "nation"),)),
    "supplier": ("s_suppkey", (("s_nationkey", "nation"),)),
    "part": ("p_partkey", ()),
    "orders": ("o_orderkey", (("o_custkey", "customer"),)),
    "lineitem": (None, (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ref(table: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{table}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def declarations(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """id and kind of every row of the tables."""
    parts = [read(spark, sf_dir, t).select(ref(t, TABLES[t][0]).alias("id"), F.lit(t).alias("kind")) for t in tables]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def relations(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """src, dst and type (the target table) of every foreign key of the tables."""
    found = None
    for t in tables:
        key, targets = TABLES[t]
        rows = read(spark, sf_dir, t)
        for column, target in targets:
            part = rows.select(ref(t, key).alias("src"), ref(target, column).alias("dst"), F.lit(target).alias("type"))
            found = part if found is None else found.unionByName(part)
    return found
