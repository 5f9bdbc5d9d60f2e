"""A dependency graph derived from order tables: suppliers as applications, parts as capabilities, customers as data objects,
nations as technologies. Relationships come from line items of quantity 50 and 1; dependencies from supplier keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph


def graph(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = [("part", "p_partkey", "p_name", "C", "capability"), ("supplier", "s_suppkey", "s_name", "A", "application"), ("customer", "c_custkey", "c_name", "D", "data_object"), ("nation", "n_nationkey", "n_name", "T", "technology")]
    elements = None
    for i, (table, key, name, letter, kind) in enumerate(parts):
        rows = read(table).select(F.concat(F.lit(letter), key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(i).alias("kind_ord"), F.col(key).cast("long").alias("ord"))
        elements = rows if elements is None else elements.union(rows)

    def edge(rows: DataFrame, src: str, kind: str, letter: str, dst: str, order: str) -> DataFrame:
        return rows.select(F.concat(F.lit("A"), src).alias("src"), F.lit(kind).alias("type"), F.concat(F.lit(letter), dst).alias("dst"), F.expr(order).cast("long").alias("ord"))

    items, orders, suppliers = read("lineitem"), read("orders").select("o_orderkey", "o_custkey"), read("supplier")
    sold = lambda q: items.where(F.col("l_quantity") == q).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    supports = items.where("l_quantity = 50").select("l_suppkey", "l_partkey").distinct()
    edges = edge(supports, "l_suppkey", "SUPPORTS", "C", "l_partkey", "l_suppkey")
    for kind, quantity in (("OWNS", 50), ("CONSUMES", 1)):
        pairs = sold(quantity).select("l_suppkey", "o_custkey").distinct()
        edges = edges.union(edge(pairs, "l_suppkey", kind, "D", "o_custkey", "l_suppkey"))
    edges = edges.union(edge(suppliers, "s_suppkey", "RUNS_ON", "T", "s_nationkey", "s_suppkey"))
    keys = suppliers.where("s_suppkey >= 1").selectExpr("s_suppkey as k", "s_suppkey div 2 as half", "s_suppkey div 3 as third")
    edges = edges.union(edge(keys, "k", "DEPENDS_ON", "A", "half", "2 * k")).union(edge(keys.where("third <> half"), "k", "DEPENDS_ON", "A", "third", "2 * k + 1"))
    if cyclic:
        edges = edges.union(spark.range(1).selectExpr("'A0' as src", "'DEPENDS_ON' as type", "'A1' as dst", "0L as ord"))
    return Graph(elements, edges)
