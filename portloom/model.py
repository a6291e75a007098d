"""Port graphs as DataFrames, and adapters from plain tables.

nodes: graph_id, node_id, type, n_ports - ports are 0 .. n_ports - 1
edges: graph_id, edge_seq, src, src_port, dst, dst_port - each stored once, in the order they were offered
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ports of an event node by event type.
EVENT_PORTS = {"click": 4, "view": 3, "purchase": 2, "signup": 2, "error": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def event_nodes(events: DataFrame) -> DataFrame:
    """A graph for each user and day; its events in order are the nodes."""
    graph = F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    order = Window.partitionBy("graph_id").orderBy("ts", "event_id")
    return (
        events.select(graph.alias("graph_id"), "ts", "event_id", F.col("event_type").alias("type"))
        .withColumn("node_id", F.row_number().over(order) - 1)
        .select("graph_id", "node_id", "type", lookup(EVENT_PORTS, F.col("type")).alias("n_ports"))
    )


def chain_edges(nodes: DataFrame) -> DataFrame:
    """Offers an edge from each node's second port (its only one, if it has one) to the next node's first."""
    order = Window.partitionBy("graph_id").orderBy("node_id")
    nxt = F.lead("node_id").over(order)
    return (
        nodes.select("graph_id", F.col("node_id").alias("edge_seq"), F.col("node_id").alias("src"), F.least(F.lit(1), F.col("n_ports") - 1).alias("src_port"), nxt.alias("dst"), F.lit(0).alias("dst_port"))
        .filter(F.col("dst").isNotNull())
    )


def order_nodes(lineitem: DataFrame) -> DataFrame:
    """A graph for each order; its lines are the nodes, typed by return flag and line status."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lineitem.select(F.col("l_orderkey").alias("graph_id"), (F.row_number().over(order) - 1).alias("node_id"), F.concat("l_returnflag", "l_linestatus").alias("type"), F.lit(3).alias("n_ports"))


def endpoints(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: graph_id, edge_seq, node_id, port, other."""
    ends = F.array(
        F.struct(F.col("src").alias("node_id"), F.col("src_port").alias("port"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node_id"), F.col("dst_port").alias("port"), F.col("src").alias("other")),
    )
    return edges.select("graph_id", "edge_seq", F.inline(ends))
