"""Export of port graphs as tables of features, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(index: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def arg_max(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def to_features(edges: DataFrame, max_ports: int) -> DataFrame:
    """(graph_id, edge_seq, src, dst, features): the ports of both ends as two one-hot halves."""
    return edges.select("graph_id", "edge_seq", "src", "dst", F.concat(one_hot(F.col("src_port"), max_ports), one_hot(F.col("dst_port"), max_ports)).alias("features"))


def from_features(rows: DataFrame, max_ports: int) -> DataFrame:
    half = lambda k: F.slice("features", 1 + k * max_ports, max_ports)
    return rows.select("graph_id", "edge_seq", "src", arg_max(half(0)).alias("src_port"), "dst", arg_max(half(1)).alias("dst_port"))


def to_directed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ports named ``node.port``."""
    port = lambda n, p: F.concat_ws(".", n, p)
    return nodes.select("graph_id", "node_id", "type", F.transform(F.sequence(F.lit(0), F.col("n_ports") - 1), lambda p: port(F.col("node_id"), p)).alias("ports")), edges.select("graph_id", "src", "dst", port("src", "src_port").alias("src_end"), port("dst", "dst_port").alias("dst_end"))
