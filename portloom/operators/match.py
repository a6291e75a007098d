"""Sub-graph search and other join-shaped operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portloom.model import endpoints


def search(nodes: DataFrame, edges: DataFrame, types: Sequence[str], bonds: Sequence[tuple[int, int]], hubs: Sequence[int] | None = None) -> DataFrame:
    """All injective maps of a connected query into each graph: columns graph_id, q0, q1, ...

    ``types``: the query's node types; ``bonds``: its edges, each but the first
    touching an earlier node; ``hubs``: query nodes with edges leaving the match,
    as often as they leave, or None for any. Edges of the query must be edges of
    the graph, others may exist between matched nodes.

    The joins run left-deep along the query's edges, each an equi-join on
    (graph, node), so rows grow with the matches found so far and with the
    degree of a node, never with its square.
    """
    if not types:
        raise ValueError("the query has no nodes")
    arcs = endpoints(edges).select("graph_id", "node_id", "other").distinct()
    typed = nodes.select("graph_id", "node_id", "type")
    arcs = arcs.join(typed.select("graph_id", F.col("node_id").alias("other"), F.col("type").alias("other_type")), ["graph_id", "other"])
    first = bonds[0][0] if bonds else 0
    found = typed.filter(F.col("type") == types[first]).select("graph_id", F.col("node_id").alias(f"q{first}"))
    placed = {first}
    for a, b in bonds:
        if a not in placed:
            a, b = b, a
        if a not in placed:
            raise ValueError("edges of the query must follow each other")
        step = arcs.filter(F.col("other_type") == types[b]).select("graph_id", F.col("node_id").alias(f"q{a}"), F.col("other").alias("_to"))
        found = found.join(step, ["graph_id", f"q{a}"])
        if b in placed:
            found = found.filter(F.col("_to") == F.col(f"q{b}")).drop("_to")
        else:
            for p in placed:
                found = found.filter(F.col("_to") != F.col(f"q{p}"))
            found = found.withColumnRenamed("_to", f"q{b}")
            placed.add(b)
    names = [f"q{i}" for i in sorted(placed)]
    if hubs is not None:
        degree = arcs.groupBy("graph_id", "node_id").agg(F.collect_list("other").alias("around"))
        for i in sorted(placed):
            d = degree.select("graph_id", F.col("node_id").alias(f"q{i}"), "around")
            leaving = F.coalesce(F.size(F.array_except("around", F.array(*names))), F.lit(0))
            found = found.join(d, ["graph_id", f"q{i}"], "left").filter(leaving == list(hubs).count(i)).drop("around")
    return found.select("graph_id", *names)


def edge_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge as the sorted pair of its node types with their ports."""
    n = nodes.select("graph_id", "node_id", "type")
    a = n.select("graph_id", F.col("node_id").alias("src"), F.col("type").alias("src_type"))
    b = n.select("graph_id", F.col("node_id").alias("dst"), F.col("type").alias("dst_type"))
    e = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return e.select("graph_id", "edge_seq", F.concat_ws(".", "src_type", "src_port").alias("src_end"), F.concat_ws(".", "dst_type", "dst_port").alias("dst_end"), F.least("src_type", "dst_type").alias("type_a"), F.greatest("src_type", "dst_type").alias("type_b"))


def line_graph(edges: DataFrame) -> DataFrame:
    """Pairs of edges of a graph that share a node, i < j: an equi-join on the node, so only neighbours meet."""
    ends = endpoints(edges).select("graph_id", "node_id", "edge_seq")
    a, b = ends.withColumnRenamed("edge_seq", "i"), ends.withColumnRenamed("edge_seq", "j")
    return a.join(b, ["graph_id", "node_id"]).filter("i < j").select("graph_id", "i", "j").distinct()


def allocate_ports(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted end (graph_id, edge_seq, node_id) the first port not taken by an earlier edge, or null if none is left.

    Requests of a node are ranked by edge; a rank below the number of ports is the port.
    """
    rank = F.row_number().over(Window.partitionBy("graph_id", "node_id").orderBy("edge_seq")) - 1
    r = wanted.withColumn("rank", rank).join(nodes.select("graph_id", "node_id", "n_ports"), ["graph_id", "node_id"])
    return r.select("graph_id", "edge_seq", "node_id", F.when(F.col("rank") < F.col("n_ports"), F.col("rank")).alias("port"))
