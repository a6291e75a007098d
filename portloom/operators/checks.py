"""Constraint checks on nodes, ports, edges and atoms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portloom.model import endpoints

#: Why an offered edge is refused, in the order of the checks; None if it is accepted.
REASONS = ("self_loop", "no_source", "no_target", "no_source_port", "no_target_port", "edge_exists", "source_port_used", "target_port_used")


def admit(nodes: DataFrame, offered: DataFrame) -> DataFrame:
    """Every offered edge with ``accepted`` and ``reason``.

    Edges are taken in the order of edge_seq; one that is refused occupies no
    port. This is a fold over each graph's edges, kept as arrays of one graph:
    graphs are small, edges of different graphs never meet.
    """
    ports = nodes.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "n_ports"))).alias("ports"))
    e = F.struct("edge_seq", "src", "src_port", "dst", "dst_port")
    lists = offered.groupBy("graph_id").agg(F.sort_array(F.collect_list(e)).alias("offers")).join(ports, "graph_id", "left")
    place = lambda n, p: F.concat_ws(".", n, p)

    def step(acc, x):
        a, b = place(x["src"], x["src_port"]), place(x["dst"], x["dst_port"])
        has = lambda n: F.map_contains_key("ports", n)
        size = lambda n: F.element_at(F.col("ports"), n)
        edge = F.concat_ws("-", a, b)
        why = (
            F.when(x["src"] == x["dst"], REASONS[0])
            .when(~has(x["src"]), REASONS[1])
            .when(~has(x["dst"]), REASONS[2])
            .when((x["src_port"] < 0) | (x["src_port"] >= size(x["src"])), REASONS[3])
            .when((x["dst_port"] < 0) | (x["dst_port"] >= size(x["dst"])), REASONS[4])
            .when(F.array_contains(acc["edges"], edge), REASONS[5])
            .when(F.array_contains(acc["used"], a), REASONS[6])
            .when(F.array_contains(acc["used"], b), REASONS[7])
        )
        return F.struct(
            F.when(why.isNull(), F.concat(acc["used"], F.array(a, b))).otherwise(acc["used"]).alias("used"),
            F.when(why.isNull(), F.concat(acc["edges"], F.array(edge))).otherwise(acc["edges"]).alias("edges"),
            F.concat(acc["why"], F.array(why)).alias("why"),
        )

    none = F.array().cast("array<string>")
    lists = lists.withColumn("ports", F.coalesce("ports", F.create_map().cast("map<int,int>")))
    folded = lists.withColumn("why", F.aggregate("offers", F.struct(none.alias("used"), none.alias("edges"), none.alias("why")), step, lambda a: a["why"]))
    return folded.select("graph_id", F.inline(F.arrays_zip("offers", "why"))).select("graph_id", "offers.*", F.col("why").isNull().alias("accepted"), F.col("why").alias("reason"))


def accepted(nodes: DataFrame, offered: DataFrame) -> DataFrame:
    return admit(nodes, offered).filter("accepted").drop("accepted", "reason")


def free_ports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its number of free ports."""
    used = endpoints(edges).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("used"))
    return nodes.join(used, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "type", (F.col("n_ports") - F.coalesce("used", F.lit(0))).alias("n_free"))


def ports_with_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each port of each node and whether it is free."""
    each = nodes.select("graph_id", "node_id", F.explode(F.sequence(F.lit(0), F.col("n_ports") - 1)).alias("port"))
    used = endpoints(edges).select("graph_id", "node_id", "port", F.lit(True).alias("used")).distinct()
    return each.join(used, ["graph_id", "node_id", "port"], "left").select("graph_id", "node_id", "port", F.col("used").isNull().alias("is_free"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its degree, 0 without edges."""
    d = endpoints(edges).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, ["graph_id", "node_id"], "left").fillna(0, ["degree"])


def within_bond_cap(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs in which no node has more edges than ports."""
    return degrees(nodes, edges).groupBy("graph_id").agg(F.bool_and(F.col("degree") <= F.col("n_ports")).alias("ok"), F.count(F.lit(1)).alias("n_nodes")).filter("ok").drop("ok")


def meeting(nodes: DataFrame, least: Mapping[str, int]) -> DataFrame:
    """Graphs with at least so many nodes of each listed type."""
    if any(v < 0 for v in least.values()):
        raise ValueError("a constraint must not be negative")
    tests = [(F.sum(F.when(F.col("type") == t, 1).otherwise(0)) >= n).alias(f"c{i}") for i, (t, n) in enumerate(least.items())]
    out = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), *tests)
    for i in range(len(least)):
        out = out.filter(F.col(f"c{i}"))
    return out.select("graph_id", "n_nodes")


def group_violations(groups: DataFrame) -> DataFrame:
    """Groups (type, pattern, hubs, n_atoms) with their first violation, null if sound."""
    v = (
        F.when((F.coalesce(F.length("type"), F.lit(0)) == 0) & (F.coalesce(F.length("pattern"), F.lit(0)) == 0), "empty type and pattern")
        .when(F.exists("hubs", lambda h: h < 0), "negative hub")
        .when(F.exists("hubs", lambda h: h >= F.col("n_atoms")), "hub beyond the last atom")
    )
    return groups.withColumn("violation", v)


def free_valency(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """valency minus the bond orders, as whole numbers after each addition, in the order of (dst, bond_order). Two aromatic bonds so take two."""
    orders = bonds.groupBy("mol_id", F.col("src").alias("atom_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dst", "bond_order"))), lambda x: x["bond_order"]).alias("orders"))
    taken = F.coalesce(F.aggregate("orders", F.lit(0), lambda a, o: (a + o).cast("int")), F.lit(0))
    return atoms.join(orders, ["mol_id", "atom_id"], "left").select("mol_id", "atom_id", "element", (F.col("valency") - taken).alias("free_valency"))


def query_groups(groups: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Groups of a library for which any of the attributes has the wanted value."""
    test = F.lit(False)
    for name, value in wanted.items():
        if name not in groups.columns:
            raise ValueError(f"groups have no attribute {name!r}")
        test = test | F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return groups.filter(test)
