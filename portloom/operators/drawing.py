"""What drawings of port graphs are computed from: layouts, port places, labels, elements for web viewers. Rendering is left to viewers."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.functions.arrow import mapped


def port_places(x: Column, y: Column, n_ports: Column, distance: Column) -> Column:
    """array<struct<x,y>>: a place for each port on a circle, clockwise from the right, and the first once more to close it; null without ports."""
    at = lambda k: -k * 2 * F.pi() / n_ports
    return F.when(n_ports > 0, F.transform(F.sequence(F.lit(0), n_ports), lambda k: F.struct((x + distance * F.cos(at(k))).alias("x"), (y + distance * F.sin(at(k))).alias("y"))))


def svg(kind: Column, n_ports: Column, radius: int = 50, port_radius: int = 30, distance: float = 48.0, color: str = "lightblue") -> Column:
    """A node as SVG text: its circle and label, then a circle and a number for each port."""
    label = lambda x, y, size, text: F.concat(F.lit('<text x="'), x, F.lit('" y="'), y, F.lit(f'" font-size="{size}" text-anchor="middle" alignment-baseline="middle" fill="black">'), text, F.lit("</text>"))
    circle = lambda x, y, r, fill: F.concat(F.lit('<circle cx="'), x, F.lit('" cy="'), y, F.lit(f'" r="{r}" fill="{fill}" stroke="black" stroke-width="2"/>'))
    mid = F.lit("100")

    def port(k: Column) -> Column:
        angle = k * 2 * F.pi() / n_ports
        x, y = (F.round(100 + distance * f(angle), 3).cast("string") for f in (F.cos, F.sin))
        return F.concat(circle(x, y, port_radius, "orange"), F.lit("\n"), label(x, y, 15, k.cast("string")))

    safe = F.replace(F.replace(kind, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ports = F.transform(F.when(n_ports > 0, F.sequence(F.lit(0), n_ports - 1)).otherwise(F.array().cast("array<int>")), port)
    head = F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="200" height="200" viewBox="0 0 200 200">')
    return F.array_join(F.concat(F.array(head, circle(mid, mid, radius, color), label(mid, mid, 25, safe)), ports, F.array(F.lit("</svg>"))), "\n")


def edge_label(src_port: Column, dst_port: Column, src_x: Column, dst_x: Column) -> Column:
    """An edge's ports in the order in which its nodes stand from left to right."""
    return F.when(src_x > dst_x, F.concat_ws("  -  ", dst_port, src_port)).otherwise(F.concat_ws("  -  ", src_port, dst_port))


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, elements): JSON of each graph's nodes, then its edges, for web viewers."""
    text = lambda c: F.col(c).cast("string")
    label = F.concat_ws("  -  ", "src_port", "dst_port")
    node = F.to_json(F.struct(F.struct(text("node_id").alias("id"), F.col("type").alias("label")).alias("data"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("position")))
    edge = F.to_json(F.struct(F.struct(text("src").alias("source"), text("dst").alias("target"), F.concat_ws("-", "src", "dst").alias("id"), label.alias("label"), label.alias("source-to-target-label")).alias("data")))
    listed = nodes.select("graph_id", F.lit(0).alias("part"), F.col("node_id").alias("k"), node.alias("json")).union(edges.select("graph_id", F.lit(1), F.col("edge_seq"), edge))
    rows = listed.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "k", "json"))), lambda e: e["json"]).alias("e"))
    return rows.select("graph_id", F.concat(F.lit("["), F.array_join("e", ","), F.lit("]")).alias("elements"))


def spring_layout(nodes: DataFrame, edges: DataFrame, iterations: int = 50, k: float = 1.0, seed: int = 0) -> DataFrame:
    """(graph_id, node_id, x, y): places after ``iterations`` small steps along the forces.

    All nodes of a graph repel each other by k²/d², edges pull by d²/k. Starts
    are hashes of seed, graph and node, so reruns agree.
    """
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    links = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("edge_seq", "src", "dst"))).alias("links"))
    graphs = n.join(links, "graph_id", "left").withColumn("name", F.col("graph_id").cast("string"))

    def kernel(name, ids, links):
        place = {v: i for i, v in enumerate(ids)}
        start = lambda v, axis: (xxhash.xxh64_intdigest(f"{seed},{name},{v},{axis}") >> 11) / float(1 << 53)
        p = np.array([[start(v, 0), start(v, 1)] for v in ids])
        ends = np.array([(place[x["src"]], place[x["dst"]]) for x in links or [] if x["src"] in place and x["dst"] in place], int).reshape(-1, 2)
        for _ in range(iterations):
            apart = p[:, None] - p[None]
            d = np.linalg.norm(apart, axis=2) + 1e-4
            push = (k * k / d**3)[:, :, None] * apart
            force = push.sum(axis=1)
            along = p[ends[:, 0]] - p[ends[:, 1]]
            pull = along * ((np.linalg.norm(along, axis=1) + 1e-4) / k)[:, None]
            np.subtract.at(force, ends[:, 0], pull)
            np.add.at(force, ends[:, 1], pull)
            p = p + 0.01 * force
        return [(v, float(x), float(y)) for v, (x, y) in zip(ids, p, strict=True)]

    return mapped(graphs, ["graph_id"], ["name", "ids", "links"], kernel, "node_id int, x double, y double")
