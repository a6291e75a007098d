"""Coloured graphs as text lines, and port graphs as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portloom.storage import checkpointed

#: One port graph; an edge is [src, src_port, dst, dst_port, order].
GRAPH_JSON = "nodes array<struct<id:int,ntype:string,pattern:string,patternType:string,ports:array<int>,hubs:array<int>>>, edges array<array<double>>"


def read_colored(spark: SparkSession, path: str) -> DataFrame:
    """Coloured graphs from a text file, blank lines left out. A missing file or one without lines is an error."""
    lines = spark.read.text(path).filter(F.length("value") > 0)
    if not lines.limit(1).count():
        raise ValueError(f"no graphs in {path!r}")
    return parse_colored(lines)


def parse_colored(lines: DataFrame) -> DataFrame:
    """(value, n, colors, edges) from lines ``n m c0 c1 ...  u v u v ...``: two spaces between nodes and edges.

    Null where a line has no two parts, a colour is negative, or counts don't fit.
    """
    halves = F.split("value", "  ")
    ints = lambda c: F.transform(F.filter(F.split(c, " +"), lambda x: x != ""), lambda x: x.try_cast("int"))
    p = lines.select("value", ints(F.get(halves, F.lit(0))).alias("head"), ints(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("tail"))
    n, m = F.get("head", F.lit(0)), F.get("head", F.lit(1))
    colors = F.slice("head", 3, F.greatest(F.size("head") - 2, F.lit(0)))
    edges = F.when(F.size("tail") >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size("tail") / 2).cast("int") - 1), lambda i: F.array(F.get("tail", 2 * i), F.get("tail", 2 * i + 1)))).otherwise(F.array().cast("array<array<int>>"))
    out = p.select("value", n.alias("n"), m.alias("m"), colors.alias("colors"), edges.alias("edges"))
    sound = (F.size("colors") == F.col("n")) & (F.size("edges") == F.col("m")) & F.forall("colors", lambda c: c >= 0)
    return out.select("value", *[F.when(sound, F.col(c)).alias(c) for c in ("n", "colors", "edges")])


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, json) from nodes (graph_id, node_id, type, n_ports) and edges."""
    ports = F.sequence(F.lit(0), F.col("n_ports") - 1)
    node = F.struct(F.col("node_id").alias("id"), F.col("type").alias("ntype"), F.lit("").alias("pattern"), F.lit("SMILES").alias("patternType"), ports.alias("ports"), ports.alias("hubs"))
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    edge = F.struct("edge_seq", F.array(*[F.col(c).cast("double") for c in ("src", "src_port", "dst", "dst_port")], F.lit(1.0)).alias("e"))
    e = edges.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(edge)), lambda x: x["e"]).alias("edges"))
    g = n.join(e, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<array<double>>")))
    return g.select("graph_id", F.to_json(F.struct("nodes", "edges")).alias("json"))


def from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from (graph_id, json). Used ports follow from the edges; orders stay doubles."""
    g = rows.select("graph_id", F.from_json("json", GRAPH_JSON).alias("g"))
    nodes = g.select("graph_id", F.inline("g.nodes")).select("graph_id", F.col("id").alias("node_id"), F.col("ntype").alias("type"), F.size("ports").alias("n_ports"))
    e = g.select("graph_id", F.posexplode("g.edges").alias("edge_seq", "e"))
    edges = e.select("graph_id", "edge_seq", *[F.col("e")[i].cast("int").alias(c) for i, c in enumerate(("src", "src_port", "dst", "dst_port"))], F.col("e")[4].alias("bond_order"))
    return nodes, edges


#: Folders that a sink's keys are dealt into, so that a batch reads only those its keys lie in.
SINK_BUCKETS = 64


def append_new(rows: DataFrame, path: str, key: str, batch: str | None = None) -> DataFrame:
    """Appends rows whose key the Parquet table at ``path`` doesn't hold yet, each key once; returns what was appended.

    A null key is a key. Run again with the same rows it appends nothing. Each
    ``batch`` has its own folders: one that is written again, after a crash
    between its job and the note that it was done, replaces what it wrote. One
    writer at a time. The table has two more columns, ``_bucket`` and ``_batch``.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SINK_BUCKETS)).cast("int")
    fresh = checkpointed(rows.dropDuplicates([key]).withColumn("_bucket", bucket))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name = "b" + (uuid.uuid4().hex if batch is None else batch)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        mine = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]
        old = spark.read.parquet(path).filter(F.col("_bucket").isin(mine) & (F.col("_batch") != name)).select(F.col(key).alias("_old"))
        fresh = checkpointed(fresh.join(old, F.col(key).eqNullSafe(F.col("_old")), "left_anti"))
    out = fresh.withColumn("_batch", F.lit(name)).write.partitionBy("_bucket", "_batch").option("partitionOverwriteMode", "dynamic")
    out.mode("overwrite").parquet(path)
    return fresh.drop("_bucket")


def append_jdbc(rows: DataFrame, url: str, name: str, key: str, options: dict[str, str] | None = None) -> DataFrame:
    """The same sink over JDBC: rows of keys that table ``name`` doesn't hold yet; its primary key holds against other writers."""
    old = rows.sparkSession.read.format("jdbc").options(url=url, dbtable=f"(SELECT {key} AS _old FROM {name}) t", **(options or {})).load()
    fresh = checkpointed(rows.dropDuplicates([key]).join(old, F.col(key).eqNullSafe(F.col("_old")), "left_anti"))
    fresh.write.format("jdbc").options(url=url, dbtable=name, **(options or {})).mode("append").save()
    return fresh


def settings(text: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and those without ``=`` are left out, spaces around both parts cut."""
    return {k.strip(): v.strip() for line in text.splitlines() if "=" in line for k, v in [line.split("=", 1)]}
