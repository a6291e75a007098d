"""Queries over the driver's tables for the port-graph operators, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portloom.model import EVENT_PORTS, chain_edges, endpoints, event_nodes, order_nodes, table
from portloom.operators import checks, chem, drawing, match, space
from portloom.plans import enumerate as gen
from portloom.plans import fragment
from portloom.sources import export, libraries, text
from portloom.storage import checkpointed, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its own name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_nodes(table(spark, sf_dir, "events"))


_NODES = """
nodes AS (
  SELECT user_id::VARCHAR || '|' || ts::DATE::VARCHAR AS graph_id, event_type AS type,
         (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1)::INT AS node_id,
         CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2 WHEN 'error' THEN 1 END AS n_ports
  FROM events
), chain AS (
  SELECT a.graph_id, a.node_id AS edge_seq, a.node_id AS src, least(1, a.n_ports - 1) AS src_port, b.node_id AS dst, 0 AS dst_port
  FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 1
)"""
_ENDS = _NODES + """, ends AS (
  SELECT graph_id, edge_seq, src AS node_id, src_port AS port, dst AS other FROM chain
  UNION ALL SELECT graph_id, edge_seq, dst, dst_port, src FROM chain
)"""


# --- histograms and correlations


@query(f"WITH {_NODES} SELECT graph_id, type, count(*) AS n FROM nodes GROUP BY ALL")
def graph_histogram(spark, sf_dir):
    return space.histogram(_nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, h AS (SELECT graph_id, type, count(*) AS n FROM nodes GROUP BY ALL),
c AS (SELECT graph_id, string_agg(type || ':' || n, ' ' ORDER BY type) AS composition FROM h GROUP BY graph_id)
SELECT composition, count(*) AS n_graphs FROM c GROUP BY composition""")
def graph_compositions(spark, sf_dir):
    return space.compositions(_nodes(spark, sf_dir))


@query("SELECT l_returnflag || l_linestatus AS type, count(*) AS n FROM lineitem GROUP BY 1")
def type_frequencies(spark, sf_dir):
    return space.frequencies(order_nodes(table(spark, sf_dir, "lineitem")))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, sum(value) AS v FROM events GROUP BY ALL),
t AS (SELECT DISTINCT event_type FROM events), f AS (SELECT p.user_id, t.event_type, coalesce(c.n, 0) AS n, p.v FROM p CROSS JOIN t LEFT JOIN c ON c.user_id = p.user_id AND c.event_type = t.event_type)
SELECT event_type AS type, round(corr(n, v), 6) AS r FROM f GROUP BY event_type""")
def type_property_corr(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counts = e.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    prop = e.groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("value"))
    return space.correlations(counts, prop, ["click", "error", "purchase", "signup", "view"]).select("type", F.round("r", 6).alias("r"))


@query(f"WITH {_ENDS}, d AS (SELECT graph_id, node_id, count(*) AS d FROM ends GROUP BY ALL) SELECT n.graph_id, n.node_id, n.type, n.n_ports, coalesce(d.d, 0) AS degree FROM nodes n LEFT JOIN d USING (graph_id, node_id)")
def node_degree(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return checks.degrees(n, chain_edges(n))


@query(f"WITH {_ENDS}, d AS (SELECT graph_id, node_id, count(*) AS d FROM ends GROUP BY ALL) SELECT type, max(coalesce(d.d, 0)) AS max_degree FROM nodes n LEFT JOIN d USING (graph_id, node_id) GROUP BY type")
def max_degree_by_type(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return checks.degrees(n, chain_edges(n)).groupBy("type").agg(F.max("degree").alias("max_degree"))


# --- checks

_OFFERS = _NODES + """, offers AS (
  SELECT * FROM chain
  UNION ALL SELECT graph_id, 1000, 0, 0, 0, 0 FROM nodes WHERE node_id = 0
  UNION ALL SELECT graph_id, 1001, 77, 0, 0, 0 FROM nodes WHERE node_id = 0
  UNION ALL SELECT graph_id, 1002, 0, 0, 99, 0 FROM nodes WHERE node_id = 0
  UNION ALL SELECT graph_id, 1003, 0, 9, 1, 0 FROM nodes WHERE node_id = 1
  UNION ALL SELECT graph_id, 1004, 0, 0, 1, 9 FROM nodes WHERE node_id = 1
  UNION ALL SELECT graph_id, 1005, src, src_port, dst, dst_port FROM chain WHERE edge_seq = 0
)"""
_FOLD = _OFFERS + """, o AS (
  SELECT o.*, row_number() OVER (PARTITION BY o.graph_id ORDER BY edge_seq) AS k, s.n_ports AS sp, d.n_ports AS dp
  FROM offers o LEFT JOIN nodes s ON s.graph_id = o.graph_id AND s.node_id = o.src LEFT JOIN nodes d ON d.graph_id = o.graph_id AND d.node_id = o.dst
), f AS (
  SELECT graph_id, 0::BIGINT AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS edges, 0 AS edge_seq, 0 AS src, 0 AS src_port, 0 AS dst, 0 AS dst_port, NULL::VARCHAR AS reason FROM (SELECT DISTINCT graph_id FROM o)
  UNION ALL
  SELECT graph_id, k, CASE WHEN reason IS NULL THEN list_concat(used, [a, b]) ELSE used END, CASE WHEN reason IS NULL THEN list_append(edges, a || '-' || b) ELSE edges END, edge_seq, src, src_port, dst, dst_port, reason
  FROM (
    SELECT o.graph_id, o.k, f.used, f.edges, o.edge_seq, o.src, o.src_port, o.dst, o.dst_port, o.src || '.' || o.src_port AS a, o.dst || '.' || o.dst_port AS b,
      CASE WHEN o.src = o.dst THEN 'self_loop' WHEN sp IS NULL THEN 'no_source' WHEN dp IS NULL THEN 'no_target'
           WHEN o.src_port NOT BETWEEN 0 AND sp - 1 THEN 'no_source_port' WHEN o.dst_port NOT BETWEEN 0 AND dp - 1 THEN 'no_target_port'
           WHEN list_contains(f.edges, o.src || '.' || o.src_port || '-' || o.dst || '.' || o.dst_port) THEN 'edge_exists'
           WHEN list_contains(f.used, o.src || '.' || o.src_port) THEN 'source_port_used' WHEN list_contains(f.used, o.dst || '.' || o.dst_port) THEN 'target_port_used' END AS reason
    FROM f JOIN o ON o.graph_id = f.graph_id AND o.k = f.k + 1
  )
)"""


def _offers(nodes: DataFrame) -> DataFrame:
    """The chain, then edges that break each rule."""
    chain = chain_edges(nodes)
    bad = [(1000, 0, 0, 0, 0, 0), (1001, 77, 0, 0, 0, 0), (1002, 0, 0, 99, 0, 0), (1003, 0, 9, 1, 0, 1), (1004, 0, 0, 1, 9, 1)]
    more = F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("edge_seq", "src", "src_port", "dst", "dst_port", "at"), b, strict=True)]) for b in bad]))
    extra = nodes.filter("node_id <= 1").select("graph_id", "node_id", more).filter("node_id = at").drop("node_id", "at")
    again = chain.filter("edge_seq = 0").withColumn("edge_seq", F.lit(1005))
    return chain.unionByName(extra).unionByName(again)


@query(f"WITH RECURSIVE {_FOLD} SELECT graph_id, edge_seq, src, src_port, dst, dst_port, reason IS NULL AS accepted, reason FROM f WHERE k > 0")
def edge_admission(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return checks.admit(n, _offers(n))


@query(f"""WITH RECURSIVE {_FOLD}, u AS (SELECT graph_id, node_id, count(*) AS n FROM (SELECT graph_id, src AS node_id FROM f WHERE k > 0 AND reason IS NULL UNION ALL SELECT graph_id, dst FROM f WHERE k > 0 AND reason IS NULL) GROUP BY ALL)
SELECT n.graph_id, n.node_id, n.type, n.n_ports - coalesce(u.n, 0) AS n_free FROM nodes n LEFT JOIN u USING (graph_id, node_id)""")
def free_ports(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return checks.free_ports(n, checks.accepted(n, _offers(n)))


@query(f"""WITH RECURSIVE {_FOLD}, u AS (SELECT graph_id, src AS node_id, src_port AS port FROM f WHERE k > 0 AND reason IS NULL UNION SELECT graph_id, dst, dst_port FROM f WHERE k > 0 AND reason IS NULL),
p AS (SELECT graph_id, node_id, unnest(range(n_ports))::INT AS port FROM nodes)
SELECT p.graph_id, p.node_id, p.port, u.port IS NULL AS is_free FROM p LEFT JOIN u USING (graph_id, node_id, port)""")
def port_is_free(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return checks.ports_with_state(n, checks.accepted(n, _offers(n)))


@query(f"""WITH {_ENDS}, d AS (SELECT graph_id, node_id, count(*) AS d FROM ends GROUP BY ALL)
SELECT graph_id, count(*) AS n_nodes FROM nodes n LEFT JOIN d USING (graph_id, node_id) GROUP BY graph_id HAVING bool_and(coalesce(d.d, 0) <= n_ports)""")
def bond_cap_filter(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return checks.within_bond_cap(n, chain_edges(n))


@query(f"WITH {_NODES} SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY graph_id HAVING count(*) FILTER (type = 'click') >= 2 AND count(*) FILTER (type = 'view') >= 1")
def positive_constraints(spark, sf_dir):
    return checks.meeting(_nodes(spark, sf_dir), {"click": 2, "view": 1})


@query("""SELECT * FROM (VALUES ('sound', NULL), ('', 'empty type and pattern'), ('low', 'negative hub'), ('high', 'hub beyond the last atom')) t(type, violation)""")
def group_validation(spark, sf_dir):
    """The SQL holds the expected answers."""
    rows = [("sound", "CO", [0, 0, 1], 2), ("", "", [], 0), ("low", "C", [-1], 1), ("high", "CO", [0, 2], 2)]
    return checks.group_violations(spark.createDataFrame(rows, "type string, pattern string, hubs array<int>, n_atoms int")).select("type", "violation")


# --- matching and joins


@query(f"""WITH {_ENDS} SELECT DISTINCT a.graph_id, a.node_id AS q0, b.node_id AS q1, c.node_id AS q2
FROM nodes a JOIN ends e ON e.graph_id = a.graph_id AND e.node_id = a.node_id JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.other
JOIN ends g ON g.graph_id = b.graph_id AND g.node_id = b.node_id JOIN nodes c ON c.graph_id = g.graph_id AND c.node_id = g.other
WHERE a.type = 'click' AND b.type = 'view' AND c.type = 'click' AND a.node_id <> c.node_id""")
def match_path3(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return match.search(n, chain_edges(n), ["click", "view", "click"], [(0, 1), (1, 2)])


@query(f"""WITH {_ENDS}, ar AS (SELECT DISTINCT graph_id, node_id, other FROM ends)
SELECT a.graph_id, a.node_id AS q0, b.node_id AS q1 FROM nodes a JOIN ar e ON e.graph_id = a.graph_id AND e.node_id = a.node_id JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.other
WHERE a.type = 'click' AND b.type = 'view'
  AND (SELECT count(*) FROM ar x WHERE x.graph_id = a.graph_id AND x.node_id = a.node_id AND x.other <> b.node_id) = 0
  AND (SELECT count(*) FROM ar x WHERE x.graph_id = b.graph_id AND x.node_id = b.node_id AND x.other <> a.node_id) = 1""")
def match_with_hubs(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return match.search(n, chain_edges(n), ["click", "view"], [(0, 1)], hubs=[1])


@query(f"""WITH {_NODES} SELECT c.graph_id, edge_seq, a.type || '.' || src_port AS src_end, b.type || '.' || dst_port AS dst_end, least(a.type, b.type) AS type_a, greatest(a.type, b.type) AS type_b
FROM chain c JOIN nodes a ON a.graph_id = c.graph_id AND a.node_id = c.src JOIN nodes b ON b.graph_id = c.graph_id AND b.node_id = c.dst""")
def edge_types(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return match.edge_types(n, chain_edges(n))


@query(f"""WITH {_NODES} SELECT least(a.type, b.type) AS type_a, greatest(a.type, b.type) AS type_b, count(*) AS n
FROM chain c JOIN nodes a ON a.graph_id = c.graph_id AND a.node_id = c.src JOIN nodes b ON b.graph_id = c.graph_id AND b.node_id = c.dst GROUP BY 1, 2""")
def edge_type_histogram(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return match.edge_types(n, chain_edges(n)).groupBy("type_a", "type_b").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ENDS} SELECT DISTINCT a.graph_id, a.edge_seq AS i, b.edge_seq AS j FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.node_id = b.node_id WHERE a.edge_seq < b.edge_seq")
def line_graph(spark, sf_dir):
    return match.line_graph(chain_edges(_nodes(spark, sf_dir)))


@query(f"""WITH {_ENDS}, r AS (SELECT e.*, n.n_ports, row_number() OVER (PARTITION BY e.graph_id, e.node_id ORDER BY edge_seq) - 1 AS k FROM ends e JOIN nodes n USING (graph_id, node_id))
SELECT graph_id, edge_seq, node_id, CASE WHEN k < n_ports THEN k END::INT AS port FROM r""")
def port_allocation(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return match.allocate_ports(n, endpoints(chain_edges(n)))


# --- similarity networks

CUTOFF, CUTOFFS = 0.3, (0.3, 0.35, 0.4, 0.45)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("community"))


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.similarity_edges(_vectors(spark, sf_dir), CUTOFF)


_NET = f"""
u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS community, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
net AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) / (a.n * b.n) AS weight FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) > {CUTOFF}),
arcs AS (SELECT i AS a, j AS b FROM net UNION ALL SELECT j, i FROM net)"""


@query(f"WITH {_NET} SELECT i, j, round(weight, 6) AS weight FROM net")
def space_network(spark, sf_dir):
    return _network(spark, sf_dir).select("i", "j", F.round("weight", 6).alias("weight"))


@query(f"WITH {_NET}, c AS (SELECT unnest({list(CUTOFFS)}::DOUBLE[]) AS cutoff) SELECT cutoff, round((SELECT count(*) FROM net WHERE weight > c.cutoff) / ((SELECT count(*) FROM u) * ((SELECT count(*) FROM u) - 1) / 2.0), 9) AS density FROM c")
def edge_density(spark, sf_dir):
    return space.edge_density(_network(spark, sf_dir), _vectors(spark, sf_dir).count(), CUTOFFS).select("cutoff", F.round("density", 9).alias("density"))


@query(f"WITH {_NET} SELECT round(avg(1 - list_dot_product(a.v, b.v) / (a.n * b.n)), 6) AS diversity FROM u a JOIN u b ON a.id < b.id")
def diversity_index(spark, sf_dir):
    return space.diversity(_vectors(spark, sf_dir)).select(F.round("diversity", 6).alias("diversity"))


@query(f"WITH {_NET}, d AS (SELECT a, count(*) AS d FROM arcs GROUP BY a) SELECT id, round(coalesce(d, 0) / ((SELECT count(*) FROM u) - 1.0), 9) AS centrality FROM u LEFT JOIN d ON a = id")
def degree_centrality(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return space.degree_centrality(v.select("id"), _network(spark, sf_dir), v.count()).select("id", F.round("centrality", 9).alias("centrality"))


@query(f"""WITH {_NET}, c AS (SELECT unnest({list(CUTOFFS)}::DOUBLE[]) AS cutoff), e AS (SELECT cutoff, p.community AS ci, q.community AS cj FROM c JOIN net ON weight > cutoff JOIN u p ON p.id = i JOIN u q ON q.id = j), m AS (SELECT cutoff, count(*)::DOUBLE AS m FROM e GROUP BY 1),
d AS (SELECT cutoff, c, count(*) AS d FROM (SELECT cutoff, ci AS c FROM e UNION ALL SELECT cutoff, cj FROM e) GROUP BY ALL), l AS (SELECT cutoff, ci AS c, count(*) AS l FROM e WHERE ci = cj GROUP BY ALL)
SELECT cutoff, round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM d LEFT JOIN l USING (cutoff, c) JOIN m USING (cutoff) GROUP BY cutoff""")
def modularity_label(spark, sf_dir):
    return space.modularity(_network(spark, sf_dir), _vectors(spark, sf_dir).select("id", "community"), CUTOFFS).select("cutoff", F.round("modularity", 6).alias("modularity"))


@query(f"""WITH {_NET}, d AS (SELECT a, count(*) AS d FROM arcs GROUP BY a), t AS (SELECT x.a, count(*) / 2 AS t FROM arcs x JOIN arcs y ON x.b = y.a JOIN arcs z ON y.b = z.a AND z.b = x.a GROUP BY x.a),
tr AS (SELECT x.i, x.j, y.j AS k FROM net x JOIN net y ON y.i = x.j JOIN net z ON z.i = x.i AND z.j = y.j), t2 AS (SELECT a, b, count(*) AS t FROM (SELECT unnest([i, i, j, j, k, k]) AS a, unnest([j, k, i, k, i, j]) AS b FROM tr) GROUP BY ALL),
q4 AS (SELECT x.i, x.j, x.k, y.k AS l FROM tr x JOIN tr y ON x.i = y.i AND x.j = y.j AND x.k < y.k JOIN net z ON z.i = x.k AND z.j = y.k), q2 AS (SELECT a, b, count(*) AS q FROM (SELECT unnest([i, i, i, j, j, j, k, k, k, l, l, l]) AS a, unnest([j, k, l, i, k, l, i, j, l, i, j, k]) AS b FROM q4) GROUP BY ALL),
c2 AS (SELECT t2.a, sum(2.0 * (t + coalesce(q, 0)) / ((t + 1) * t)) AS c FROM t2 LEFT JOIN q2 USING (a, b) GROUP BY t2.a),
f AS (SELECT id, coalesce(d, 0)::DOUBLE AS d, coalesce(t, 0)::DOUBLE AS t, coalesce(c, 0)::DOUBLE AS c FROM u LEFT JOIN d ON d.a = id LEFT JOIN t ON t.a = id LEFT JOIN c2 ON c2.a = id)
SELECT id, (d + 1)::BIGINT AS n_nodes, (d + t)::BIGINT AS n_edges, round(CASE WHEN d > 0 THEN 2 * (d + t) / ((d + 1) * d) ELSE 0 END, 9) AS density,
round(CASE WHEN d > 0 THEN 2 - 2 * (d + t) / ((d + 1) * d) ELSE 0 END, 9) AS mean_distance, round(CASE WHEN d > 1 THEN 2 * t / (d * (d - 1)) ELSE 0 END, 9) AS clustering,
round((CASE WHEN d > 1 THEN 2 * t / (d * (d - 1)) ELSE 0 END + c) / (d + 1), 9) AS average_clustering, CASE WHEN d = 0 THEN 0 WHEN d + t >= (d + 1) * d / 2 THEN 1 ELSE 2 END AS diameter, CASE WHEN d = 0 THEN 0 ELSE 1 END AS radius FROM f""")
def ego_density(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    e = space.ego_networks(v.select("id"), _network(spark, sf_dir))
    return e.select("id", "n_nodes", "n_edges", *[F.round(c, 9).alias(c) for c in ("density", "mean_distance", "clustering", "average_clustering")], "diameter", "radius")


@query()
def closeness(spark, sf_dir):
    """Of all nodes, with no bound on steps; a block holds at most about 2,000 sources. Tested against brute force."""
    v = _vectors(spark, sf_dir)
    n = v.count()
    return space.closeness(checkpointed(_network(spark, sf_dir)), v.select("id"), n, blocks=-(-n // 2000) or 1)


@query()
def shortest_paths(spark, sf_dir):
    """All paths of least weight from node 0 to node 3, with no bound on steps. Tested against brute force."""
    return space.shortest_paths(checkpointed(_network(spark, sf_dir)), 0, 3).select(F.array_join("path", "-").alias("path"))


@query(f"""WITH {_NODES}, s AS (SELECT graph_id, node_id, count(*) OVER (PARTITION BY graph_id) AS n FROM nodes)
SELECT graph_id, node_id::BIGINT AS node_id, (node_id * (n - 1 - node_id))::DOUBLE AS betweenness FROM s WHERE n > 1""")
def betweenness(spark, sf_dir):
    """Chains have a closed form, which the SQL uses."""
    e = chain_edges(_nodes(spark, sf_dir)).select(F.col("graph_id").alias("g"), F.col("src").cast("bigint").alias("i"), F.col("dst").cast("bigint").alias("j"))
    return space.betweenness(e).select(F.col("g").alias("graph_id"), F.col("id").alias("node_id"), "betweenness")


@query()
def eigenvector_centrality(spark, sf_dir):
    return space.eigenvector_centrality(checkpointed(_network(spark, sf_dir)))


@query("""WITH p AS (SELECT s_suppkey AS id, (s_suppkey // 10)::DOUBLE AS x, (s_suppkey % 10)::DOUBLE AS y FROM supplier)
SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.id < b.id WHERE abs(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - 1) <= 0.001""")
def radius_edges(spark, sf_dir):
    """Suppliers on a grid; each is linked to those next to it."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("id"), F.floor(k / 10).cast("double").alias("x"), (k % 10).cast("double").alias("y"))
    return space.radius_edges(p, 1.0, 0.001)


# --- symmetry and enumeration

#: A chain of atoms for each order: returned lines are oxygen, accepted ones nitrogen, others carbon.
_MOLS = "mols AS (SELECT l_orderkey AS mol_id, string_agg(e, '' ORDER BY l_linenumber, e) AS smiles FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'C' ELSE 'O' END AS e FROM lineitem) GROUP BY 1)"


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.col("l_returnflag") == "A", "N").when(F.col("l_returnflag") == "N", "C").otherwise("O")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", e.alias("e")))).alias("es"))
    return rows.select("mol_id", F.array_join(F.transform("es", lambda x: x["e"]), "").alias("smiles"))


def _links(n: Column) -> Column:
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array(i, i + 1))).otherwise(F.array().cast("array<array<int>>"))


def _chain_graphs(molecules: DataFrame) -> DataFrame:
    n = F.length("smiles")
    return molecules.select("mol_id", "smiles", n.alias("n"), F.slice(F.split("smiles", ""), F.lit(1), n).alias("labels"), _links(n).alias("edges"))



@query("""WITH RECURSIVE m AS (SELECT unnest(range(64)) AS g), p AS (SELECT * FROM (VALUES (0,0,1),(1,0,2),(2,0,3),(3,1,2),(4,1,3),(5,2,3)) t(b, u, v)),
e AS (SELECT g, u, v FROM m JOIN p ON (g >> b) & 1 = 1), r AS (SELECT DISTINCT g, 0 AS x FROM m UNION SELECT r.g, CASE WHEN e.u = r.x THEN e.v ELSE e.u END FROM r JOIN e ON e.g = r.g AND (e.u = r.x OR e.v = r.x)),
c AS (SELECT g FROM r GROUP BY g HAVING count(DISTINCT x) = 4), q AS (SELECT a.i AS p0, b.i AS p1, c.i AS p2, d.i AS p3 FROM range(4) a(i), range(4) b(i), range(4) c(i), range(4) d(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
i AS (SELECT c.g, q.p0, q.p1, q.p2, q.p3, sum(1 << t.b) AS h FROM c JOIN e ON e.g = c.g, q JOIN p t ON true WHERE t.u = least([p0, p1, p2, p3][e.u + 1], [p0, p1, p2, p3][e.v + 1]) AND t.v = greatest([p0, p1, p2, p3][e.u + 1], [p0, p1, p2, p3][e.v + 1]) GROUP BY ALL),
k AS (SELECT g, min(h) AS h FROM i GROUP BY g) SELECT bit_count(h::BIGINT)::INT AS n_edges, count(DISTINCT h) AS n_graphs FROM k GROUP BY 1""")
def connected_skeletons_n4(spark, sf_dir):
    return gen.skeletons(spark, 4).groupBy(F.size("edges").alias("n_edges")).agg(F.count(F.lit(1)).alias("n_graphs"))


@query("SELECT k, n_colored::BIGINT AS n_colored FROM (VALUES (1, 6), (2, 50), (3, 201), (4, 566)) t(k, n_colored)")
def colored_skeletons_n4(spark, sf_dir):
    """The SQL holds the expected counts."""
    s = gen.skeletons(spark, 4)
    parts = [gen.colored(s, k).select(F.lit(k).alias("k")) for k in (1, 2, 3, 4)]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n_colored"))


def _symmetry(spark: SparkSession) -> DataFrame:
    """Cycle types of some graphs' automorphisms."""
    ring = lambda n: [[i, (i + 1) % n] for i in range(n)]
    cases = [("c4", 4, ring(4)), ("c6", 6, ring(6)), ("p3", 3, [[0, 1], [1, 2]]), ("k3", 3, ring(3))]

    g = spark.createDataFrame(cases, "name string, n int, edges array<array<int>>").withColumn("labels", F.array_repeat(F.lit(""), F.col("n")))
    return chem.cycle_indices(g, ["name"])


@query("""SELECT name, cycles, share::DOUBLE AS share FROM (VALUES ('c4', '1,1,1,1', 0.125), ('c4', '1,1,2', 0.25), ('c4', '2,2', 0.375), ('c4', '4', 0.25), ('p3', '1,1,1', 0.5), ('p3', '1,2', 0.5), ('k3', '1,1,1', 0.166666667), ('k3', '1,2', 0.5), ('k3', '3', 0.333333333)) t(name, cycles, share)""")
def cycle_index(spark, sf_dir):
    """The SQL holds the expected answers."""
    return _symmetry(spark).filter("name <> 'c6'").select("name", F.array_join("cycles", ",").alias("cycles"), F.round(F.col("num") / F.col("den"), 9).alias("share"))


@query("""WITH q AS (SELECT a.i AS p0, b.i AS p1, c.i AS p2, d.i AS p3, e.i AS p4, f.i AS p5 FROM range(6) a(i), range(6) b(i), range(6) c(i), range(6) d(i), range(6) e(i), range(6) f(i)
WHERE (b.i - a.i) % 6 IN (1, 5, -1, -5) AND (c.i - b.i) % 6 IN (1, 5, -1, -5) AND (d.i - c.i) % 6 IN (1, 5, -1, -5) AND (e.i - d.i) % 6 IN (1, 5, -1, -5) AND (f.i - e.i) % 6 IN (1, 5, -1, -5) AND (a.i - f.i) % 6 IN (1, 5, -1, -5) AND len(list_distinct([a.i, b.i, c.i, d.i, e.i, f.i])) = 6),
col AS (SELECT unnest(range(64)) AS m), im AS (SELECT m, sum(((m >> j.i) & 1) << [p0, p1, p2, p3, p4, p5][j.i + 1]) AS h FROM col, q, range(6) j(i) GROUP BY m, p0, p1, p2, p3, p4, p5)
SELECT count(DISTINCT h) AS n_colorings FROM (SELECT m, min(h) AS h FROM im GROUP BY m)""")
def polya_c6(spark, sf_dir):
    return _symmetry(spark).filter("name = 'c6'").agg(F.round(F.sum(F.col("num") / F.col("den") * F.pow(F.lit(2), F.size("cycles")))).cast("bigint").alias("n_colorings"))


@query(f"""WITH {_MOLS}, n AS (SELECT DISTINCT length(smiles) AS n FROM mols), c AS (SELECT n, lpad(bin(unnest(range(1 << n))), n::INT, '0') AS s FROM n)
SELECT n::INT AS n, length(replace(k, '0', ''))::INT AS n_second, count(*)::BIGINT AS n_colorings FROM (SELECT DISTINCT n, least(s, reverse(s)) AS k FROM c) GROUP BY ALL""")
def chain_inventories(spark, sf_dir):
    """Chains of each length that occurs, coloured with two colours up to reversal, by how often the second is used."""
    n = _chain_graphs(_molecules(spark, sf_dir)).select("n").distinct()
    bare = n.select("n", F.array_repeat(F.lit(""), F.col("n")).alias("labels"), _links(F.col("n")).alias("edges"))
    return chem.inventories(bare.withColumnRenamed("n", "length"), ["length"], ["a", "b"]).select(F.col("length").alias("n"), F.col("used")[1].alias("n_second"), F.col("n").alias("n_colorings"))


@query(f"""WITH {_MOLS}, r AS (SELECT mol_id, smiles, length(smiles)::INT AS n, smiles = reverse(smiles) AS pal FROM mols)
SELECT mol_id, array_to_string(list_transform(range(n), lambda i: CASE WHEN pal THEN least(i, n - 1 - i) ELSE i END), ',') AS nodes, array_to_string(list_transform(range(n - 1), lambda i: CASE WHEN pal THEN least(i, n - 2 - i) ELSE i END), ',') AS edges,
CASE WHEN pal AND n > 1 THEN 2 ELSE 1 END::BIGINT AS n_automorphisms FROM r""")
def orbits(spark, sf_dir):
    g = chem.symmetries(_chain_graphs(_molecules(spark, sf_dir)), ["mol_id"])
    return g.select("mol_id", F.array_join("node_orbits", ",").alias("nodes"), F.array_join("edge_orbits", ",").alias("edges"), "n_automorphisms")


@query(f"""WITH {_MOLS} SELECT mol_id, array_to_string(list_transform(range(length(smiles)), lambda i: CASE WHEN smiles = reverse(smiles) THEN least(i, length(smiles) - 1 - i) ELSE i END), ',') AS orbits FROM mols""")
def hub_orbits(spark, sf_dir):
    """Of a port on each atom of a chain."""
    g = _chain_graphs(_molecules(spark, sf_dir)).select("mol_id", F.col("smiles").alias("pattern"), F.sequence(F.lit(0), F.col("n") - 1).alias("hubs"))
    return chem.hub_orbits(g, ["mol_id"]).select("mol_id", F.array_join("orbits", ",").alias("orbits"))


#: Alphabets whose numbers of molecules are known.
GEN4 = [gen.Group("t2", "N", (0, 0, 0)), gen.Group("Methyl", "C", (0, 0, 0)), gen.Group("ester", "C(=O)O", (0, 2)), gen.Group("extra1", "O", (0, 0))]
COUNT4 = [gen.Group("ester", "C(O)=O", (0, 1)), gen.Group("amine", "N", (0, 0, 0)), gen.Group("carbon", "C", (0, 0, 0, 0)), gen.Group("alkene", "C=C", (0, 0, 1, 1))]


@query("SELECT alphabet, n, n_molecules::BIGINT AS n_molecules FROM (VALUES ('gen4', 1, 4), ('gen4', 2, 15), ('gen4', 3, 94), ('count4', 2, 15), ('count4', 3, 135)) t(alphabet, n, n_molecules)")
def exhaustive_generate(spark, sf_dir):
    """Distinct molecules by alphabet and number of groups; the SQL holds the expected counts."""
    parts = [gen.exhaustive(spark, n, g).select(F.lit(a).alias("alphabet"), F.lit(n).alias("n")) for a, g, ns in (("gen4", GEN4, (1, 2, 3)), ("count4", COUNT4, (2, 3))) for n in ns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("alphabet", "n").agg(F.count(F.lit(1)).alias("n_molecules"))


@query()
def random_generate_seeded(spark, sf_dir):
    return gen.random_sample(spark, 3, GEN4, count=40, seed=5)


@query(f"""WITH {_MOLS}, r AS (SELECT mol_id, CASE WHEN length(smiles) = 1 OR smiles = reverse(smiles) THEN 1 ELSE 2 END AS one FROM mols)
SELECT mol_id, unnest([1, 2])::INT AS degree, unnest([one, 1])::BIGINT AS n_sets FROM r""")
def possible_attachments(spark, sf_dir):
    """Ways to attach to a chain with a port on its first and one on its last atom, by number of ports used."""
    g = _molecules(spark, sf_dir).select("mol_id", F.lit("chain").alias("type"), F.col("smiles").alias("pattern"), F.array(F.lit(0), F.length("smiles") - 1).alias("hubs"))
    return chem.attachment_sets(g, ["mol_id"]).groupBy("mol_id", "degree").agg(F.count(F.lit(1)).alias("n_sets"))


@query(f"""WITH {_MOLS}, r AS (SELECT mol_id, smiles, length(smiles)::INT - 1 AS m FROM mols)
SELECT mol_id, array_to_string(range(m), ',') AS image FROM r UNION ALL SELECT mol_id, array_to_string(list_transform(range(m), lambda i: m - 1 - i), ',') FROM r WHERE m > 1 AND smiles = reverse(smiles)""")
def edge_automorphisms(spark, sf_dir):
    """Of each chain, what its symmetries do to its bonds."""
    return chem.edge_images(_chain_graphs(_molecules(spark, sf_dir)), ["mol_id"]).select("mol_id", F.array_join("image", ",").alias("image"))


@query("WITH s AS (SELECT unnest([[0,0,0]]) AS h), m AS (SELECT unnest(range(8)) AS b) SELECT DISTINCT 'amine' AS type, repeat('0', bit_count(b::BIGINT)::INT) AS hubs FROM m")
def valency_variants(spark, sf_dir):
    g = spark.createDataFrame([("amine", [0, 0, 0])], "type string, hubs array<int>")
    return fragment.variants_of(g).select("type", F.array_join("hubs", "").alias("hubs"))


# --- packings and fragments

_CASES = [
    (1, [(0, 1), (1, 2), (2, 3)]),
    (2, [(0, 1), (0, 2), (0, 3), (4, 5)]),
    (3, [(0, 1), (0, 2), (0, 3), (4, 5), (5, 6)]),
    (4, [(0, 1), (2, 3), (4, 5), (1, 2), (3, 4), (5, 6)]),
]
_CASES_SQL = "c(case_id, matches) AS (VALUES " + ", ".join(f"({i}, {[list(m) for m in ms]})" for i, ms in _CASES) + ")"


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, [list(m) for m in ms]) for i, ms in _CASES], "case_id bigint, matches array<array<int>>")


@query(f"""WITH RECURSIVE {_CASES_SQL}, p AS (SELECT case_id, matches, 0 AS last, []::INT[] AS used, []::INT[][] AS packing FROM c
UNION ALL SELECT case_id, matches, i::INT, list_concat(used, matches[i]), list_append(packing, matches[i]) FROM (SELECT p.*, unnest(range(last + 1, len(matches) + 1)) AS i FROM p) WHERE NOT list_has_any(used, matches[i])),
r AS (SELECT *, len(packing) AS size, max(len(packing)) OVER (PARTITION BY case_id) AS most FROM p)
SELECT case_id::BIGINT AS case_id, size::INT AS size, (count(*) OVER (PARTITION BY case_id))::INT AS n_packings, list_transform(packing, lambda x: x[1]::VARCHAR || '-' || x[2]::VARCHAR).array_to_string(' ') AS packing FROM r WHERE size = most""")
def max_packing(spark, sf_dir):
    return fragment.packed(_cases(spark)).select("case_id", "size", "n_packings", F.array_join(F.transform("packing", lambda m: F.array_join(m, "-")), " ").alias("packing"))


@query("SELECT case_id::BIGINT AS case_id, packing FROM (VALUES (1, '0-1 2-3'), (2, '0-1 4-5'), (3, '0-1 4-5'), (4, '0-1 2-3 4-5')) t(case_id, packing)")
def greedy_packing(spark, sf_dir):
    """The SQL holds the expected answers."""
    return _cases(spark).select("case_id", F.array_join(F.transform(fragment.greedy(F.col("matches")), lambda m: F.array_join(m, "-")), " ").alias("packing"))


EXHAUSTIVE3 = [gen.Group("amine", "N", (0, 0, 0)), gen.Group("alkene_secondary_amine", "C(N(C))", (0, 0, 0, 1, 2, 2, 2)), gen.Group("alkene", "C", (0, 0, 0))]


@query("SELECT smiles, n_groups, n_covers::BIGINT AS n_covers FROM (VALUES ('CCC(C)NCCNC', 5, 4), ('CCC(C)NCCNC', 7, 4), ('CCC(C)NCCNC', 9, 1)) t(smiles, n_groups, n_covers)")
def exhaustive_fragment(spark, sf_dir):
    """The SQL holds the expected answers: nine covers in all."""
    m = spark.createDataFrame([("CCC(C)NCCNC",)], "smiles string")
    return fragment.fragments(m, EXHAUSTIVE3).groupBy("smiles", "n_groups").agg(F.count(F.lit(1)).alias("n_covers"))


#: Molecules with the queries laid over them.
LAID_OUT = [
    (1, "C(C)CO", ["[C]C", "[O]", "[C]"]),
    (2, "CCOC", ["[O]C", "[C]"]),
    (3, "C(C)CO", ["[C]C", "[O]C", "[C]", "[O]"]),
    (4, "C(O)CO", ["[O]C", "[C]", "[O]"]),
    (5, "COCO", ["[O]C", "[C]", "[O]"]),
    (6, "COCO", ["[O]C"]),
    (7, "C(O)(O)(O)OC", ["[O]C", "[C]C", "C", "O"]),
    (8, "CCC1CCCCC1", ["[C;R]", "[C]C"]),
    (9, "CNC(C(C)O)C(N)CCN", ["[C;R]", "[C](=O)O", "[C]O", "[C]C", "[O;X1]", "[C]", "[N]"]),
]


@query("SELECT case_id, n_results::BIGINT AS n_results FROM (VALUES (1, 2), (2, 2), (3, 2), (4, 1), (5, 1), (6, 1), (7, 3), (8, 1), (9, 1)) t(case_id, n_results)")
def fragment_queries(spark, sf_dir):
    """Complete results by case; the SQL holds the expected counts."""
    parts = [fragment.laid_out(spark.createDataFrame([(s,)], "smiles string"), q).select(F.lit(i).alias("case_id")) for i, s, q in LAID_OUT]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_results"))


@query("SELECT * FROM (VALUES ('joback', 42), ('saft', 36), ('unifac', 92)) t(library, n_groups)")
def library_sizes(spark, sf_dir):
    """The published sizes, with one group added to the first; the SQL holds them."""
    every = functools.reduce(DataFrame.unionByName, [libraries.groups(spark, k) for k in libraries.LIBRARIES])
    return libraries.sizes(libraries.added(every, "joback", ("-B<", "[B]", (0, 0, 0))))


@query("""SELECT library, smiles, type, n::BIGINT AS n FROM (VALUES ('unifac', 'CC(C)C', 'CH', 1), ('unifac', 'CC(C)C', 'CH3', 3), ('joback', 'CC(C)C', '-CH3', 3), ('joback', 'CC(C)C', '>CH-', 1), ('saft', 'CC(C)C', 'CH3', 3), ('saft', 'CC(C)C', 'CH', 1), ('unifac', 'OCC(O)CO', 'OH (P)', 2), ('unifac', 'OCC(O)CO', 'CH2', 2), ('unifac', 'OCC(O)CO', 'CH', 1), ('unifac', 'OCC(O)CO', 'OH (S)', 1), ('joback', 'OCC(O)CO', '-OH (alcohol)', 3), ('joback', 'OCC(O)CO', '-CH2-', 2), ('joback', 'OCC(O)CO', '>CH-', 1), ('saft', 'OCC(O)CO', 'CH2OH', 2), ('saft', 'OCC(O)CO', 'CHOH', 1), ('unifac', 'O=CO', 'HCOO', 1), ('joback', 'O=CO', '-COOH (acid)', 1), ('saft', 'O=CO', 'COOH', 1), ('unifac', 'COC(C)=O', 'CH3COO', 1), ('unifac', 'COC(C)=O', 'CH3', 1), ('joback', 'COC(C)=O', '-CH3', 2), ('joback', 'COC(C)=O', '-COO- (ester)', 1), ('saft', 'COC(C)=O', 'CH3', 2), ('saft', 'COC(C)=O', 'COO', 1)) t(library, smiles, type, n)""")
def library_fragments(spark, sf_dir):
    """Groups of some molecules by library; the SQL holds the expected histograms."""
    m = spark.createDataFrame([(s,) for s in ["CC(C)C", "COC(C)=O", "O=CO", "OCC(O)CO"]], "smiles string")
    parts = [libraries.histograms(m, k).select(F.lit(k).alias("library"), "smiles", "type", "n") for k in libraries.LIBRARIES]
    return parts[0].union(parts[1]).union(parts[2])


# --- molecules


@query(f"WITH {_MOLS} SELECT mol_id, length(smiles)::INT AS n_atoms, length(smiles)::INT - 1 AS n_bonds, true AS same FROM mols")
def graph_to_smiles(spark, sf_dir):
    """Chains as port graphs of single atoms, expanded to atoms and written; each must be the molecule that its own text is."""
    m = _molecules(spark, sf_dir)
    nodes = m.select(F.col("mol_id").alias("graph_id"), F.posexplode(F.split("smiles", "")).alias("node_id", "type")).filter("type <> ''").select("graph_id", "node_id", "type", F.col("type").alias("pattern"), F.array(F.lit(0), F.lit(0)).alias("hubs"))
    edges = m.filter(F.length("smiles") > 1).select(F.col("mol_id").alias("graph_id"), F.explode(F.sequence(F.lit(0), F.length("smiles") - 2)).alias("src")).select("graph_id", F.col("src").alias("edge_seq"), "src", F.lit(1).alias("src_port"), (F.col("src") + 1).alias("dst"), F.lit(0).alias("dst_port"))
    out = chem.expanded(nodes, edges).withColumnRenamed("graph_id", "mol_id").join(chem.keyed(m, ["mol_id"]), "mol_id")
    return out.select("mol_id", "n_atoms", "n_bonds", (F.col("smiles") == F.col("canonical")).alias("same"))


@query(f"WITH {_MOLS} SELECT min(smiles) AS smiles, count(DISTINCT smiles) AS n_texts, count(*) AS n_molecules FROM mols GROUP BY least(smiles, reverse(smiles))")
def canonical_dedup(spark, sf_dir):
    """Texts of the same molecule share a key."""
    return chem.keyed(_molecules(spark, sf_dir), ["mol_id", "smiles"]).groupBy("canonical_key").agg(F.min("smiles").alias("smiles"), F.countDistinct("smiles").alias("n_texts"), F.count(F.lit(1)).alias("n_molecules")).drop("canonical_key")


@query(f"WITH {_MOLS}, a AS (SELECT mol_id, smiles, unnest(range(length(smiles)))::INT AS i FROM mols), e AS (SELECT mol_id, i, substr(smiles, i + 1, 1) AS element FROM a) SELECT mol_id, i AS atom_id, element, CASE element WHEN 'C' THEN 4 WHEN 'N' THEN 3 ELSE 2 END AS valency FROM e")
def molecule_atoms(spark, sf_dir):
    return chem.atoms(chem.parsed(_molecules(spark, sf_dir), ["mol_id"]), ["mol_id"]).drop("charge")


@query(f"WITH {_MOLS}, a AS (SELECT mol_id, unnest(range(length(smiles) - 1))::INT AS i FROM mols) SELECT mol_id, i AS src, i + 1 AS dst, 1.0::DOUBLE AS bond_order FROM a UNION ALL SELECT mol_id, i + 1, i, 1.0 FROM a")
def molecule_bonds(spark, sf_dir):
    return chem.bonds(chem.parsed(_molecules(spark, sf_dir), ["mol_id"]), ["mol_id"])


@query(f"WITH {_MOLS}, a AS (SELECT mol_id, length(smiles) AS n, smiles, unnest(range(length(smiles)))::INT AS hub FROM mols) SELECT mol_id, hub, CASE substr(smiles, hub + 1, 1) WHEN 'C' THEN 3 WHEN 'N' THEN 2 ELSE 1 END + CASE WHEN n = 1 THEN 1 ELSE 0 END::BIGINT AS n_ports FROM a")
def hubs_from_pattern(spark, sf_dir):
    h = chem.hubs_from_patterns(_molecules(spark, sf_dir), ["mol_id"], "smiles")
    return h.select("mol_id", F.explode("hubs").alias("hub")).groupBy("mol_id", "hub").agg(F.count(F.lit(1)).alias("n_ports"))



@query(f"""WITH {_MOLS}, l AS (SELECT mol_id, smiles, length(smiles)::INT AS n FROM mols WHERE length(smiles) > 2)
SELECT mol_id, (n - 2) || ' ' || (n - 1) AS image FROM l WHERE smiles LIKE '%CO' UNION ALL SELECT mol_id, '1 0' FROM l WHERE smiles LIKE 'OC%'""")
def substructure_search(spark, sf_dir):
    """Carbon with oxygen at the end of a chain: one bond leaves the carbon, none the oxygen."""
    return chem.substructures(_molecules(spark, sf_dir), ["mol_id"], "CO", [0]).select("mol_id", F.array_join("image", " ").alias("image"))


@query(f"""WITH {_MOLS}, a AS (SELECT mol_id, smiles, unnest(range(1, length(smiles))) AS i FROM mols)
SELECT mol_id, count(*) AS n_matches FROM a WHERE substr(smiles, i::INT, 2) IN ('CO', 'OC') GROUP BY mol_id""")
def pattern_matches(spark, sf_dir):
    return chem.pattern_matches(_molecules(spark, sf_dir), ["mol_id"], "[#6]~[#8;D1,D2]").groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_matches"))


@query(f"""WITH RECURSIVE {_MOLS}, t AS (SELECT DISTINCT smiles, length(smiles)::INT AS n FROM mols), f AS (SELECT smiles, n, 1 AS i, 1::BIGINT AS now, 1::BIGINT AS before FROM t
UNION ALL SELECT smiles, n, i + 1, now + CASE WHEN substr(smiles, i, 2) IN ('CN', 'NC') THEN before ELSE 0 END, now FROM f WHERE i < n)
SELECT smiles, now AS n_covers, true AS same FROM f WHERE i = n""")
def cover_round_trip(spark, sf_dir):
    """Every cover of each chain by single atoms and the pair CN, as a port graph; put together again each must be the molecule it came from."""
    pieces = [gen.Group("c", "C", (0, 0, 0)), gen.Group("n", "N", (0, 0, 0)), gen.Group("o", "O", (0, 0)), gen.Group("cn", "CN", (0, 0, 0, 1, 1))]
    m = _molecules(spark, sf_dir).select("smiles").distinct()
    g = fragment.cover_graphs(m, pieces).select("smiles", F.concat_ws("/", "smiles", "result").alias("graph_id"), "nodes", "edges")
    nodes = g.select("graph_id", F.posexplode("nodes").alias("node_id", "n")).select("graph_id", "node_id", "n.*")
    edges = g.select("graph_id", F.posexplode("edges").alias("edge_seq", "e")).select("graph_id", "edge_seq", "e.*")
    back = chem.expanded(nodes, edges).select(F.substring_index("graph_id", "/", 1).alias("smiles"), F.col("smiles").alias("back"))
    return back.join(chem.keyed(m, ["smiles"]), "smiles").groupBy("smiles").agg(F.count(F.lit(1)).alias("n_covers"), F.bool_and(F.col("back") == F.col("canonical")).alias("same"))


@query(f"""WITH {_MOLS} SELECT mol_id, length(smiles)::INT AS n_groups, length(smiles)::INT - 1 AS n_edges FROM mols""")
def fragment_graphs(spark, sf_dir):
    """Chains laid out with single atoms: one result each, with an edge for each bond."""
    pieces = fragment.pieces_of(["[C]", "[N]", "[O]"])
    pieces = [p._replace(hubs=h) for p, h in zip(pieces, ((0, 0, 0, 0), (0, 0, 0), (0, 0)), strict=True)]
    g = fragment.port_graphs(_molecules(spark, sf_dir), pieces, incomplete="raise error", keep=["mol_id"])
    return g.select("mol_id", F.size("nodes").alias("n_groups"), F.size("edges").alias("n_edges"))


_OFFERED = "b AS (SELECT mol_id, seq, seq::INT AS src, (seq + 1)::INT AS dst FROM (SELECT mol_id, smiles, unnest(range(length(smiles)))::INT AS seq FROM mols))"


@query(f"""WITH {_MOLS}, {_OFFERED}, l AS (SELECT mol_id, length(smiles) AS n, smiles FROM mols)
SELECT b.mol_id, b.seq, CASE WHEN b.seq = l.n - 1 THEN 'no target' END AS reason FROM b JOIN l USING (mol_id)""")
def bond_admission(spark, sf_dir):
    """Bonds of each chain, and one past its end."""
    m = chem.parsed(_molecules(spark, sf_dir), ["mol_id"])
    offered = chem.atoms(m, ["mol_id"]).select("mol_id", F.col("atom_id").alias("seq"), F.col("atom_id").alias("src"), (F.col("atom_id") + 1).alias("dst"), F.lit(1.0).alias("bond_order"))
    return chem.admit_bonds(chem.atoms(m, ["mol_id"]), offered).select("mol_id", "seq", "reason")


@query(f"""WITH {_MOLS}, a AS (SELECT mol_id, smiles, unnest(range(length(smiles)))::INT AS seq FROM mols), t AS (SELECT mol_id, seq, substr(smiles, seq + 1, 1) AS type FROM a),
f AS (SELECT mol_id, type, min(seq) AS first FROM t GROUP BY ALL) SELECT mol_id, seq, type, seq AS node_id, NULL::VARCHAR AS reason FROM t JOIN f USING (mol_id, type)
UNION ALL SELECT mol_id, 1000, substr(smiles, 1, 1), NULL, 'type exists with another pattern and other hubs' FROM mols UNION ALL SELECT mol_id, 1001, 'unheard', NULL, 'unknown type without a pattern' FROM mols""")
def node_admission(spark, sf_dir):
    """A node for each atom, the first of a type with its pattern; then one that changes a known type, and one of an unknown type."""
    a = chem.atoms(chem.parsed(_molecules(spark, sf_dir), ["mol_id"]), ["mol_id"]).select(F.col("mol_id").alias("graph_id"), F.col("atom_id").alias("seq"), F.col("element").alias("type"))
    first = a.groupBy("graph_id", "type").agg(F.min("seq").alias("first"))
    known = a.join(first, ["graph_id", "type"]).select("graph_id", "seq", "type", F.when(F.col("seq") == F.col("first"), F.col("type")).alias("pattern"), F.when(F.col("seq") == F.col("first"), F.array(F.lit(0), F.lit(0))).alias("hubs"))
    heads = a.filter("seq = 0")
    changed = heads.select("graph_id", F.lit(1000).alias("seq"), "type", F.lit("F").alias("pattern"), F.array(F.lit(0)).alias("hubs"))
    unheard = heads.select("graph_id", F.lit(1001).alias("seq"), F.lit("unheard").alias("type"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("array<int>").alias("hubs"))
    return chem.admit_nodes(known.unionByName(changed).unionByName(unheard)).select(F.col("graph_id").alias("mol_id"), "seq", "type", "node_id", "reason")


@query(f"""WITH {_ENDS}, n AS (SELECT graph_id, string_agg(node_id || ':' || type, ', ' ORDER BY node_id) AS n FROM nodes GROUP BY 1), e AS (SELECT graph_id, string_agg(src || '.' || src_port || '-' || dst || '.' || dst_port, ', ' ORDER BY edge_seq) AS e FROM chain GROUP BY 1)
SELECT graph_id, 'nodes [' || n || '] edges [' || coalesce(e, '') || ']' AS text FROM n LEFT JOIN e USING (graph_id)""")
def graph_texts(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return chem.graph_texts(n, chain_edges(n))


@query("""WITH t AS (SELECT list_sort(list(DISTINCT event_type)) AS a FROM events), m AS (SELECT a, unnest(range(1 << len(a))) AS b FROM t)
SELECT array_to_string(list_filter(a, lambda x, i: (b >> (i - 1)) & 1 = 1), ',') AS subset FROM m""")
def alphabet_powerset(spark, sf_dir):
    return chem.powerset(table(spark, sf_dir, "events"), "event_type").select(F.array_join("subset", ",").alias("subset"))


@query(f"""WITH {_NODES}, e AS (SELECT DISTINCT p.type AS a, q.type AS b FROM chain c JOIN nodes p ON p.graph_id = c.graph_id AND p.node_id = c.src JOIN nodes q ON q.graph_id = c.graph_id AND q.node_id = c.dst WHERE p.type <> 'error')
SELECT x.a || '*' || x.b AS term FROM e x JOIN e y ON x.a = y.b AND x.b = y.a""")
def inventory_filter(spark, sf_dir):
    """A term for each two types; those stay that follow each other in both orders, edges that leave errors not counted."""
    n = _nodes(spark, sf_dir)
    src, dst = n.select("graph_id", F.col("node_id").alias("src"), F.col("type").alias("a")), n.select("graph_id", F.col("node_id").alias("dst"), F.col("type").alias("b"))
    edges = chain_edges(n).join(src, ["graph_id", "src"]).join(dst, ["graph_id", "dst"]).filter("a <> 'error'").select("a", "b").distinct()
    types = spark.createDataFrame([(a, b) for a in EVENT_PORTS for b in EVENT_PORTS], "a string, b string")
    pairs = types.select(F.concat_ws("*", "a", "b").alias("term"), F.concat_ws("*", "a", "b").alias("factor"), "a", "b")
    return chem.filtered_inventory(pairs.select("term", "factor"), pairs.select("factor", "a", "b"), edges)


@query("SELECT * FROM (VALUES (0, 'C', 2), (1, 'C', 1), (2, 'O', 0), (3, 'C', 2)) t(atom_id, element, free_valency)")
def free_valency(spark, sf_dir):
    """Orders add up as whole numbers; the SQL holds the expected answers."""
    atoms = spark.createDataFrame([(1, 0, "C", 4), (1, 1, "C", 4), (1, 2, "O", 2), (1, 3, "C", 4)], "mol_id int, atom_id int, element string, valency int")
    bonds = [(1, 0, 1, 1.0), (1, 1, 0, 1.0), (1, 1, 2, 2.0), (1, 2, 1, 2.0), (1, 0, 3, 1.5), (1, 3, 0, 1.5), (1, 3, 9, 1.5)]
    return checks.free_valency(atoms, spark.createDataFrame(bonds, "mol_id int, src int, dst int, bond_order double")).drop("mol_id")


# --- text, JSON, sinks, export

_LINES = ["3 2 0 1 0  0 1 1 2", "1 0 4  ", "2 1 0 0  0 1", "2 1 0 -1  0 1", "broken", "4 3 0 1 2 3  0 3 1 3 2 3"]


@query("""SELECT * FROM (VALUES (3, '0 1 0', '0-1 1-2'), (1, '4', ''), (2, '0 0', '0-1'), (4, '0 1 2 3', '0-3 1-3 2-3')) t(n, colors, edges)""")
def vcolg_parse(spark, sf_dir):
    """The SQL holds the expected answers."""
    p = text.parse_colored(spark.createDataFrame([(x,) for x in _LINES], "value string")).filter(F.col("n").isNotNull())
    return p.select("n", F.array_join("colors", " ").alias("colors"), F.array_join(F.transform("edges", lambda e: F.array_join(e, "-")), " ").alias("edges"))


@query(f"WITH {_NODES} SELECT graph_id, edge_seq, src, src_port, dst, dst_port, 1.0::DOUBLE AS bond_order FROM chain")
def json_roundtrip(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return text.from_json(text.to_json(n, chain_edges(n)))[1]


@query(f"WITH {_NODES} SELECT graph_id, edge_seq, src, src_port, dst, dst_port FROM chain")
def onehot_roundtrip(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return export.from_features(export.to_features(chain_edges(n), 4), 4)


@query(f"WITH {_NODES} SELECT graph_id, src, dst, src || '.' || src_port AS src_end, dst || '.' || dst_port AS dst_end FROM chain")
def directed_export(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return export.to_directed(n, chain_edges(n))[1]


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT user_id, string_agg(event_type || ':' || n, ' ' ORDER BY event_type) AS composition FROM c GROUP BY user_id)
SELECT DISTINCT composition FROM k WHERE composition NOT IN (SELECT composition FROM k WHERE user_id % 2 = 0)""")
def dedup_sink(spark, sf_dir):
    """A table takes the compositions of even users, then those of all; what the second call appends."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws(":", x["event_type"], x["n"]))
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.array_join(parts, " ").alias("composition"))
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    text.append_new(c.filter("user_id % 2 = 0").select("composition"), path, "composition")
    return text.append_new(c.select("composition"), path, "composition")


@query("SELECT p_partkey FROM part WHERE p_size = 10 OR p_brand = 'Brand#1'")
def library_query(spark, sf_dir):
    """Parts as a library: any of the attributes may fit."""
    return checks.query_groups(table(spark, sf_dir, "part"), {"p_size": 10, "p_brand": "Brand#1"}).select("p_partkey")


# --- more of the space's network


@query(f"""WITH RECURSIVE {_NET}, r AS (SELECT id, id AS x FROM u UNION SELECT r.id, arcs.b FROM r JOIN arcs ON arcs.a = r.x) SELECT id, min(x) AS component FROM r GROUP BY id""")
def network_components(spark, sf_dir):
    return space.components(_vectors(spark, sf_dir).select("id"), _network(spark, sf_dir))


@query()
def greedy_communities(spark, sf_dir):
    """Communities of the network, largest first, with its modularity; tested against plain merging."""
    net = checkpointed(_network(spark, sf_dir))
    found = checkpointed(space.communities(net.select(F.lit("net").alias("g"), "i", "j")).select("id", "community"))
    return found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(space.modularity(net, found, CUTOFFS[:1]).select(F.round("modularity", 9).alias("modularity")))


_WL = _NODES + """, x0 AS (SELECT graph_id, node_id, type AS l FROM nodes), ar AS (SELECT graph_id, src AS a, dst AS b FROM chain UNION SELECT graph_id, dst, src FROM chain),
x1 AS (SELECT x.graph_id, x.node_id, any_value(x.l) || '(' || coalesce(string_agg(y.l, ',' ORDER BY y.l), '') || ')' AS l FROM x0 x LEFT JOIN ar ON ar.graph_id = x.graph_id AND ar.a = x.node_id LEFT JOIN x0 y ON y.graph_id = ar.graph_id AND y.node_id = ar.b GROUP BY ALL),
x2 AS (SELECT x.graph_id, x.node_id, any_value(x.l) || '(' || coalesce(string_agg(y.l, ',' ORDER BY y.l), '') || ')' AS l FROM x1 x LEFT JOIN ar ON ar.graph_id = x.graph_id AND ar.a = x.node_id LEFT JOIN x1 y ON y.graph_id = ar.graph_id AND y.node_id = ar.b GROUP BY ALL),
w AS (SELECT graph_id, l, count(*) AS n FROM (SELECT graph_id, l || '0' AS l FROM x0 UNION ALL SELECT graph_id, l || '1' FROM x1 UNION ALL SELECT graph_id, l || '2' FROM x2) GROUP BY ALL)"""


@query(f"WITH {_WL} SELECT n_graphs, n, count(*) AS n_labels FROM (SELECT l, count(*) AS n_graphs, sum(n)::BIGINT AS n FROM w GROUP BY l) GROUP BY ALL")
def wl_label_classes(spark, sf_dir):
    """How many refined labels have so many graphs and nodes; the SQL spells labels out."""
    n = _nodes(spark, sf_dir)
    per = space.wl_features(n, chain_edges(n), 2).groupBy("label").agg(F.count(F.lit(1)).alias("n_graphs"), F.sum("n").alias("n"))
    return per.groupBy("n_graphs", "n").agg(F.count(F.lit(1)).alias("n_labels"))


# --- variants, sinks and what drawings need


@query("""WITH g AS (SELECT s_suppkey AS id, list_transform(range(12), lambda i: (i % (1 + s_suppkey % 12))::INT) AS hubs FROM supplier), m AS (SELECT id, hubs, unnest(range(4096)) AS b FROM g)
SELECT id, count(DISTINCT list_sort(list_filter(hubs, lambda x, i: (b >> (i - 1)) & 1 = 1))) AS n_variants FROM m GROUP BY id""")
def many_port_variants(spark, sf_dir):
    """Groups of twelve ports on one to twelve atoms, and in how many ways their ports can be used."""
    k = F.col("s_suppkey")
    g = table(spark, sf_dir, "supplier").select(k.cast("string").alias("type"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (i % (1 + k % 12)).cast("int")).alias("hubs"))
    return fragment.variants_of(g).groupBy(F.col("type").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n_variants"))


@query("""WITH u AS (SELECT [coalesce(l_discount, 0), l_tax, 0] AS v FROM lineitem), n AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u WHERE list_dot_product(v, v) > 0),
t AS (SELECT sum(v[1]) AS a, sum(v[2]) AS b, count(*)::DOUBLE AS n FROM n) SELECT round(1 - (a * a + b * b - n) / (n * (n - 1)), 6) AS diversity FROM t""")
def diversity_with_zero_vectors(spark, sf_dir):
    """Of lines as (discount, tax, 0); lines with neither have no direction."""
    rows = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("id"), F.array("l_discount", "l_tax", F.lit(0.0)).alias("v"))
    return space.diversity(rows).select(F.round("diversity", 6).alias("diversity"))


@query("""WITH c AS (SELECT user_id, CASE WHEN user_id % 3 > 0 THEN event_type END AS k FROM events) SELECT DISTINCT k FROM c WHERE user_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.user_id % 2 = 0 AND d.k IS NOT DISTINCT FROM c.k)""")
def dedup_sink_null_keys(spark, sf_dir):
    """A sink that has taken even users' types, nulls among them, and what it appends of those of odd users."""
    c = table(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("k"))
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    text.append_new(c.filter("user_id % 2 = 0").select("k"), path, "k")
    return text.append_new(c.filter("user_id % 2 = 1").select("k"), path, "k")


@query(f"""WITH {_NODES}, p AS (SELECT graph_id, node_id, n_ports, unnest(range(n_ports + 1))::INT AS k FROM nodes)
SELECT graph_id, node_id, k, round(node_id + 2.0 * cos(-k * 2 * pi() / n_ports), 6) + 0.0 AS x, round(2.0 * sin(-k * 2 * pi() / n_ports), 6) + 0.0 AS y FROM p""")
def port_places(spark, sf_dir):
    """Places of each node's ports, nodes in a row."""
    n = _nodes(spark, sf_dir).withColumn("p", drawing.port_places(F.col("node_id").cast("double"), F.lit(0.0), F.col("n_ports"), F.lit(2.0)))
    return n.select("graph_id", "node_id", F.posexplode("p").alias("k", "p")).select("graph_id", "node_id", "k", (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"))


@query(f"""WITH {_NODES} SELECT graph_id, edge_seq, CASE WHEN src % 3 > dst % 3 THEN dst_port || '  -  ' || src_port ELSE src_port || '  -  ' || dst_port END AS label FROM chain""")
def edge_labels(spark, sf_dir):
    """Labels of edges whose nodes stand at node_id mod 3."""
    return chain_edges(_nodes(spark, sf_dir)).select("graph_id", "edge_seq", drawing.edge_label(F.col("src_port"), F.col("dst_port"), F.col("src") % 3, F.col("dst") % 3).alias("label"))


@query(f"""WITH {_NODES}, n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), e AS (SELECT graph_id, count(*) AS n FROM chain GROUP BY 1) SELECT n.graph_id, n.n AS n_nodes, coalesce(e.n, 0) AS n_edges FROM n LEFT JOIN e USING (graph_id)""")
def viewer_elements(spark, sf_dir):
    """Elements of each graph, read back from their JSON and counted."""
    n = _nodes(spark, sf_dir)
    e = F.from_json("elements", "array<struct<data:struct<id:string,source:string>,position:struct<x:int,y:int>>>")
    found = drawing.elements(n, chain_edges(n)).select("graph_id", e.alias("e"))
    return found.select("graph_id", F.size(F.filter("e", lambda x: x["position"].isNotNull())).cast("bigint").alias("n_nodes"), F.size(F.filter("e", lambda x: x["data"]["source"].isNotNull())).cast("bigint").alias("n_edges"))
