"""Analysis of whole spaces of graphs: frequencies, similarity networks, centralities."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portloom.functions.arrow import mapped
from portloom.model import endpoints
from portloom.storage import checkpointed

#: Rows of a block in the all-pairs similarity; a pair of blocks is one task's work.
BLOCK_ROWS = 2048


def histogram(nodes: DataFrame) -> DataFrame:
    """Nodes of each type in each graph."""
    return nodes.groupBy("graph_id", "type").agg(F.count(F.lit(1)).alias("n"))


def compositions(nodes: DataFrame) -> DataFrame:
    """Graphs by composition: a text of sorted type:count, and how many graphs have it."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws(":", x["type"], x["n"]))
    per = histogram(nodes).groupBy("graph_id").agg(F.array_join(parts, " ").alias("composition"))
    return per.groupBy("composition").agg(F.count(F.lit(1)).alias("n_graphs"))


def frequencies(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def correlations(counts: DataFrame, prop: DataFrame, types: Sequence[str]) -> DataFrame:
    """Pearson correlation of each type's count with a property; counts (id, type, n), prop (id, value)."""
    wide = prop.join(counts.groupBy("id").pivot("type", list(types)).agg(F.sum("n")), "id", "left").fillna(0, list(types))
    row = wide.agg(*[F.corr(t, "value").alias(t) for t in types])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("r")) for t in types])))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of unit vectors, row by row."""
    return a @ b.T


def _pairs(key: tuple, pdf: pd.DataFrame, cutoff: float, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if key[0] == key[1]:
        b = a
    if not len(a) or not len(b):
        return pd.DataFrame({"i": [], "j": [], "weight": []})
    sim = kernel(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()))
    i, j = np.nonzero(sim > cutoff)
    x, y, w = a["id"].to_numpy()[i], b["id"].to_numpy()[j], sim[i, j]
    keep = x < y if key[0] == key[1] else np.ones(len(x), bool)
    return pd.DataFrame({"i": np.minimum(x, y)[keep], "j": np.maximum(x, y)[keep], "weight": w[keep]})


def similarity_edges(vectors: DataFrame, cutoff: float, rows: int | None = None, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine) -> DataFrame:
    """(i, j, weight) for pairs i < j with a similarity above ``cutoff``; vectors: (id, v).

    ``kernel`` gives the similarities of two blocks of rows, which reach it with
    length one; without it they are cosines. Vectors of length zero have no pairs.

    All pairs are asked for, so rows are dealt into blocks and every pair of
    blocks is one matrix product; only pairs above the cutoff leave a task.
    """
    n = rows if rows is not None else vectors.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    v = F.transform("v", lambda x: x.cast("double"))
    unit = vectors.select("id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    unit = unit.select("id", F.transform("v", lambda x: x / F.when(F.col("norm") > 0, F.col("norm"))).alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).filter(F.col("v")[0].isNotNull())
    every = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("a"), F.greatest("block", k).alias("b"), F.when(F.col("block") <= k, 0).otherwise(1).alias("side")))
    dealt = unit.select("id", "v", F.inline(every))
    return dealt.groupBy("a", "b").applyInPandas(lambda key, pdf: _pairs(key, pdf, cutoff, kernel), "i bigint, j bigint, weight double")


def edge_density(edges: DataFrame, n: int, cutoffs: Sequence[float]) -> DataFrame:
    """Share of pairs above each cutoff; edges above the least cutoff are enough. Counted in one pass."""
    counts = edges.agg(*[F.count(F.when(F.col("weight") > c, 1)).alias(f"c{k}") for k, c in enumerate(cutoffs)])
    pairs = n * (n - 1) / 2
    return counts.select(F.inline(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), (F.col(f"c{k}") / F.lit(float(pairs))).alias("density")) for k, c in enumerate(cutoffs)])))


def diversity(vectors: DataFrame) -> DataFrame:
    """Mean of 1 - cosine over all pairs, from the sum of unit vectors: the pairs' cosines add up to (|sum|^2 - n) / 2.

    Vectors of length zero have no direction and are left out; null if fewer than two are left.
    """
    v = vectors.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    parts = v.filter("norm > 0").select(F.posexplode("v").alias("k", "x"), "norm").groupBy("k").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count(F.lit(1)).alias("n"))
    t = parts.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    pairs = F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
    return t.select((1 - (F.col("ss") - F.col("n")) / pairs).alias("diversity"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select(F.col("j").alias("a"), F.col("i").alias("b")))


def degree_centrality(ids: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    d = both_ways(edges).groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    return ids.join(d, ids["id"] == d["a"], "left").select("id", (F.coalesce("d", F.lit(0)) / F.lit(float(max(n - 1, 1)))).alias("centrality"))


def modularity(edges: DataFrame, part: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """(cutoff, modularity) of a partition (id, community), over the edges above each cutoff; a cutoff without edges has no row."""
    p1, p2 = part.select(F.col("id").alias("i"), F.col("community").alias("ci")), part.select(F.col("id").alias("j"), F.col("community").alias("cj"))
    above = F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: F.col("weight") > c)
    e = edges.withColumn("cutoff", F.explode(above)).join(p1, "i").join(p2, "j")
    # Communities of each cutoff are few against edges; ends and inner edges are counted in one pass.
    ends = F.inline(F.array(F.struct(F.col("ci").alias("c"), F.when(F.col("ci") == F.col("cj"), 1).otherwise(0).alias("inner")), F.struct(F.col("cj").alias("c"), F.lit(0).alias("inner"))))
    per = e.select("cutoff", ends).groupBy("cutoff", "c").agg(F.count(F.lit(1)).alias("d"), F.sum("inner").alias("l"))
    sums = per.groupBy("cutoff").agg(F.sum("l").alias("l"), F.sum("d").alias("d2"), F.sum(F.pow(F.col("d").cast("double"), F.lit(2))).alias("dd"))
    return sums.select("cutoff", (2 * F.col("l") / F.col("d2") - F.col("dd") / F.pow(F.col("d2").cast("double"), F.lit(2))).alias("modularity"))


#: Edges packed into one row for a kernel that holds a whole graph, and arcs sorted at a time there.
PACKED_EDGES, SORTED_ARCS = 1 << 19, 1 << 23


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (g, i, j) as rows (g, i, j, a, b): the different ends as 64-bit ids, and each edge's places among them, in two bytes where they fit. Loops go."""

    def codes(x: np.ndarray) -> tuple[bytes, bytes]:
        ids, at = np.unique(x, return_inverse=True)
        return ids.astype(np.int64).tobytes(), at.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes()

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, own in pa.Table.from_batches(held).to_pandas().groupby("g", sort=False, dropna=False):
            own = own[own["i"] != own["j"]]
            if len(own):
                (i, a), (j, b) = codes(own["i"].to_numpy()), codes(own["j"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(g) else g], pa.string()), *[pa.array([x], pa.binary()) for x in (i, j, a, b)]], ["g", "i", "j", "a", "b"])

    held, rows = [], 0
    for x in batches:
        held.append(x)
        rows += x.num_rows
        if rows >= PACKED_EDGES:
            yield from out(held)
            held, rows = [], 0
    if rows:
        yield from out(held)


def _read_packed(rows: Iterator[Sequence[bytes]]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The nodes of packed edges, sorted, and parts (i, j, a, b): places of the parts' ends among the nodes, and each edge's places among these."""
    parts = []
    for i, j, a, b in rows:
        i, j = np.frombuffer(i, np.int64), np.frombuffer(j, np.int64)
        parts.append([i, j, *[np.frombuffer(x, np.uint16 if len(ids) <= 1 << 16 else np.uint32) for x, ids in ((a, i), (b, j))]])
    nodes = np.unique(np.concatenate([x for p in parts for x in p[:2]])) if parts else np.zeros(0, np.int64)
    for p in parts:
        p[:2] = (np.searchsorted(nodes, x).astype(np.int32) for x in p[:2])
    return nodes, parts


def _neighbours(rows: Iterator[Sequence[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes of a graph, sorted, and the places of each node's different neighbours, sorted; rows (i, j, a, b) as packed."""
    nodes, parts = _read_packed(rows)
    n, arcs = len(nodes), 2 * sum(len(p[2]) for p in parts)
    near: list[np.ndarray] = []
    step = max(1, n // max(1, -(-arcs // SORTED_ARCS)))
    for lo in range(0, n, step):
        hi, found = min(lo + step, n), []
        for i, j, a, b in parts:
            for ids, x, other, y in ((i, a, j, b), (j, b, i, a)):
                # Ends outside the range are sorted out by their few different ids.
                at = np.flatnonzero(((ids >= lo) & (ids < hi))[x])
                found.append((ids[x[at]] - lo).astype(np.int64) * n + other[y[at]])
        key = np.unique(np.concatenate(found))
        ends = np.searchsorted(key, np.arange(1, hi - lo) * n)
        near += [x.copy() for x in np.split((key % n).astype(np.int32), ends)]
    return nodes, near


def _merged(near: list[np.ndarray]) -> np.ndarray:
    """Community of each node, named by its least member: the two communities whose union raises modularity most become one, until none raises it. Ties go to the lesser names.

    ``near`` has the sorted neighbours of each node and is used up. Rows name
    communities as they were when the row was last read, and are brought up to
    date when read again. Each community knows its best partner; where that was
    merged for the worse, the old gain stays as an upper bound until the
    community comes out on top.
    """
    n = len(near)
    rows, counts = near, [None] * n
    degree = np.array([len(x) for x in rows], np.int64)
    ends = int(degree.sum())
    name, members = np.arange(n, dtype=np.int32), [np.array([v], np.int32) for v in range(n)]
    best, partner, stale = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)

    def read(c: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of a community and the gains of a union with each; its best partner is noted."""
        at = name[rows[c]]
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else order
        k = np.diff(np.append(first, len(at))) if counts[c] is None else np.add.reduceat(counts[c][order].astype(np.int64), first) if len(at) else first
        at = at[first]
        other = at != c
        at, k = at[other], k[other]
        rows[c], counts[c] = at, k.astype(np.min_scalar_type(k.max())) if len(k) else k
        gain = k * ends - degree[c] * degree[at]
        top = int(gain.argmax()) if len(gain) else -1
        best[c], partner[c], stale[c] = (gain[top], at[top], False) if len(gain) else (0, -1, False)
        return at, gain

    for c in range(n):
        top = int(degree[rows[c]].argmin())
        partner[c], best[c] = rows[c][top], ends - degree[c] * degree[rows[c][top]]
    while n:
        a = int(best.argmax())
        if best[a] <= 0:
            break
        if stale[a]:
            read(a)
            continue
        b = int(partner[a])
        name[members[b]] = a
        members[a] = np.concatenate([members[a], members[b]])
        degree[a] += degree[b]
        counts[a] = np.concatenate([np.ones(len(rows[x]), np.uint8) if counts[x] is None else counts[x] for x in (a, b)])
        rows[a] = np.concatenate([rows[a], rows[b]])
        rows[b] = counts[b] = members[b] = None
        best[b], stale[b] = 0, False
        at, gain = read(a)
        old, was, open_ = best[at], partner[at], stale[at]
        touched = (was == a) | (was == b)
        exact = (gain > old) | (~open_ & (gain == old) & (touched | (was > a)))
        best[at[exact]], partner[at[exact]], stale[at[exact]] = gain[exact], a, False
        stale[at[~exact & touched]] = True
    return name


def communities(edges: DataFrame) -> DataFrame:
    """(g, id, community) by greedy modularity, for edges (g, i, j); a graph is worked in one kernel, which gets its edges packed. Ties go to the lesser nodes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = []

        def rows() -> Iterator[Sequence[bytes]]:
            for x in batches:
                g.append(x.column(0)[0].as_py())
                yield from zip(*(x.column(k).to_pylist() for k in range(1, 5)), strict=True)

        nodes, near = _neighbours(rows())
        yield pa.RecordBatch.from_arrays([pa.array([g[0]] * len(nodes), pa.string()), pa.array(nodes), pa.array(nodes[_merged(near)])], ["g", "id", "community"])

    packed = edges.select("g", F.col("i").cast("bigint"), F.col("j").cast("bigint")).mapInArrow(_packed, "g string, i binary, j binary, a binary, b binary")
    return packed.groupBy("g").applyInArrow(kernel, "g string, id bigint, community bigint")


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that can be reached. Labels take their neighbours' least, then their label's label, until none changes."""
    arcs = checkpointed(both_ways(edges).distinct())
    label = checkpointed(ids.select("id", F.col("id").alias("component")))
    while True:
        near = arcs.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        step = label.join(near, "id", "left").select("id", "component", F.least("component", "least").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("far"))
        after = checkpointed(step.join(jump, "low").select("id", F.least("low", "far").alias("new"), "component"))
        changed = after.filter("new <> component").limit(1).count()
        label = after.select("id", F.col("new").alias("component"))
        if not changed:
            return label


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once, i < j < k: wedges are made at the end of least degree, so hubs make few."""
    deg = both_ways(edges).groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    e = edges.join(deg.select(F.col("a").alias("i"), F.col("d").alias("di")), "i").join(deg.select(F.col("a").alias("j"), F.col("d").alias("dj")), "j")
    low = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j")))
    out = e.select(F.when(low, F.col("i")).otherwise(F.col("j")).alias("lo"), F.when(low, F.col("j")).otherwise(F.col("i")).alias("hi"))
    wedge = out.select("lo", F.col("hi").alias("x")).join(out.select("lo", F.col("hi").alias("y")), "lo").filter("x < y")
    closed = wedge.join(edges.select(F.col("i").alias("x"), F.col("j").alias("y")), ["x", "y"])
    s = F.array_sort(F.array("lo", "x", "y"))
    return closed.select(s[0].alias("i"), s[1].alias("j"), s[2].alias("k"))


def _ego(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Edges (x, y) among the sorted neighbours of a node: how many they are, and the sum of the neighbours' clustering in the small graph."""
    d = len(near)
    x, y = np.searchsorted(near, x), np.searchsorted(near, y)
    x, y = np.divmod(np.unique(np.minimum(x, y) * d + np.maximum(x, y)), d)
    bits = np.zeros((d, -(-d // 64)), np.uint64)
    for u, v in ((x, y), (y, x)):
        np.bitwise_or.at(bits, (u, v >> 6), np.uint64(1) << (v & 63).astype(np.uint64))
    t = np.bincount(x, minlength=d) + np.bincount(y, minlength=d)
    # Neighbours that the ends of each edge share, seen from both ends, are the edges among what an end is joined to, twice.
    shared = np.zeros(len(x))
    for at in range(0, len(x), EGO_EDGES):
        part = slice(at, at + EGO_EDGES)
        shared[part] = np.bitwise_count(bits[x[part]] & bits[y[part]]).sum(axis=1)
    q = (np.bincount(x, shared, d) + np.bincount(y, shared, d)) / 2
    t, q = t[t > 0], q[t > 0]
    return len(x), float((2 * (t + q) / ((t + 1.0) * t)).sum())


def _egos(parts: list[list[np.ndarray]], n: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, float]]:
    """(place, d, t, c) of the nodes at lo .. hi - 1: a bit for each of them says of every node whether it is a neighbour, and edges whose ends share bits are edges of their small graphs. A range with more than EGO_HELD of these is worked in halves."""
    m = -(-(hi - lo) // 64)
    bits, own = np.zeros((n, m), np.uint64), []
    for i, j, a, b in parts:
        for ids, x, other, y in ((i, a, j, b), (j, b, i, a)):
            at = np.flatnonzero(((ids >= lo) & (ids < hi))[x])
            own.append((ids[x[at]] - lo).astype(np.int64) * n + other[y[at]])
    who, near = np.divmod(np.unique(np.concatenate(own)), n)
    np.bitwise_or.at(bits, (near, who >> 6), np.uint64(1) << (who & 63).astype(np.uint64))
    centre, ends, held = [], [], 0
    for i, j, a, b in parts:
        for at in range(0, len(a), EGO_EDGES):
            x, y = i[a[at : at + EGO_EDGES]], j[b[at : at + EGO_EDGES]]
            both = bits[x]
            both &= bits[y]
            e = np.flatnonzero(both)
            v, e, word = both.reshape(-1)[e], e // m, e % m
            while len(v):
                low = v & (~v + np.uint64(1))
                centre.append((word * 64 + np.bitwise_count(low - np.uint64(1))).astype(np.uint16))
                ends.append(np.stack([x[e], y[e]]))
                held += len(e)
                if held > EGO_HELD and hi - lo > 1:
                    del centre, ends, bits, both, own
                    middle = (lo + hi) // 2
                    yield from _egos(parts, n, lo, middle)
                    yield from _egos(parts, n, middle, hi)
                    return
                v = v ^ low
                left = v != 0
                v, e, word = v[left], e[left], word[left]
    centre = np.concatenate([np.zeros(0, np.uint16), *centre])
    order = np.argsort(centre, kind="stable")
    x, y = np.concatenate([np.zeros((2, 0), np.int32), *ends], axis=1)[:, order]
    places = np.arange(hi - lo + 1)
    first, edge = np.searchsorted(who, places), np.searchsorted(centre[order], places)
    for k in range(hi - lo):
        yield lo + k, int(first[k + 1] - first[k]), *_ego(near[first[k] : first[k + 1]], x[edge[k] : edge[k + 1]], y[edge[k] : edge[k + 1]])


#: Nodes whose small graphs are worked together, how many of a task, edges looked at a time, and edges of small graphs held at a time where there are several.
EGO_NODES, EGO_TASK, EGO_EDGES, EGO_HELD = 512, 2048, 1 << 16, 1 << 22


def ego_counts(edges: DataFrame, n: int) -> DataFrame:
    """(id, d, t, c) of each node with edges (i, j): neighbours, edges between them, and the sum of their clustering in the node's small graph.

    Wedges and triangles are never rows: each task holds all edges, packed to
    some four bytes each, and works the small graphs of its share of about ``n``
    nodes. Repeated edges, either way, count once; loops don't count.
    """
    packed = checkpointed(edges.select(F.lit("").alias("g"), F.col("i").cast("bigint"), F.col("j").cast("bigint")).mapInArrow(_packed, "g string, i binary, j binary, a binary, b binary"))
    tasks = max(1, -(-n // EGO_TASK))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = []

        def rows() -> Iterator[Sequence[bytes]]:
            for x in batches:
                mine.extend(x.column(4).to_pylist())
                yield from zip(*(x.column(k).to_pylist() for k in range(4)), strict=True)

        nodes, parts = _read_packed(rows())
        if not parts:
            return
        begin, end = (len(nodes) * k // tasks for k in (mine[0], mine[0] + 1))
        for lo in range(begin, end, EGO_NODES):
            k, d, t, c = zip(*_egos(parts, len(nodes), lo, min(lo + EGO_NODES, end)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[list(k)]), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(c, pa.float64())], ["id", "d", "t", "c"])

    share = edges.sparkSession.range(0, tasks, 1, tasks).select(F.col("id").alias("task"))
    # Every task reads the packed rows itself: no shuffle, no broadcast.
    return packed.drop("g").coalesce(1).hint("shuffle_replicate_nl").crossJoin(share).mapInArrow(kernel, "id bigint, d bigint, t bigint, c double")


def ego_networks(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Properties of each node with its neighbours as a graph of its own.

    Every two of its nodes are one or two steps apart, so the mean distance is
    2 - density, the diameter 1 if all are neighbours and else 2, the radius 1.
    ``clustering`` is the node's own, ``average_clustering`` the mean over all
    nodes of the small graph: a neighbour that shares t triangles and q
    4-cliques with the centre has t + 1 neighbours there with t + q edges
    between them. A node without neighbours has 0 everywhere.
    """
    e = ids.join(ego_counts(edges, ids.count()), "id", "left").fillna(0, ["d", "t", "c"])
    size, links = F.col("d") + 1, F.col("d") + F.col("t")
    density = F.when(F.col("d") > 0, 2 * links / (size * F.col("d"))).otherwise(F.lit(0.0))
    own = F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0))
    return e.select("id", size.alias("n_nodes"), links.alias("n_edges"), density.alias("density"), F.when(F.col("d") > 0, 2 - density).otherwise(F.lit(0.0)).alias("mean_distance"), own.alias("clustering"), ((own + F.col("c")) / size).alias("average_clustering"), F.when(F.col("d") == 0, 0).when(density >= 1, 1).otherwise(2).alias("diameter"), F.when(F.col("d") == 0, 0).otherwise(1).alias("radius"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, hops): least number of steps, by rounds of frontier joins until none is new; each round is checkpointed."""
    arcs = both_ways(edges)
    seen = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"))
    front, k = seen, 0
    while True:
        k += 1
        step = front.select("source", F.col("id").alias("a")).join(arcs, "a").select("source", F.col("b").alias("id")).distinct()
        front = checkpointed(step.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(k)))
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    return seen


def closeness(edges: DataFrame, sources: DataFrame, n: int, blocks: int = 1) -> DataFrame:
    """Closeness by reach: (r - 1) / sum of distances * (r - 1) / (n - 1), with r nodes reached; sources are taken in ``blocks``, one after another."""
    parts = []
    for k in range(blocks):
        some = sources.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else sources
        d = distances(edges, some).groupBy("source").agg(F.sum("hops").alias("s"), (F.count(F.lit(1)) - 1).alias("r"))
        parts.append(checkpointed(d) if blocks > 1 else d)
    d = functools.reduce(DataFrame.unionByName, parts)
    return d.select(F.col("source").alias("id"), F.when(F.col("s") > 0, F.col("r") / F.col("s") * F.col("r") / F.lit(float(max(n - 1, 1)))).otherwise(F.lit(0.0)).alias("closeness"))


def shortest_paths(edges: DataFrame, source: int, target: int) -> DataFrame:
    """All paths of least weight from source to target, as arrays; edges (i, j, weight) with weights above 0.

    Distances are relaxed until none changes, with no bound on steps; paths then
    grow along the arcs that keep to them.
    """
    arcs = checkpointed(edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "weight").union(edges.select("j", "i", "weight")))
    if arcs.filter("weight <= 0").limit(1).count():
        raise ValueError("weights must be above 0")
    d = front = edges.sparkSession.createDataFrame([(source, 0.0)], "id bigint, d double")
    while front.limit(1).count():
        step = front.withColumnRenamed("id", "a").join(arcs, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("d") + F.col("weight")).alias("e"))
        front = checkpointed(step.join(d, "id", "left").filter("d IS NULL OR e < d").select("id", F.col("e").alias("d")))
        d = checkpointed(d.unionByName(front).groupBy("id").agg(F.min("d").alias("d")))
    # Sums in another order may differ in the last digits.
    near, far = d.select(F.col("id").alias("a"), F.col("d").alias("da")), d.select(F.col("id").alias("b"), F.col("d").alias("db"))
    tight = checkpointed(arcs.join(near, "a").join(far, "b").filter("db > da AND abs(da + weight - db) <= 1e-12 * greatest(1.0, db)").select("a", "b").distinct())
    paths = edges.sparkSession.createDataFrame([(target, [target])], "a bigint, path array<bigint>").join(near.select("a"), "a", "left_semi")
    done = paths.filter(F.col("a") == source)
    while paths.limit(1).count():
        paths = checkpointed(paths.withColumnRenamed("a", "b").join(tight, "b").select("a", F.concat(F.array("a"), "path").alias("path")))
        done = done.unionByName(paths.filter(F.col("a") == source))
    return done.select("path")


def wl_features(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Counts of refined node labels (graph_id, label, n): each round a label becomes the hash of itself and its sorted neighbours'."""
    arcs = endpoints(edges).select("graph_id", "node_id", "other").distinct()
    label = nodes.select("graph_id", "node_id", F.xxhash64("type").alias("label"))
    every = label
    for _ in range(rounds):
        around = arcs.join(label.select("graph_id", F.col("node_id").alias("other"), F.col("label").alias("near")), ["graph_id", "other"]).groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_list("near")).alias("near"))
        label = label.join(around, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.xxhash64("label", F.coalesce("near", F.array().cast("array<bigint>"))).alias("label"))
        every = every.unionByName(label)
    return every.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n"))


def wl_kernel(nodes: DataFrame, edges: DataFrame, rounds: int, cutoff: float = 0.0) -> DataFrame:
    """(i, j, weight), i < j: cosine of two graphs' counts of refined labels, above ``cutoff``. Graphs that share no label have no row; all others are pairs."""
    f = checkpointed(wl_features(nodes, edges, rounds))
    norm = f.groupBy("graph_id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    f = checkpointed(f.join(norm, "graph_id").select("graph_id", "label", (F.col("n") / F.col("norm")).alias("x")))
    pairs = f.select(F.col("graph_id").alias("i"), "label", F.col("x").alias("xi")).join(f.select(F.col("graph_id").alias("j"), "label", F.col("x").alias("xj")), "label").filter("i < j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("weight")).filter(F.col("weight") > cutoff)


def betweenness(edges: DataFrame, blocks: int = 1) -> DataFrame:
    """Betweenness of each node of each graph: edges (g, i, j), Brandes' sums.

    ``blocks`` kernels share a graph's sources and each holds all its edges; sums of the parts are the whole.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for i, j in zip(pdf["i"], pdf["j"], strict=True):
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        score = dict.fromkeys(near, 0.0)
        mine = pdf["block"].iloc[0]
        for s in (v for v in near if v % blocks == mine):
            order, before, paths, dist = [s], {s: []}, {s: 1.0}, {s: 0}
            for x in order:
                for y in near[x]:
                    if y not in dist:
                        dist[y], paths[y], before[y] = dist[x] + 1, 0.0, []
                        order.append(y)
                    if dist[y] == dist[x] + 1:
                        paths[y] += paths[x]
                        before[y].append(x)
            share = dict.fromkeys(order, 0.0)
            for y in reversed(order):
                for x in before[y]:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
                if y != s:
                    score[y] += share[y] / 2
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(score), "id": list(score), "betweenness": list(score.values())})

    dealt = edges.select("g", "i", "j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    parts = dealt.groupBy("g", "block").applyInPandas(kernel, "g string, id bigint, betweenness double")
    return parts if blocks == 1 else parts.groupBy("g", "id").agg(F.sum("betweenness").alias("betweenness"))


def eigenvector_centrality(edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, centrality): power iteration over A + I, normalised and checkpointed each round, until the sum of changes is below n * ``tolerance``."""
    arcs = checkpointed(both_ways(edges))
    x = arcs.select(F.col("a").alias("id")).distinct()
    n = x.count()
    x = checkpointed(x.withColumn("x", F.lit(1.0 / max(n, 1))))
    change = float("inf")
    while n and change >= n * tolerance:
        near = arcs.join(x.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("x").alias("near"))
        y = checkpointed(x.join(near, "id").select("id", "x", (F.col("x") + F.col("near")).alias("y")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("n")).first()["n"]
        change = y.agg(F.sum(F.abs(F.col("y") / norm - F.col("x"))).alias("d")).first()["d"]
        x = y.select("id", (F.col("y") / F.lit(norm)).alias("x"))
    return x.withColumnRenamed("x", "centrality")


def radius_edges(points: DataFrame, distance: float, tolerance: float, relative: float = 0.0) -> DataFrame:
    """(i, j), i < j, for points (id, x, y) or (id, x, y, z) whose distance is ``distance`` within ``tolerance`` + ``relative`` * ``distance``: cells of that size meet their neighbours only."""
    axes = [c for c in ("x", "y", "z") if c in points.columns]
    most = tolerance + relative * abs(distance)
    cell = points.select("id", *axes, *[F.floor(F.col(c) / (distance + most)).alias(f"c{c}") for c in axes])
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{c}") for c, s in zip(axes, step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=len(axes))])
    near = cell.withColumn("s", F.explode(steps))
    a = near.select(F.col("id").alias("i"), *[F.col(c).alias(f"{c}1") for c in axes], *[(F.col(f"c{c}") + F.col(f"s.d{c}")).alias(f"c{c}") for c in axes])
    pairs = a.join(cell.withColumnRenamed("id", "j"), [f"c{c}" for c in axes]).filter("i < j")
    square = functools.reduce(lambda p, q: p + q, [F.pow(F.col(f"{c}1") - F.col(c), F.lit(2)) for c in axes])
    return pairs.filter(F.abs(F.sqrt(square) - distance) <= most).select("i", "j")


def signed_permutations(rows: DataFrame) -> DataFrame:
    """(id, x, y, z): the different points whose coordinates are three of ``values`` in any order and with any signs; rows (id, values) with three values at least."""

    def kernel(values: list[float]) -> list[tuple]:
        signed = [[v * s for v, s in zip(values, signs, strict=True)] for signs in itertools.product((1, -1), repeat=len(values))]
        return sorted({tuple(v + 0.0 for v in p) for own in signed for p in itertools.permutations(own, 3)})

    return mapped(rows, ["id"], ["values"], kernel, "x double, y double, z double")


def projected(vectors: DataFrame, k: int = 2) -> DataFrame:
    """Principal components (id, components) of vectors (id, v)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    return PCA(k=k, inputCol="f", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("components"))
