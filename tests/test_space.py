"""Analysis of graph spaces against brute force on small graphs."""

import itertools
import random
from collections import Counter, deque

import numpy as np

from portloom.operators import space


def test_closeness_of_all_nodes_however_far(spark):
    pairs = [(i, i + 1) for i in range(12)] + [(20, 21), (3, 30)]
    ids = sorted({x for p in pairs for x in p} | {40})
    near = {x: [b if a == x else a for a, b in pairs if x in (a, b)] for x in ids}
    want = {}
    for s in ids:
        dist, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        r, total = len(dist) - 1, sum(dist.values())
        want[s] = r / total * r / (len(ids) - 1) if total else 0.0
    got = space.closeness(spark.createDataFrame(pairs, "i bigint, j bigint"), spark.createDataFrame([(x,) for x in ids], "id bigint"), len(ids), blocks=2).collect()
    assert len(got) == len(ids) and all(abs(r["closeness"] - want[r["id"]]) < 1e-12 for r in got)


def test_eigenvector_centrality_converges(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    a = np.zeros((7, 7))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r["id"]: r["centrality"] for r in space.eigenvector_centrality(spark.createDataFrame(pairs, "i bigint, j bigint")).collect()}
    assert max(abs(got[i] - want[i]) for i in range(7)) < 1e-4


def test_weighted_paths_of_many_steps(spark):
    rnd = random.Random(3)
    arcs = {(i, i + 1): 1.0 for i in range(7)} | {(0, 7): 50.0, (0, 4): 4.0, (2, 6): 4.0, (1, 9): 1.0}
    for i, j in itertools.combinations(range(9), 2):
        if rnd.random() < 0.2:
            arcs.setdefault((i, j), float(rnd.randrange(6, 12)))
    weight = arcs | {(j, i): w for (i, j), w in arcs.items()}
    found = []

    def walk(path, total):
        if path[-1] == 7:
            found.append((total, tuple(path)))
            return
        for (a, b), w in weight.items():
            if a == path[-1] and b not in path:
                walk([*path, b], total + w)

    walk([0], 0.0)
    best = min(found)[0]
    want = sorted(p for t, p in found if t == best)
    assert len(want) > 1 and max(map(len, want)) == 8
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in arcs.items()] + [(20, 21, 1.0)], "i bigint, j bigint, weight double")
    assert sorted(tuple(r["path"]) for r in space.shortest_paths(edges, 0, 7).collect()) == want
    assert space.shortest_paths(edges, 0, 21).count() == 0


def test_communities_by_plain_merging(spark):
    rnd = random.Random(5)
    pairs = sorted({(min(a, b), max(a, b)) for g in range(4) for _ in range(22) for a, b in [rnd.sample(range(8 * g, 8 * g + 8), 2)]} | {(7, 8), (15, 16), (23, 24)})

    def quality(part):
        m = len(pairs)
        return sum(sum(i in c and j in c for i, j in pairs) / m - (sum((i in c) + (j in c) for i, j in pairs) / (2 * m)) ** 2 for c in part)

    part = [{v} for v in sorted({x for p in pairs for x in p})]
    while True:
        best = max(((quality([c for c in part if c not in (a, b)] + [a | b]) - quality(part), -min(a), -min(b), a, b) for a, b in itertools.combinations(part, 2) if any((i in a and j in b) or (i in b and j in a) for i, j in pairs)), default=None)
        if best is None or best[0] <= 1e-12:
            break
        part = [c for c in part if c not in best[3:]] + [best[3] | best[4]]
    got = space.communities(spark.createDataFrame([("g", i, j) for i, j in pairs], "g string, i bigint, j bigint")).collect()
    sets = {}
    for r in got:
        sets.setdefault(r["community"], set()).add(r["id"])
    assert abs(quality(list(sets.values())) - quality(part)) < 1e-9 and all(min(s) == c for c, s in sets.items())
    m = space.modularity(spark.createDataFrame([(i, j, 0.5) for i, j in pairs], "i bigint, j bigint, weight double"), spark.createDataFrame([(r["id"], r["community"]) for r in got], "id bigint, community bigint"), [0.1, 0.9]).collect()
    assert len(m) == 1 and abs(m[0]["modularity"] - quality(part)) < 1e-9


def merged_one_by_one(pairs):
    """The definition: every pair of joined communities is looked at before each union."""
    part = {v: v for p in pairs for v in p}
    while True:
        degree, between = Counter(part[v] for p in pairs for v in p), Counter(tuple(sorted((part[i], part[j]))) for i, j in pairs if part[i] != part[j])
        gain, a, b = min(((-(n * 2 * len(pairs) - degree[a] * degree[b]), a, b) for (a, b), n in between.items()), default=(0, 0, 0))
        if gain >= 0:
            return part
        part = {v: a if c == b else c for v, c in part.items()}


def test_communities_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(space, "SORTED_ARCS", 40)
    rnd = random.Random(9)
    rows, want = [], set()
    for g in range(30):
        n = rnd.randrange(3, 26)
        pairs = {tuple(sorted(rnd.sample([7 * v - 40 for v in range(n)], 2))) for _ in range(rnd.randrange(2, 3 * n))}
        want |= {(f"g{g}", v, c) for v, c in merged_one_by_one(sorted(pairs)).items()}
        rows += [(f"g{g}", *(p if rnd.random() < 0.5 else p[::-1])) for p in sorted(pairs) for _ in range(1 + (rnd.random() < 0.2))] + [(f"g{g}", 5000, 5000)]
    got = space.communities(spark.createDataFrame(rows, "g string, i bigint, j bigint").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_communities_need_few_bytes_an_edge():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, m = 3000, 400_000
    i, j = rng.integers(0, n, (2, m))
    keep = (i != j) & ((i % 6 == j % 6) | (rng.random(m) < 0.3))
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * int(keep.sum())), pa.array(i[keep]), pa.array(j[keep])], ["g", "i", "j"])
    rows = [tuple(r.values())[1:] for b in space._packed(iter([batch])) for r in b.to_pylist()]
    assert sum(map(len, rows[0])) < 4.5 * keep.sum()
    tracemalloc.start()
    part = space._merged(space._neighbours(iter(rows))[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 < len(set(part.tolist())) < 100 and peak < 100 * keep.sum()


def test_small_graphs_of_many_blocks(spark, monkeypatch):
    """Several tasks, blocks and slices of edges; repeated edges, loops and lone nodes; and no wedge ever is a row."""
    for name, x in {"EGO_TASK": 40, "EGO_NODES": 17, "EGO_EDGES": 100, "EGO_HELD": 60, "PACKED_EDGES": 150}.items():
        monkeypatch.setattr(space, name, x)
    rnd = random.Random(6)
    pairs = {tuple(sorted(rnd.sample(range(0, 270, 3), 2))) for _ in range(900)} | {(3, 900 + k) for k in range(80)} | {(1000 + a, 1000 + b) for a, b in itertools.combinations(range(5), 2)}
    near = {}
    for i, j in pairs:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)

    def clustering(v, within):
        own = near[v] & within
        return sum(b in near[a] for a, b in itertools.combinations(own, 2)) * 2 / (len(own) * (len(own) - 1)) if len(own) > 1 else 0.0

    rows = [p if rnd.random() < 0.5 else p[::-1] for p in sorted(pairs)] + [(3, 6), (6, 3), (9, 9)]
    pairs |= {(3, 6)}
    near[3].add(6), near[6].add(3)
    ids = sorted({*near, 2000})
    got = {r["id"]: r for r in space.ego_networks(spark.createDataFrame([(v,) for v in ids], "id bigint"), spark.createDataFrame(rows, "i bigint, j bigint").repartition(3)).collect()}
    assert sorted(got) == ids and got[2000]["n_nodes"] == 1 and got[2000]["average_clustering"] == 0
    for v in near:
        group = near[v] | {v}
        n_edges = sum(b in near[a] for a, b in itertools.combinations(group, 2))
        assert (got[v]["n_nodes"], got[v]["n_edges"]) == (len(group), n_edges)
        assert abs(got[v]["average_clustering"] - sum(clustering(x, group) for x in group) / len(group)) < 1e-12
        assert abs(got[v]["clustering"] - clustering(v, group)) < 1e-12 and got[v]["diameter"] == (1 if n_edges * 2 == len(group) * (len(group) - 1) else 2)
    plan = space.ego_networks(spark.createDataFrame([(v,) for v in ids], "id bigint"), spark.createDataFrame(rows, "i bigint, j bigint"))._jdf.queryExecution().toString()
    assert "Aggregate" not in plan


def test_betweenness_in_blocks(spark):
    rnd = random.Random(2)
    pairs = sorted({tuple(sorted(rnd.sample(range(20), 2))) for _ in range(40)})
    e = spark.createDataFrame([("g", i, j) for i, j in pairs], "g string, i bigint, j bigint")
    one, many = ({r["id"]: r["betweenness"] for r in space.betweenness(e, b).collect()} for b in (1, 5))
    assert one.keys() == many.keys() and all(abs(one[v] - many[v]) < 1e-9 for v in one)


def test_kernels_zero_vectors_and_points(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "id bigint, v array<double>")
    assert {(r["i"], r["j"]) for r in space.similarity_edges(v, 0.5).collect()} == {(0, 1)}
    assert {(r["i"], r["j"]) for r in space.similarity_edges(v, -1.5, kernel=lambda a, b: -((a[:, None] - b[None]) ** 2).sum(axis=2)).collect()} == {(0, 1)}
    assert abs(space.diversity(v).first()["diversity"] - 2 / 3) < 1e-12
    assert space.diversity(v.limit(1)).first()["diversity"] is None and space.diversity(v.limit(0)).first()["diversity"] is None
    n = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "y"), ("c", 0, "z")], "graph_id string, node_id int, type string")
    e = spark.createDataFrame([("a", 0, 0, 0, 1, 0), ("b", 0, 0, 0, 1, 0)], "graph_id string, edge_seq int, src int, src_port int, dst int, dst_port int")
    assert [(r["i"], r["j"], round(r["weight"], 9)) for r in space.wl_kernel(n, e, 2).collect()] == [("a", "b", 1.0)]
    p = space.signed_permutations(spark.createDataFrame([(0, [1.0, 2.0, 0.0])], "id bigint, values array<double>"))
    want = {q for s in itertools.product((1, -1), repeat=2) for q in itertools.permutations((s[0] * 1.0, s[1] * 2.0, 0.0))}
    assert {(r["x"], r["y"], r["z"]) for r in p.collect()} == want
    cube = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(itertools.product((0, 1), repeat=3))]
    assert space.radius_edges(spark.createDataFrame(cube, "id bigint, x double, y double, z double"), 1.0, 0.1, 1e-5).count() == 12
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "id bigint, v array<double>")
    c = [r["components"] for r in space.projected(line, 1).orderBy("id").collect()]
    assert all(abs(abs(b[0] - a[0]) - 5**0.5) < 1e-9 for a, b in itertools.pairwise(c))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40)], "i bigint, j bigint")
    got = {r["id"]: r["component"] for r in space.components(spark.createDataFrame([(i,) for i in [*range(31), 40, 50, 99]], "id bigint"), e).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 99: 99}


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from portloom import storage

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(RuntimeError):
        storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
