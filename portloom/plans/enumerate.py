"""Enumeration of port graphs: all of them, or a seeded random sample.

A plan is a lazy DataFrame: skeletons, colourings, constraints, port choices,
canonical keys, distinct. Skeletons of up to five nodes come from the driver,
larger ones from rounds on executors; everything that grows with the alphabet
runs on executors and is folded by one shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portloom.functions.arrow import mapped
from portloom.functions.molecules import Molecule, parse, write
from portloom.functions.symmetry import colorings, connected_skeletons, topology_key
from portloom.storage import checkpointed


@dataclass(frozen=True)
class Group:
    """A node type: a pattern, and for each port the atom of the pattern that it hangs on."""

    type: str
    pattern: str
    hubs: tuple[int, ...]

    def __post_init__(self) -> None:
        if not self.type and not self.pattern:
            raise ValueError("a group needs a type or a pattern")
        m = parse(self.pattern)
        if any(h < 0 or h >= len(m.elements) for h in self.hubs):
            raise ValueError(f"hub outside the pattern {self.pattern!r}")
        if any(self.hubs.count(a) > m.valencies[a] for a in set(self.hubs)):
            raise ValueError(f"more ports than valency in {self.pattern!r}")


def expand(groups: Sequence[Group], edges: Sequence[tuple[int, int, int, int]]) -> Molecule:
    """The atoms of a port graph: patterns one after another, their bonds, then a bond for each edge."""
    m, offset = Molecule(), []
    for g in groups:
        p = parse(g.pattern)
        offset.append(len(m.elements))
        m.bonds += [(u + offset[-1], v + offset[-1], o) for u, v, o in p.bonds]
        m.elements += p.elements
        m.valencies += p.valencies
    for a, pa_, b, pb in edges:
        m.bonds.append((offset[a] + groups[a].hubs[pa_], offset[b] + groups[b].hubs[pb], 1.0))
    return m


def distinct_choices(groups: Sequence[Group], links: Sequence[tuple[int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """All ways to give each end of each link a port of its own, ports on the same atom taken in order only."""
    free = [{h: [i for i, x in enumerate(g.hubs) if x == h] for h in sorted(set(g.hubs))} for g in groups]

    def grow(k: int, used: dict[tuple[int, int], int], out: list) -> Iterator[list]:
        if k == len(links):
            yield out
            return
        a, b = links[k]
        for ha, hb in product(free[a], free[b]):
            ia, ib = used.get((a, ha), 0), used.get((b, hb), 0)
            if ia < len(free[a][ha]) and ib < len(free[b][hb]):
                yield from grow(k + 1, used | {(a, ha): ia + 1, (b, hb): ib + 1}, [*out, (a, free[a][ha][ia], b, free[b][hb][ib])])

    yield from grow(0, {}, [])


def attachments(group: Group, degree: int) -> list[tuple[int, ...]]:
    """Port sets of a size, one for each way to attach that differs: those with the same molecule once marked are the same."""
    out: dict[str, tuple[int, ...]] = {}
    for ports in combinations(range(len(group.hubs)), degree):
        m = parse(group.pattern)
        for p in ports:
            m.elements.append("I")
            m.valencies.append(1)
            m.bonds.append((group.hubs[p], len(m.elements) - 1, 1.0))
        out.setdefault(m.key(), ports)
    return list(out.values())


_GRAPH = "canonical_key string, smiles string, types array<string>, edges array<array<int>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["canonical_key", "smiles", "types", "edges"])


#: Nodes up to which skeletons are searched on the driver; those of five nodes are 21.
DRIVER_NODES = 5


def skeletons(spark: SparkSession, n: int) -> DataFrame:
    """(skeleton, n, edges): connected graphs on n nodes up to isomorphism.

    Beyond DRIVER_NODES each round adds a node with every non-empty set of
    neighbours to the graphs of the round before, on executors, and one graph of
    each key stays.
    """
    rows = [(i, min(n, DRIVER_NODES), [list(e) for e in s]) for i, s in enumerate(connected_skeletons(min(n, DRIVER_NODES)))]
    found = spark.createDataFrame(rows, "skeleton int, n int, edges array<array<int>>")
    for v in range(DRIVER_NODES, n):
        around = F.filter(F.sequence(F.lit(0), F.lit(v - 1)), lambda u: F.col("mask").bitwiseAND(F.element_at(F.array(*[F.lit(1 << u) for u in range(v)]), u + 1)) != 0)
        grown = found.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit((1 << v) - 1)))).select(F.concat("edges", F.transform(around, lambda u: F.array(u, F.lit(v)))).alias("edges"))
        keyed = mapped(grown.repartition(spark.sparkContext.defaultParallelism), ["edges"], ["edges"], lambda edges, m=v + 1: [(topology_key(m, [(a, b, "") for a, b in edges]),)], "key string")
        level = keyed.groupBy("key").agg(F.min("edges").alias("edges"))
        found = checkpointed(level.select(F.monotonically_increasing_id().alias("skeleton"), F.lit(v + 1).alias("n"), "edges"))
    return found.select(F.col("skeleton").cast("bigint").alias("skeleton"), "n", "edges")


def colored(skeleton: DataFrame, k: int) -> DataFrame:
    """(skeleton, n, edges, colors): each skeleton's colourings with k colours up to its symmetries.

    The colours of the first two nodes are dealt to tasks, so the colourings of
    one skeleton are searched by k² of them, and leave each in small batches.
    """
    every = F.array(*[F.lit(c) for c in range(k)])
    starts = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(2))), F.array(F.array().cast("array<int>")), lambda acc, _: F.flatten(F.transform(acc, lambda s: F.transform(every, lambda c: F.concat(s, F.array(c))))))
    dealt = skeleton.withColumn("start", F.explode(starts))
    if k > 1:
        dealt = dealt.repartition(skeleton.sparkSession.sparkContext.defaultParallelism)

    def kernel(n, edges, start):
        return ((list(c),) for c in colorings(n, [tuple(e) for e in edges], k, start))

    return mapped(dealt, ["skeleton", "n", "edges"], ["n", "edges", "start"], kernel, "colors array<int>")


def exhaustive(spark: SparkSession, n: int, groups: Sequence[Group], at_least: Mapping[str, int] | None = None) -> DataFrame:
    """Every distinct molecule of n groups, each once: canonical_key, smiles, types, edges.

    Groups are told apart by type, pattern and hubs. ``at_least``: least number
    of groups of a type; types outside the alphabet are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if not groups:
        raise ValueError("the alphabet is empty")
    at_least = {t: k for t, k in (at_least or {}).items() if any(g.type == t for g in groups)}
    if any(k < 0 for k in at_least.values()):
        raise ValueError("a constraint must not be negative")
    groups = sorted(set(groups), key=lambda g: (g.type, g.pattern, g.hubs))
    ports = F.array(*[F.lit(len(g.hubs)) for g in groups])
    c = colored(skeletons(spark, n), len(groups))
    degree = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: F.size(F.filter("edges", lambda e: (e[0] == v) | (e[1] == v))))
    # Constraints and the bond cap stay columns, so they run before any port is chosen.
    c = c.filter(F.forall(F.zip_with(degree, "colors", lambda d, x: d <= F.get(ports, x)), lambda ok: ok))
    for t, k in at_least.items():
        own = [i for i, g in enumerate(groups) if g.type == t]
        c = c.filter(F.size(F.filter("colors", lambda x: x.isin(own))) >= k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = [groups[x] for x in r["colors"]]
                seen = {}
                for edges in distinct_choices(own, [tuple(e) for e in r["edges"]]):
                    m = expand(own, edges)
                    key = m.key()
                    if key not in seen:
                        seen[key] = (key, write(m), [g.type for g in own], [list(e) for e in edges])
                yield _batch(list(seen.values()))

    parts = spark.sparkContext.defaultParallelism
    found = c.repartition(parts).mapInArrow(run, _GRAPH)
    best = F.min(F.struct("smiles", "types", "edges")).alias("g")
    return found.groupBy("canonical_key").agg(best).select("canonical_key", "g.*")


def random_sample(spark: SparkSession, n: int, groups: Sequence[Group], count: int = 100, seed: int = 0) -> DataFrame:
    """Up to ``count`` distinct molecules of n groups from at most 1000 * count seeded attempts; the same seed gives the same result."""
    if n < 1 or count < 1:
        raise ValueError("n and count must be at least 1")
    if not groups:
        raise ValueError("the alphabet is empty")
    groups = sorted(set(groups), key=lambda g: (g.type, g.pattern, g.hubs))
    bones = connected_skeletons(n)

    def pick(attempt: int, k: int, m: int) -> int:
        return xxhash.xxh64_intdigest(f"{seed},{attempt},{k}") % m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, tries = [], []
            for a in b.column(0).to_pylist():
                links = bones[pick(a, 0, len(bones))]
                own = [groups[pick(a, 1 + v, len(groups))] for v in range(n)]
                free = [sorted(range(len(g.hubs)), key=lambda p, v=v: pick(a, 1000 + 100 * v + p, 1 << 62)) for v, g in enumerate(own)]
                edges = []
                for u, v in links:
                    if not free[u] or not free[v]:
                        break
                    edges.append((u, free[u].pop(), v, free[v].pop()))
                if len(edges) == len(links):
                    m = expand(own, edges)
                    rows.append((m.key(), write(m), [g.type for g in own], [list(e) for e in edges]))
                    tries.append(a)
            out = _batch(rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(tries, pa.int64())], [*out.schema.names, "attempt"])

    # Rounds of growing numbers of attempts, until there are enough or the attempts end.
    done, tries, found = 0, 4 * count, None
    while True:
        new = spark.range(done, tries).mapInArrow(run, _GRAPH + ", attempt bigint")
        found = new if found is None else found.unionByName(new)
        first = found.groupBy("canonical_key").agg(F.min_by(F.struct("smiles", "types", "edges"), "attempt").alias("g"), F.min("attempt").alias("attempt"))
        if tries >= 1000 * count or first.limit(count).count() >= count:
            return first.orderBy("attempt").limit(count).select("canonical_key", "g.*")
        done, tries = tries, min(1000 * count, 8 * tries)
