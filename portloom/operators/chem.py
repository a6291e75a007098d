"""Molecules and patterns as tables: reading, keys, symmetries, attachments, expansion and search.

Each operator takes a table of texts or graphs and works a row in one kernel;
molecules are small and there are many. A text that can't be read gives a row
with ``error`` set and nulls in place of results; a null text has the error
``no text``; the empty text is the empty molecule.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portloom.functions import molecules as mol
from portloom.functions import smarts, symmetry
from portloom.functions.arrow import mapped
from portloom.plans.enumerate import Group, attachments, expand

NO_TEXT = "no text"


def _read(text: str | None, valid: bool = False) -> tuple[mol.Molecule | None, str | None]:
    if text is None:
        return None, NO_TEXT
    try:
        m = mol.parse(text)
    except mol.ParseError as e:
        return None, str(e)
    return m, violation(m) if valid else None


def violation(m: mol.Molecule) -> str | None:
    """What is unsound about a molecule: a valency below zero, bonds beyond an atom's valency, or parts that don't hang together."""
    if any(v < 0 for v in m.valencies):
        return "negative valency"
    if any(m.free_valency(a) < 0 for a in range(len(m.elements))):
        return "bonds exceed the valency"
    near: dict[int, set[int]] = {a: set() for a in range(len(m.elements))}
    for u, v, _ in m.bonds:
        near[u].add(v)
        near[v].add(u)
    seen, todo = {0}, [0] if m.elements else []
    while todo:
        new = near[todo.pop()] - seen
        seen |= new
        todo += new
    return "more than one component" if m.elements and len(seen) < len(m.elements) else None


def _charge(element: str) -> tuple[str, int]:
    symbol = element.rstrip("+-0123456789")
    return symbol, int(element[len(symbol) :] or 0)


_MOLECULE = "elements array<string>, charges array<int>, valencies array<int>, bonds array<struct<src:int,dst:int,order:double>>, error string"


def parsed(texts: DataFrame, keep: Sequence[str], text: str = "smiles", validate: bool = False) -> DataFrame:
    """``keep``, elements, charges, valencies, bonds and error for every row. ``validate``: unsound molecules have an error too, and keep their atoms."""

    def kernel(s: str | None):
        m, error = _read(s, validate)
        if m is None:
            yield None, None, None, None, error
            return
        both = [_charge(e) for e in m.elements]
        yield [s for s, _ in both], [c for _, c in both], m.valencies, [{"src": u, "dst": v, "order": o} for u, v, o in m.bonds], error

    return mapped(texts, keep, [text], kernel, _MOLECULE)


def atoms(molecules: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, atom_id, element, charge, valency: a row for each atom of parsed molecules."""
    return molecules.select(*keep, F.posexplode(F.arrays_zip("elements", "charges", "valencies")).alias("atom_id", "a")).select(*keep, "atom_id", F.col("a.elements").alias("element"), F.col("a.charges").alias("charge"), F.col("a.valencies").alias("valency"))


def bonds(molecules: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, src, dst, bond_order: a row for each direction of each bond of parsed molecules."""
    ways = F.inline(F.flatten(F.transform("bonds", lambda b: F.array(F.struct(b["src"].alias("src"), b["dst"].alias("dst"), b["order"].alias("bond_order")), F.struct(b["dst"].alias("src"), b["src"].alias("dst"), b["order"].alias("bond_order"))))))
    return molecules.select(*keep, ways)


def keyed(texts: DataFrame, keep: Sequence[str], text: str = "smiles") -> DataFrame:
    """``keep``, canonical_key, topology_key, canonical (the one text of the molecule) and error for every row."""

    def kernel(s: str | None):
        m, error = _read(s)
        yield (None, None, None, error) if m is None else (m.key(), m.topology(), mol.write(m), error)

    return mapped(texts, keep, [text], kernel, "canonical_key string, topology_key string, canonical string, error string")


def symmetries(graphs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, node_orbits, edge_orbits, n_automorphisms for graphs (labels array<string>, edges array<array<int>>): each orbit is named by its least member."""

    def kernel(labels, edges):
        es = [(u, v, "") for u, v in edges]
        yield (*symmetry.orbits(labels, es), len(symmetry.automorphisms(labels, es)))

    return mapped(graphs, keep, ["labels", "edges"], kernel, "node_orbits array<int>, edge_orbits array<int>, n_automorphisms bigint")


def edge_images(graphs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and image: what each automorphism does to a graph's edges, each permutation once."""

    def kernel(labels, edges):
        return [(list(p),) for p in symmetry.edge_permutations(labels, [(u, v, "") for u, v in edges])]

    return mapped(graphs, keep, ["labels", "edges"], kernel, "image array<int>")


def cycle_indices(graphs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, cycles, num, den: the share num/den of a graph's automorphisms with cycles of these lengths."""

    def kernel(labels, edges):
        return [(list(t), f.numerator, f.denominator) for t, f in symmetry.cycle_index(labels, [(u, v, "") for u, v in edges]).items()]

    return mapped(graphs, keep, ["labels", "edges"], kernel, "cycles array<int>, num bigint, den bigint")


def inventories(graphs: DataFrame, keep: Sequence[str], colors: Sequence[str]) -> DataFrame:
    """``keep``, used, n: how many colourings up to symmetry use each colour how often; ``used`` goes with ``colors``."""

    def kernel(labels, edges):
        index = symmetry.cycle_index(labels, [(u, v, "") for u, v in edges])
        return [(list(use), n) for use, n in symmetry.pattern_inventory(index, colors).items()]

    return mapped(graphs, keep, ["labels", "edges"], kernel, "used array<int>, n bigint")


def hub_orbits(groups: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, orbits and error for groups (pattern, hubs): of each port the least atom that its own can be moved to."""

    def kernel(pattern, hubs):
        m, error = _read(pattern)
        if m is not None and any(h < 0 or h >= len(m.elements) for h in hubs):
            m, error = None, "hub beyond the last atom"
        yield (None, error) if m is None else (symmetry.hub_orbits(m.elements, m.bonds, hubs), None)

    return mapped(groups, keep, ["pattern", "hubs"], kernel, "orbits array<int>, error string")


def attachment_sets(groups: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, degree, ports: for groups (type, pattern, hubs), of each size the sets of ports that differ up to the pattern's symmetry. Unsound groups give no rows."""

    def kernel(kind, pattern, hubs):
        try:
            g = Group(kind, pattern, tuple(hubs))
        except ValueError:
            return []
        return [(d, list(p)) for d in range(1, len(g.hubs) + 1) for p in attachments(g, d)]

    return mapped(groups, keep, ["type", "pattern", "hubs"], kernel, "degree int, ports array<int>")


def hubs_from_patterns(patterns: DataFrame, keep: Sequence[str], pattern: str = "pattern") -> DataFrame:
    """``keep`` and hubs, inferred from a pattern's letters; null for a null pattern."""
    return mapped(patterns, keep, [pattern], lambda p: [(None if p is None else mol.hubs_of(p),)], "hubs array<int>")


def expanded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, smiles, n_atoms, n_bonds, error: the atoms of each port graph.

    nodes: (graph_id, node_id, type, pattern, hubs), edges as everywhere. A graph
    without nodes does not occur; edges to nodes or ports that aren't there are an error.
    """
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "type", "pattern", "hubs"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("edge_seq", "src", "src_port", "dst", "dst_port"))).alias("links"))
    graphs = n.join(e, "graph_id", "left").withColumn("links", F.coalesce("links", F.expr("array()").cast(e.schema["links"].dataType)))

    def kernel(own, links):
        at = {x["node_id"]: k for k, x in enumerate(own)}
        try:
            groups = [Group(x["type"], x["pattern"], tuple(x["hubs"])) for x in own]
            m = expand(groups, [(at[x["src"]], x["src_port"], at[x["dst"]], x["dst_port"]) for x in links])
        except (ValueError, KeyError, IndexError) as x:
            yield None, None, None, f"{type(x).__name__}: {x}"
            return
        yield mol.write(m), len(m.elements), len(m.bonds), None

    return mapped(graphs, ["graph_id"], ["nodes", "links"], kernel, "smiles string, n_atoms int, n_bonds int, error string")


def substructures(texts: DataFrame, keep: Sequence[str], query: str, hubs: Sequence[int], text: str = "smiles") -> DataFrame:
    """``keep`` and image: where a molecule holds the query with as many bonds leaving each atom as ``hubs`` names it. Unreadable texts give no rows."""
    wanted = mol.parse(query)

    def kernel(s):
        m, _ = _read(s)
        return [] if m is None else [(i,) for i in mol.search(m, wanted, list(hubs))]

    return mapped(texts, keep, [text], kernel, "image array<int>")


def pattern_matches(texts: DataFrame, keep: Sequence[str], pattern: str, text: str = "smiles") -> DataFrame:
    """``keep``, match, atoms: each set of atoms that an atom pattern fits, once. Unreadable texts give no rows."""
    smarts.parse(pattern)  # a bad pattern fails here, not in a task

    def kernel(s):
        m, _ = _read(s)
        return [] if m is None else [(k, list(a)) for k, a in enumerate(smarts.matches(smarts.View(m), smarts.parse(pattern)))]

    return mapped(texts, keep, [text], kernel, "match int, atoms array<int>")


def described(nodes: DataFrame, keep: Sequence[str], descriptor, column: str = "pattern") -> DataFrame:
    """``keep`` and features: any Python callable from a pattern to numbers, run once for each pattern of a batch."""

    def kernel(p):
        if p not in known:
            if len(known) > 100_000:
                known.clear()
            known[p] = [float(x) for x in descriptor(p)]
        yield (known[p],)

    known: dict[str, list[float]] = {}
    return mapped(nodes, keep, [column], kernel, "features array<double>")


def filtered_inventory(terms: DataFrame, edge_types: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms (term, factor) all of whose factors stand for a pair of colours that occurs as an edge in both directions.

    edge_types: (factor, a, b); edges: (a, b), coloured and directed. A factor
    without a pair keeps no term.
    """
    there = edges.select("a", "b").distinct()
    both = there.join(there.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    good = edge_types.join(both, ["a", "b"], "left_semi").select("factor", F.lit(True).alias("good"))
    return terms.join(good, "factor", "left").groupBy("term").agg(F.bool_and(F.coalesce("good", F.lit(False))).alias("ok")).filter("ok").select("term")


def powerset(items: DataFrame, column: str) -> DataFrame:
    """subset: every subset of a short list of distinct values, as sorted arrays (one row in, 2**n rows out)."""
    every = items.agg(F.array_sort(F.collect_set(column)).alias("all"))
    grown = F.aggregate("all", F.array(F.slice("all", 1, 0)), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return every.select(F.explode(grown).alias("subset"))


def group_text(group: Group) -> str:
    """A group in one line."""
    return f"Group({group.type!r}, {group.pattern!r}, hubs={list(group.hubs)})"


def graph_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, text): nodes and edges of each graph in one text, in order."""
    n = nodes.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "type"))), lambda x: F.concat_ws(":", x["node_id"], x["type"])), ", ").alias("n"))
    e = edges.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge_seq", "src", "src_port", "dst", "dst_port"))), lambda x: F.format_string("%d.%d-%d.%d", x["src"], x["src_port"], x["dst"], x["dst_port"])), ", ").alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", F.format_string("nodes [%s] edges [%s]", "n", F.coalesce("e", F.lit(""))).alias("text"))


#: Why an offered node is refused.
NODE_REASONS = ("no type", "negative hub", "type exists with another pattern and other hubs", "unknown type without a pattern")


def admit_nodes(offered: DataFrame) -> DataFrame:
    """Every offered node (graph_id, seq, type, pattern, hubs) with node_id, pattern, hubs and reason.

    Nodes are taken in the order of seq. A node of a known type may come
    without a pattern and takes that of the first of its type; one that changes
    both the pattern and the hubs of a known type is refused. Refused nodes
    have no node_id. Null types and patterns are empty ones, null hubs none.
    """
    listed = offered.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("hubs", F.array().cast("array<int>")).alias("hubs")))).alias("offers"))

    def kernel(offers):
        taken: dict[str, list[tuple[str, list[int]]]] = {}
        n = 0
        for o in offers:
            kind, pattern, hubs, why = o["type"], o["pattern"], o["hubs"], None
            same = taken.get(kind, [])
            if not kind:
                why = NODE_REASONS[0]
            elif not pattern:
                if not same:
                    why = NODE_REASONS[3]
                else:
                    pattern, hubs = same[0]
            elif any(h < 0 for h in hubs):
                why = NODE_REASONS[1]
            elif any(pattern != p and hubs != h for p, h in same):
                why = NODE_REASONS[2]
            if why is None:
                taken.setdefault(kind, []).append((pattern, hubs))
                n += 1
            yield o["seq"], kind, None if why else n - 1, pattern, hubs, why

    return mapped(listed, ["graph_id"], ["offers"], kernel, "seq int, type string, node_id int, pattern string, hubs array<int>, reason string")


#: Why an offered bond is refused, in the order of the checks.
BOND_REASONS = ("no source", "no target", "valency of both", "valency of the source", "valency of the target", "bond exists", "order")


def admit_bonds(atoms_: DataFrame, offered: DataFrame, validate: bool = True) -> DataFrame:
    """Every offered bond (mol_id, seq, src, dst, bond_order) with ``reason``, null if taken.

    atoms_: (mol_id, atom_id, valency). Bonds are taken in the order of seq; one
    that is refused takes no valency. Orders count as whole numbers, one after
    another. ``validate`` false leaves out the checks of valencies.
    """
    own = atoms_.groupBy("mol_id").agg(F.collect_list(F.struct("atom_id", "valency")).alias("own"))
    listed = offered.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("seq", "src", "dst", "bond_order"))).alias("offers")).join(own, "mol_id", "left")

    def kernel(offers, own):
        left = {a["atom_id"]: a["valency"] for a in own or []}
        taken: set[tuple[int, int, float]] = set()
        for o in offers:
            u, v, order = o["src"], o["dst"], o["bond_order"]
            tests = (
                u not in left, v not in left,
                validate and left.get(u, 0) <= 0 and left.get(v, 0) <= 0, validate and left.get(u, 0) <= 0, validate and left.get(v, 0) <= 0,
                (min(u, v), max(u, v), order) in taken, not 1 <= order <= 4,
            )
            why = next((r for r, t in zip(BOND_REASONS, tests, strict=True) if t), None)
            if why is None:
                taken.add((min(u, v), max(u, v), order))
                for a in (u, v):
                    left[a] -= int(order)
            yield o["seq"], u, v, order, why

    return mapped(listed, ["mol_id"], ["offers", "own"], kernel, "seq int, src int, dst int, bond_order double, reason string")


def sorted_cells(colors: Sequence[int]) -> list[list[int]]:
    """Vertices by colour, each colour's in a cell."""
    by = sorted(range(len(colors)), key=lambda v: (colors[v], v))
    return [list(g) for _, g in groupby(by, key=colors.__getitem__)]
