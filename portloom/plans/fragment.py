"""Covering molecules with groups: packings of matches, and exact covers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.functions import smarts
from portloom.functions.arrow import mapped
from portloom.functions.molecules import FragmentationError, Molecule, ParseError, hubs_of, parse, search
from portloom.plans.enumerate import Group


def packings(matches: Sequence[Sequence[int]], mode: str = "ideal") -> list[list[tuple[int, ...]]]:
    """Sets of disjoint matches. ``ideal``: all of the greatest size, sorted; ``quick``: first come, first served.

    State is a bitmask of the places used. A branch that can't reach the best
    size even with all that is left is cut.
    """
    if mode not in ("ideal", "quick"):
        raise ValueError(f"unknown mode {mode!r}")
    sets = [tuple(m) for m in matches]
    masks = [sum(1 << a for a in set(m)) for m in sets]
    if mode == "quick":
        used, out = 0, []
        for s, m in zip(sets, masks, strict=True):
            if not used & m:
                used |= m
                out.append(s)
        return [out] if out else []
    best: list[list[tuple[int, ...]]] = []
    size = 0

    def grow(at: int, used: int, chosen: list[int]) -> None:
        nonlocal best, size
        if len(chosen) > size:
            best, size = [], len(chosen)
        if len(chosen) == size and size:
            best.append([sets[i] for i in chosen])
        for i in range(at, len(sets)):
            if len(chosen) + len(sets) - i < size:
                break
            if not used & masks[i]:
                grow(i + 1, used | masks[i], [*chosen, i])

    grow(0, 0, [])
    return sorted(best)


def packed(cases: DataFrame, mode: str = "ideal") -> DataFrame:
    """(case_id, n_packings, size, packing) for each packing of each row's ``matches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, len(ps), len(p), [list(m) for m in p]) for c, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for ps in [packings(ms, mode)] for p in ps]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["case_id", "n_packings", "size", "packing"])

    return cases.select(F.col("case_id").cast("bigint"), "matches").mapInArrow(run, "case_id bigint, n_packings int, size int, packing array<array<int>>")


def greedy(matches: Column) -> Column:
    """The quick packing as an expression: a fold over the ordered matches."""
    none = F.array().cast("array<array<int>>")
    take = lambda acc, m: F.when(F.arrays_overlap(F.flatten(acc), m), acc).otherwise(F.concat(acc, F.array(m)))
    return F.aggregate(matches, none, take)


def variants(group: Group) -> list[Group]:
    """The group with every subset of its ports, ports on one atom being alike."""
    out = {}
    for mask in range(1 << len(group.hubs)):
        hubs = tuple(h for i, h in enumerate(group.hubs) if mask >> i & 1)
        out[hubs] = Group(group.type, group.pattern, hubs)
    return [out[h] for h in sorted(out, key=lambda h: (-len(h), h))]


def variants_of(groups: DataFrame) -> DataFrame:
    """(type, hubs): all subsets of each group's ports, each once; ports on one atom are alike, so of each atom's ports a number is taken."""
    atoms = F.transform(F.array_sort(F.array_distinct("hubs")), lambda h: F.struct(h.alias("h"), F.size(F.filter("hubs", lambda x: x == h)).alias("n")))
    more = lambda acc, a: F.flatten(F.transform(acc, lambda s: F.transform(F.sequence(F.lit(0), a["n"]), lambda k: F.concat(s, F.array_repeat(a["h"], k)))))
    every = F.aggregate(atoms, F.array(F.array().cast("array<int>")), more)
    return groups.select("type", F.explode(every).alias("hubs")).distinct()


def exact_covers(m: Molecule, groups: Sequence[Group]) -> list[list[tuple[str, tuple[int, ...], tuple[int, ...]]]]:
    """All covers of the molecule's atoms by groups whose ports are exactly the bonds that leave them.

    A cover lists (type, hubs used, image of the pattern's atoms); images that
    differ by a symmetry of the pattern are covers of their own.
    """
    found: dict[tuple[str, tuple[int, ...], tuple[int, ...]], None] = {}
    for g in groups:
        q = parse(g.pattern)
        for v in variants(g):
            for image in search(m, q, list(v.hubs)):
                found[g.type, v.hubs, tuple(image)] = None
    blocks = sorted(found, key=lambda b: (-len(b[2]), b))
    masks = [sum(1 << a for a in atoms) for _, _, atoms in blocks]
    full, out = (1 << len(m.elements)) - 1, []

    def grow(used: int, chosen: list[int]) -> None:
        if used == full:
            out.append(sorted(blocks[i] for i in chosen))
            return
        low = ~used & (used + 1)  # the first atom not covered; one of its blocks must come
        for i, mask in enumerate(masks):
            if mask & low and not mask & used:
                grow(used | mask, [*chosen, i])

    grow(0, [])
    return sorted(out, key=lambda c: (len(c), c))


def fragments(molecules: DataFrame, groups: Sequence[Group], on_fail: str = "remove") -> DataFrame:
    """(smiles, cover, n_groups, histogram) for each exact cover of each molecule, fewest groups first.

    A molecule without a cover, or a text that can't be read, gives no row (``remove``), a row with cover null
    (``keep``), or stops the query (``error``). Each molecule is worked in one
    kernel; molecules are small and there are many.
    """
    if on_fail not in ("remove", "keep", "error"):
        raise ValueError(f"unknown on_fail {on_fail!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(0).to_pylist():
                try:
                    covers = exact_covers(parse(s), groups) if s else []
                except ParseError:
                    covers = []
                if not covers and on_fail == "error":
                    raise FragmentationError(f"no cover of {s!r}")
                rows += [(s, k, len(c), [t for t, _, _ in c]) for k, c in enumerate(covers)] or ([(s, None, None, None)] if on_fail == "keep" else [])
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["smiles", "cover", "n_groups", "types"])

    return molecules.select("smiles").mapInArrow(run, "smiles string, cover int, n_groups int, types array<string>")


def fragment_states(m: Molecule, queries: Sequence[str], sorter: str = "list", mode: str = "ideal") -> list[tuple[tuple[int, tuple[int, ...]], ...]]:
    """States reached by laying the queries' matches over the molecule in turn: (query, atoms) pairs, fewest first.

    Each query branches into its packings; a group that overlaps what a state
    holds is left out of that state. Queries go by number of atoms, then mass,
    greatest first (``size``), or as listed (``list``).
    """
    if sorter not in ("size", "list"):
        raise ValueError(f"unknown sorter {sorter!r}")
    patterns = [smarts.parse(q) for q in queries]
    order = list(range(len(queries)))
    if sorter == "size":
        order.sort(key=lambda i: (-len(patterns[i].atoms), -sum(smarts.MASS.get(s, 0.0) for s in patterns[i].symbols)))
    view = smarts.View(m)
    states: dict[tuple, None] = {(): None}
    for i in order:
        sets = packings(smarts.matches(view, patterns[i]), mode)
        if not sets:
            continue
        new: dict[tuple, None] = {}
        for state in states:
            taken = {a for _, atoms in state for a in atoms}
            for p in sets:
                new[tuple(sorted([*state, *((i, atoms) for atoms in p if not taken & set(atoms))]))] = None
        states = new
    return sorted(states, key=lambda s: (len(s), s))


class Piece(NamedTuple):
    """A group to lay over molecules. ``kind``: the notation of its pattern, ``SMARTS`` or ``SMILES``."""

    type: str
    pattern: str
    hubs: tuple[int, ...]
    kind: str = "SMARTS"


def pieces_of(patterns: Sequence[str]) -> list[Piece]:
    """Groups named ``type 0``, ``type 1`` .. from patterns, with hubs inferred from their letters; what is no atom pattern is read as a molecule."""
    out = []
    for i, p in enumerate(patterns):
        try:
            smarts.parse(p)
            kind = "SMARTS"
        except ParseError:
            parse(p)
            kind = "SMILES"
        out.append(Piece(f"type {i}", p, tuple(hubs_of(p)), kind))
    return out


def ported(pieces: Sequence[Piece], state: Sequence[tuple[int, tuple[int, ...]]], links: Sequence[tuple[int, int, int, int, float]]) -> tuple[list[tuple[int, int, int, int, float]], int]:
    """Edges (group, port, group, port, order) of a laid out molecule, and how many bonds found no port.

    In the order of the bonds, each end takes the first free port that hangs on its atom.
    """
    used: set[tuple[int, int]] = set()

    def free(g: int, atom: int) -> int | None:
        return next((p for p, h in enumerate(pieces[state[g][0]].hubs) if h == atom and (g, p) not in used), None)

    out, lost = [], 0
    for a, i, b, j, o in links:
        p, q = free(a, i), free(b, j)
        if p is None or q is None:
            lost += 1
            continue
        used |= {(a, p), (b, q)}
        out.append((a, p, b, q, o))
    return out, lost


_PORT_GRAPH = "result int, nodes array<struct<type:string,pattern:string,hubs:array<int>>>, edges array<struct<src:int,src_port:int,dst:int,dst_port:int,bond_order:double>>, n_left int"


def _port_graph(own: Sequence[tuple[str, str, Sequence[int]]], edges: Sequence[tuple[int, int, int, int, float]]) -> tuple[list[dict], list[dict]]:
    names = ("src", "src_port", "dst", "dst_port", "bond_order")
    return [{"type": t, "pattern": p, "hubs": list(h)} for t, p, h in own], [dict(zip(names, e, strict=True)) for e in edges]


def port_graphs(molecules: DataFrame, pieces: Sequence[Piece], incomplete: str = "remove", sorter: str = "list", mode: str = "ideal", match_hubs: bool = False, keep: Sequence[str] = ("smiles",)) -> DataFrame:
    """``keep``, result, nodes, edges, n_left: the port graphs that a molecule falls into when the groups are laid over it in turn.

    ``incomplete`` says what happens to results that leave atoms or bonds without
    a port: ``remove``, ``keep`` or ``raise error``. ``match_hubs`` asks that an
    atom's hydrogens fit the group's ports. Null, empty and unreadable texts give
    no rows.
    """
    if incomplete not in ("remove", "keep", "raise error"):
        raise ValueError(f"unknown handling {incomplete!r}")
    if any(p.kind not in ("SMARTS", "SMILES") for p in pieces):
        raise ValueError("a group's pattern must be SMARTS or SMILES")
    queries = [smarts.with_ports(p.pattern, p.hubs) if match_hubs and p.kind == "SMARTS" else p.pattern for p in pieces]

    def kernel(s: str | None):
        try:
            m = parse(s or "")
        except ParseError:
            return
        k = 0
        for state in fragment_states(m, queries, sorter, mode) if m.elements else ():
            left = len(m.elements) - sum(len(atoms) for _, atoms in state)
            edges, lost = ported(pieces, state, connections(m, state))
            if (left or lost) and incomplete == "raise error":
                raise FragmentationError(f"{left} atoms and {lost} bonds of {s!r} are left")
            if incomplete == "keep" or not (left or lost):
                yield (k, *_port_graph([pieces[i][:3] for i, _ in state], edges), left)
                k += 1

    return mapped(molecules, keep, ["smiles"], kernel, _PORT_GRAPH)


def cover_graphs(molecules: DataFrame, groups: Sequence[Group], keep: Sequence[str] = ("smiles",)) -> DataFrame:
    """``keep``, result, nodes, edges, n_left: exact covers as port graphs, two groups joined by one edge at most, as each port stands for one bond.

    Each group has the ports that its cover uses. Molecules without a cover and
    unreadable texts give no rows.
    """
    def kernel(s: str | None):
        try:
            m = parse(s or "")
        except ParseError:
            return
        for k, cover in enumerate(exact_covers(m, groups) if m.elements else ()):
            own = [Piece(t, next(g.pattern for g in groups if g.type == t), hubs, "SMILES") for t, hubs, _ in cover]
            state = [(i, atoms) for i, (_, _, atoms) in enumerate(cover)]
            links, seen = [], set()
            for x in connections(m, state):
                if (x[0], x[2]) not in seen:
                    seen.add((x[0], x[2]))
                    links.append(x)
            yield (k, *_port_graph([p[:3] for p in own], ported(own, state, links)[0]), 0)

    return mapped(molecules, keep, ["smiles"], kernel, _PORT_GRAPH)


def connections(m: Molecule, state: Sequence[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, float]]:
    """Bonds between the groups of a state: (group, place in it, group, place in it, order)."""
    at = {a: (g, k) for g, (_, atoms) in enumerate(state) for k, a in enumerate(atoms)}
    return sorted((*min(at[u], at[v]), *max(at[u], at[v]), o) for u, v, o in m.bonds if u in at and v in at and at[u][0] != at[v][0])


def laid_out(molecules: DataFrame, queries: Sequence[str], incomplete: str = "remove", sorter: str = "list", mode: str = "ideal") -> DataFrame:
    """(smiles, result, chosen, queries, n_groups, n_edges, n_left) for each molecule and each way to lay the queries over it.

    ``incomplete`` says what happens to results that leave atoms: ``remove``,
    ``keep``, or ``raise error``. Null, empty and unreadable texts give no rows
    (with ``raise error`` the last stop the query).
    """
    if incomplete not in ("remove", "keep", "raise error"):
        raise ValueError(f"unknown handling {incomplete!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(0).to_pylist():
                if not s:
                    continue
                try:
                    m, k = parse(s), 0
                except ParseError as e:
                    if incomplete == "raise error":
                        raise FragmentationError(str(e)) from e
                    continue
                for state in fragment_states(m, queries, sorter, mode):
                    left = len(m.elements) - sum(len(atoms) for _, atoms in state)
                    if left and incomplete == "raise error":
                        raise FragmentationError(f"{left} atoms of {s!r} are left")
                    if not left or incomplete == "keep":
                        rows.append((s, k, [i for i, _ in state], [queries[i] for i, _ in state], len(state), len(connections(m, state)), left))
                        k += 1
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["smiles", "result", "chosen", "queries", "n_groups", "n_edges", "n_left"])

    return molecules.select("smiles").mapInArrow(run, "smiles string, result int, chosen array<int>, queries array<string>, n_groups int, n_edges int, n_left int")
