"""Molecule tables: values, bad input, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from portloom.functions import molecules as mol
from portloom.functions import smarts
from portloom.model import chain_edges
from portloom.operators import chem, drawing
from portloom.plans import enumerate as gen
from portloom.plans import fragment
from portloom.sources import libraries, text

TEXTS = ["CCO", "OCC", "C1CCCC1", "[NH4+]", "CS(=O)(=O)C", "C#N", "", "C(", "X", None, "CC.C"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "mol_id int, smiles string, error string")


def test_parsed_rows_and_errors(texts):
    got = {r["mol_id"]: r for r in chem.parsed(texts, ["mol_id"]).collect()}
    assert len(got) == len(TEXTS)
    assert got[3]["elements"] == ["N"] and got[3]["charges"] == [1] and got[3]["valencies"] == [4]
    assert got[4]["valencies"][1] == 6 and [b["order"] for b in got[4]["bonds"]] == [1.0, 2.0, 2.0, 1.0]
    assert got[6]["elements"] == [] and got[6]["error"] is None
    assert got[7]["elements"] is None and "branch" in got[7]["error"] and "unknown" in got[8]["error"] and got[9]["error"] == chem.NO_TEXT
    strict = {r["mol_id"]: r["error"] for r in chem.parsed(texts, ["mol_id"], validate=True).collect()}
    assert strict[0] is None and strict[10] == "more than one component"
    assert chem.violation(mol.parse("C(C)(C)(C)(C)C")) == "bonds exceed the valency" and chem.violation(mol.parse("[F--]")) == "negative valency"
    atoms = chem.atoms(chem.parsed(texts, ["mol_id"]), ["mol_id"])
    assert atoms.count() == sum(len(mol.parse(TEXTS[i]).elements) for i in (0, 1, 2, 3, 4, 5, 10))
    assert chem.bonds(chem.parsed(texts, ["mol_id"]), ["mol_id"]).filter("mol_id = 2").count() == 10


def test_keys_and_search(texts, spark):
    got = {r["mol_id"]: r for r in chem.keyed(texts, ["mol_id"]).collect()}
    assert got[0]["canonical_key"] == got[1]["canonical_key"] and got[0]["canonical"] == got[1]["canonical"]
    assert got[0]["topology_key"] == chem.keyed(spark.createDataFrame([(0, "NCC")], "mol_id int, smiles string"), ["mol_id"]).first()["topology_key"]
    assert got[9]["canonical_key"] is None and got[6]["canonical"] == ""
    cases = [("CCC", "C", [0]), ("CCC", "C", [0, 0]), ("CCC", "C", [0, 0, 0]), ("CCOCO", "CO", [0, 0]), ("C=CO", "C=C", [0]), ("C=CO", "C=C", [0, 0]), ("C=CO", "O", [0]), ("CNCNOC=O", "C(-O)(=O)", [0]), ("CNCNOC=O", "C(-O)(=O)", [1]), ("CNCNC(=O)O", "CNC", [2]), ("CNCNC(=O)O", "CNC", [0, 2, 2])]
    want = [[[0], [2]], [[1]], [], [], [[1, 0]], [], [[2]], [], [[5, 4, 6]], [[0, 1, 2]], [[2, 3, 4]]]
    for (t, q, h), w in zip(cases, want, strict=True):
        rows = spark.createDataFrame([(t,), (None,), ("C(",)], "smiles string")
        assert [r["image"] for r in chem.substructures(rows, ["smiles"], q, h).collect()] == w, (t, q, h)
    assert {r["mol_id"] for r in chem.pattern_matches(texts, ["mol_id"], "[O;X1]").collect()} == {4}
    with pytest.raises(mol.ParseError):
        chem.pattern_matches(texts, ["mol_id"], "[C")
    assert chem.keyed(texts.limit(0), ["mol_id"]).count() == 0


def test_symmetries_and_groups(spark):
    ring = [[0, 2], [0, 3], [1, 2], [1, 3]]
    g = spark.createDataFrame([(1, ["0"] * 4, ring), (2, ["0", "0", "0", "1"], ring)], "id int, labels array<string>, edges array<array<int>>")
    got = {r["id"]: r for r in chem.symmetries(g, ["id"]).collect()}
    assert (got[1]["node_orbits"], got[1]["edge_orbits"], got[1]["n_automorphisms"]) == ([0] * 4, [0] * 4, 8)
    assert (got[2]["node_orbits"], got[2]["edge_orbits"]) == ([0, 0, 2, 3], [0, 1, 0, 1])
    assert chem.edge_images(g, ["id"]).filter("id = 1").count() == 8
    groups = spark.createDataFrame([("methyl", "C", [0, 0, 0]), ("ester", "C(=O)O", [0, 2]), ("alkene", "C=C", [0, 0, 1, 1]), ("bad", "C(", [0]), ("far", "C", [4])], "type string, pattern string, hubs array<int>")
    counts = {(r["type"], r["degree"]): r["n"] for r in chem.attachment_sets(groups, ["type"]).groupBy("type", "degree").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {("methyl", 1): 1, ("methyl", 2): 1, ("methyl", 3): 1, ("ester", 1): 2, ("ester", 2): 1, ("alkene", 1): 1, ("alkene", 2): 2, ("alkene", 3): 1, ("alkene", 4): 1}
    orbits = {r["type"]: (r["orbits"], r["error"]) for r in chem.hub_orbits(groups, ["type"]).collect()}
    assert orbits["alkene"] == ([0, 0, 0, 0], None) and orbits["ester"][0] == [0, 1] and orbits["far"][1] and orbits["bad"][1]
    hubs = chem.hubs_from_patterns(spark.createDataFrame([("C",), ("CO",), ("CHONPBrBClISiSeSFLi",), (None,)], "pattern string"), ["pattern"])
    assert [r["hubs"] for r in hubs.collect()] == [[0] * 4, [0, 0, 0, 1], [0, 0, 0, 2, 3, 3, 4, 4, 6, 6, 9, 9, 9, 10, 11], None]
    assert {tuple(r["subset"]) for r in chem.powerset(groups.filter("type < 'c'"), "type").collect()} == {(), ("alkene",), ("bad",), ("alkene", "bad")}


def test_expansion(spark):
    n = [("one", 0, "c", "C", [0] * 4), ("two", 0, "c", "C", [0] * 4), ("two", 1, "n", "N", [0] * 3), ("bad", 0, "c", "C", [0])] + [("ring", i, "c", "C", [0] * 4) for i in range(5)]
    e = [("two", 0, 0, 0, 1, 0), ("bad", 0, 0, 0, 7, 0)] + [("ring", i, i, 0, (i + 1) % 5, 1) for i in range(5)]
    nodes = spark.createDataFrame(n, "graph_id string, node_id int, type string, pattern string, hubs array<int>")
    edges = spark.createDataFrame(e, "graph_id string, edge_seq int, src int, src_port int, dst int, dst_port int")
    got = {r["graph_id"]: r for r in chem.expanded(nodes, edges).collect()}
    assert (got["one"]["smiles"], got["two"]["smiles"], got["ring"]["smiles"]) == ("C", "CN", "C1CCCC1") and "KeyError" in got["bad"]["error"]
    assert chem.expanded(nodes.limit(0), edges.limit(0)).count() == 0
    f = chem.described(nodes, ["node_id"], lambda p: [len(p), ord(p[0])]).first()["features"]
    assert f == [1.0, 67.0]
    assert chem.group_text(gen.Group("c", "C", (0, 0))) == "Group('c', 'C', hubs=[0, 0])" and chem.sorted_cells([1, 0, 1, 2]) == [[1], [0, 2], [3]]


def test_admission(spark):
    offered = [(0, "a", "C", [0]), (1, "a", None, None), (2, "a", "N", [0]), (3, "a", "N", [0, 0]), (4, "", "C", [0]), (5, "z", None, None), (6, "b", "O", [-1]), (7, None, None, None)]
    rows = chem.admit_nodes(spark.createDataFrame([("g", *o) for o in offered], "graph_id string, seq int, type string, pattern string, hubs array<int>")).collect()
    got = {r["seq"]: (r["node_id"], r["pattern"], r["reason"]) for r in rows}
    assert got[0] == (0, "C", None) and got[1] == (1, "C", None) and got[2][0] == 2
    assert [got[k][2] for k in (3, 4, 5, 6, 7)] == [chem.NODE_REASONS[2], chem.NODE_REASONS[0], chem.NODE_REASONS[3], chem.NODE_REASONS[1], chem.NODE_REASONS[0]]
    atoms = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 4)], "mol_id int, atom_id int, valency int")
    bonds = [(0, 9, 0, 1.0), (1, 0, 9, 1.0), (2, 0, 1, 1.0), (3, 1, 0, 1.0), (4, 2, 0, 1.0), (5, 2, 1, 1.0), (6, 1, 2, 1.0), (7, 1, 3, 5.0), (8, 3, 1, 1.0)]
    b = spark.createDataFrame([(1, *x) for x in bonds], "mol_id int, seq int, src int, dst int, bond_order double")
    why = {r["seq"]: r["reason"] for r in chem.admit_bonds(atoms, b).collect()}
    assert why == {0: "no source", 1: "no target", 2: None, 3: "valency of the target", 4: "valency of both", 5: "valency of the source", 6: "valency of the target", 7: "order", 8: None}
    free = {r["seq"]: r["reason"] for r in chem.admit_bonds(atoms, b, validate=False).collect()}
    assert free[3] == "bond exists" and free[4] is None


@pytest.mark.parametrize(("pattern", "hubs", "want"), [("CNC", [0, 0], "[CH1,CH2,CH3][NH1][CH3]"), ("[C]", [0, 0], "[CH2,CH3,CH4]"), ("[C]ON", [0, 0, 0, 2, 2], "[CH0,CH1,CH2,CH3][OH0][NH0,NH1,NH2]"), ("[C;R](C)N", [0, 0], "[R;CH0,CH1,CH2]([CH3])[NH2]"), ("C(N(C))", [0, 0], "[CH1,CH2,CH3]([NH1]([CH3]))"), ("[C](C(=O)O)", [0], "[CH2,CH3]([CH0](=[OH0])[OH1])"), ("c1ccccc1", [0], "c1ccccc1"), ("[C]([Br])[Cl]", [0], "[CH1,CH2]([BrH0])[ClH0]")])
def test_patterns_with_ports(pattern, hubs, want):
    assert smarts.with_ports(pattern, hubs) == want
    smarts.parse(want)


def test_port_graphs(spark):
    five = [fragment.Piece(*p) for p in [("oxyl", "O", (0, 0)), ("ester", "C(=O)O", (0, 2)), ("amine", "N", (0, 0, 0)), ("asa", "C(N(C))", (0, 0)), ("alkene", "C", (0, 0, 0))]]
    m = spark.createDataFrame([("CCC(C)NCCNC",), (None,), ("",), ("C(",)], "smiles string")
    r = fragment.port_graphs(m, five, sorter="size", match_hubs=True).first()
    assert sorted(n["type"] for n in r["nodes"]) == ["alkene"] * 5 + ["amine", "asa"] and len(r["edges"]) == 6 and r["n_left"] == 0
    ends = [x for e in r["edges"] for x in ((e["src"], e["src_port"]), (e["dst"], e["dst_port"]))]
    assert len(set(ends)) == len(ends)
    assert fragment.port_graphs(m, five, sorter="size").count() == 0
    assert fragment.port_graphs(m, five, "keep", sorter="size").count() > 0
    with pytest.raises(Exception, match="are left"):
        fragment.port_graphs(m, five, "raise error", sorter="size").collect()
    for bad in (lambda: fragment.port_graphs(m, five, "else"), lambda: fragment.port_graphs(m, [fragment.Piece("a", "C", (), "INCHI")])):
        with pytest.raises(ValueError):
            bad()
    assert [(p.type, p.hubs) for p in fragment.pieces_of(["[C]", "CO"])] == [("type 0", (0, 0, 0, 0)), ("type 1", (0, 0, 0, 1))]
    groups = [gen.Group("amine", "N", (0, 0, 0)), gen.Group("alkene", "C", (0, 0, 0))]
    c = fragment.cover_graphs(m, groups).collect()
    assert len(c) == 1 and len(c[0]["nodes"]) == 9 and len(c[0]["edges"]) == 8


def test_variants_have_no_cap(spark):
    g = spark.createDataFrame([("wide", list(range(12))), ("alike", [0] * 30), ("none", [])], "type string, hubs array<int>")
    assert {r["type"]: r["count"] for r in fragment.variants_of(g).groupBy("type").count().collect()} == {"wide": 4096, "alike": 31, "none": 1}


def test_skeletons_by_rounds(spark, monkeypatch):
    want = gen.skeletons(spark, 5).count()
    monkeypatch.setattr(gen, "DRIVER_NODES", 3)
    assert gen.skeletons(spark, 5).count() == want == 21 and gen.skeletons(spark, 4).count() == 6


def test_libraries_and_settings(spark, tmp_path):
    lib = libraries.added(libraries.groups(spark, "saft"), "saft", ("new", "[B]", (0,)), doi="d", priority=3)
    r = lib.filter("type = 'new'").first()
    assert (r["ordinal"], r["doi"], r["priority"], r["pattern_type"]) == (36, "d", 3, "SMARTS") and libraries.sizes(lib).first()["n_groups"] == 37
    with pytest.raises(ValueError):
        libraries.added(lib, "saft", ("", "", ()))
    with pytest.raises(Exception, match="cover"):
        libraries.histograms(spark.createDataFrame([("[Se]",), ("BB",)], "smiles string"), "joback", "error").collect()
    assert text.settings("host = a\n\nport=5=6\nnothing\n") == {"host": "a", "port": "5=6"}
    (tmp_path / "empty.txt").write_text("\n\n")
    with pytest.raises(ValueError):
        text.read_colored(spark, str(tmp_path / "empty.txt"))
    with pytest.raises(Exception, match="(?i)path"):
        text.read_colored(spark, str(tmp_path / "missing.txt"))
    # A graph's tables survive a Parquet round trip.
    lib.write.parquet(str(tmp_path / "lib"))
    assert spark.read.parquet(str(tmp_path / "lib")).exceptAll(lib).count() == 0


def test_sink_keeps_null_keys_once_and_reruns_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "k string")
    path = str(tmp_path / "t")
    assert text.append_new(rows, path, "k", "q-0").count() == 3
    assert text.append_new(rows, path, "k").count() == 0
    assert text.append_new(rows.union(spark.createDataFrame([("c",)], "k string")), path, "k", "q-0").count() == 4  # the batch again, with more
    assert text.append_new(rows, path, "k", "q-1").count() == 0
    assert sorted(map(str, (r["k"] for r in spark.read.parquet(path).collect()))) == ["None", "a", "b", "c"]


def test_drawing(spark):
    nodes = spark.createDataFrame([("g", i, "a<b" if i else "x", 3) for i in range(4)] + [("h", 0, "x", 1)], "graph_id string, node_id int, type string, n_ports int")
    edges = chain_edges(nodes)
    a = drawing.spring_layout(nodes, edges, seed=1).collect()
    assert a == drawing.spring_layout(nodes, edges, seed=1).collect() and len(a) == 5 and len({(r["x"], r["y"]) for r in a}) == 5
    svg = nodes.select(drawing.svg(F.col("type"), F.col("n_ports")).alias("s")).collect()
    assert all(r["s"].startswith("<svg") and r["s"].endswith("</svg>") for r in svg) and "a&lt;b" in svg[1]["s"] and svg[0]["s"].count("<circle") == 4
    assert nodes.select(drawing.port_places(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(1.0)).alias("p")).first()["p"] is None
