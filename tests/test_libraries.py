"""Known groups and edges of molecules by library (library_cases.json: smiles, library, groups, edges)."""

import json
from collections import Counter
from pathlib import Path

import pytest

from portloom.functions.molecules import ParseError, parse
from portloom.functions.smarts import View, matches
from portloom.functions.smarts import parse as pattern
from portloom.plans.fragment import connections, fragment_states
from portloom.sources import libraries

CASES = json.loads((Path(__file__).parent / "library_cases.json").read_text())


@pytest.mark.parametrize(("smiles", "library", "groups", "edges"), CASES, ids=[f"{c[1]}-{c[0]}" for c in CASES])
def test_groups_and_edges(smiles, library, groups, edges):
    rows, m = libraries.LIBRARIES[library.lower()], parse(smiles)
    whole = [s for s in fragment_states(m, [p for _, p, _ in rows], "size") if sum(len(a) for _, a in s) == len(m.elements)]
    if not groups:
        assert not whole
        return
    assert Counter(rows[i][0] for i, _ in whole[0]) == groups
    types = [rows[i][0] for i, _ in whole[0]]
    want = Counter()
    for a, b, n in edges:
        want[tuple(sorted((a, b)))] += n
    assert Counter(tuple(sorted((types[g], types[h]))) for g, _, h, _, _ in connections(m, whole[0])) == want


def test_what_is_not_covered(spark):
    m = spark.createDataFrame([("CC",), ("C",), ("NC=O",)], "smiles string")
    kept = {r["smiles"] for r in libraries.histograms(m, "saft").collect()}
    whole = {r["smiles"]: r["type"] for r in libraries.histograms(m, "saft", "condense").collect() if r["smiles"] not in kept}
    assert all(k == v for k, v in whole.items())
    single = {r["smiles"] for r in libraries.histograms(m, "saft", "itemize").collect()}
    assert single == {"CC", "C", "NC=O"}
    with pytest.raises(ValueError):
        libraries.histograms(m, "saft", "else")


@pytest.mark.parametrize(("text", "smiles", "n"), [("[C;R]", "CCC1CCCCC1", 6), ("[CH3]", "CC(C)C", 3), ("[#6]~[#8]", "CC(=O)O", 2), ("[!#6]", "CCO", 1), ("[O;X1]", "CC=O", 1), ("[C;$(C=O)]", "CC(=O)C", 1), ("c", "c1ccccc1", 6), ("[C,N;!R]", "CN1CC1", 1), ("C!@C", "CC1CC1", 1)])
def test_patterns(text, smiles, n):
    assert len(matches(View(parse(smiles)), pattern(text))) == n


@pytest.mark.parametrize("text", ["[C", "C(", "[Q]", "C1CC", "$"])
def test_bad_patterns(text):
    with pytest.raises(ParseError):
        pattern(text)
