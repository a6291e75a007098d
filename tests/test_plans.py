from itertools import combinations, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from portloom.functions.molecules import FragmentationError, parse
from portloom.functions.symmetry import connected_skeletons
from portloom.plans import enumerate as gen
from portloom.plans import fragment
from portloom.queries import COUNT4, EXHAUSTIVE3, GEN4


def test_exhaustive_matches_brute_force(spark):
    want = set()
    for bones in connected_skeletons(3):
        for own in product(COUNT4, repeat=3):
            ends = [[(u, p, v, q) for p in range(len(own[u].hubs)) for q in range(len(own[v].hubs))] for u, v in bones]
            for edges in product(*ends):
                used = [x for u, p, v, q in edges for x in ((u, p), (v, q))]
                if len(set(used)) == len(used):
                    want.add(gen.expand(own, edges).key())
    got = [r["canonical_key"] for r in gen.exhaustive(spark, 3, COUNT4).collect()]
    assert len(got) == len(set(got)) == 135 and set(got) == want


def test_constraints_and_arguments(spark):
    got = gen.exhaustive(spark, 3, GEN4, {"ester": 2, "unknown": 9}).collect()
    assert got and all(r["types"].count("ester") >= 2 for r in got)
    for bad in [lambda: gen.exhaustive(spark, 0, GEN4), lambda: gen.exhaustive(spark, 2, []), lambda: gen.exhaustive(spark, 2, GEN4, {"ester": -1}), lambda: gen.random_sample(spark, 2, GEN4, count=0)]:
        with pytest.raises(ValueError):
            bad()


def test_random_sample_is_seeded_and_within_all(spark):
    a = [r["canonical_key"] for r in gen.random_sample(spark, 3, GEN4, 30, seed=2).collect()]
    assert a == [r["canonical_key"] for r in gen.random_sample(spark, 3, GEN4, 30, seed=2).collect()]
    assert len(set(a)) == 30 and set(a) <= {r["canonical_key"] for r in gen.exhaustive(spark, 3, GEN4).collect()}
    assert gen.random_sample(spark, 1, GEN4, 50).count() == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 7), min_size=1, max_size=3), max_size=7))
def test_packings_match_brute_force(matches):
    sets = [tuple(sorted(m)) for m in matches]
    best, found = 0, []
    for k in range(1, len(sets) + 1):
        for c in combinations(range(len(sets)), k):
            if all(not set(sets[i]) & set(sets[j]) for i, j in combinations(c, 2)):
                found = found if best == k else []
                best = k
                found.append([sets[i] for i in c])
    assert fragment.packings(sets) == sorted(found)


def test_fragments(spark):
    m = spark.createDataFrame([("CCC(C)NCCNC",), ("CCBr",)], "smiles string")
    assert fragment.fragments(m, EXHAUSTIVE3).count() == 9
    assert [r["n_groups"] for r in fragment.fragments(m, EXHAUSTIVE3, "keep").collect() if r["smiles"] == "CCBr"] == [None]
    with pytest.raises(Exception, match="no cover"):
        fragment.fragments(m, EXHAUSTIVE3, "error").collect()
    with pytest.raises(ValueError):
        fragment.fragments(m, EXHAUSTIVE3, "else")
    assert issubclass(FragmentationError, ValueError)
    for cover in fragment.exact_covers(parse("CCC(C)NCCNC"), EXHAUSTIVE3):
        assert sorted(a for _, _, atoms in cover for a in atoms) == list(range(9))
