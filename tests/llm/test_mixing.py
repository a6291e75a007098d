import random
from collections import Counter

import pytest

from portloom.llm import mixing


def shares(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[k] for k in open_)
        over = [k for k in open_ if w[k] * level >= 3 * sizes[k]]
        if not over:
            return target | {k: w[k] * level for k in open_}
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
            open_.remove(k)
    return target


def test_targets_and_taken(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(0, 40), rnd.choice(["a", "a", "a", "b", "é", "zz", None]), i, "x") for i in range(1500)]
    rows += [(5000, "w " * 50, "tiny", 1, "x"), (5001, None, "nothing", 1, "x"), (None, "w w", "b", 1, "x"), (7, rows[7][1], rows[7][2], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    want = shares(dict(sizes) | {"nothing": 0})
    by = {r[0]: r[2] for r in rows}
    taken, most = Counter(), Counter()
    for r in got:
        s = by[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= most[s], s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_equal_ids_and_equal_rows_are_told_apart(spark):
    """A source whose rows share one id or none still meets its target to within one document."""
    rows = [(None, f"w{i} " * 3, "a") for i in range(400)] + [(5, "same text here", "a") for i in range(300)] + [(i, "x " * 7, "b") for i in range(50)] + [(9000 + i, "y z", "c") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        by[r["source_size"], r["target"]] += r["taken"]
    assert len(by) == 3 and all(abs(t - goal) <= 7 for (_, goal), t in by.items())


def test_many_sources_are_ranked_in_ranges(spark):
    rows = [(i, "w " * (1 + i % 5), None if i % 97 == 0 else f"host{i % 331:04d}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = shares(dict(sizes))
    got = {r["source"]: r["target"] for r in mixing.targets(docs.select("source", mixing.size_of(docs["text"]).alias("size"))).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_copies_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9), (2, "c d e", None, 9)], "doc_id bigint, text string, source string, _times int")
    assert mixing.replicated(docs).columns == docs.columns
    total = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(len(r["text"].split()) for r in mixing.replicated(docs).collect()) == total
    assert mixing.mix(docs.limit(0)).count() == 0
