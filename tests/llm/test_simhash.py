import random

import pytest
from pyspark.sql import functions as F

from portloom.llm import simhash
from portloom.llm.components import roots

SCHEMA = "doc_id bigint, text string, fp string, u int"


def plain_components(fps):
    """Least id reachable over pairs at three bits or fewer, by brute force."""
    ids = list(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and label[a] < label[b]:
                    label[b], changed = label[a], True
    return label


def near_texts():
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(400)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append(words)
        for _ in range(6):
            w = list(words)
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
            rows.append(w)
        rows.append(list(base[0]) if k % 3 == 0 else list(words))
    return [(i, " ".join(w), "clash", 1) for i, w in enumerate(rows)]


@pytest.mark.parametrize("hot", [256, 1])
def test_components_match_brute_force(spark, hot):
    rows = near_texts() + [(900, None, None, None), (901, "", "", 0), (902, " \n\t", "x", 2), (903, "one", "x", 2), (904, "ONE", "x", 2), (905, "a b", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, hot=hot).collect()}
    fps = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(fps)
    assert fps[900] == fps[901] == fps[902] == 0 and fps[903] == fps[904]


@pytest.mark.parametrize("hot", [256, 2])
def test_close_fingerprints_link_whatever_the_bucket(spark, hot):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {rnd.getrandbits(64) for _ in range(20)} | set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5, 3, 2, 3):
            fps.add(b ^ sum(1 << x for x in rnd.sample(range(64), k)))
        for _ in range(15):
            fps.add(b ^ sum(1 << x for x in rnd.sample(range(32), rnd.choice([2, 3, 4]))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in roots(simhash.links(df, hot)).collect()}
    want = plain_components({s: s & ((1 << 64) - 1) for s in signed})
    least = {}
    for s in signed:
        least.setdefault(want[s], []).append(s)
    got = {}
    for s in signed:
        got.setdefault(found.get(s, s), []).append(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, least.values()))


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick  brown\tfox jumps over the lazy dog the quick brown fox"
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    w = long.split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(long) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_empty_table_null_and_repeated_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", "", 1), (3, "a b c d", "", 1), (3, "a b c d", "", 1), (None, "q r s t u v", "", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_thinned_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d", "f", 1), (2, "a b c d", "g", 2), (2, "a b c d", "h", 3), (None, "A b c d", "i", 4), (9, "other words altogether here", "j", 5)]
    out = simhash.thinned(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp", "u"]
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 9]
