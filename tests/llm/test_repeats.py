import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from portloom.llm import repeats

U = repeats.UNIT


def plain(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + U] for r in raws for i in range(len(r) - U + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - U + 1):
            if seen[r[i : i + U]] > 1:
                gone[i : i + U] = 1
        spans = int(((gone[:-1] == 1) & (np.append(0, gone[:-2]) == 0)).sum()) if len(r) else 0
        left = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def cases():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(5)]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, len(s) // 2)
            parts += [prose(rnd.randrange(0, 40)), s[a : a + rnd.randrange(100, len(s))]]
        out.append(" ".join(parts))
    out += [out[3], out[3], None, "", "", "short", "short", "a" * 500, "a" * 199, "ab" * 300, "é" * 150, prose(30) + "x" * 230, shared[0][:230] + shared[0][:230], "q" * 200]
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_matches_brute_force(spark, hot):
    texts = cases()
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, k1 int")
    got = repeats.repeats(docs, hot).collect()
    want = plain(texts)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((str(i if i % 7 else None), *w) for i, w in enumerate(want))


def test_texts_of_equal_half_digests_stay_apart(spark, monkeypatch):
    """Neither half of the digest stands for a text alone."""
    real = repeats._digests
    texts = cases()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = sorted((i, *w) for i, w in enumerate(plain(texts)))
    for half in (0, 1):
        monkeypatch.setattr(repeats, "_digests", lambda t, half=half: tuple(F.lit(7).cast("bigint") if i == half else d for i, d in enumerate(real(t))))
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeats(docs).collect()) == want


def test_heavy_anchors_and_no_table_left(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", 3)
    texts = cases() + ["z" * 260 + str(i) for i in range(30)]
    before = {t.name for t in spark.catalog.listTables()}
    got = repeats.repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == sorted((i, w[1], w[3]) for i, w in enumerate(plain(texts)))


def test_blocks_and_long_texts(spark, monkeypatch):
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    texts = [base, base[2000:2600] + "zz" + base[100:420], base[:150]]
    monkeypatch.setattr(repeats, "BLOCK", 512)
    monkeypatch.setattr(repeats, "REFINED", 2000)
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array([1, 2, 3], pa.int64()), pa.array(texts)], ["k1", "k2", "text"])
    rows = [r for out in repeats._anchors(iter([b])) for r in out.to_pylist()]
    # Each window of each text belongs to one run.
    for k, t in enumerate(texts, 1):
        owned = Counter(s for r in rows if r["k1"] == k for s in range(r["pack"] >> 16, (r["pack"] >> 16) + (r["pack"] & 255) + 1))
        assert owned == Counter(range(max(0, len(t) - U + 1)))


def test_refined_pointers():
    rnd = random.Random(9)
    s = bytes(rnd.choice(b"ab") for _ in range(300))
    x = np.frombuffer(s + s[:260] + b"c" + s[40:], np.uint8)
    ptr = repeats.refined(x)
    raw, seen = x.tobytes(), {}
    for i in range(len(raw) - U + 1):
        assert seen.setdefault(raw[i : i + U], ptr[i]) == ptr[i]
    assert len(set(seen.values())) == len(seen)


def test_empty_table(spark):
    assert repeats.repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
