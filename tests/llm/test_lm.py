import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from portloom.llm import lm


def vocabulary():
    top = [(f"w{chr(97 + i % 26)}{i}".encode(), 200 - i) for i in range(150)]
    old, lm.HEAD = lm.HEAD, 100
    try:
        return lm.Vocabulary(top, 50, 20_000, 400, {k: (5, 3) for k in range(0, lm.TAIL_CLASSES, 2)})
    finally:
        lm.HEAD = old


@pytest.fixture
def network():
    v = vocabulary()
    net = lm.Network(v)
    r = np.random.default_rng(1)
    for k in ("class_w", "word_w", "u"):
        getattr(net, k)[...] = r.standard_normal(getattr(net, k).shape) * 0.3
    return v, net


def test_probabilities_sum_to_one(network):
    v, net = network
    h = np.random.default_rng(2).standard_normal((3, lm.HIDDEN)).astype(np.float32)
    for row in h:
        total = 0.0
        heads = np.arange(v.heads)
        total += np.exp(net.log_probs(np.repeat(row[None], v.heads, 0), v.cls[heads], heads)).sum()
        tails = np.arange(lm.HEAD_CLASSES, lm.HEAD_CLASSES + lm.TAIL_CLASSES)
        total += np.exp(net.log_probs(np.repeat(row[None], len(tails), 0), tails, np.full(len(tails), -1))).sum()
        assert abs(total - 1) < 1e-4


def test_gradients(network):
    v, net = network
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    r = np.random.default_rng(3)
    y = r.integers(0, v.heads, (4, 3))
    x = r.integers(0, v.heads, (4, 3))
    cls, begin = v.classes(y), np.zeros((4, 3), bool)

    def loss():
        hs, _ = net.states(x, begin, np.zeros((3, lm.HIDDEN)))
        return -net.log_probs(hs.reshape(-1, lm.HIDDEN).astype(np.float64), cls.reshape(-1), y.reshape(-1)).sum()

    hs, kept = net.states(x, begin, np.zeros((3, lm.HIDDEN)))
    _, dh, gs = net.log_probs(hs.reshape(-1, lm.HIDDEN), cls.reshape(-1), y.reshape(-1), grad=True)
    dg, gs["u"] = net.backward(x, kept, dh.reshape(hs.shape))
    gs["gates"] = np.zeros_like(net.gates)
    np.add.at(gs["gates"], x, dg)
    for k in net.NAMES:
        p, g = getattr(net, k), gs[k]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 0.03 * abs(g[at]) + 0.02, k


def test_state_runs_through_whole_documents(network):
    v, net = network
    r = np.random.default_rng(4)
    docs = [r.integers(0, v.heads, n) for n in (1, 5, 90, 33, 64, 2, 200)]
    got = lm.log_likelihoods(net, v, docs, lanes=3, steps=8)
    for d, g in zip(docs, got, strict=True):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for before, y in zip([lm.END, *d[:-1]], d, strict=True):
            hs, _ = net.states(v.inputs(np.array([[before]])), np.zeros((1, 1), bool), h)
            h = hs[-1]
            total += float(net.log_probs(h, v.classes(np.array([y])), np.array([y]))[0])
        assert abs(total - g) < 1e-3 * max(1, abs(total))


def corpus(n=260):
    rnd = random.Random(6)
    kinds = [[f"{a}{i}{e}" for i in range(60)] for a, e in (("x", "ta"), ("y", "no"), ("z", "ck"))]
    rows = []
    for i in range(n):
        words = kinds[i % 3]
        rows.append((i, " ".join(rnd.choice(words[:20] if rnd.random() < 0.7 else words) for _ in range(rnd.randrange(5, 90))), 0.5))
    return rows + [(None, None, 1.0), (901, "", 1.0), (901, "", 1.0), (902, "X1ta unseenword  Y2NO\t", 1.0), (903, "one", None)]


def test_base_and_model(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(lm, "KNOWN", 100)
    monkeypatch.setattr(lm, "HEAD", 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    got = sorted(lm.scored(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter()
    for i, t, _ in rows:
        if not out(i):
            c.update([*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    text = {r[0]: [*(r[1] or "").lower().split(), None] for r in rows}
    gain = []
    for r in got:
        ts = text[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(ts), sum(c[t] > 0 for t in ts), n)
        assert abs(r["base_score"] - sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) < 1e-6
        if r["held_out"] and len(ts) > 5:
            gain.append((r["score"] - r["base_score"]) / len(ts))
    assert np.mean(gain) > 0.1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.scored(docs).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.scored(spark.createDataFrame([(only, "a b")], "doc_id bigint, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)


def test_gradients_stop_where_a_document_begins(network):
    v, net = network
    r = np.random.default_rng(5)
    before = r.integers(1, v.heads, (6, 2))
    before[3, 0] = before[1, 1] = lm.END
    x, begin, y = v.inputs(before), before == lm.END, r.integers(0, v.heads, 12)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    zero = np.zeros((2, lm.HIDDEN))

    def after(t, lane, shift):
        net.gates[x[t, lane]] += shift
        hs, _ = net.states(x, begin, zero)
        net.gates[x[t, lane]] -= shift
        return -net.log_probs(hs.reshape(-1, lm.HIDDEN).astype(np.float64), v.classes(y), y).sum()

    hs, kept = net.states(x, begin, zero)
    _, dh, _ = net.log_probs(hs.reshape(-1, lm.HIDDEN), v.classes(y), y, grad=True)
    dg, _ = net.backward(x, kept, dh.reshape(hs.shape), begin)
    total = np.zeros_like(net.gates)
    np.add.at(total, x, dg)
    for t, lane in [(2, 0), (0, 1), (3, 0), (5, 1)]:
        k = int(np.argmax(np.abs(total[x[t, lane]])))
        shift = np.zeros(3 * lm.HIDDEN)
        shift[k] = 1e-2
        assert abs((after(t, lane, shift) - after(t, lane, -shift)) / 2e-2 - total[x[t, lane], k]) < 0.03 * abs(total[x[t, lane], k]) + 0.02


def test_every_token_is_trained_on(network):
    v, net = network
    r = np.random.default_rng(6)
    docs = [np.append(r.integers(1, v.heads, n), lm.END) for n in [0, 1, 15, 16, 17, 2500, *r.integers(1, 300, 200)]]
    assert lm.train(net, v, iter(docs)) == sum(map(len, docs))
    assert lm.train(net, v, iter([])) == 0


def test_late_patterns_of_long_documents_are_learnt(spark, monkeypatch):
    """One word stands after another once in 1,000 tokens, right before the end: few windows of a sample would hold it."""
    rnd = random.Random(8)
    monkeypatch.setattr(lm, "HEAD", 60)
    filler = [f"x{i}ta" for i in range(40)]
    docs = [(i, " ".join([*(rnd.choice(filler) for _ in range(rnd.randrange(900, 1000))), "lastly", "goodbye"])) for i in range(120)]
    rows = spark.createDataFrame(docs, "rid bigint, text string").selectExpr("rid", "rid AS doc_id", "text", "false AS held_out")
    v, net, _, _ = lm.learnt(rows)
    codes = lambda *words: v.codes([w.encode() for w in words])[0]
    start = lm.Network(v)
    score = lambda n: float(lm.log_likelihoods(n, v, [codes(*filler, "lastly", "goodbye")])[0] - lm.log_likelihoods(n, v, [codes(*filler, "lastly")[:-1]])[0])
    assert score(net) > score(start) + 4


def test_training_does_not_depend_on_batches_and_copies_are_apart(network):
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa

    v, net = network
    r = np.random.default_rng(9)
    docs = [np.append(r.integers(1, v.heads, r.integers(0, 80)), lm.END).astype("<i4").tobytes() for _ in range(60)]
    copy = [0] * 25 + [3] * 35
    run = lm._trainer(SimpleNamespace(value=pickle.dumps(v)), SimpleNamespace(value=net.params()))
    outs = []
    for size in (60, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(copy[k : k + size], pa.int32()), pa.array(docs[k : k + size], pa.binary())], ["copy", "codes"]) for k in range(0, 60, size)]
        outs.append([b.to_pydict() for b in run(iter(batches))])
    assert outs[0] == outs[1] and [o["copy"][0] for o in outs[0]] == [0, 3]
    assert [o["n"][0] for o in outs[0]] == [sum(len(d) // 4 for d in docs[:25]), sum(len(d) // 4 for d in docs[25:])]


def test_same_model_for_any_layout_with_every_token_in_one_copy(spark, monkeypatch):
    monkeypatch.setattr(lm, "COPY_TOKENS", 1500)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    monkeypatch.setattr(lm, "HEAD", 60)
    seen = []
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, score double").selectExpr("monotonically_increasing_id() AS rid", "doc_id", "text", "false AS held_out")
    for n in (1, 5):
        v, net, _, _ = lm.learnt(docs.repartition(n))
        seen.append({k: p.copy() for k, p in net.params().items()})
    assert round(v.total / 1500) > 4
    assert all(np.array_equal(seen[0][k], seen[1][k]) for k in seen[0])


def test_frequent_words_by_threshold(spark, monkeypatch):
    """All words of a count or none, never more than asked, whatever the counts."""
    n = {f"w{i}": 1 + i // 4 for i in range(80)} | {"big": 5000, "bigger": 70_001, "tie": 5003}
    counts = spark.createDataFrame(list(n.items()), "word string, n bigint")
    for most in (1, 3, 10, 50, 500):
        monkeypatch.setattr(lm, "KNOWN", most)
        got = lm._frequent(counts)
        assert len(got) <= most and got == sorted(got, key=lambda x: (-x[1], x[0]))
        if got:
            assert {w for w, _ in got} == {w.encode() for w, c in n.items() if c >= got[-1][1]}
    monkeypatch.setattr(lm, "KNOWN", 500)
    assert len(lm._frequent(counts)) == len(n)


def test_ties_and_a_very_long_text(spark, monkeypatch):
    """Words of equal counts at the edge of what is known, and a text of 300,000 words, whose state runs through it."""
    monkeypatch.setattr(lm, "KNOWN", 10)
    monkeypatch.setattr(lm, "HEAD", 5)
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    long = " ".join(f"w{i % 30}" for i in range(300_000))
    got = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame([(train[0], long), (train[1], "w1 w1 w2 zzz")], "doc_id bigint, text string")).collect()}
    n, v = 300_000 + 4 + 2, 32
    c = Counter(long.split() + "w1 w1 w2 zzz".split())
    for i, t in ((train[0], long), (train[1], "w1 w1 w2 zzz")):
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t.split()) + math.log10(3 / (n + v + 1))
        assert abs(got[i]["base_score"] - want) < 1e-6 * abs(want) and got[i]["n_known"] == len(t.split()) + 1 and got[i]["score"] < 0
    assert got[train[0]]["score"] > got[train[0]]["base_score"]
