import random
import zlib

import numpy as np

from portloom.llm import toxicity


def test_learns_sentences_from_document_labels(spark):
    rnd = random.Random(1)
    plain = [f"word{i}" for i in range(150)]
    sent = lambda bad: " ".join([rnd.choice(plain) for _ in range(8)] + ["zurk" + rnd.choice("abcdefgh")] * bad)
    docs, labels, bad_at = [], [], {}
    for i in range(900):
        y = int(rnd.random() < 0.2)
        n = rnd.randrange(1, 9)
        spot = rnd.randrange(n) if y else -1
        docs.append((i, ". ".join(sent(int(k == spot)) for k in range(n)), "clash"))
        labels.append((i, 1, y))
        bad_at[i] = spot
    docs += [(2000, None, "x"), (2001, "", "x"), (2001, "", "x"), (None, "word1 zurka", "x")]
    labels += [(None, 1, 1), (5000, 1, 0), (2000, 0, None), (3, 0, labels[3][2])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    y = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(d, y).collect()
    assert len(got) == len(docs)
    text, truth = {r[0]: r[1] for r in docs}, {r[0]: r[2] for r in labels}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert len(held) > 150 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in held:
        for o in r["offending"]:
            assert "zurk" in text[r["doc_id"]][o["start"] : o["end"]]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_without_labels_scores_are_a_constant(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    y = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(d, y).first()["score"] == 0.5
    assert toxicity.toxicity(d.limit(0), y).count() == 0


def test_noisy_or():
    m = toxicity.Model({"bad": 3.0}, -2.0)
    s, found = m.score("a bad one. another. bad bad")
    p, q = 1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(2.0))
    assert abs(s - (1 - (1 - p) ** 2 * (1 - q))) < 1e-12
    assert [(a, b) for a, b, _ in found] == [(0, 9), (19, 27)]


def test_plain_sentences_do_not_lift_long_documents():
    m = toxicity.Model({"bad": 3.0}, -2.0)
    long = "nothing here. " * 50_000
    assert m.score(long)[0] == m.score("nothing here")[0] == m.score("")[0] == m.score(None)[0]
    s, found = m.score(long + "bad. " + long)
    assert abs(s - m.score("bad")[0]) < 1e-12 and [(a, b) for a, b, _ in found] == [(len(long) - 1, len(long) + 3)]


def test_fit_is_the_least_of_the_plain_loss():
    """Written out by definition, the loss only grows when a weight or the bias is moved."""
    rnd = random.Random(4)
    bags = [[[rnd.randrange(4) for _ in range(rnd.randrange(1, 3))] for _ in range(rnd.randrange(4))] for _ in range(300)]
    y = np.array([int(any(0 in s for s in b) and rnd.random() < 0.9 or rnd.random() < 0.05) for b in bags])
    w, bias = toxicity._fit(y, bags, 4)

    def loss(w, bias):
        total = 0.0
        for t, b in zip(y, bags, strict=True):
            clean = 1 / (1 + np.exp(bias))
            for s in b:
                clean *= 1 / (1 + np.exp(bias + sum(w[i] for i in s)))
            total -= np.log(1 - clean if t else clean)
        return total / len(y) + toxicity.DECAY / 2 * float(w @ w)

    best = loss(w, bias)
    for k in range(5):
        for step in (-0.3, 0.3):
            moved = w.copy()
            if k < 4:
                moved[k] += step
            assert loss(moved, bias + step * (k == 4)) > best


def test_repeated_ids_keep_the_sample_bounded(spark):
    d = spark.createDataFrame([(1, "bad thing"), (1, "bad thing"), (1, None), (2, "good thing")] * 20, "doc_id bigint, text string")
    y = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(d, y).count() == 80
