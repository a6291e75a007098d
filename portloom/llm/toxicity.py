"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words
and in their first and last letters (insults are also built from stems); a
document's is the noisy-or of its sentences, 1 - prod(1 - p). Labels belong to
documents only: the gradient of the document's likelihood reaches its sentences
through the noisy-or, which is how the offending ones are found. Sentences
without a chosen feature say nothing; together they are one leak of the
noisy-or, the same for a document of one sentence and one of thousands.

Features are chosen by a chi-square test on document counts, and weights are
fitted on the driver, both on a bounded sample of labelled rows (``SAMPLE``); what
the driver holds doesn't grow with the corpus. Scores cover every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import stored

#: Labelled rows learnt from at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: Features in the model at most, documents that one is in at least, and its least chi-square.
FEATURES, LEAST_DOCS, LEAST_CHI2 = 2_000, 5, 12.0
ROUNDS, RATE, DECAY = 250, 0.08, 1e-4
THRESHOLD = 0.3
#: Words whose weights a Python worker keeps.
KEPT = 200_000

_CUT = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence with a word in it; a text without words is one empty sentence."""
    out, at = [], 0
    for m in _CUT.finditer(text or ""):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text or "")))
    return [(s, e) for s, e in out if _WORD.search(text or "", s, e)] or [(0, 0)]


def sentence_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word itself, and the beginnings and the end of longer ones."""
    out = [word]
    if len(word) > 4:
        out += ["^" + word[:4], word[-4:] + "$"]
    if len(word) > 5:
        out.append("^" + word[:5])
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of words by label, summed for each batch."""
    for b in batches:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            n[y].update({f for w in sentence_words(text.as_py() or "") for f in features(w)})
        words = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], ["word", "pos", "neg"])


def _encoder(words: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(0):
                text = x.as_py() or ""
                rows.append([[i for w in sentence_words(text[s:e]) for f in features(w) if (i := words.get(f)) is not None] for s, e in sentences(text)])
            filled = [[s for s in r if s] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(filled, pa.list_(pa.list_(pa.int32())))], ["y", "s"])

    return run


def _fit(y: np.ndarray, bags: list[list[list[int]]], k: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; each document has one leak, which scores the bias alone."""
    doc = np.array([d for d, b in enumerate(bags) for _ in b], np.int64)
    sent = np.array([i for i, s in enumerate(s for b in bags for s in b) for _ in s], np.int64)
    word = np.array([w for b in bags for s in b for w in s], np.int64)
    theta = np.zeros(k + 1)
    theta[k] = -4.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, ROUNDS + 1):
        w, b = theta[:k], theta[k]
        z = b + np.bincount(sent, w[word], minlength=len(doc))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        none = np.bincount(doc, np.logaddexp(0, z), minlength=len(y)) + np.logaddexp(0, b)  # -log(1 - P)
        share = np.where(y == 1, -np.exp(-none) / np.maximum(-np.expm1(-none), 1e-12), 1.0)  # dloss / dnone
        gz = share[doc] * p
        g = np.append(np.bincount(word, gz[sent], minlength=k), gz.sum() + share.sum() * p0) / max(len(y), 1)
        g[:k] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:k], float(theta[k])


class Model:
    """Weights by feature, and the bias of every sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        """Sum over the word's features; the latest words are kept."""
        if len(self.known) >= KEPT:
            self.known.clear()
        z = self.known[word] = sum([self.weights.get(f, 0.0) for f in features(word)])
        return z

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its offending sentences (start, end, score)."""
        none, found, known = float(np.logaddexp(0, self.bias)), [], self.known
        for s, e in sentences(text):
            z = 0.0
            for w in sorted(sentence_words(text[s:e])) if e else ():
                x = known.get(w)
                z += self._weight(w) if x is None else x
            if z == 0.0:
                continue
            none += float(np.logaddexp(0, self.bias + z))
            p = 1 / (1 + float(np.exp(-(self.bias + z))))
            if p >= THRESHOLD:
                found.append((s, e, p))
        return float(-np.expm1(-none)), found


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents that aren't held out.

    Of repeated labels the greatest counts; null ids and labels are left out.
    Without labels of both kinds every score is the share of positive labels.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` rows of two numbers; of rows that share an id the least text counts, so the sample keeps its bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = stored(rows.select("text", "y").repartition(16), "labelled")
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 1)
        return Model({}, float(np.log(share / (1 - share))))
    a, c = F.col("pos"), F.col("neg")
    n = pos + neg
    cross = (a * (neg - c) - c * (pos - a)).cast("double")
    chi2 = F.lit(float(n)) * cross * cross / ((a + c) * (n - a - c) * float(pos) * float(neg))
    counts = rows.mapInArrow(_bags, "word string, pos bigint, neg bigint").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = counts.filter((a + c >= LEAST_DOCS) & (a + c < n)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").limit(FEATURES)
    words = {r["word"]: i for i, r in enumerate(best.collect())}
    data = rows.mapInArrow(_encoder(words), "y int, s array<array<int>>").toPandas()
    bags = [[list(s) for s in b] for b in data["s"]]
    weights, bias = _fit(data["y"].to_numpy(), bags, len(words))
    return Model({w: float(weights[i]) for w, i in words.items() if abs(weights[i]) > 1e-3}, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row.

    Null and empty texts have the leak alone. A document of thousands of
    sentences gets more than a short one only by sentences that have chosen
    features. Repeated rows stay. Only doc_id
    and text are read, and only the text enters the score. The model is at most
    ``FEATURES`` weights, whatever the corpus.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.score(x.as_py()) for x in b.column(1)]
            spots = [[{"start": s, "end": e, "score": p} for s, e, p in f] for _, f in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array(spots, place)], ["doc_id", "score", "offending"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<start:int,end:int,score:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels``, then scores all of ``docs``."""
    return scored(docs, learnt(docs, labels))
