"""Document log-likelihood from a gated recurrent language model.

Tokens are words and one end per document. The output is factored: a softmax
over classes, then one over the words of the class. The most frequent words
lie in frequency classes and both parts depend on the state; all other words
lie in classes by their last character, within which their share is their
count. So every text has a probability, unseen words too.

Counts come from all training documents. Texts become codes once, stored in the
shared folder. The network is a GRU in numpy, trained by backpropagation through
windows of ``STEPS`` tokens with the state carried from one to the next, over
all windows of every training document, each once. Documents are dealt by a hash
of id and text to copies of the network, of about ``COPY_TOKENS`` tokens each, so
the result depends on neither files nor batches (rows without an id are dealt by
their place, so that many of them don't meet in one copy). The first copy is trained from
nothing, all others start where it ended, and these are averaged in a tree, so
neither a task nor the driver ever holds all of them. Scoring runs over whole
documents and carries the state across windows.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import stored

#: Words the network knows one by one; words whose counts are broadcast (the rest are joined). Both are fixed, whatever the corpus.
HEAD, KNOWN = 512, 120_000
HEAD_CLASSES, TAIL_CLASSES = 10, 50
HIDDEN, STEPS, LANES, FIRST_LANES = 16, 24, 160, 4
#: Training tokens of a copy of the network, about; documents that are sorted by length at a time, most of a copy's.
COPY_TOKENS, CHUNK = 2_000_000, 16_384
#: Documents, and tokens, scored at a time.
SCORED_DOCS, SCORED_TOKENS = 8192, 4_000_000
RATE = 0.08
#: Copies of the network that one task averages.
FAN_IN = 16
END = 0


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; the end is not among them. Bytes split and lower-case at ASCII characters only, just as asked."""
    return text.lower().split() if text else []


def tail_class(word: bytes) -> int:
    """Class of a word that the network doesn't know one by one, by its last byte."""
    c = word[-1]
    return c - 97 if 97 <= c <= 122 else 26 + c % 8 if c < 128 else 34 + c % 16


def _raw() -> Column:
    """The text's bytes; workers need no decoded text."""
    return F.col("text").cast("binary").alias("text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    n: Counter = Counter()
    for b in batches:
        for x in b.column(0):
            n.update(tokens(x.as_py()))
            if len(n) > 500_000:
                yield out(n)
                n = Counter()
    if n:
        yield out(n)


class Vocabulary:
    """Codes of the most frequent words, with what the network and the counts need of each.

    Code 0 is the end, codes below ``heads`` words of the network, later ones
    words of which only the count is known.
    """

    def __init__(self, top: list[tuple[bytes, int]], ends: int, total: int, distinct: int, tail: dict[int, tuple[int, int]]):
        words = [w for w, _ in top]
        self.code = {w: i + 1 for i, w in enumerate(words)}
        counts = np.array([ends, *(c for _, c in top)], float)
        self.heads = min(HEAD, len(words)) + 1
        self.total, self.distinct = total, distinct
        self.log_count = np.log10(counts + 1)
        self.known = counts > 0
        head = counts[: self.heads] + 1
        # Head classes: equal shares of the square roots of counts.
        share = np.cumsum(np.sqrt(head)) / np.sqrt(head).sum()
        cls = np.minimum((share * HEAD_CLASSES * 0.999999).astype(int), HEAD_CLASSES - 1)
        self.first = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1))
        tails = np.array([tail_class(w) for w in words[self.heads - 1 :]], int)
        self.cls = np.concatenate([cls, HEAD_CLASSES + tails])
        self.input = np.concatenate([np.arange(self.heads), self.heads + tails])
        z = np.array([tail.get(k, (0, 0)) for k in range(TAIL_CLASSES)], float)
        self.log_tail = np.log10(z[:, 0] + z[:, 1] + 1)
        mass = np.append(np.bincount(cls, head, HEAD_CLASSES), z[:, 0] + 1)
        self.class_bias = np.log(np.maximum(mass, 0.5) / mass.sum()).astype(np.float32)
        word_mass = np.bincount(cls, head, HEAD_CLASSES)[cls]
        self.word_bias = np.log(head / word_mass).astype(np.float32)

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Codes of words and an end; -1 - k for a word without one that has tail class k; and those words."""
        get = self.code.get
        codes = np.array([get(w, -1) for w in words] + [END], np.int64)
        rare = np.flatnonzero(codes < 0)
        lost = [words[i] for i in rare]
        codes[rare] = [-1 - tail_class(w) for w in lost]
        return codes, lost

    def inputs(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.input[np.maximum(codes, 0)], self.heads - 1 - codes)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.cls[np.maximum(codes, 0)], HEAD_CLASSES - 1 - codes)


class Network:
    """GRU with class-factored output. ``gates`` holds each input's share of the three gates."""

    NAMES = ("gates", "u", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, v: Vocabulary):
        r = np.random.default_rng(7)
        n = v.heads + TAIL_CLASSES
        init = lambda *s: (r.standard_normal(s) * 0.08).astype(np.float32)
        self.gates, self.u = init(n, 3 * HIDDEN), init(HIDDEN, 3 * HIDDEN)
        self.class_w, self.word_w = np.zeros((HEAD_CLASSES + TAIL_CLASSES, HIDDEN), np.float32), np.zeros((v.heads, HIDDEN), np.float32)
        self.class_b, self.word_b = v.class_bias.copy(), v.word_bias.copy()
        self.first = v.first

    def params(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    def states(self, x: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step for inputs x (steps, lanes); ``start`` marks where a document begins and the state is zero."""
        d, (steps, lanes) = HIDDEN, x.shape
        g = self.gates[x]
        # Each gate in a piece of its own: z and r beside each other, then n.
        zr_all, new = np.ascontiguousarray(g[:, :, : 2 * d]), np.ascontiguousarray(g[:, :, 2 * d :])
        u_zr, u_n = np.ascontiguousarray(self.u[:, : 2 * d]), np.ascontiguousarray(self.u[:, 2 * d :])
        hs, before, un = np.empty((steps, lanes, d), np.float32), np.empty_like(new), np.empty_like(new)
        begins = start.any(axis=1)
        for t in range(steps):
            if begins[t]:
                h = h * ~start[t][:, None]
            before[t] = h
            zr, n = zr_all[t], new[t]
            zr += h @ u_zr
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.matmul(h, u_n, out=un[t])
            n += zr[:, d:] * un[t]
            np.tanh(n, out=n)
            h = n + zr[:, :d] * (h - n)
            hs[t] = h
        return hs, (before, zr_all[:, :, :d], zr_all[:, :, d:], new, un)

    def log_probs(self, hs: np.ndarray, cls: np.ndarray, word: np.ndarray, grad: bool = False):
        """Natural log probabilities of (class, head word) at each state; with ``grad``, the gradients of minus their sum.

        ``word`` is -1 for words that the network doesn't know one by one: of
        these it gives the class only.
        """
        m = len(hs)
        logits = hs @ self.class_w.T
        logits += self.class_b
        logits -= logits.max(axis=1, keepdims=True)
        every = np.arange(m)
        out = logits[every, cls]
        e = np.exp(logits, out=logits)
        s = e.sum(axis=1)
        out -= np.log(s)
        dh = gs = None
        if grad:
            e /= s[:, None]
            e[every, cls] -= 1
            dh = e @ self.class_w
            gs = {"class_w": e.T @ hs, "class_b": e.sum(axis=0), "word_w": np.zeros_like(self.word_w), "word_b": np.zeros_like(self.word_b)}
        # Head words by class, so that each class is a slice.
        order = np.flatnonzero(word >= 0)
        order = order[np.argsort(cls[order], kind="stable")]
        bounds = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
        own, picked = hs[order], word[order]
        chosen, d_own = np.zeros(len(order), out.dtype), np.zeros_like(own) if grad else None
        for k in range(HEAD_CLASSES):
            lo, hi, (a, b) = bounds[k], bounds[k + 1], self.first[k : k + 2]
            if lo == hi or b - a < 2:
                continue
            hk, at, w = own[lo:hi], picked[lo:hi] - a, self.word_w[a:b]
            q = hk @ w.T
            q += self.word_b[a:b]
            q -= q.max(axis=1, keepdims=True)
            rows = every[: hi - lo]
            chosen[lo:hi] = q[rows, at]
            p = np.exp(q, out=q)
            total = p.sum(axis=1)
            chosen[lo:hi] -= np.log(total)
            if grad:
                p /= total[:, None]
                p[rows, at] -= 1
                np.matmul(p, w, out=d_own[lo:hi])
                np.matmul(p.T, hk, out=gs["word_w"][a:b])
                gs["word_b"][a:b] = p.sum(axis=0)
        out[order] += chosen
        if grad:
            dh[order] += d_own
        return (out, dh, gs) if grad else out

    def backward(self, x: np.ndarray, kept: tuple, dhs: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gates at each step and of the recurrent weights; the state before the window is a constant, and that before a ``start`` is zero."""
        d, (before, z, r, n, un) = HIDDEN, kept
        # What each gate's gradient takes of the state's, for all steps at once.
        of_n = (1 - z) * (1 - n * n)
        of_z, of_r = (before - n) * z * (1 - z), of_n * un * r * (1 - r)
        steps, lanes = x.shape
        dg, dn_r = np.empty((3, steps, lanes, d), n.dtype), np.empty_like(n)
        u_z, u_r, u_n = (np.ascontiguousarray(self.u[:, k : k + d].T) for k in (0, d, 2 * d))
        z, r, dh = np.ascontiguousarray(z), np.ascontiguousarray(r), np.zeros_like(dhs[0])
        for t in range(steps - 1, -1, -1):
            dh = dh + dhs[t]
            dz, dr, dn = dg[0, t], dg[1, t], dg[2, t]
            np.multiply(dh, of_z[t], out=dz)
            np.multiply(dh, of_r[t], out=dr)
            np.multiply(dh, of_n[t], out=dn)
            np.multiply(dn, r[t], out=dn_r[t])
            dh = dh * z[t] + dz @ u_z + dr @ u_r + dn_r[t] @ u_n
            if start is not None and start[t].any():
                dh = dh * ~start[t][:, None]
        by = before.reshape(-1, d).T
        du = np.concatenate([by @ p.reshape(-1, d) for p in (dg[0], dg[1], dn_r)], axis=1)
        return np.ascontiguousarray(dg.transpose(1, 2, 0, 3)).reshape(steps, lanes, 3 * d), du


def _sorted_chunks(docs: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Documents in chunks of CHUNK, the longest of each first, so that no long one is left to run alone."""
    docs = iter(docs)
    while chunk := list(itertools.islice(docs, CHUNK)):
        yield from sorted(chunk, key=len, reverse=True)


def train(net: Network, v: Vocabulary, docs: Iterable[np.ndarray]) -> int:
    """Adagrad on each window of STEPS tokens of each document's codes, once; gives the number of tokens.

    Lanes read one document after another to its end. The state runs on from
    window to window and is zero where a document begins, which is where the
    code before is an end. A lane more is opened with each window up to LANES,
    so the first steps are small ones.
    """
    acc = {k: np.full_like(p, 1e-2) for k, p in net.params().items()}
    source, more, total = _sorted_chunks(docs), True, 0
    rest: list[np.ndarray] = []
    h, last = np.zeros((0, HIDDEN), np.float32), np.zeros(0, np.int64)
    lanes = FIRST_LANES
    while True:
        # Lanes that ran out are closed, new ones opened.
        keep = [k for k, r in enumerate(rest) if len(r) or more]
        rest, h, last = [rest[k] for k in keep], h[keep], last[keep]
        if more and len(rest) < lanes:
            new = lanes - len(rest)
            rest += [np.zeros(0, np.int64)] * new
            h, last = np.concatenate([h, np.zeros((new, HIDDEN), np.float32)]), np.concatenate([last, np.full(new, END)])
        lanes = min(LANES, lanes + 1)
        y, ok = np.full((STEPS, len(rest)), END), np.zeros((STEPS, len(rest)), bool)
        for k, r in enumerate(rest):
            while more and len(r) < STEPS:
                d = next(source, None)
                more = d is not None
                if more:
                    r = np.concatenate([r, d]) if len(r) else d
            n = min(STEPS, len(r))
            y[:n, k], ok[:n, k] = r[:n], True
            rest[k] = r[n:]
        live = np.flatnonzero(ok.reshape(-1))
        if not len(live):
            return total
        total += len(live)
        before = np.concatenate([last[None], y[:-1]])
        x, begin = v.inputs(before), before == END
        cls, word = v.classes(y).reshape(-1), np.where((y >= 0) & (y < v.heads), y, -1).reshape(-1)
        hs, kept = net.states(x, begin, h)
        flat = hs.reshape(-1, HIDDEN)
        _, dlive, gs = net.log_probs(flat[live], cls[live], word[live], grad=True)
        dh = np.zeros_like(flat)
        dh[live] = dlive
        dg, gs["u"] = net.backward(x, kept, dh.reshape(hs.shape), begin)
        # Rows of the same input are summed in runs.
        flat_x = x.reshape(-1)
        order = np.argsort(flat_x, kind="stable")
        ids, at = np.unique(flat_x[order], return_index=True)
        gs["gates"] = np.add.reduceat(dg.reshape(-1, 3 * HIDDEN)[order], at)
        for k, g in gs.items():
            g *= 30 / len(live)
            rows = ids if k == "gates" else slice(None)
            a = acc[k][rows] + g * g
            acc[k][rows] = a
            np.sqrt(a, out=a)
            g *= RATE
            g /= a
            getattr(net, k)[rows] -= g
        h, last = hs[-1], y[-1]


def log_likelihoods(net: Network, v: Vocabulary, docs: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log probability of each document's codes: network words whole, others their class.

    Documents follow one another in lanes; the state runs on through a document
    over all its windows and is zero at its start.
    """
    if not docs:
        return np.zeros(0)
    lanes = min(lanes, len(docs))
    fill, own = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = heapq.heappop(heap)
        own[k].append(i)
        fill[k] = n + len(docs[i])
        heapq.heappush(heap, (fill[k], k))
    # Longest lanes first, so that the lanes still running are a leading run.
    by = np.argsort(-fill, kind="stable")
    own, fill = [i for k in by for i in own[k]], fill[by]
    sizes = np.array([len(docs[i]) for i in own])
    codes, doc = np.concatenate([docs[i] for i in own]).astype(np.int32), np.repeat(np.array(own, np.int32), sizes)
    start = np.zeros(len(codes), bool)
    start[np.cumsum(sizes) - sizes] = True
    before = np.append(np.int32(END), codes[:-1])
    before[start] = END
    x, cls, word = v.inputs(before).astype(np.int32), v.classes(codes).astype(np.int32), np.where((codes >= 0) & (codes < v.heads), codes, -1)
    offset = np.cumsum(fill) - fill
    h, lp = np.zeros((lanes, HIDDEN), np.float32), np.empty(len(codes), np.float32)
    for t in range(0, int(fill[0]), steps):
        live = int((fill > t).sum())
        place = np.arange(t, t + steps)[:, None]
        at = offset[:live] + place
        if fill[live - 1] < t + steps:
            ok = place < fill[:live]
            at = np.where(ok, at, 0)
            hs, _ = net.states(x[at], start[at] & ok, h[:live])
            h, hs, at = hs[-1], hs[ok], at[ok]
        else:
            hs, _ = net.states(x[at], start[at], h[:live])
            h, hs, at = hs[-1], hs.reshape(-1, HIDDEN), at.reshape(-1)
        lp[at] = net.log_probs(hs, cls[at], word[at])
    return np.bincount(doc, lp, len(docs))


def _coder(v_bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes of whole texts as 32-bit numbers, and the words that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(v_bytes.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                own, lost = [], []
                for x in part.column(4):
                    c, rare = v.codes(tokens(x.as_py()))
                    own.append(c.astype("<i4").tobytes())
                    lost.append(rare)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(own, pa.binary()), pa.array(lost, pa.list_(pa.string()))], ["rid", "doc_id", "held_out", "place", "codes", "rare"])

    return run


def _unpacked(codes: pa.Array) -> Iterator[np.ndarray]:
    for x in codes:
        yield np.frombuffer(x.as_py(), "<i4")


def _trainer(v_bytes, start) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One network for each copy of a partition, whose rows (copy, codes) come sorted by copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(v_bytes.value)
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), strict=True))
        for copy, own in itertools.groupby(rows, key=lambda r: r[0]):
            net = Network(v)
            for k, p in start.value.items():
                getattr(net, k)[...] = p
            n = train(net, v, (c for _, c in own))
            yield _parts_batch(net.params(), copy, n)

    return run


def _parts_batch(params: dict[str, np.ndarray], copy: int, n: int) -> pa.RecordBatch:
    m = len(params)
    return pa.RecordBatch.from_arrays([pa.array(list(params)), pa.array([copy] * m, pa.int32()), pa.array([n] * m, pa.int64()), pa.array([p.astype("<f4").tobytes() for p in params.values()], pa.binary())], ["part", "copy", "n", "data"])


_PARTS = "part string, copy int, n bigint, data binary"


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("copy")
    n = group["n"].to_numpy(float)
    total = sum(np.frombuffer(d, "<f4").astype(np.float64) * w for d, w in zip(group["data"], n, strict=True))
    return pd.DataFrame({"part": [group["part"].iloc[0]], "copy": [int(group["copy"].iloc[0]) // FAN_IN], "n": [int(n.sum())], "data": [(total / n.sum()).astype("<f4").tobytes()]})


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, KNOWN at most, by count and then by word: all of a count or none.

    How many words have each count is summed in bins, exact below 1024 and 64 to
    a power of two above, so the driver gets some thousand numbers and then
    these words.
    """
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("n")) - 6, F.lit(0))).cast("bigint")
    low = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.col("n") / step) * step).cast("bigint")
    least, held = None, 0
    for r in counts.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("low")).collect():
        held += r["m"]
        if held > KNOWN:
            break
        least = r["low"]
    if least is None:
        return []
    return sorted(((r["word"].encode(), r["n"]) for r in counts.filter(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of training documents, and the counts of all their words."""
    counts = stored(docs.select(_raw()).mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    ends = docs.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = _frequent(counts)
    heads = {w for w, _ in top[:HEAD]}

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
        for b in batches:
            for w, c in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in heads:
                    n[tail_class(w)] += c
                    k[tail_class(w)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(TAIL_CLASSES), pa.int32()), pa.array(n), pa.array(k)], ["cls", "n", "k"])

    per = counts.mapInArrow(tails, "cls int, n bigint, k bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()
    return Vocabulary(top, ends, sums["n"] + ends, sums["v"] + (ends > 0), {r["cls"]: (r["n"], r["k"]) for r in per}), counts


def fitted(v: Vocabulary, vb, coded: DataFrame) -> Network:
    """The network trained on rows (place, codes), every token once."""
    spark = coded.sparkSession
    net = Network(v)
    shapes = {k: p.shape for k, p in net.params().items()}
    copies = max(1, round(v.total / COPY_TOKENS))
    dealt = coded.select(F.pmod("place", F.lit(copies)).cast("int").alias("copy"), "codes", "place")
    # The first copy alone, then all others from where it ended.
    for first, last in ((0, 1), (1, copies)):
        if first == last:
            break
        start = spark.sparkContext.broadcast(net.params())
        left = last - first
        rows = dealt.withColumn("copy", F.col("copy") - first).filter((F.col("copy") >= 0) & (F.col("copy") < left)).repartitionById(left, "copy")
        parts = stored(rows.sortWithinPartitions("copy", "place").select("copy", "codes").mapInArrow(_trainer(vb, start), _PARTS), "copies")
        while left > 1:
            left = -(-left // FAN_IN)
            parts = stored(parts.groupBy("part", F.floor(F.col("copy") / FAN_IN)).applyInPandas(_averaged, _PARTS), "copies")
        for r in parts.collect():
            getattr(net, r["part"])[...] = np.frombuffer(r["data"], "<f4").reshape(shapes[r["part"]])
        start.destroy()
    return net


def _scorer(vb, nb) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(vb.value)
        net = Network(v)
        for k, p in nb.value.items():
            getattr(net, k)[...] = p
        ln10 = math.log(10)
        for b in batches:
            at = 0
            while at < b.num_rows:
                part, docs, size = b.slice(at, SCORED_DOCS), [], 0
                for c in _unpacked(part.column(3)):
                    docs.append(c)
                    size += len(c)
                    if size >= SCORED_TOKENS:
                        break
                part = part.slice(0, len(docs))
                at += len(docs)
                net_part = log_likelihoods(net, v, docs) / ln10
                known, base, tail = [], [], []
                for c in docs:
                    own = c[c >= 0]
                    known.append(int(v.known[own].sum()))
                    base.append(float(v.log_count[own].sum()))
                    cls = v.classes(c)
                    late = own[own >= v.heads]
                    tail.append(float(v.log_count[late].sum() - v.log_tail[cls[cls >= HEAD_CLASSES] - HEAD_CLASSES].sum()))
                cols = [*part.columns[:3], pa.array([len(c) for c in docs], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(net_part + np.array(tail))]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "net"])

    return run


def learnt(docs: DataFrame) -> tuple[Vocabulary, Network, DataFrame, DataFrame]:
    """Vocabulary, network, the counts of all words, and the codes of all rows, from rows (rid, doc_id, text, held_out); learns from those not held out."""
    spark = docs.sparkSession
    v, counts = vocabulary(docs.filter("NOT held_out"))
    vb = spark.sparkContext.broadcast(pickle.dumps(v))
    names = f"rid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, place bigint, codes binary, rare array<string>"
    coded = stored(docs.select("rid", "doc_id", "held_out", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "rid")), "text").alias("place"), _raw()).mapInArrow(_coder(vb), names), "codes")
    return v, fitted(v, vb, coded.filter("NOT held_out").select("place", "codes")), counts, coded


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Reads doc_id and text. Null and empty texts are one end. Repeated rows and
    null ids are documents of their own. Without training documents every token
    is unseen: base_score is 0 then, and the network keeps its start. Of words
    of equal count all or none are known to the network and the broadcast counts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"), held_out(F.col("doc_id")).alias("held_out"))
    v, net, counts, coded = learnt(rows)
    vb, nb = spark.sparkContext.broadcast(pickle.dumps(v)), spark.sparkContext.broadcast(net.params())
    names = f"rid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, base double, net double"
    parts = stored(coded.select("rid", "doc_id", "held_out", "codes").mapInArrow(_scorer(vb, nb), names), "parts")
    # Words whose counts aren't broadcast meet them here; each is rare, so no key is hot.
    rare = coded.select("rid", F.explode("rare").alias("word")).join(counts, "word").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("seen"))
    z = math.log10(v.total + v.distinct + 1)
    more = F.coalesce("more", F.lit(0.0))
    out = parts.join(rare, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("bigint").alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * z).alias("base_score"), (F.col("net") + more).alias("score"),
    )
