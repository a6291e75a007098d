"""Removal of repeated byte strings, by bucket-pointer refinement.

A byte goes if some string of ``UNIT`` bytes over it also starts anywhere else.
Suffixes are first put into q-gram buckets: in every window of UNIT bytes the
q-gram of least hash, its anchor, is chosen by content alone, so equal windows
have equal anchors at equal places and only windows whose anchors share a
bucket can be equal. One anchor serves the run of windows in which it is the
least, some 90 on average, so buckets hold runs instead of single bytes, and
buckets of one run drop out at once.

Runs whose bytes are all the same need no more. The rest of each bucket is
refined: its windows are sorted by 8-byte prefixes, and each round sorts those
still tied by the bucket pointer of the suffix 8, 16, 32, 64 and at last 72
bytes on. Pointers updated in one round are what the next one reads, and
suffixes alone in their bucket are not touched again. Windows with the same
pointer in the end agree in all UNIT bytes.

A bucket with more than ``HOT`` different runs isn't brought to one task;
each of its windows becomes a row with a 128-bit digest, and rows are counted.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import shared_dir, stored

UNIT, QGRAM = 200, 24
WINDOW = UNIT - QGRAM + 1
#: Bytes whose anchors are found at a time; places within them fit into 21 bits.
BLOCK, PLACE = 1 << 20, (1 << 21) - 1
#: Bytes of runs refined at a time, if whole buckets allow.
REFINED = 4 << 20
HOT = 50_000
#: Rows of one key from which they are salted, salts, and the most keys that can be heavy.
HEAVY, SALTS, HEAVY_KEYS = 5_000, 64, 10_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place."""
    n = len(x) - QGRAM + 1
    words = np.ndarray(len(x) - 7, "<u8", x, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        h += words[k : k + n]
        h *= np.uint64(m)
        h ^= h >> np.uint64(32)
    return h


def runs(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor, hash) of the runs of windows that share an anchor; ``valid`` says which windows count.

    ``x``: up to twice BLOCK bytes. Of equally small q-grams the leftmost is the anchor.
    """
    g = _mixed(x)
    low = (g & np.uint64(~PLACE & (2**64 - 1))) | np.arange(len(g), dtype=np.uint64)
    n, width = len(x) - UNIT + 1, 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    at = (np.minimum(low[:n], low[WINDOW - width : WINDOW - width + n]) & np.uint64(PLACE)).astype(np.int64)
    edge = np.ones(n, bool)
    edge[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n) - 1
    ok = valid[start]
    start, end = start[ok], end[ok]
    return start, end, at[start], g[at[start]]


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of bytes, and where each begins; null is empty."""
    col = pa.array(col.to_pylist(), pa.large_binary()) if pa.types.is_string_view(col.type) else col.cast(pa.large_binary()).fill_null(b"")
    if col.offset:
        col = pa.concat_arrays([col])
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed(start: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Start, place of the anchor after it and length of a run in one number."""
    return (start << 16) | ((anchor - start) << 8) | (end - start)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = _bytes(b.column(2))
        k1, k2 = (np.asarray(b.column(i)) for i in (0, 1))
        for at in range(0, max(len(data) - UNIT + 1, 0), BLOCK):
            part = data[at : at + BLOCK + UNIT - 1]
            n = len(part) - UNIT + 1
            # Windows that don't cross into the next text.
            row = np.searchsorted(offsets, np.arange(at, at + n), side="right") - 1
            valid = np.arange(at, at + n) + UNIT <= offsets[row + 1]
            if not valid.any():
                continue
            # Runs also end where a text does: the last windows of a text are never valid for the next.
            start, end, anchor, h = runs(np.ascontiguousarray(part), valid)
            r = row[start]
            base = at - offsets[r]
            out = [pa.array(k1[r]), pa.array(k2[r]), pa.array(h.view(np.int64)), pa.array(packed(start + base, end + base, anchor + base))]
            yield pa.RecordBatch.from_arrays(out, ["k1", "k2", "h", "pack"])


def _unpacked(pack: int) -> tuple[int, int, int]:
    """First window, its last after the first, and bytes in all."""
    span = pack & 255
    return pack >> 16, span, span + UNIT


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each run's bytes, from rows (k1, k2, text, [(h, pack)])."""
    for b in batches:
        k1, k2, hs, packs, digests = [], [], [], [], []
        for a, c, t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            raw = t.as_py().encode()
            for x in own.as_py():
                i, _, n = _unpacked(x["pack"])
                d = xxhash.xxh3_64_intdigest(raw[i : i + n], 1)
                digests.append(d - (1 << 64) if d >> 63 else d)
                hs.append(x["h"])
                packs.append(x["pack"])
                k1.append(a)
                k2.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (k1, k2, hs, packs, digests)], ["k1", "k2", "h", "pack", "ctx"])


def _shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of runs that need refinement, from rows (k1, k2, text, [(h, pack, n)])."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            cols: list[list] = [[] for _ in range(6)]
            for a, c, t, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                raw = t.as_py().encode()
                for x in own.as_py():
                    i, _, n = _unpacked(x["pack"])
                    for v, y in zip(cols, (x["h"], x["n"], a, c, x["pack"], raw[i : i + n]), strict=True):
                        v.append(y)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], ["h", "n", "k1", "k2", "pack", "data"])


def refined(x: np.ndarray) -> np.ndarray:
    """Bucket pointers of the suffixes of ``x`` at depth UNIT: two suffixes with UNIT bytes left have the same one if those are equal."""
    n = len(x) - 7
    words = np.ndarray(n, ">u8", x, strides=(1,)).astype(np.uint64)
    order = np.argsort(words, kind="stable")
    ptr = np.empty(n, np.int64)

    def point(members: np.ndarray, slots: np.ndarray, new: np.ndarray) -> None:
        """Points ``members``, in order, to the last slot of their bucket; ``new`` marks where buckets begin."""
        ends = np.append(np.flatnonzero(new)[1:], len(members)) - 1
        ptr[members] = np.repeat(slots[ends], np.diff(np.append(np.flatnonzero(new), len(members))))

    v = words[order]
    point(order, np.arange(n), np.append(True, v[1:] != v[:-1]))
    depth = 8
    while depth < UNIT:
        step = min(depth, UNIT - depth)
        held = ptr[order]
        tied = np.zeros(n, bool)
        same = held[1:] == held[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        members = order[slots]
        ahead = members + step
        later = np.where(ahead < n, ptr[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((later, ptr[members]))
        members, later = members[by], later[by]
        own = ptr[members]
        order[slots] = members
        point(members, slots, np.append(True, (own[1:] != own[:-1]) | (later[1:] != later[:-1])))
        depth += step
    return ptr


def _refine(rows: list[tuple]) -> Iterator[tuple]:
    """(k1, k2, pack, lo, hi): windows lo..hi of a run that occur elsewhere, for runs that occur once."""
    data = b"".join(r[5] for r in rows)
    ptr = refined(np.frombuffer(data, np.uint8))
    spans = np.array([r[4] & 255 for r in rows], np.int64)
    base = np.cumsum([0, *(len(r[5]) for r in rows[:-1])])
    which = np.repeat(np.arange(len(rows)), spans + 1)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(spans + 1) - spans - 1, spans + 1)
    bucket = ptr[base[which] + inner]
    times = np.bincount(bucket, weights=np.array([r[1] for r in rows], float)[which], minlength=len(data))
    twice = times[bucket] > 1.5
    first = np.flatnonzero(twice & ~np.append(False, twice[:-1] & (which[1:] == which[:-1])))
    last = np.flatnonzero(twice & ~np.append(twice[1:] & (which[1:] == which[:-1]), False))
    for f, e in zip(first, last, strict=True):
        r = rows[which[f]]
        if r[1] == 1:
            yield r[2], r[3], r[4], int(inner[f]), int(inner[e])


_SPANS = "k1 bigint, k2 bigint, pack bigint, lo int, hi int"


def _spans_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["k1", "k2", "pack", "lo", "hi"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refines whole buckets of a partition sorted by anchor hash, some at a time."""
    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if rows and rows[-1][0] != r[0]:
                if size >= REFINED:
                    yield _spans_batch(list(_refine(rows)))
                    rows, size = [], 0
            rows.append(r)
            size += len(r[5])
    if rows:
        yield _spans_batch(list(_refine(rows)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of runs in hot buckets: a 128-bit digest of its UNIT bytes."""
    for b in batches:
        for h, n, k1, k2, pack, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            span = pack & 255
            d = [xxhash.xxh3_128_intdigest(data[s : s + UNIT]) for s in range(span + 1)]
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            m = span + 1
            cols = [[signed(x & (2**64 - 1)) for x in d], [signed(x >> 64) for x in d], [n] * m, [k1] * m, [k2] * m, [pack] * m]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(range(m), pa.int32())], ["d1", "d2", "n", "k1", "k2", "pack", "lo"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text: (k1, k2, n_bytes, n_removed, n_spans, kept_sha256, kept), from rows (k1, k2, text, [(pack, lo, hi)])."""
    for b in batches:
        out = []
        for t, own in zip(b.column(2), b.column(3), strict=True):
            raw = t.as_py().encode()
            cover = sorted(((x["pack"] >> 16) + x["lo"], (x["pack"] >> 16) + x["hi"] + UNIT) for x in own.as_py() or [])
            at, left, removed, spans, end = 0, [], 0, 0, -1
            for s, e in cover:
                if s > end:
                    spans += 1
                    left.append(raw[at:s])
                    removed += e - s
                else:
                    removed += max(0, e - end)
                end = max(end, e)
                at = max(at, end)
            left.append(raw[at:])
            kept = b"".join(left)
            out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _digests(text: Column) -> tuple[Column, Column]:
    """The two halves of a text's MD5 as signed numbers."""
    d = F.md5(text)
    return tuple(F.conv(F.substring(d, at, 16), 16, -10).cast("bigint") for at in (1, 17))


def _keys(docs: DataFrame) -> DataFrame:
    """A digest of 128 bits stands for each text; equal texts are one text with copies."""
    t = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = _digests(t)
    return docs.withColumn("text", t).withColumn("k1", k1).withColumn("k2", k2)


def _met(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` is among stored ``keys`` (each once, with the number ``n`` of its rows), with the keys' other columns.

    Rows of heavy keys are salted by their text, and these keys copied for each
    salt. A key is heavy with more than HEAVY rows and more than a part in
    HEAVY_KEYS of all, so there are fewer of them than HEAVY_KEYS, and they are broadcast.
    """
    most = max(HEAVY, (keys.agg(F.sum("n").alias("n")).first()["n"] or 0) // HEAVY_KEYS)
    heavy = F.col("n") > most
    known = keys.filter(heavy).select(*on, F.lit(True).alias("_heavy"))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(known), on, "left").withColumn("_salt", salt).drop("_heavy")
    every = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keys.withColumn("_salt", F.explode(every)).drop("n"), [*on, "_salt"]).drop("_salt")


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """Different texts with the number of documents that have them, bucketed by their keys in the shared folder, and the table's name.

    Bucketed, they are joined three times below and shuffled once.
    """
    spark = docs.sparkSession
    # First texts are partial aggregates: a group of copies folds before the shuffle.
    one = docs.select("k1", "k2", "text").groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"portloom_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, "k1", "k2").saveAsTable(name)
    return spark.table(name), name


def repeated(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(k1, k2, pack, lo, hi): the windows that occur elsewhere, from different texts with their copies."""
    keys = ["k1", "k2"]
    every = texts.filter("octet_length(text) >= 200").select(*keys, "text")
    anchors = stored(every.mapInArrow(_anchors, "k1 bigint, k2 bigint, h bigint, pack bigint"), "anchors")
    # Buckets of one run end here.
    shared = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchor_counts")
    own = stored(_met(anchors, shared, ["h"]).groupBy(*keys).agg(F.collect_list(F.struct("h", "pack")).alias("own")), "shared")
    found = stored(texts.select(*keys, "text").join(own, keys).mapInArrow(_contexts, "k1 bigint, k2 bigint, h bigint, pack bigint, ctx bigint"), "contexts")
    # One run for each different content, with how often it occurs.
    different = stored(found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*keys, "pack"), F.col("pack")).alias("at")), "different")
    whole = _met(found, different.filter("n > 1").select("h", "ctx", "n"), ["h", "ctx"]).select(*keys, "pack", F.lit(0).alias("lo"), F.col("pack").bitwiseAND(F.lit(255)).cast("int").alias("hi"))
    unsettled = stored(different.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).filter("n > 1 AND least = 1").select("h", "n", F.col("n").alias("m")), "unsettled_anchors")
    todo = _met(different.select("h", "n", F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"), F.col("at.pack").alias("pack")), unsettled, ["h"]).select("h", "n", *keys, "pack", (F.col("m") > hot).alias("hot"))
    todo = stored(todo.groupBy(*keys, "hot").agg(F.collect_list(F.struct("h", "pack", "n")).alias("own")), "unsettled")

    def bytes_of(rows: DataFrame) -> DataFrame:
        return texts.select(*keys, "text").join(rows.select(*keys, "own"), keys).mapInArrow(_shipped, "h bigint, n bigint, k1 bigint, k2 bigint, pack bigint, data binary")

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = bytes_of(todo.filter("NOT hot")).repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_buckets, _SPANS)
    out = whole.union(cold)
    if todo.filter("hot").limit(1).count():
        each = stored(bytes_of(todo.filter("hot")).mapInArrow(_windows, "d1 bigint, d2 bigint, n bigint, k1 bigint, k2 bigint, pack bigint, lo int"), "windows")
        twice = each.groupBy("d1", "d2").agg(F.sum("n").alias("n")).filter("n > 1").select("d1", "d2")
        out = out.union(each.filter("n = 1").join(twice, ["d1", "d2"]).select(*keys, "pack", "lo", F.col("lo").alias("hi")))
    return out


def trimmed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes left) for every row.

    Reads doc_id and text. Null texts are empty, texts below UNIT bytes stay
    whole, copies of a text of UNIT bytes or more go whole - all of them, as
    each repeats the others. Repeated rows and null ids count as documents.
    """
    keyed = _keys(docs.select("doc_id", "text"))
    texts, name = _texts(keyed)
    spans = repeated(texts, hot)
    per = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("pack", "lo", "hi")).alias("own"))
    kept = texts.filter("copies = 1 OR octet_length(text) < 200").select("k1", "k2", "text").join(per, ["k1", "k2"], "left")
    left = kept.mapInArrow(_kept, "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    copies = texts.filter("copies > 1 AND octet_length(text) >= 200")
    n = F.octet_length("text").cast("bigint")
    gone = copies.select("k1", "k2", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    out = keyed.select("doc_id", "k1", "k2").join(left.union(gone), ["k1", "k2"]).drop("k1", "k2")
    # The plan holds the files; the catalog need not keep their name.
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return trimmed(docs, hot).drop("kept")
