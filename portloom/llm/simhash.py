"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits votes over the XXH64 of all three-word shingles. Two
fingerprints with three differing bits at most differ in one bit at most in
one of their two 32-bit halves. So each distinct fingerprint is stored in two
tables under its halves, the ball of radius one around each half is looked up,
and the full distance is verified. (Of two halves that differ in one bit, only
the one with a zero there looks: 17 keys on average instead of 33.)

Halves shared by more than ``HOT`` distinct fingerprints don't pair their
members. For them balls in the other half meet in keys: a key that one member
reaches with one flip and others with two holds only members that are linked
or linked through it, so each is joined to the least - rows grow with the
members, not with their square, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import raw_of, stored
from portloom.llm.components import roots

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Distinct fingerprints in one half's bucket from which its members are linked without pairs.
HOT = 256
#: Shingles hashed at a time, so that a very long text needs no more memory than others.
BLOCK = 1 << 16
_ONES = np.uint64(0x0101010101010101)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set; eight counters of one byte lie in a word."""
    n = len(hashes)
    whole = np.zeros(-(-n // 255) * 255, np.uint64)
    whole[:n] = hashes
    rows = whole.reshape(-1, 255)
    out = np.empty((8, 8), np.int64)
    for bit in range(8):
        sums = ((rows >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)
        out[:, bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(text: str | bytes | None) -> int:
    """Unsigned fingerprint of a whole text or its UTF-8; 0 for a text without words. Bytes lower-case A-Z only and split at the words' separators only."""
    words = (raw_of(text) if isinstance(text, str) else text).lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        found = [digest(b"%b %b %b" % (a, b, c), SEED) for a, b, c in zip(part, part[1:], part[2:], strict=False)]
        votes += _votes(np.array(found, np.uint64))
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])


def fingerprints(docs: DataFrame, key: str) -> DataFrame:
    """(id, fp) for every row; ``fp`` as a signed long."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp bigint")


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * side).bitwiseAND(F.lit(0xFFFFFFFF))


def _masks(most: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(32), k)]


def _met(members: DataFrame) -> DataFrame:
    """Edges to the least member of each key (key columns k1, k2, k3) that someone reaches with one flip at most."""
    keys = ["k1", "k2", "k3"]
    least = members.groupBy(*keys).agg(F.min("fp").alias("m"), F.min("flips").alias("f"), F.count(F.lit(1)).alias("n")).filter("f <= 1 AND n > 1")
    return members.join(least, keys).filter("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct()


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``, enough to connect all that link.

    Every edge is a link (three bits at most) or joins two that are linked
    through a third.
    """
    tables = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _half(F.col("fp"), s).alias("half")) for s in (0, 1)])).alias("t")).select("fp", "t.side", "t.half")
    busy = stored(tables.groupBy("side", "half").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("side", "half"), "busy")
    zero_bits = F.filter(F.array(*[F.lit(1 << b).cast("bigint") for b in range(32)]), lambda m: F.col("half").bitwiseAND(m) == 0)
    probes = tables.withColumn("key", F.explode(F.concat(F.array(F.col("half")), F.transform(zero_bits, lambda m: F.col("half").bitwiseOR(m)))))
    some = busy.limit(1).count() > 0
    if some:
        mark = lambda t, name, key: t.join(busy.select("side", F.col("half").alias(key), F.lit(True).alias(name)), ["side", key], "left").fillna(False, [name])
        tables_, probes = mark(tables, "busy", "half"), mark(mark(probes, "own_busy", "half"), "key_busy", "key")
    else:
        tables_ = tables
    a, b = probes.alias("a"), tables_.select("side", F.col("half").alias("key"), F.col("fp").alias("other"))
    if some:
        # Pairs of which both buckets are busy are left to the keys below.
        a = a.filter("NOT (own_busy AND key_busy)")
    pairs = a.join(b, ["side", "key"]).filter((F.col("key") != F.col("half")) | (F.col("fp") < F.col("other")))
    near = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    if not some:
        return near
    members = tables.join(busy, ["side", "half"]).withColumn("rest", F.when(F.col("side") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0)))
    flip = lambda most: F.explode(F.array(*[F.lit(m).cast("bigint") for m in _masks(most)]))
    same = members.withColumn("mask", flip(2)).select("fp", F.col("side").alias("k1"), F.col("half").alias("k2"), F.col("rest").bitwiseXOR(F.col("mask")).alias("k3"), F.bit_count("mask").alias("flips"))
    # One bit of the busy half apart: both fold that bit to one, the bit's place is part of the key.
    bit = F.explode(F.sequence(F.lit(0), F.lit(31)))
    folded = members.withColumn("bit", bit).withColumn("mask", flip(1)).select("fp", (F.col("side") + 2 * (F.col("bit") + 1)).alias("k1"), F.col("half").bitwiseOR(F.expr("shiftleft(1L, bit)")).alias("k2"), F.col("rest").bitwiseXOR(F.col("mask")).alias("k3"), F.bit_count("mask").alias("flips"))
    return near.union(_met(same)).union(_met(folded))


def grouped(docs: DataFrame, key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(id, fp, root): every row with the least fingerprint of its component, over all rows."""
    fps = stored(fingerprints(docs, key), "fingerprints")
    distinct = fps.select("fp").distinct()
    found = roots(links(distinct, hot))
    return fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("id", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row.

    component_id is the least doc_id of all documents reachable over links, the
    document itself included; null ids count only where a component has no
    other. Null, empty and blank texts have fingerprint zero and link like
    others; a text of fewer than three words is one shingle. Repeated rows stay.
    Only doc_id and text are read.
    """
    g = grouped(docs.select("doc_id", "text"), hot=hot)
    # Least id of each distinct fingerprint first, so that copies fold before the shuffle.
    per = g.groupBy("root").agg(F.min("id").alias("component_id"))
    return g.join(per, "root").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def thinned(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns it came with: the one with the least doc_id (null last), of equal ones the first read."""
    own = {c: c if c in ("text", "doc_id") else f"c{i}" for i, c in enumerate(docs.columns)}
    rows = stored(docs.toDF(*own.values()).withColumn("_rid", F.monotonically_increasing_id()), "rows")
    g = grouped(rows.select("_rid", "text"), key="_rid")
    ranked = g.join(rows.select(F.col("_rid").alias("id"), "doc_id"), "id")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "id")
    first = ranked.groupBy("root").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "first.id")
    losers = g.join(first.withColumnRenamed("id", "stays"), "root").filter("id <> stays").select(F.col("id").alias("_rid"))
    return rows.join(losers, "_rid", "left_anti").select(*[F.col(n).alias(c) for c, n in own.items()])
