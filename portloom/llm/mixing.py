"""Mixing sources to target weights without sorting the documents.

Each document has a key of 45 hexadecimal digits: 15 of a hash of its id, 15 of
its text, 15 of its place in the input. Sizes are summed by (source, leading
digits); the running sums name the bucket in which a source's budget ends, and
only that bucket's rows are summed again by the next digits, until it holds one
document. A document's extra copy is taken if its key lies below the threshold,
so thresholds for growing budgets are nested: a larger mix holds the smaller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portloom.llm.common import SPACE_CLASS, small, stored

#: Digits refined at a time (4096 buckets), digits of each of a key's three parts, and of the whole key.
DIGITS, PART = 3, 15
KEY = 3 * PART
WEIGHTS, MOST = (5, 2, 1), 3


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACE_CLASS + "+"), "")).cast("bigint")


def key_of(doc_id: Column, text: Column, place: Column) -> Column:
    """MD5 of the id as text, then of the text, then of the place; a null counts as empty. Rows alike in id and text differ in place only, and which of them is taken makes no difference."""
    part = lambda c: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, PART)
    return F.concat(part(doc_id), part(text), part(place))


def ranked(sources: DataFrame) -> DataFrame:
    """``i``: each source's rank by code point, null last. Ranges of sources are numbered apart; the driver holds a count for each range."""
    by = F.col("source").asc_nulls_last()
    ranges = stored(sources.repartitionByRange(by).withColumn("range", F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for r in ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():
        before[r["range"]] = total
        total += r["n"]
    if not before:
        return ranges.withColumn("i", F.lit(0).cast("bigint")).drop("range")
    first = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("range"))
    return ranges.withColumn("i", first + F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1).drop("range")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for each source, from rows (source, size).

    Sources by code point, null last, weigh 5, 2, 1, repeating. Shares that
    would exceed ``MOST`` times their source stop there and the excess goes to
    the others by weight: the level of the others rises until it caps no more.
    Each round is a sum over the sources.
    """
    s = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("i") % len(WEIGHTS) + 1).cast("int"))
    s = stored(s.withColumn("w", w).withColumn("cap", MOST * F.col("source_size")).select("source", "source_size", "w", "cap"), "sources")
    total = s.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") / F.col("w") <= F.lit(level)
        r = s.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (total - (r["cap"] or 0)) / r["w"]
    top = F.col("cap").cast("double")
    return s.select("source", "source_size", top.alias("target") if level is None else F.when(F.col("cap") / F.col("w") <= F.lit(level), top).otherwise(F.col("w") * F.lit(level)).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, ``edge`` and ``whole``: documents whose key begins below ``edge`` are taken once more, and those that begin with it if ``whole``.

    sizes: (source, size, key); budgets: (source, budget) in words. The edge is
    where the sum of sizes comes nearest to the budget; of two equally near the
    lower. After the first round only rows of boundary buckets are read.
    """
    rows = sizes
    state = stored(budgets.select("source", F.lit("").alias("edge"), F.lit(0).cast("bigint").alias("sum"), "budget"), "budgets")
    settled = []
    for n in range(DIGITS, KEY + 1, DIGITS):
        s, d = small(state).alias("s"), rows.withColumn("cell", F.substring("key", 1, n)).alias("d")
        inside = F.col("d.source").eqNullSafe(F.col("s.source")) & F.col("d.cell").startswith(F.col("s.edge"))
        cells = stored(d.join(s, inside).groupBy(F.col("s.source").alias("source"), F.col("d.cell").alias("cell")).agg(F.sum("d.size").alias("n"), F.count(F.lit(1)).alias("m")), f"cells{n}")
        # At most 4096 cells of a source meet here.
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        c = cells.withColumn("upto", F.sum("n").over(run)).alias("c").join(small(state).alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        before = F.col("s.sum") + F.col("c.upto") - F.col("c.n")
        # The last cell that begins within the budget is the boundary.
        last = F.max(F.struct(F.col("c.cell").alias("edge"), before.alias("sum"), F.col("c.n").alias("n"), F.col("c.m").alias("m"), F.col("s.budget").alias("budget")))
        edge = stored(c.filter(before <= F.col("s.budget")).groupBy(F.col("s.source").alias("source")).agg(last.alias("e")).select("source", "e.*"), f"edge{n}")
        over = F.col("sum") + F.col("n") - F.col("budget")
        # A cell of one document, or one that the budget just fills or doesn't enter, needs no refinement.
        done = (F.col("m") == 1) | (over == 0) | (F.col("sum") == F.col("budget")) | F.lit(n == KEY)
        settled.append(edge.filter(done).select("source", "edge", (over < F.col("budget") - F.col("sum")).alias("whole")))
        state = edge.filter(~done).select("source", "edge", "sum", "budget")
        if not state.limit(1).count():
            break
        e = small(state.select(F.col("source").alias("_source"), F.col("edge").alias("_edge")))
        rows = stored(rows.join(e, F.col("source").eqNullSafe(F.col("_source")) & F.col("key").startswith(F.col("_edge"))).select("source", "size", "key"), f"boundary{n}")
    return reduce(DataFrame.unionByName, settled)


def mixed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and size, source_size, target, taken for every row of ``docs``.

    A source's target holds each document floor(target / source_size) times
    whole; what is left of the target is its budget for one more copy of the
    documents below the threshold. Reads doc_id, text and source. Null texts
    have size 0, a null source is a source. Rows with equal ids, null ids too,
    are told apart by their texts, equal rows by their place. A source of size 0
    takes nothing. No documents: no rows.
    """
    key = key_of(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id())
    sizes = stored(docs.select(*keep, F.col("source").alias("_source"), size_of(F.col("text")).alias("_size"), key.alias("_key")), "sizes")
    flat = sizes.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key"))
    goal = stored(targets(flat), "targets").withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    edges = thresholds(flat, goal.select("source", "budget")).select(F.col("source").alias("_s"), "edge", F.col("whole").alias("last"))
    g = small(goal.join(edges, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.struct("source", "source_size", "target", "whole", "edge", "last").alias("_g")))
    out = sizes.join(g, F.col("_source").eqNullSafe(F.col("_g.source")), "left")
    start = F.substring(F.col("_key"), F.lit(1), F.length("_g.edge"))
    extra = F.coalesce((start < F.col("_g.edge")) | ((start == F.col("_g.edge")) & F.col("_g.last")), F.lit(False))
    times = F.least(F.col("_g.whole") + extra.cast("int"), F.lit(MOST))
    return out.select(*keep, F.col("_size").alias("size"), F.col("_g.source_size").alias("source_size"), F.col("_g.target").alias("target"), (F.col("_size") * times).cast("bigint").alias("taken"), times.cast("int").alias("_times"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixed(docs.select("doc_id", "text", "source"), ["doc_id"]).drop("_times")


def replicated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    own = {c: c if c in ("text", "source", "doc_id") else f"c{i}" for i, c in enumerate(docs.columns)}
    out = mixed(docs.toDF(*own.values()), [*own.values()]).filter("_times > 0")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(n).alias(c) for c, n in own.items()])
