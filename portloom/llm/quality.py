"""Quality rules with thresholds adapted to each language and source.

Every document gets five measures and five rates. The rates of all documents
are gathered in mergeable quantile sketches, one for each (lang, source): a
sketch is a histogram over logarithmic bins (16 per power of two, below 32
exact), so merging is adding counts, the result does not depend on the order
of merging, and a quantile is off by one sixteenth at most. Fences come from
the sketch's quartiles. Groups with few documents use the sketch of their
language, then that of the corpus, both merged from the same rows.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import small, stored

#: Rates by name, with the slack that a fence leaves at least: an upper fence is
#: q75 + SPREAD * (q75 - q25) + slack, a lower one q25 - SPREAD * (q75 - q25) - slack.
#: Per mille, but for word length, which is in hundredths of a character.
#: A source whose quartiles are equal leaves the slack alone, so each lies where a text stands out: that of
#: repeats below the 200 at which the base rule fails a text.
SLACK = {"symbols": 100, "caps": 50, "repeats": 100, "dup_lines": 200, "word_len": 150}
TWO_SIDED = ("word_len",)
SPREAD = 4
#: Documents that a group needs for thresholds of its own.
MIN_GROUP = 100
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """Array of words; empty for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``_q``: a struct of the measures and helpers."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = docs.withColumn("_q", F.struct(
        words(F.col(text)).alias("w"),
        F.filter(F.split(t, "\\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
    ))
    w = F.col("_q.w")
    # One hash per window of five words; none for a text of fewer words.
    hashes = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    more = plain.withColumn("_q", F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))).cast("bigint").alias("n_caps"),
        F.size("_q.lines").cast("bigint").alias("n_lines"),
        (F.size("_q.lines") - F.size(F.array_distinct("_q.lines"))).cast("bigint").alias("n_dup_lines"),
        hashes.alias("h"),
    ))
    h = F.col("_q.h")
    ranked = more.withColumn("_r", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    r, n = F.col("_r"), F.size("_r")
    at = F.filter(r, lambda x, k: ((k > 0) & (F.get(r, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k < n - 1) & (F.get(r, F.least(k + 1, n - 1))["h"] == x["h"])))
    # A fold over the sorted positions: each window adds the words that the one before did not cover.
    covered = F.aggregate(
        F.array_sort(F.transform(at, lambda x: x["i"])),
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(5), i - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    q = F.col("_q")
    return ranked.withColumn("_q", F.struct(
        q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), q["n_caps"].alias("n_caps"), q["n_lines"].alias("n_lines"),
    )).drop("_r")


def _rate(name: str) -> Column:
    """The rate as a whole number; 0 where there are no words."""
    q = F.col("_q")
    over, under = {
        "symbols": (1000 * q["n_symbols"], q["n_words"]),
        "caps": (1000 * q["n_caps"], q["word_chars"]),
        "repeats": (1000 * q["n_repeat_words"], q["n_words"]),
        "dup_lines": (1000 * q["n_dup_lines"], q["n_lines"]),
        "word_len": (100 * q["word_chars"], q["n_words"]),
    }[name]
    return F.coalesce(F.floor(over / F.when(under > 0, under)), F.lit(0)).cast("bigint")


def bin_of(v: Column) -> Column:
    """Sketch bin of a whole number >= 0, as the bin's least value: exact below 32, then 16 to a power of two."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 5, F.lit(0))).cast("bigint")
    return (F.floor(v / step) * step).cast("bigint")


def thresholds(rated: DataFrame) -> DataFrame:
    """One row for each (lang, source) with its fences ``hi_<rate>`` and ``lo_<rate>``.

    Base-failed documents stay out of the sketches. Rows are first summed by
    (lang, source, rate, bin), so a source with a third of all rows costs no
    task more than others.
    """
    ok = rated.filter(~F.col("_q.base_failed"))
    long = ok.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(k).alias("rate"), bin_of(F.col("_q")[k]).alias("bin")) for k in SLACK])))
    cells = stored(long.groupBy("lang", "source", "rate", "bin").agg(F.count(F.lit(1)).alias("n")), "cells")

    def sketch(level: int, *keys: str) -> DataFrame:
        by = cells if level == 2 else cells.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
        cols = [F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("s"), F.sum("n").alias("total")]
        return by.groupBy(*keys, "rate").agg(*cols)
    def quantile(s: Column, total: Column, num: int) -> Column:
        """Least bin at which the running count reaches num/100 of the total."""
        return F.aggregate(s, F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("v")),
            lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(a["v"].isNull() & ((a["c"] + x["n"]) * 100 >= total * num), x["bin"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])
    def fences(level: int, *keys: str) -> DataFrame:
        q = sketch(level, *keys).select(*keys, "rate", "total", quantile(F.col("s"), F.col("total"), 25).alias("q25"), quantile(F.col("s"), F.col("total"), 75).alias("q75"))
        slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("rate"))
        width = SPREAD * (F.col("q75") - F.col("q25")) + slack
        pick = lambda k, v: F.max(F.when(F.col("rate") == k, v))
        return q.groupBy(*keys).agg(F.max("total").alias("total"), *[pick(k, F.col("q75") + width).alias(f"hi_{k}") for k in SLACK], *[pick(k, F.col("q25") - width).alias(f"lo_{k}") for k in TWO_SIDED])
    names = [f"hi_{k}" for k in SLACK] + [f"lo_{k}" for k in TWO_SIDED]
    own, lang, every = fences(2, "lang", "source").alias("a"), fences(1, "lang").alias("b"), fences(0).first()
    joined = own.join(lang, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    enough = lambda t: F.col(f"{t}.total") >= MIN_GROUP
    corpus = lambda k: F.lit(every[k] if every is not None else None).cast("bigint")
    return joined.select("a.lang", "a.source", *[F.when(enough("a"), F.col(f"a.{k}")).when(enough("b"), F.col(f"b.{k}")).otherwise(corpus(k)).alias(k) for k in names])


def rated(docs: DataFrame) -> DataFrame:
    """``docs`` with measures, ``base_failed`` and rates in the struct ``_q``."""
    m = measured(docs)
    q = F.col("_q")
    base = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return m.withColumn("_q", F.struct(*[q[k].alias(k) for k in (*MEASURES, "n_caps", "n_lines")], base.alias("base_failed"), *[_rate(k).alias(k) for k in SLACK]))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` with the struct ``_q`` of measures and the verdict ``_q.kept``.

    Columns read: text, lang, source. Null texts count as empty, null languages
    and sources as groups of their own. Every input row gives one row, repeated
    rows too; the columns in ``keep`` stay (none may begin with ``_``; the
    callers rename). The measures of all documents are written to the shared
    folder once, then joined with the thresholds.
    """
    table = stored(rated(docs).select(*dict.fromkeys([*keep, "lang", "source"]), "_q"), "measured")
    fences = stored(thresholds(table), "thresholds")
    t = small(fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*[c for c in fences.columns if c not in ("lang", "source")]).alias("_t")))
    joined = table.join(t, table["lang"].eqNullSafe(F.col("_lang")) & table["source"].eqNullSafe(F.col("_source")), "left")
    q = F.col("_q")
    fits = ~q["base_failed"]
    for k in SLACK:
        fits = fits & F.coalesce(q[k] <= F.col("_t")[f"hi_{k}"], F.lit(True))
    for k in TWO_SIDED:
        fits = fits & F.coalesce(q[k] >= F.col("_t")[f"lo_{k}"], F.lit(True))
    return joined.withColumn("_q", F.struct(*[q[k].alias(k) for k in (*MEASURES, *SLACK, "base_failed")], fits.alias("kept"))).drop("_t", "_lang", "_source")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, ``base_failed`` and ``kept``, one row per document."""
    out = judged(docs.select("doc_id", "text", "lang", "source"), ["doc_id"])
    q = F.col("_q")
    return out.select("doc_id", *[q[k].alias(k) for k in MEASURES], q["base_failed"].alias("base_failed"), q["kept"].alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    own = {c: c if c in ("text", "lang", "source") else f"c{i}" for i, c in enumerate(docs.columns)}
    out = judged(docs.toDF(*own.values()), [*own.values()]).filter(F.col("_q.kept"))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])
