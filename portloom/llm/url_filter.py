"""URL filter rules by host suffix and path prefix.

A rule (host, path, verdict) fits its host and all subdomains, for paths that
start with the rule's. Each url is expanded into host suffixes at label
boundaries times path prefixes at slashes; the expressions meet the rules in
an equi-join on a 32-bit hash prefix, then the full SHA-256 digest and the
rest of the rule's path are confirmed. The longest fitting rule wins.

Only DataFrame functions run here. Rules are broadcast up to
``BROADCAST_RULES``; beyond that both sides are salted, so that a host suffix
with a third of all urls is dealt over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import lower_az

#: About 150 bytes each, 15 MB in all.
BROADCAST_RULES = 100_000
SALTS = 64


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(lower_az(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def compiled(rules: DataFrame) -> DataFrame:
    """Rules ready to join: one row for each (host, path).

    Null or empty hosts fit nothing and go; a null path is the empty one. Of
    repeated rules with different verdicts, block wins. The path is cut after
    its last slash into ``prefix`` and ``rest``.
    """
    r = rules.select(lower_az(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(F.length("host") > 0)
    one = r.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
    prefix = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    one = one.withColumn("prefix", prefix).withColumn("digest", _digest(F.col("host"), F.col("prefix")))
    return one.select(_short(F.col("digest")).alias("short"), "digest", "host", "path", "verdict")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    Reads page_id and url; other columns are ignored. Every row gives one row,
    repeated rows and null ids too. A null url, or one without ``://``, has an
    empty host and path, no rule and the verdict ``default``. Ties in the
    length of host + path go to the longer host. Urls with very many labels or
    slashes are expanded no deeper than the deepest rule, which loses nothing.
    """
    ready = compiled(rules)
    size = ready.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.max(F.size(F.split("path", "/"))).alias("slashes")).first()
    n, labels, slashes = size["n"], size["labels"] or 1, size["slashes"] or 1
    base = pages.select("page_id", "url").select(F.monotonically_increasing_id().alias("rid"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts, cuts = F.split("host", "\\."), F.split("path", "/")
    # Only the last `labels` labels and the first `slashes` slashes matter.
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(cuts), F.lit(slashes))), lambda k: F.when(k == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(cuts, 1, k - 1), "/"), F.lit("/"))))
    pairs = base.withColumn("s", F.explode(suffixes)).withColumn("p", F.explode(prefixes)).withColumn("d", _digest(F.col("s"), F.col("p"))).drop("s", "p")
    pairs = pairs.withColumn("k", _short(F.col("d")))
    r = ready.select(F.col("short").alias("k"), F.col("digest").alias("rd"), F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("hl"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"), F.col("path").alias("path")).alias("m"))
    if n <= BROADCAST_RULES:
        found = pairs.join(F.broadcast(r), "k", "left")
    else:
        salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")
        found = pairs.withColumn("salt", salt).join(r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["k", "salt"], "left")
    fits = (F.col("d") == F.col("rd")) & F.col("path").startswith(F.col("m.path"))
    # The expressions of a url lie together, so the partial aggregate leaves one row of each before the shuffle.
    best = found.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(fits, F.col("m"))).alias("m"))
    return best.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
