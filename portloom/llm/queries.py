"""What the entry module registers: one thin query for each operator, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portloom.llm import lm, mixing, pieces, pii, quality, repeats, simhash, topk, toxicity, url_filter
from portloom.llm.common import table

#: (host, path, verdict) of op1's contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


#: The vocabulary file of op9; ``pieces.encoded`` takes any other.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), PIECE_MODEL, ["doc_id"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_top_k": op2_top_k,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_suffix_array": op8_suffix_array,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
}

_OP1 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_SLACK = ", ".join(f"('{k}', {v})" for k, v in quality.SLACK.items())
QUALITY_CTE = rf"""
d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM @docs@
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d
), win AS (
  SELECT rid, i, w[i:i+4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win), range(5) AS s(k) WHERE c > 1 GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_caps,
         len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid
), q AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols, CASE WHEN word_chars > 0 THEN 1000 * n_caps // word_chars ELSE 0 END AS caps,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_len
  FROM m
), slack(rate, slack) AS (VALUES {_SLACK}
), r AS (
  UNPIVOT (SELECT rid, lang, source, symbols, caps, repeats, dup_lines, word_len FROM q WHERE NOT base_failed) ON symbols, caps, repeats, dup_lines, word_len INTO NAME rate VALUE v
), b AS (
  SELECT lang, source, rate, (v // s) * s AS bin FROM (SELECT *, (2 ** greatest(length(bin(v)) - 5, 0))::BIGINT AS s FROM r)
), lev AS (
  SELECT 2 AS level, lang, source, rate, bin, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, bin, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, rate, bin, count(*) FROM b GROUP BY ALL
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS c, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM lev
), qs AS (
  SELECT level, lang, source, rate, max(total) AS total, min(bin) FILTER (c * 100 >= total * 25) AS q25, min(bin) FILTER (c * 100 >= total * 75) AS q75 FROM cum GROUP BY ALL
), f AS (
  SELECT level, lang, source, qs.rate, total, q75 + {quality.SPREAD} * (q75 - q25) + slack AS hi, CASE WHEN qs.rate = 'word_len' THEN q25 - {quality.SPREAD} * (q75 - q25) - slack END AS lo FROM qs JOIN slack USING (rate)
), g AS (
  SELECT a.lang, a.source, a.rate, CASE WHEN a.total >= {quality.MIN_GROUP} THEN a.hi WHEN l.total >= {quality.MIN_GROUP} THEN l.hi ELSE e.hi END AS hi,
         CASE WHEN a.total >= {quality.MIN_GROUP} THEN a.lo WHEN l.total >= {quality.MIN_GROUP} THEN l.lo ELSE e.lo END AS lo
  FROM f a LEFT JOIN f l ON l.level = 1 AND a.lang IS NOT DISTINCT FROM l.lang AND a.rate = l.rate LEFT JOIN f e ON e.level = 0 AND a.rate = e.rate WHERE a.level = 2
), out AS (
  SELECT rid, bool_or(v > hi OR v < coalesce(lo, v)) AS odd FROM r JOIN g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source AND r.rate = g.rate GROUP BY rid
)"""
_OP5 = "WITH " + QUALITY_CTE.replace("@docs@", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(odd, false)) AS kept FROM q LEFT JOIN out ON q.rid = out.rid
"""

#: Written apart from the operator: shares by repeated resharing, thresholds by sorting.
MIXING_CTE = r"""
ms AS (
  SELECT row_number() OVER () AS rid, *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) || substr(md5(coalesce(text, '')), 1, 15) AS h FROM @docs@
), tot AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM ms GROUP BY source
), wt AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM tot
), lvl AS (
  SELECT max(l) AS level FROM (
    SELECT ((SELECT sum(source_size) FROM wt) - coalesce((SELECT sum(3 * b.source_size) FROM wt b WHERE 3 * b.source_size / b.w <= x.r), 0)) / (SELECT sum(b.w) FROM wt b WHERE 3 * b.source_size / b.w > x.r) AS l, x.r
    FROM (SELECT DISTINCT 3 * source_size / w AS r FROM wt UNION ALL SELECT -1.0::DOUBLE) x
  ) WHERE l >= r
), goal AS (
  SELECT source, source_size, CASE WHEN 3 * source_size / w <= level THEN (3 * source_size)::DOUBLE ELSE w * level END AS target FROM wt, lvl
), gb AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget FROM goal
), ru AS (
  SELECT rid, source, size, row_number() OVER o AS k, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM ms WINDOW o AS (PARTITION BY source ORDER BY h, rid)
), edge AS (
  SELECT gb.source, max(k) AS k, arg_max(upto, k) AS upto, arg_max(size, k) AS n, any_value(budget) AS budget FROM ru JOIN gb ON ru.source IS NOT DISTINCT FROM gb.source WHERE upto - size <= budget GROUP BY gb.source
), th AS (
  SELECT source, CASE WHEN upto - budget < budget - (upto - n) THEN k + 1 ELSE k END AS below FROM edge
), mixed AS (
  SELECT ms.*, gb.source_size, gb.target, least(3, gb.whole + CASE WHEN ru.k < below THEN 1 ELSE 0 END)::BIGINT AS times
  FROM ms JOIN ru USING (rid) JOIN gb ON ms.source IS NOT DISTINCT FROM gb.source JOIN th ON ms.source IS NOT DISTINCT FROM th.source
)"""
_OP7 = "WITH " + MIXING_CTE.replace("@docs@", "documents") + """
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM mixed
"""

ORACLES: dict[str, str] = {"op1_url_filters": _OP1, "op5_quality_rules": _OP5, "op7_mixing": _OP7}
