import random
import re

from portloom.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, w int"


def plain(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    at = {i + k for i, g in enumerate(wins) if wins.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)


def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9)))
    out = []
    for i in range(400):
        w = [word() for _ in range(rnd.randrange(20, 120))]
        if i % 50 == 7:
            w = [x + "$$" for x in w]
        if i % 50 == 9:
            w = [x.upper() for x in w]
        if i % 9 == 0:
            w += w[:6] + w[3:9]
        out.append((i, rnd.choice([" ", "\n", "\t"]).join(w), "en" if i % 3 else None, f"s{i % 2}", "x", 1))
    return out + [(500, None, "en", "s0", "x", 1), (501, "", None, None, "x", 1), (502, " \n\t ", "de", "s9", "x", 1), (503, "a b c d e " * 2000, "en", "s0", "x", 1), (None, out[1][1], "en", "s0", "x", 1), (1, *out[1][1:])]


def test_measures_and_verdicts(spark):
    data = rows()
    got = quality.quality(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    text = {r[0]: r[1] for r in data}
    for r in got:
        if r["doc_id"] == 503:
            assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (10_000, 10_000, True)
            continue
        n = plain(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i in range(400) if i % 50 in (7, 9))
    clean = [i for i in range(400) if i % 50 not in (7, 9) and i % 9]
    assert sum(kept[i] for i in clean) >= 0.99 * len(clean)


def test_each_rate_rejects_what_stands_out(spark):
    """Two hundred plain documents, and one for each rate that stands out by it alone and passes the base rule."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    data = [(i, lines(prose(100)), "en", "s", "x", 1) for i in range(200)]
    p = prose(100)
    odd = {
        "symbols": " ".join(w + "$" if i % 4 == 0 else w for i, w in enumerate(p)),
        "caps": " ".join(w.upper() if i % 5 == 0 else w for i, w in enumerate(p)),
        "repeats": " ".join(p + p[:8]),
        "dup_lines": lines(p) + "\none two" * 6,
        "word_len": " ".join(w * 3 for w in p),
    }
    data += [(1000 + k, t, "en", "s", "x", 1) for k, t in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(data, SCHEMA)).collect()}
    for k, name in enumerate(odd):
        assert not got[1000 + k]["base_failed"] and not got[1000 + k]["kept"], name
    assert all(got[i]["kept"] for i in range(200))


def test_bins():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    s = SparkSession.getActiveSession()
    for r in s.range(0, 5000, 7).select("id", quality.bin_of(F.col("id")).alias("b")).collect():
        assert r["b"] <= r["id"] and (r["id"] < 32 and r["b"] == r["id"] or r["id"] < r["b"] * (1 + 1 / 16) + 1e-9)


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = quality.filtered(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert quality.filtered(docs.limit(0)).count() == 0 and quality.quality(docs.limit(0)).count() == 0
