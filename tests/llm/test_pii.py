import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from portloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                odd = [int(c) for c in d[::-1]]
                if not 12 <= len(d) <= 19 or sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(odd)) % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_match_the_patterns():
    rnd = random.Random(2)
    parts = ["a", "b.c", "@", "x@y.com", ".", "-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (988) 555-2485", "+", "12", " ", "\n", "é", "m@n", "@@", "%", "00000000000000000000", "79927398713", "user.name+tag@sub.example.co.uk"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert pii.base_spans(t) == plain(t), repr(t)


def test_very_long_runs_are_linear():
    for t in ["1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" * 100_000]:
        pii.base_spans(t)


def test_terms_that_reveal_an_entity(spark):
    rnd = random.Random(4)
    filler = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud"]) for _ in range(n))
    rows = [(i, f"{filler(9)} Quixotel, wrote from q@corp.example.com {filler(9)}", "c") for i in range(6)]
    rows += [(100 + i, filler(30), "c") for i in range(60)] + [(90, f"{filler(5)} (quixotel) {filler(4)}", "c"), (91, None, None), (92, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    spanned = {i: [text[i][int(s):int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",")) if k == "term"] for i, r in got.items() if "term" in r["spans"]}
    assert set(spanned) == {*range(6), 90} and spanned[90] == ["quixotel"] and "Quixotel" in spanned[0]
    assert not any(w in ("alpha", "river") for s in spanned.values() for w in s)
    assert got[91]["spans"] == "" and got[91]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.cleaned(docs).collect()}
    assert "q@corp" not in clean[0] and "<EMAIL>" in clean[0] and "uixotel" not in clean[90] and clean[91] is None and clean[101] == text[101]
    # The same through the join instead of the broadcast.
    old, pii.BROADCAST_TERMS = pii.BROADCAST_TERMS, 0
    try:
        again = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
        assert again == {i: r["spans"] for i, r in got.items()}
        assert {r["doc_id"]: r["text"] for r in pii.cleaned(docs).collect()} == clean
    finally:
        pii.BROADCAST_TERMS = old


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, "x"), (1, "x")], "doc_id bigint, text string")
    assert sorted((str(r["doc_id"]), r["n_email"]) for r in pii.personal_data(docs).collect()) == [("1", 0), ("1", 0), ("None", 1)]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_two_contexts_are_enough_and_copies_are_none(spark):
    rnd = random.Random(11)
    filler = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud"]) for _ in range(n))
    rows = [(i, f"{filler(9)} Zorblatt, user zed77, at +1 988 555 2485 {filler(9)}") for i in (1, 2)]
    copied = f"{filler(9)} oddword near +1 988 555 9999 {filler(5)}"
    rows += [(3, copied), (4, copied), (5, copied + " stone"), (6, f"{filler(8)} lonely +1 988 555 1111 {filler(9)}")]
    rows += [(100 + i, filler(30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = dict(rows)
    found = {r["doc_id"]: {text[r["doc_id"]][int(s):int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"} for r in pii.personal_data(docs).collect()}
    assert all({"Zorblatt", "zed77"} <= found[i] for i in (1, 2))
    assert not any(found[i] for i in found if i > 2)


def test_the_chance_is_a_bound(spark):
    from math import comb, exp

    from pyspark.sql import functions as F

    cases = [(1, 1, 1, 50), (2, 2, 2, 70), (2, 5, 3, 70), (3, 6, 7, 69), (6, 6, 7, 69), (4, 30, 20, 90)]
    for x, k, m, n in cases:
        got = exp(spark.range(1).select(pii.chance(F.lit(x), F.lit(k), F.lit(m), n)).first()[0])
        tail = sum(comb(m, j) * comb(n - m, k - j) for j in range(x, min(k, m) + 1)) / comb(n, k)
        assert tail <= got * (1 + 1e-9) and abs(got / (comb(k, x) * comb(m, x) / comb(n, x)) - 1) < 1e-9


def test_secrets():
    t = 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and a1 1111111111111111111111 aaaaaaaaaaaaaaaaaaaaaaaa1 user.with-a-1-very-long-name-99@x.com Zm9vYmFyYmF6cXV4MTIz=='
    found = [t[s:e] for _, s, e in pii.secrets(t, pii.base_spans(t))]
    assert found == ["f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "Zm9vYmFyYmF6cXV4MTIz=="]
    assert pii.secrets(None, []) == pii.secrets("", []) == pii.secrets("no digits at all", []) == []
    assert len(pii.secrets("a1" * 200_000 + " 9" * 200_000, [])) == 0


def brute(texts):
    """All spans by the definition: counts over the whole table, then every word of every text."""
    import math

    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)

    def term(w):
        t = lower(w).strip(".,;:!?()[]{}<>\"'*_")
        return t if any(c.isalnum() for c in t) else ""

    def found(t):
        base = plain(t)
        out = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/=_-]+", t):
            g = m.group()
            bits = -sum(g.count(c) / len(g) * math.log2(g.count(c) / len(g)) for c in set(g))
            if len(g) >= 20 and re.search("[0-9]", g) and re.search("[A-Za-z]", g) and bits >= 3 and all(e <= m.start() or s >= m.end() for _, s, e in base):
                out.append(("term", *m.span()))
        return base, out

    near, holders = {}, {}
    for i, t in enumerate(texts):
        for w in {term(w) for w in split(t)} - {""}:
            holders.setdefault(w, set()).add(i)
        for kind, s, e in found(t)[1]:
            v = t[s:e]
            value = f"secret:{v}" if kind == "term" else kind + ":" + (lower(v) if kind in ("email", "ip") else re.sub("[^0-9]", "", v))
            left, right = split(t[:s])[-8:], split(t[e:])[:8]
            marks = tuple(tuple(w or [*left, "", *right]) for w in (left[:-4], right[4:]))
            for c in (value, value.split(":")[0] + ":*"):
                near.setdefault(c, []).append((i, marks, {term(w) for w in left + right} - {""}))
    pairs = {}
    for c, rows in near.items():
        for i, marks, terms in rows:
            for w in terms:
                pairs.setdefault((c, w), []).append((i, *marks))
    once = lambda rows: min(len({r[k] for r in rows}) for k in range(3))
    n, known = len(texts), set()
    for (c, w), rows in pairs.items():
        x, k = once(rows), max(once(rows), once([(i, *m) for i, m, ws in near[c] if ws]))
        m, n_c, n_ct = len(holders[w]), len({i for i, _, _ in near[c]}), len({r[0] for r in rows})
        chance = sum(math.log((k - j) * (m - j) / ((j + 1) * max(n - j, 1))) for j in range(min(x, 64)))
        if chance <= math.log(0.05 / len(pairs)) and n_c < n and math.log2(n_ct * n / (n_c * m)) / math.log2(n / n_c) >= 0.8:
            known.add(w)
    out = []
    for t in texts:
        base, spans = found(t)
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            w = term(m.group())
            if w in known:
                s = m.start() + lower(m.group()).index(w)
                if all(e <= s or b >= s + len(w) for _, b, e in spans if (_, b, e) in found(t)[1]):
                    spans = [*spans, ("term", s, s + len(w))]
        kinds = [*PATTERNS, "term"]
        out.append(",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2]))))
    return out


def test_all_spans_match_brute_force(spark):
    rnd = random.Random(21)
    words = [f"{a}{b}" for a in ("ka", "mo", "ri", "tu", "ve") for b in ("lon", "sta", "dir", "pex", "um", "a")]
    filler = lambda n: [rnd.choice(words) for _ in range(n)]
    hexed = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(32))
    texts = []
    for i in range(220):
        t = filler(rnd.randrange(12, 40))
        if i % 11 == 0:
            t[6:6] = ["token", "=", f'"{hexed()}"']
        if i % 13 == 0:
            t[5:5] = ["Phone:", "+1 (988) 555-" + str(2000 + i), "(office)"]
        if i % 17 == 0:
            t[7:7] = ["Brabantine,", "mail", "me@corp.example.com"]
        if i % 23 == 0:
            t.append("brabantine" if i % 2 else "spam@else.org")
        texts.append(" ".join(t))
    texts += [texts[0], texts[11], "", "1.2.3.4"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(rows).collect()}
    want = brute(texts)
    assert sum("term" in w for w in want) > 30
    assert [got[i] for i in range(len(texts))] == want


def test_the_chance_counts_every_common_context(spark):
    from math import lgamma

    from pyspark.sql import functions as F

    log_comb = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    cases = [(64, 80, 70, 200), (65, 80, 70, 200), (65, 65, 65, 65), (500, 500, 500, 1000), (900, 1000, 950, 3000), (70_000, 80_000, 90_000, 1_000_000)]
    for x, k, m, n in cases:
        got = spark.range(1).select(pii.chance(F.lit(x), F.lit(k), F.lit(m), n)).first()[0]
        want = log_comb(k, x) + log_comb(m, x) - log_comb(n, x)
        assert abs(got - want) < 1e-8 + 1e-9 * abs(want), (x, k, m, n)


def common_kind():
    """Every second document has an address of its own, and 'reachable' stands by each of them and nowhere else."""
    rnd = random.Random(17)
    filler = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud"]) for _ in range(n))
    return [(i, f"{filler(9)} Reachable at user{i}@corp.example.com {filler(9)}" if i % 2 else filler(20)) for i in range(400)]


def test_a_term_with_many_common_contexts_is_found(spark):
    rows = common_kind()
    text = dict(rows)
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found = {text[r["doc_id"]][int(s):int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"}
        assert ("Reachable" in found) == (r["doc_id"] % 2 == 1) and "river" not in found


def test_chance_is_decided_by_the_tail(spark):
    """Against sums of whole numbers: frequent and rare entities, tails on both sides of the limit, the least and the most in common."""
    rnd = random.Random(23)
    rows = [(10, 10, 10, 1000), (1, 1, 1, 1), (594, 1900, 600, 2000), (580, 1900, 600, 2000), (3, 5, 4, 6), (100, 2000, 5000, 20_000), (690, 2000, 5000, 20_000), (700, 12_000, 1000, 20_000)]
    for _ in range(150):
        n = rnd.choice([30, 400, 5000])
        k, m = rnd.randint(1, n), rnd.randint(1, n)
        mean = k * m / n
        rows.append((max(1, min(k, m, int(mean + rnd.uniform(-1, 8) * (mean + 1) ** 0.5))), k, m, n))
    limit = math.log(1e-6)

    def tail(x, k, m, n):
        total = c = math.comb(k, x) * math.comb(n - k, m - x)
        for i in range(x, min(k, m)):
            c = c * (k - i) * (m - i) // ((i + 1) * (n - k - m + i + 1)) if c else math.comb(k, i + 1) * math.comb(n - k, m - i - 1)
            total += c
        return total / math.comb(n, m)

    tails = {r: tail(*r) for r in rows}
    for n in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == n]
        df = spark.createDataFrame([r[:3] for r in own], "x bigint, k bigint, m bigint")
        got = [r[0] for r in df.select(pii.beyond_chance(F.col("x"), F.col("k"), F.col("m"), n, F.lit(limit))).collect()]
        assert got == [tails[r] <= 1e-6 for r in own]
    assert 20 < sum(tails[r] <= 1e-6 for r in rows) < len(rows) - 20
