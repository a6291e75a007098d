"""Personal data: patterns, and terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; long strings
of letters and digits without order are secrets, which disclose themselves. The
protected entities are each value, and each kind as a class of its own. Over the
corpus, terms that stand within ``WINDOW`` words of an entity are counted with
it: a term t discloses an entity
c by PMI(c; t) / IC(c) = log2(P(c|t) / P(c)) / log2(1 / P(c)), 1 if t never
occurs without c. Terms at or above ``REMOVE`` are removed wherever they occur,
those at or above ``GENERALISE`` replaced by a placeholder. A pair counts if it
stands together more often than chance has it: copies of a context are counted
as one, and the hypergeometric tail, times the number of pairs, must be below
``ALPHA``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import lower_ascii, raw_of, stored, words_of

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, ALPHA, GENERALISE, REMOVE = 8, 0.05, 0.8, 0.97
#: Contexts are copies of each other if they agree in the words more than so many away from the entity on one side.
PHRASE = 4
#: Factors of a tail's bound that are multiplied one by one; with more of them the same product comes from factorials.
FACTORS = 64
#: Terms of a tail's sum that are added one by one; those after them enter by the geometric series above them.
SUMMED = 512
#: Disclosing terms broadcast to the workers; with more of them they meet the documents in a join.
BROADCAST_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: Digits with one separator between them at most: each address and card number lies within one.
_DIGITS = re.compile(r"[0-9](?:[\x20.-]?[0-9])*+")
# A digit before the start is ruled out: a match from inside a run would also begin at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?()[]{}<>\"'*_"
_RAW_EDGES = _EDGES.encode()


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: from each @ back over the characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in ``KINDS``; code points, end exclusive."""
    if not text:
        return []
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for run in _DIGITS.finditer(text):
        s, e = run.span()
        if e - s < 7:
            continue
        if text.count(".", s, e) > 2:
            for m in _IP.finditer(text, s, e):
                if all(len(p) < 4 and int(p) < 256 or int(p.lstrip("0")[:4] or 0) < 256 for p in m.group().split(".")):
                    found.append(("ip", *m.span()))
        if e - s >= 12:
            for m in _CARD.finditer(text, s, e):
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and _luhn(d):
                    found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return ordered(found)


#: Characters of a secret, the least length, and the least Shannon entropy of its characters in bits.
_SECRET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
SECRET_LENGTH, SECRET_BITS = 20, 3.0


def secrets(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of whole runs of letters, digits and ``+/=_-`` with both letters and digits, long and without order; none that overlaps a base span.

    Runs are looked for around digits, so texts without them cost nothing.
    """
    out, done = [], 0
    for m in _DIGITS.finditer(text or ""):
        if m.start() < done:
            continue
        lo = hi = m.start()
        while lo > done and text[lo - 1] in _SECRET:
            lo -= 1
        while hi < len(text) and text[hi] in _SECRET:
            hi += 1
        done = hi
        if hi - lo < SECRET_LENGTH:
            continue
        run = Counter(text[lo:hi])
        if all(c in "0123456789+/=_-" for c in run) or sum(-n * math.log2(n / (hi - lo)) for n in run.values()) < SECRET_BITS * (hi - lo):
            continue
        if all(e <= lo or s >= hi for _, s, e in base):
            out.append(("term", lo, hi))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _value(kind: str, text: str) -> str:
    """An entity's value: the same for spellings of the same number or address. The spans of secrets come as terms."""
    if kind == "term":
        return "secret:" + text
    return kind + ":" + (lower_ascii(text) if kind in ("email", "ip") else _digits(text))


def term_of(word: str) -> str:
    """A word as a term: A-Z lower-cased, punctuation at its ends cut; empty if no letter or digit is left."""
    t = lower_ascii(word).strip(_EDGES)
    return t if any(c.isalnum() for c in t) else ""


def terms_in(text: str | None) -> set[bytes]:
    """The different terms of a text in UTF-8, and words of punctuation, whose rest may be empty or no term."""
    return {w.strip(_RAW_EDGES) for w in set(raw_of(text).lower().split())} if text else set()


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to WINDOW whole words on either side."""
    size = 64 * WINDOW
    while True:
        lo, hi = max(0, start - size), min(len(text), end + size)
        before, after = words_of(text[lo:start]), words_of(text[end:hi])
        if (lo == 0 or len(before) > WINDOW) and (hi == len(text) or len(after) > WINDOW):
            return before[-WINDOW:], after[:WINDOW]
        size *= 4


def _mark(words: list[str]) -> str:
    return hashlib.md5("\n".join(words).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def entities(kind: str, text: str) -> tuple[str, str]:
    """What a span protects: its value, and the class of its kind."""
    value = _value(kind, text)
    return value, value[: value.index(":")] + ":*"


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, str, str]]:
    """(entity, term, left, right) for the terms around each span; left and right mark the outer words, or all where there are none."""
    out = []
    for kind, s, e in spans:
        before, after = _around(text, s, e)
        left, right = (_mark(w or [*before, "", *after]) for w in (before[:-PHRASE], after[PHRASE:]))
        terms = {term_of(w) for w in before + after} - {""}
        out += [(c, t, left, right) for c in entities(kind, text[s:e]) for t in terms]
    return out


def raw_terms(terms: Collection[str]) -> frozenset[bytes]:
    return frozenset(map(raw_of, terms))


def term_spans(text: str, terms: Collection[str], base: list[tuple[str, int, int]], raw: frozenset[bytes] | None = None) -> list[tuple[str, int, int]]:
    """Spans of words that are disclosing terms, without the punctuation at their ends; none that overlaps a base span. ``raw``: the terms in UTF-8, if at hand."""
    out, k = [], 0
    if terms_in(text).isdisjoint(raw_terms(terms) if raw is None else raw):
        return out
    taken = sorted((s, e) for _, s, e in base)
    for m in _WORD.finditer(text):
        w = m.group()
        t = term_of(w)
        if t and t in terms:
            s = m.start() + len(w) - len(w.lstrip(_EDGES))
            e = s + len(t)
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if k == len(taken) or taken[k][0] >= e:
                out.append(("term", s, e))
    return out


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("c", pa.string()), ("t", pa.string()), ("l", pa.string()), ("r", pa.string())]))
    for b in batches:
        rows, near, has = [], [], []
        for x in b.column(1):
            text = x.as_py()
            base = base_spans(text)
            hidden = secrets(text, base)
            spans = ordered(base + hidden) if hidden else base
            rows.append(_row(base, spans))
            near.append([{"c": c, "t": t, "l": x, "r": y} for c, t, x, y in contexts(text, spans)] if spans else [])
            has.append(list({c for k, s, e in spans for c in entities(k, text[s:e])}))
        yield pa.RecordBatch.from_arrays([b.column(0), *_columns(rows), pa.array(near, kind), pa.array(has, pa.list_(pa.string()))], ["id", *_NAMES, "near", "has"])


def _spans(text: str | None, terms: dict[str, float], raw: frozenset[bytes] | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the method adds: secrets and disclosing terms."""
    base = base_spans(text)
    extra = secrets(text, base)
    return base, extra + (term_spans(text, terms, sorted(base + extra, key=lambda s: s[1]), raw) if text and terms else [])


_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _row(base: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> tuple:
    n = {k: 0 for k in KINDS}
    for k, _, _ in base:
        n[k] += 1
    plain = joined(base)
    return (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(plain.encode()).hexdigest(), joined(spans) if spans is not base else plain, len(spans))


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


#: Logarithms of the factorials that Stirling's series is not used for.
_SMALL_FACTORIALS = [math.lgamma(i + 1) for i in range(32)]


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, to the last digits of a double."""
    z = F.greatest(n, F.lit(len(_SMALL_FACTORIALS))).cast("double")
    series = z * F.log(z) - z + 0.5 * F.log(2 * math.pi * z) + (1 / 12 - (1 / 360 - 1 / 1260 / (z * z)) / (z * z)) / z
    small = F.element_at(F.array(*[F.lit(x) for x in _SMALL_FACTORIALS]), (F.least(n, F.lit(len(_SMALL_FACTORIALS) - 1)) + 1).cast("int"))
    return F.when(n < len(_SMALL_FACTORIALS), small).otherwise(series)


def chance(x: Column, k: Column, m: Column, n: int) -> Column:
    """Upper bound of the chance that k and m of n documents have x or more in common: C(k, x) C(m, x) / C(n, x), as a natural logarithm.

    All x factors count: the first ones grow where k m > n, so a part of the product would not do.
    """
    all_n, few = F.lit(n).cast("bigint"), F.least(x, F.lit(FACTORS)).cast("int")
    ratio = lambda i: F.log((k - i) * (m - i) / ((i + 1.0) * F.greatest(all_n - i, F.lit(1))))
    one_by_one = F.aggregate(F.sequence(F.lit(0), few - 1), F.lit(0.0), lambda a, i: a + ratio(i))
    fact = _log_factorial
    at_once = fact(k) - fact(k - x) + fact(m) - fact(m - x) + fact(all_n - x) - fact(all_n) - fact(x)
    return F.when(x <= FACTORS, one_by_one).otherwise(at_once)


def beyond_chance(x: Column, k: Column, m: Column, n: int, limit: Column) -> Column:
    """Whether the chance that k and m of n documents have x or more in common is ``limit`` (a natural logarithm) at most.

    ``chance`` settles most pairs. It grows beyond the tail, even beyond 1, where
    k is most of the documents, so what it refuses is decided by the tail itself.
    """
    all_n, fact = F.lit(n).cast("bigint"), lambda i: _log_factorial(F.greatest(i, F.lit(0)))
    others = all_n - k - m  # below -x if k and m can't have as few in common
    ratio = lambda i: (k - i) * (m - i) / ((i + 1.0) * F.greatest(others + i + 1, F.lit(1)))
    first = fact(k) - fact(x) - fact(k - x) + fact(all_n - k) - fact(m - x) - fact(others + x) + fact(m) + fact(all_n - m) - fact(all_n)
    start = F.struct(F.lit(1.0).alias("next"), F.lit(0.0).alias("sum"))
    steps = F.sequence(F.lit(0), F.greatest(F.least(k - x, m - x, F.lit(SUMMED)), F.lit(0)).cast("int"))
    series = F.aggregate(steps, start, lambda a, i: F.struct((a["next"] * ratio(x + i)).alias("next"), (a["sum"] + a["next"]).alias("sum")), lambda a: a["sum"] + a["next"] / F.when(ratio(x) < 1, 1 - ratio(x)))
    # Each term alone is less than the tail; where terms still grow, x is no more than chance has it.
    refused = (others + x < 0) | (ratio(x) >= 1) | (first > limit)
    return F.when(chance(x, k, m, n) <= limit, True).when(refused, False).otherwise(first + F.log(series) <= limit)


def disclosures(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of at least GENERALISE, from the stored first pass over all documents.

    ``x`` common contexts and ``k`` contexts of the entity are counted with
    copies as one; a document counts once however often it has the entity.
    """
    near = stored(scan.select("rid", F.inline("near")), "near")
    once = lambda name: [F.least(F.countDistinct("l"), F.countDistinct("r"), F.countDistinct("rid")).alias(name)]
    pairs = stored(near.groupBy("c", "t").agg(*once("x"), F.countDistinct("rid").alias("n_ct")), "pairs")
    n_pairs = pairs.count()
    empty = docs.sparkSession.createDataFrame([], "entity string, term string, disclosure double")
    if n_pairs == 0:
        return empty
    n, limit = scan.count(), F.lit(math.log(ALPHA / n_pairs))
    of_c = scan.select("rid", F.explode("has").alias("c")).groupBy("c").agg(F.countDistinct("rid").alias("n_c"))
    of_c = of_c.join(near.groupBy("c").agg(*once("k")), "c")
    # The chance only grows with the documents that hold the term; where it is too great for the least number, they need no counting.
    # A class stands with a share of all terms; its pairs stay where they are, as classes are as many as kinds.
    of_c, is_class = stored(of_c, "entities"), F.col("c").endswith(":*")
    pairs = pairs.filter(is_class).join(F.broadcast(of_c.filter(is_class)), "c").unionByName(pairs.filter(~is_class).join(of_c.filter(~is_class), "c")).withColumn("k", F.greatest("k", "x"))
    pairs = stored(pairs.filter(beyond_chance(F.col("x"), F.col("k"), F.col("n_ct"), n, limit)), "likely")
    if pairs.limit(1).count() == 0:
        return empty
    both = pairs.join(_holding(docs, pairs.select("t").distinct()), "t").withColumn("n_t", F.greatest("n_t", "n_ct"))
    both = both.filter(beyond_chance(F.col("x"), F.col("k"), F.col("n_t"), n, limit))
    ic = F.log2(F.lit(float(n)) / F.col("n_c"))
    share = F.log2(F.col("n_ct") * float(n) / (F.col("n_c") * F.col("n_t"))) / F.when(ic > 0, ic)
    return both.select(F.col("c").alias("entity"), F.col("t").alias("term"), share.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, terms = [], []
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = [t for w in terms_in(x.as_py()) if (t := term_of(w.decode("utf-8", "surrogatepass")))]
            ids += [i] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], ["rid", "t"])


def _holders(known: Callable[[], frozenset[bytes] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(t, n): documents that hold each known term (any word, if ``known`` gives None), summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], ["t", "n"])

        terms, n = known(), Counter()
        for b in batches:
            for x in b.column(0):
                own = terms_in(x.as_py())
                n.update(own if terms is None else own & terms)
                if len(n) > 300_000:
                    yield out()
                    n.clear()
        yield out()

    return run


def _holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n_t): how many documents hold each term. Terms are broadcast up to BROADCAST_TERMS; beyond, joined."""
    if terms.count() <= BROADCAST_TERMS:
        known = docs.sparkSession.sparkContext.broadcast(raw_terms([r["t"] for r in terms.collect()]))
        counted = docs.select("text").mapInArrow(_holders(lambda: known.value), "t string, n bigint")
    else:
        counted = docs.select("text").mapInArrow(_holders(lambda: None), "t string, n bigint").join(terms, "t", "left_semi")
    return counted.groupBy("t").agg(F.sum("n").alias("n_t"))


def _documents(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), "text")


def _scanned(rows: DataFrame) -> DataFrame:
    """First pass; the row number lets documents without or with equal ids be told apart."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for out in _scan(iter([pa.RecordBatch.from_arrays([part.column(0), part.column(2)], ["id", "text"])])):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out.columns[1:]], ["rid", "id", *_NAMES, "near", "has"])

    return rows.mapInArrow(run, f"rid bigint, id {kind}, {_FOUND}, near array<struct<c:string,t:string,l:string,r:string>>, has array<string>")


def _with_terms(rows: DataFrame, terms: DataFrame, sanitise: bool) -> DataFrame:
    """Second pass over whole texts with the terms that disclose: (rid, id, found..., clean)."""
    kind = rows.schema["id"].dataType.simpleString()
    few = terms.count() <= BROADCAST_TERMS
    if few:
        known = rows.sparkSession.sparkContext.broadcast({r["t"]: r["worst"] for r in terms.collect()})
        src = rows.withColumn("own", F.lit(None).cast("array<struct<t:string,worst:double>>"))
    else:
        known = None
        rows = stored(rows, "rows")  # row numbers must be the same on both sides of the join
        own = rows.select("rid", "text").mapInArrow(_terms_of, "rid bigint, t string").join(terms, "t").groupBy("rid").agg(F.collect_list(F.struct("t", "worst")).alias("own"))
        src = rows.join(own, "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = None if known is None else raw_terms(known.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out, clean = [], []
                for x, own in zip(part.column(2), part.column(3), strict=True):
                    text = x.as_py()
                    terms_ = known.value if known is not None else {o["t"]: o["worst"] for o in own.as_py() or []}
                    base, extra = _spans(text, terms_, raw)
                    out.append(_row(base, ordered(base + extra)))
                    clean.append(sanitised(text, base + extra, terms_) if sanitise else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_columns(out), pa.array(clean, pa.string())], ["rid", "id", *_NAMES, "clean"])

    return src.select("rid", "id", "text", "own").mapInArrow(run, f"rid bigint, id {kind}, {_FOUND}, clean string")


def sanitised(text: str | None, spans: list[tuple[str, int, int]], terms: dict[str, float]) -> str | None:
    """The text with patterns and disclosing terms generalised to ``<KIND>``, or removed from ``REMOVE`` on."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in ordered(spans):
        if s < at:  # overlaps what was replaced before it
            at = max(at, e)
            continue
        out.append(text[at:s])
        if kind != "term" or terms.get(term_of(text[s:e]), 0.0) < REMOVE:
            out.append(f"<{kind.upper()}>")
        at = e
    return "".join([*out, text[at:]])


def _worst(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("term").alias("t")).agg(F.max("disclosure").alias("worst"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (how many these are) for every row.

    Null and empty texts have no spans. Repeated rows and null ids stay rows of
    their own; only doc_id and text are read. The second pass over the texts
    runs only if some term discloses an entity.
    """
    rows = _documents(docs, "doc_id")
    scan = stored(_scanned(rows), "scan")
    terms = stored(_worst(disclosures(scan, rows)), "terms")
    out = _with_terms(rows, terms, sanitise=False) if terms.limit(1).count() else scan
    return out.select(F.col("id").alias("doc_id"), *_NAMES)


def cleaned(docs: DataFrame) -> DataFrame:
    """All documents with their texts sanitised and ``n_chars`` counted anew; other columns as they came."""
    own = {c: c if c in ("text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values()).withColumn("rid", F.monotonically_increasing_id())
    scan = stored(_scanned(rows.select("rid", F.lit(0).cast("bigint").alias("id"), "text")), "scan")
    terms = stored(_worst(disclosures(scan, rows)), "terms")
    known = rows.sparkSession.sparkContext.broadcast({r["t"]: r["worst"] for r in terms.collect()}) if terms.count() <= BROADCAST_TERMS else None
    names = [*own.values()]
    at = names.index("text")
    if known is None:
        rows = stored(rows, "rows")
        per = rows.select("rid", "text").mapInArrow(_terms_of, "rid bigint, t string").join(terms, "t").groupBy("rid").agg(F.collect_list(F.struct("t", "worst")).alias("own"))
        src = rows.join(per, "rid", "left").select(*names, "own")
    else:
        src = rows.select(*names, F.lit(None).cast("array<struct<t:string,worst:double>>").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = None if known is None else raw_terms(known.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                clean = []
                for x, mine in zip(part.column(at), part.column(len(names)), strict=True):
                    text = x.as_py()
                    terms_ = known.value if known is not None else {o["t"]: o["worst"] for o in mine.as_py() or []}
                    base, extra = _spans(text, terms_, raw)
                    clean.append(sanitised(text, base + extra, terms_))
                cols = [pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(part.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    out = src.mapInArrow(run, kinds)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(out.schema["n_chars"].dataType))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])
