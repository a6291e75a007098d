"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text once. At each place it keeps one backpointer: the last
piece of the best segmentation that ends there. For a model of merges the best
segmentation is the one that merging by rank gives; it is local, because a
row of pieces is what merging gives exactly if each two neighbours are what
merging gives for the two alone. So a piece may follow another if the pair
stands that test (kept in a table), and one piece does at each place.

Pieces have a bounded length, so only the backpointers of one piece length
can still be reached. When the paths from all of them meet in one place, the
ids up to it are final and go out; the search holds a few piece lengths of a
text of any length (the ids of a text are gathered, as its row needs them). The start of a word is always such a place, since no piece
holds a space behind other characters. So the words of many texts are searched
side by side in numpy, each step one character of all words that are that long:
an automaton of the pieces gives those that end there, and a table of pairs
the longest that may. Only long words are searched one by one.

Ids equal those of the public library for every text without U+2581, which the
library takes for a space; here it is spelled in bytes, so decoding gives back
every text exactly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Longest chunk that is searched beside others, characters searched at a time, entries of the automaton, and pairs of pieces kept by each Python worker.
SHORT, WINDOW, MOVES, KEPT_PAIRS = 48, 1 << 19, 1 << 25, 250_000
#: Places between two looks for a common boundary in a long chunk.
LOOK = 64
_CHUNK = re.compile(r"\n+| *[^ \n]+| +")
#: The first character of a chunk that isn't a text's first.
_START = re.compile(r"(?<! ) |(?<!\n)\n|(?<=\n)[^ \n]")


#: Fixed values of the public file format: message ``trainer_spec``, its field ``model_type``, and that field's value for merges.
TRAINER_SPEC, MODEL_TYPE, BPE = 2, 3, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields, those inside not taken apart."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            c = raw[at]
            at += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


def model_type(proto: bytes) -> int:
    """The kind of a model file; 1, the format's default, where it names none."""
    spec = b"".join(v for k, v in _fields(proto) if k == TRAINER_SPEC)
    return next((v for k, v in _fields(spec) if k == MODEL_TYPE), 1)


class Fits:
    """Table of the pairs of pieces that were tried; found by open addressing, a row of pairs at once."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.n = pieces, len(pieces.texts)
        self.bits = (4 * KEPT_PAIRS - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        #: Twice the pair's number, and one more if the second may follow the first; -1 where there is none.
        self.slots, self.held = np.full(1 << self.bits, -1, np.int64), 0

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it."""
        pairs = before.astype(np.int64) * self.n + piece
        at = self._slot(pairs)
        got = self.slots.take(at)
        todo = np.flatnonzero(got >> 1 != pairs)
        while len(todo):
            new = todo[got.take(todo) < 0]
            if len(new):
                got[new] = self._judge(pairs[new])
            todo = todo[got.take(todo) >> 1 != pairs.take(todo)]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            got[todo] = self.slots.take(at.take(todo))
            todo = todo[got.take(todo) >> 1 != pairs.take(todo)]
        return (got & 1).astype(bool)

    def _judge(self, pairs: np.ndarray) -> np.ndarray:
        """Tries pairs that the table doesn't hold and enters them."""
        once, back = np.unique(pairs, return_inverse=True)
        texts, found = self.pieces.texts, []
        for pair, at in zip(once.tolist(), self._slot(once).tolist()):
            found.append(2 * pair + self.pieces.stands(texts[pair // self.n], texts[pair % self.n]))
            if self.held >= KEPT_PAIRS:
                self.clear()
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = found[-1]
            self.held += 1
        return np.array(found)[back]


class Pieces:
    """Vocabulary of a model file, with encoder and decoder."""

    def __init__(self, proto: bytes):
        if model_type(proto) != BPE:
            raise ValueError("the model is not one of merges, for which alone the search is exact")
        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(m.get_piece_size())
        self.ids = {m.id_to_piece(i).replace(SPACE, " "): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: All texts within pieces, and the pieces that each of them ends in, longest first.
        self.within = {p[j:k] for p in self.ids for j in range(len(p)) for k in range(j + 1, len(p) + 1)}
        self.ends: dict[str, tuple[str, ...]] = {}
        self.spelled = [b""] * len(ids)
        for p, i in self.ids.items():
            self.spelled[i] = p.encode()
        for b, i in enumerate(self.byte):
            self.spelled[i] = bytes([b])
        self.pairs: dict[tuple[str, str], bool] = {}
        self._automaton()
        self.fits = Fits(self)

    def _automaton(self) -> None:
        """Tables for searching chunks side by side.

        A state is the longest text before a place that begins a piece of two characters or more; state 0 is the empty one.
        Characters outside such pieces always stand alone and lead there. Where there are more states times characters than
        ``MOVES``, chunks with the characters of fewest pieces are searched one by one.
        """
        whole = [p for p in self.ids if len(p) > 1]
        begins = ["", *sorted({p[:k] for p in whole for k in range(1, len(p) + 1)} | {c for p in whole for c in p}, key=len)]
        number = {t: i for i, t in enumerate(begins)}
        count: dict[str, int] = {}
        for c in chain.from_iterable(whole):
            count[c] = count.get(c, 0) + 1
        often = sorted(count, key=lambda c: (-count[c], c))
        width = min(len(often), max(1, MOVES // len(begins))) + 1
        kind = {c: i for i, c in enumerate(often, 1)}
        #: By code point: 0 stands alone, below ``width`` a column of ``move``, else the chunk is searched alone.
        self.kind, self.width = np.zeros(0x110000, np.int32), width
        for c, i in kind.items():
            self.kind[ord(c)] = i
        # Texts of one character that are no pieces are numbered behind the ids; the last number is that of a start and of what stands alone.
        self.texts: list[str] = [""] * len(self.spelled)
        for p, i in self.ids.items():
            self.texts[i] = p
        bare = {c: len(self.texts) + i for i, c in enumerate(c for c in often if c not in self.ids)}
        self.texts += [*bare, ""]
        self.alone = len(self.texts) - 1
        self.length = np.array([max(1, len(t)) for t in self.texts])
        move = np.zeros((len(begins), width), np.uint16 if len(begins) < 1 << 16 else np.int32)
        own: list[list[int]] = [[] for _ in begins]
        for i, t in enumerate(begins[1:], 1):
            if t[:-1] in number:
                own[number[t[:-1]]].append(i)
        first, sizes, numbers = [0], [1], [self.alone]
        for i, t in enumerate(begins):
            if t:  # the row of the longest state that this one ends in, which is done
                move[i] = move[next((number[t[k:]] for k in range(1, len(t)) if t[k:] in number), 0)]
                first.append(len(sizes))
            for j in own[i]:
                if (c := kind[begins[j][-1]]) < width:
                    move[i, c] = j
            for k in range(len(t)):
                n = self.ids.get(t[k:], bare.get(t[k:]))
                if n is not None:
                    sizes.append(len(t) - k)
                    numbers.append(n)
        self.move, self.first, self.sizes, self.numbers = move.ravel(), np.array(first), np.array(sizes), np.array(numbers)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the pair of best score first, of equal ones the leftmost."""
        row, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(row) - 1):
                s = score.get(row[k] + row[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return row
            row[at : at + 2] = [row[at] + row[at + 1]]

    def stands(self, a: str, b: str) -> bool:
        """Whether merging a + b gives back a and b; an empty a is the start of a text."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def follows(self, a: str, b: str) -> bool:
        """``stands``, kept in a table."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.stands(a, b)
        return found

    def _spell(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))

    def _ends(self, tail: str) -> tuple[str, ...]:
        own = tuple([tail[k:] for k in range(len(tail)) if tail[k:] in self.ids or k == len(tail) - 1])
        if tail in self.within:
            self.ends[tail] = own
        return own

    def _search(self, text: str, base: int, last: list[str], tail: str, stop: int) -> str:
        """Adds to ``last`` the piece that ends at each place up to ``stop``; last[k] ends at base + k.

        ``tail``: the longest text before the next place that lies within some piece.
        """
        within, ends, pairs = self.within, self.ends, self.pairs
        for end in range(base + len(last), stop + 1):
            tail += text[end - 1]
            while tail not in within and len(tail) > 1:
                tail = tail[1:]
            for piece in ends.get(tail) or self._ends(tail):
                start = end - len(piece) - base
                if start < 0:
                    continue
                before = last[start]
                fits = pairs.get((before, piece))
                if fits or fits is None and self.follows(before, piece):
                    break
            last.append(piece)
        return tail

    def _path(self, base: int, last: list[str], at: int) -> tuple[int, ...]:
        """Ids of the best way from ``base`` to ``at``."""
        way, k, known, out = [], at - base, self.ids, []
        while k > 0:
            way.append(last[k])
            k -= len(way[-1])
        for p in reversed(way):
            i = known.get(p)
            if i is None:
                out += self._spell(p)
            else:
                out.append(i)
        return tuple(out)

    def stream(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of a chunk of any length, in runs as soon as they are final."""
        base, last, tail, longest = 0, [""], "", self.longest
        for stop in range(LOOK, len(text) + LOOK, LOOK):
            end = min(stop, len(text))
            tail = self._search(text, base, last, tail, end)
            # Places from which a later piece can still start; at the end of the chunk only that.
            alive = {end} if end == len(text) else set(range(max(base, end + 1 - longest), end + 1))
            while len(alive) > 1:
                at = max(alive)
                alive.discard(at)
                alive.add(max(base, at - len(last[at - base])))
            at = alive.pop()
            if at > base:
                yield self._path(base, last, at)
                # What ends at the boundary is still needed to judge what follows it.
                last = last[at - base :]
                base = at

    def _beside(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> None:
        """Searches chunks side by side: enters the number of the piece that ends at each place.

        ``starts``: where ``codes`` has the first character of each chunk, longest chunk first, and ``last`` the place before it.
        """
        state = np.zeros(len(starts), np.int64)
        kinds = self.kind[codes]
        longer = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
        for step, n in enumerate(longer.tolist()):
            here = starts[:n] + step
            state = self.move.take(state[:n] * self.width + kinds.take(here)).astype(np.int64)
            at = self.first.take(state)
            size, piece = self.sizes.take(at), self.numbers.take(at)
            todo = np.flatnonzero(size > 1)
            while len(todo):
                fits = self.fits.of(last.take(here.take(todo) + 1 - size.take(todo)), piece.take(todo))
                todo = todo[~fits]
                # The next shorter piece; the one character itself stands anyway.
                at[todo] += 1
                size[todo], piece[todo] = self.sizes.take(at.take(todo)), self.numbers.take(at.take(todo))
                todo = todo[size.take(todo) > 1]
            last[here + 1] = piece

    def _run(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a chunk, one behind the other, and the number of ids of each."""
        text = "".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        if not text:
            return np.empty(0, np.int32), sizes
        # A place before each chunk and one behind each character: chunks are moved apart by one code.
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space, line = codes == 32, codes == 10
        new = np.empty(len(codes), bool)
        new[0] = True
        new[1:] = (space[1:] & ~space[:-1]) | (line[1:] & ~line[:-1]) | (line[:-1] & ~line[1:] & ~space[1:])
        ends = np.cumsum(sizes)
        new[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(codes)))
        rank = np.arange(len(begin))
        place = begin + rank
        apart = np.zeros(len(codes) + len(begin), np.uint32)
        apart[np.arange(len(codes)) + np.cumsum(new) - 1] = codes
        single = np.logical_or.reduceat(self.kind[codes] >= self.width, begin) | (size > SHORT)
        order = np.flatnonzero(~single)
        order = order[np.argsort(-size[order], kind="stable")]
        last = np.full(len(apart) + 1, self.alone, np.int32)
        self._beside(apart, place[order], size[order], last)
        # Back from the end of each chunk; what is met are the ids, in the order of the text.
        met = np.zeros(len(last), bool)
        at, low = (place + size)[order], place[order]
        while len(at):
            met[at] = True
            at = at - self.length.take(last.take(at))
            more = at > low
            at, low = at[more], low[more]
        met[(place + size)[single]] = True
        where = np.flatnonzero(met)
        ids = last[where]
        odd = ids >= len(self.spelled)
        count = np.ones(len(ids), np.int64)
        if odd.any():
            chunk = {e: text[b : b + k] for e, b, k in zip(*((x[single]).tolist() for x in (place + size, begin, size)))}
            spelled = [self._ids(chunk[w]) if w in chunk else self._spell(chr(apart[w - 1])) for w in where[odd].tolist()]
            count[odd] = [len(x) for x in spelled]
            ids = np.repeat(ids, count)
            ids[np.repeat(odd, count)] = np.fromiter(chain.from_iterable(spelled), np.int32)
        # Places of a part end before the first of the next one.
        bound = np.searchsorted(where, np.append(place, len(last))[np.searchsorted(begin, ends)], "right")
        upto = np.append(0, np.cumsum(count))[bound]
        return ids, np.diff(upto, prepend=0)

    def _ids(self, chunk: str) -> array:
        """Ids of one chunk by itself."""
        out = array("i")
        for run in self.stream(chunk):
            out.extend(run)
        return out

    def encoded(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, some ``WINDOW`` characters at a time: short texts together, a long one in parts that end with a chunk."""
        parts: list[str] = []
        held = 0
        for text in texts:
            rest = " " + text if text else ""
            if held + len(rest) > WINDOW and parts:
                yield from self._split(parts)
                parts, held = [], 0
            if len(rest) <= WINDOW:
                parts.append(rest)
                held += len(rest)
                continue
            runs, at = [], 0
            while at < len(rest):
                cut = _START.search(rest, at + WINDOW)
                end = cut.start() if cut else len(rest)
                if end - at > 2 * WINDOW:  # one chunk is as long as a window
                    runs += [np.array(self._ids(m.group()), np.int32) for m in _CHUNK.finditer(rest, at, end)]
                else:
                    runs.append(self._run([rest[at:end]])[0])
                at = end
            yield np.concatenate(runs)
        yield from self._split(parts)

    def _split(self, parts: list[str]) -> Iterator[np.ndarray]:
        ids, sizes = self._run(parts)
        ends = np.cumsum(sizes).tolist()
        yield from (ids[a:b] for a, b in zip([0, *ends], ends))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null or empty."""
        return next(self.encoded([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding put first goes. Bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_LOADED: dict[int, Pieces] = {}


def _loaded(proto: bytes) -> Pieces:
    """One model for each Python worker, so that its tables serve all tasks."""
    key = hash(proto)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(proto)
    return _LOADED[key]


def encoded(docs: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, ids and round_trip for every row of ``docs``.

    Reads ``keep`` and text. round_trip tells that decoding the ids gives the
    text; null and empty texts have no ids and round_trip true. Repeated rows
    stay. The model file is read on the driver and broadcast: half a megabyte,
    whatever the corpus.
    """
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _loaded(proto.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(n).to_pylist()
                found = list(p.encoded(texts))
                same = [p.decode(ids.tolist()) == (text or "") for text, ids in zip(texts, found)]
                sizes = np.array([len(x) for x in found], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(sizes.astype(np.int64)), ids, pa.array(same)], names)

    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    names = [*src.columns[:n], "n_tokens", "ids", "round_trip"]
    kinds = ", ".join(f"c{i} {src.schema[i].dataType.simpleString()}" for i in range(n))
    out = src.mapInArrow(run, f"{kinds}, n_tokens bigint, ids array<int>, round_trip boolean")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids", "round_trip")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    with open(model_path, "rb") as f:
        proto = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _loaded(proto.value)
        for b in batches:
            texts = [None if x.as_py() is None else p.decode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
