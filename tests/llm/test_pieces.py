import random
import sys

import pytest
import sentencepiece

from portloom.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rnd = random.Random(3)
    parts = ["the", "The", "ing", "erst", "ü", "é", "ñ", " ", "  ", "\n", "\t", ".", ",", "123", "日本", "\U0001f600", "a", "b", "o", "un", "re", "'", "-", "<s>", "<0x0A>", "www", "qu", "lich"]
    for n in (1, 2, 3, 5, 8, 13, 40, 200):
        for _ in range(60):
            yield "".join(rnd.choice(parts) for _ in range(n))
    yield from ["hello world", " lead", "trail ", "a" * 300, " " * 40 + "x", "x" + " " * 70, "ab" * 500, "\x00\x1c z", "internationalization" * 30]


def test_ids_equal_the_library_and_decode_back(model, library):
    for t in texts():
        ids = model.encode(t)
        assert ids == library.encode(t), repr(t)
        assert model.decode(ids) == t


def test_stream_commits_before_the_end(model):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    runs = list(model.stream(text))
    assert len(runs) > 20
    # The same search with all backpointers kept to the end.
    last = [""]
    for end in range(1, len(text) + 1):
        last.append(next(p for s in range(max(0, end - model.longest), end) if (end - s == 1 or text[s:end] in model.ids) for p in [text[s:end]] if not last[s] or model.follows(last[s], p)))
    out, k = [], len(text)
    while k:
        out.append(last[k])
        k -= len(last[k])
    assert [i for r in runs for i in r] == [model.ids[p] for p in reversed(out)]


def test_lower_one_eighth_block_is_exact(model):
    for t in ["a▁b", "▁", "x ▁ y"]:
        assert model.decode(model.encode(t)) == t


def test_frames(spark):
    rows = [(1, "the thing", "clash"), (None, None, None), (3, "", ""), (3, "", ""), (4, "w" * 20_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = pieces.encoded(docs, MODEL, ["doc_id"])
    got = out.collect()
    assert len(got) == 5 and all(r["round_trip"] for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (None, 3)} == {0}
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(out, MODEL).collect()}
    assert back[1] == "the thing" and back[4] == "w" * 20_000 and back[3] == ""
    assert pieces.encoded(docs.limit(0), MODEL, ["doc_id"]).count() == 0


@pytest.mark.parametrize(("short", "window", "moves"), [(48, 1 << 19, 1 << 25), (3, 1 << 19, 1 << 25), (48, 20, 1 << 25), (5, 300, 1 << 25), (48, 1000, 1 << 21)])
def test_texts_searched_together_have_the_ids_of_each(model, library, monkeypatch, short, window, moves):
    monkeypatch.setattr(pieces, "SHORT", short)
    monkeypatch.setattr(pieces, "WINDOW", window)
    monkeypatch.setattr(pieces, "MOVES", moves)
    if moves < 1 << 25:  # too few for all characters
        with open(MODEL, "rb") as f:
            model = pieces.Pieces(f.read())
        assert 1 < model.width <= model.kind.max()
    some = [None, "", *list(texts())[::3], "", " \n\n  a\n b \n", "\n", "日" * 100 + " 本", None]
    got = [ids.tolist() for ids in model.encoded(some)]
    assert got == [library.encode(t or "") for t in some]


def test_pairs_are_judged_again_after_the_table_was_full(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 64)
    with open(MODEL, "rb") as f:
        model = pieces.Pieces(f.read())
    some = list(texts())[::2]
    assert [ids.tolist() for ids in model.encoded(some)] == [library.encode(t) for t in some]
    assert model.fits.held <= 64


def test_new_words_take_no_python_call_each(model):
    rnd = random.Random(5)
    parts = ["the", "ing", "erst", "un", "re", "tion", "an", "ly", "ñ", "com"]
    first, second = (" ".join("".join(rnd.choices(parts, k=7)) for _ in range(5000)) for _ in range(2))
    model.encode(first)
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        ids = model.encode(second)
    finally:
        sys.setprofile(None)
    assert model.decode(ids) == second
    assert calls < 2500
