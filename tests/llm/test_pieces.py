import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from specloom.llm import pieces

MODEL = pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "  ", "▁", "▁▁a", " ▁ ", " x", "x ", "a" * 40, " " * 50, "a" + " " * 37 + "b", "\n\n\n", "<0x0A>", "<unk></s>", "=" * 21, "é ﬁ ①Ａ", "\x00a", "中文字 한글", "😀x", "​", "\xa0x"]


def want(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_match_the_library(text):
    own = pieces.load(MODEL)
    assert own.encode(text) == LIBRARY.encode(text)
    assert own.decode(LIBRARY.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))
    assert own.digest(text) == want(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aaabcdethn  \n\t▁é😀0123.,-'中"), max_size=80))
def test_any_text_matches_the_library(text):
    own = pieces.load(MODEL)
    assert own.encode(text) == LIBRARY.encode(text)
    assert own.digest(text) == want(text)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 5)
    monkeypatch.setattr(pieces, "PARTS_KEPT", 3)
    own = pieces.Pieces(MODEL)
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choices("thenational", k=7)) for _ in range(300))
    assert own.encode(text) == LIBRARY.encode(text) and own.digest(text) == want(text)
    assert len(own.words) <= 3 and len(own.parts) <= 3 and len(own.pairs) <= 5


def test_every_row_of_a_table(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, None), (2, ""), (3, "long text " * 30000), (4, "tie"), (5, "tie")]
    df = spark.createDataFrame([(d, t, "clash", 7) for d, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(df, MODEL).collect())
    assert got == sorted((str(d), *want(t)) for d, t in rows)
    back = pieces.decoded(pieces.encoded(df, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)
    assert pieces.digests(df.limit(0), MODEL).count() == 0
