import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from specloom.llm import packing
from tokenizers import Tokenizer

MODEL = packing.default_model()
LIBRARY = Tokenizer.from_file(MODEL)
ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "can't  stop\n\n\tnow ", "中文字 한글 😀", "\xa0x y", "́e", "1" * 5000, "a" * 3000, " " * 700, "\x00�"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts_are_the_librarys(text):
    assert packing.load(MODEL).fast is not None
    assert packing.load(MODEL).ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text_are_the_librarys(text):
    assert packing.load(MODEL).ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def naive(lengths, size):
    """Best-fit decreasing, piece by piece."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(size - n)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 40).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    size, lengths = case
    counts, used = Counter(lengths), {}
    steps = packing.plan(counts, size)
    for n, (length, rank, first, before, each) in enumerate(steps):
        after = steps[n + 1][1] if n + 1 < len(steps) and steps[n + 1][0] == length else counts[length]
        for i in range(after - rank):
            of = first + i // each
            assert used.get(of, 0) == before + i % each * length
            used[of] = used.get(of, 0) + length
    assert sorted(size - u for u in used.values()) == naive(lengths, size)
    assert sum(used.values()) == sum(lengths)


def check(rows, texts, size, end):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        own = sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == size for r in own[1:])
        assert len(own) == -(-len(ids) // size)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(seqs)


def test_pack_is_whole_and_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "IN_BUCKET", 7)
    rng = random.Random(3)
    words = ["one", "three", "house", "тест", "中文", "wünsche", "2024", "-"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 60, 300]))) for i in range(300)}
    texts |= {300 + i: "same text here" for i in range(100)}  # one hot length
    texts[900], texts[901] = None, "long " * 4000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = packing.pack(docs, MODEL, size=64).collect()
    n = check(found, texts, 64, 2)
    assert n == len(naive([r["length"] for r in found], 64))


def test_empty_table_extra_columns_null_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, MODEL).collect() == []
    docs = spark.createDataFrame([(None, "a", 1, 2), (None, "b c", 3, 4), (5, "x", 1, 1), (5, "x", 1, 1)], "doc_id long, text string, length long, _row long")
    rows = packing.pack(docs, MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (0, 3), (5, 2), (5, 2)]
    assert {r["sequence_id"] for r in rows} == {0} and sorted(r["offset"] for r in rows) == [0, 3, 5, 7]


def test_query_over_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op13(spark, sf).collect()
    n = check(rows, texts, 1024, 2)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 1024) * 1.02 + 1
