import re
from collections import defaultdict

import pytest
from specloom.llm import mixing

DOCS = "doc_id long, text string, source string, size string, key string, target string"


def want_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if most * sizes[s] <= w[s] * level}
        full |= new
        if not new:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}


def check(rows, df, largest_slack=1.0):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, words, strict=True):
        sizes[s] += n
    goal = want_targets(sizes)
    got = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), n) for (d, _, _), n in zip(rows, words, strict=True))
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= biggest[s] + 1e-6
    return got


def make(spark, rows):
    return spark.createDataFrame([(d, t, s, "clash", "clash", "clash") for d, t, s in rows], DOCS)


def test_targets_are_met_within_a_document_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    rows += [(5000 + i, "word " * 10, None) for i in range(5)]
    df = make(spark, rows)
    first = check(rows, df)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_nulls_ties_repeats_and_empty_texts(spark):
    rows = [(1, None, "a"), (1, "x y z", "a"), (1, "x y z", "a"), (None, "x", "a"), (None, "x", "a"), (2, "", None), (3, "\t\n", None), (4, "w " * 50000, "b"), (5, "é é  ", "c")]
    check(rows, make(spark, rows))


def test_tree_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, "w " * (1 + i % 13), "ab"[i % 2]) for i in range(300)]
    check(rows, make(spark, rows))


def test_empty_table(spark):
    assert mixing.mix(make(spark, [])).count() == 0


def test_copies_carry_whole_rows(spark):
    rows = [(i, "w " * (1 + i % 13), "abc"[i % 3]) for i in range(200)] + [(7, "w " * 8, "b"), (None, "", "a")]
    df = make(spark, rows)
    out = mixing.copies(df)
    assert out.columns == df.columns
    have = defaultdict(int)
    for r in out.collect():
        have[r.doc_id, r.source] += len(r.text.split())
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.taken
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v}
    assert (None, "a") in have
