import math
import random

import numpy as np
import pytest
from specloom.llm import negatives as N
from pyspark.sql import functions as F

from tests.oracle import compare

KIND = "vec_id long, embedding array<float>, label int, row long, v string"


def brute(rows, share=80, want=5, every=10):
    kept = []
    for vec_id, e, label, *_ in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    id_of = lambda i: (kept[i][0] is None, kept[i][0] or 0, i)
    dot = lambda a, b: sum(x * y for x, y in zip(kept[a][2], kept[b][2], strict=False))
    out = []
    for a, (vec_id, label, _) in enumerate(kept):
        if vec_id is None or vec_id % every:
            continue
        scores = [(dot(a, b), b) for b in range(len(kept)) if b != a]
        positives = sorted(((-s, *id_of(b)) for s, b in scores if kept[b][1] == label))[:want]
        for s, _, _, b in positives:
            p = -s
            inside = sorted((-n, *id_of(c)) for n, c in scores if kept[c][1] != label and share * p <= 100 * n <= 100 * p)[:want]
            out += [(vec_id, kept[b][0], r, kept[c][0], p, -n) for r, (n, _, _, c) in enumerate(inside, 1)]
    return sorted(out, key=str)


def made(seed, n=400, size=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        e = [rng.gauss(0.1, 0.2) for _ in range(size)]
        if i % 3 == 0:
            e = [0.25, 0.5, -0.125, 0.0, 0.3, 0.1]  # a third has one vector
        rows.append((i, e, rng.choice([0, 1, 2]), 7, "x"))
    rows += [(None, [0.2] * size, 1, 7, "x"), (10, [0.3] * size, 2, 7, "x"), (500, [0.2] * 3, 0, 7, "x"), (510, [], 1, 7, "x")]
    rows += [(520, None, 1, 7, "x"), (530, [0.1] * size, None, 7, "x"), (540, [float("nan")] * size, 1, 7, "x"), (550, [float("inf")] + [0.0] * 5, 1, 7, "x"), (560, [None] * size, 1, 7, "x")]
    return rows + [(570, [0.0] * size, 2, 7, "x"), (580, [-0.4] * size, 2, 7, "x")]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def mined(spark, rows, **options):
    return found(N.mined(N.vectors(spark.createDataFrame(rows, KIND).repartition(3)), F.col("id") % 10 == 0, **options))


def test_equals_brute_force_with_hot_vectors_ties_and_odd_rows(spark):
    rows = made(1)
    assert mined(spark, rows) == brute(rows)


def test_many_tiles_groups_and_cells_change_nothing(spark, monkeypatch):
    rows = made(2, 300)
    monkeypatch.setattr(N, "TILE", 40)
    monkeypatch.setattr(N, "QUERIES", 20)
    monkeypatch.setattr(N, "SPLITS", 5)
    monkeypatch.setattr(N, "SAMPLE", 30)
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 2**18 for _ in range(8)], i % 3, 0, "x") for i in range(60)]
    want = brute(rows)
    assert want and max(r[4] for r in want) > 2**53
    assert mined(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(0, [0.5], 1, 0, "x")], [(0, [0.5], 1, 0, "x"), (1, [0.5], 1, 0, "x")], [(0, None, 1, 0, "x")]])
def test_small_and_empty_tables(spark, rows):
    assert mined(spark, rows) == brute(rows) == []


def test_tree_reaches_all_and_skips_some():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (12, 8))
    values = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 10, (3000, 8))).astype(np.int64)
    space = N.Space(8, float((values * values).sum(1).max()), True)
    rows = {"v": values, "row": np.arange(3000), "label": rng.integers(0, 2, 3000)}
    asked = {"v": values[:50], "row": np.arange(50), "label": rows["label"][:50], "lo": np.full(50, -(1 << 63)), "hi": np.full(50, (1 << 63) - 1)}
    search, seen, leaf = N.Search(space, rows, asked, True, 5), [], N.Search.leaf
    search.leaf = lambda of, who: (seen.append(len(of) * len(who)), leaf(search, of, who))
    search.run()
    assert [x.tolist() if hasattr(x, "tolist") else x for x in search.found()] == [list(x) for x in N._plain(rows, asked, True, 5)]
    assert sum(seen) < 0.7 * 50 * 3000


def test_query_equals_its_sql(spark):
    compare(spark, N.op11, N.ORACLE, "/root/testdata/sf0.01")
