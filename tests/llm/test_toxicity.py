import random

import numpy as np
from pyspark.sql import functions as F
from specloom.llm import toxicity

DOCS = "doc_id long, text string, source string, score string, _tox string"
BAD = ["zorgling", "vexpat", "krudd"]


def corpus(n=400, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeioulmnrst", k=rnd.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = rnd.choices(words, k=rnd.randint(5, 200))
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            text[rnd.randrange(len(text))] = rnd.choice(BAD) + rnd.choice(["", "s", "ing"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_block_max_search_equals_dense_cosine_from_counts():
    rng = np.random.default_rng(0)
    idf = rng.uniform(0.5, 3, 40)
    examples = [(sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist()), None, int(rng.integers(0, 2))) for _ in range(700)]
    examples = [(t, rng.integers(1, 4, len(t)).tolist(), y, i) for i, (t, _, y) in enumerate(examples)]
    index = toxicity.build(examples, idf, 0.2, 0.1)
    assert index.good.sum() + index.bad.sum() == len(examples)
    least, dense = {}, {}
    for terms, counts, _, i in examples:  # straight from the rows, without the index
        x = np.zeros(40)
        x[terms] = (1 + np.log(counts)) * idf[terms]
        key = (tuple(terms), tuple(counts))
        least.setdefault(key, i)
        dense[least[key]] = x / np.linalg.norm(x)
    assert set(index.ids) == set(dense)
    for _ in range(50):
        terms = sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist())
        q = np.zeros(40)
        q[terms] = idf[terms]
        q /= np.linalg.norm(q)
        want = sorted((-round(float(x @ q), 9) for x in dense.values() if x @ q > 0))[:15]
        got = index.nearest(index.vector(terms, [1] * len(terms)), 15)
        assert [-round(s, 9) for s, _ in got] == want
        assert all(abs(dense[index.ids[e]] @ q - s) < 1e-12 for s, e in got)


def test_whole_search_from_texts(spark):
    """Evidence and cosines of real texts equal a dense search over vectors counted here, word by word."""
    rows = corpus(300, 9)
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    index, known = toxicity.fit(df, labels)

    def counted(text):
        x = np.zeros(len(known))
        for w in text.split():
            for t in toxicity.terms_of_word(w):
                if t in known:
                    x[known[t]] += 1
        return x

    every = {d: counted(t) for d, t, _ in rows}
    spread = sum((x > 0).astype(int) for x in every.values())
    idf = np.log((len(rows) + 1) / (spread + 1)) + 1e-3

    def scaled(x):
        y = np.where(x > 0, (1 + np.log(np.maximum(x, 1))) * idf, 0)
        return y / (np.linalg.norm(y) or 1)

    seen = 0
    for r in toxicity.score(df, (index, known)).collect():
        q = scaled(every[r.doc_id])
        for own, cosine in zip(r.examples, r.cosines, strict=True):
            assert abs(q @ scaled(every[own]) - cosine) < 1e-9
            seen += 1
        best = max((q @ scaled(every[i]) for i in index.ids), default=0)
        assert not best or abs(best - r.cosines[0]) < 1e-9
    assert seen > 100


def test_scores_are_calibrated():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    a, b = toxicity._curve(x, 1 - y, y)
    assert abs(a - 0.5) < 0.1 and abs(b + 1) < 0.15


def test_held_out_rows_are_found_and_labels_are_no_input(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "s", "clash", "clash") for d, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(d, y, None) for d, _, y in rows] + [(None, 1, 1), (5, None, 1), (99999, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    assert any("zorg" in t for t in model[1])
    got = {r.doc_id: r for r in toxicity.score(df, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    truth = {d: y for d, _, y in rows}
    held = [d for d in truth if got[d].out]
    assert 80 < len(held) < 200
    wrong = [d for d in held if (got[d].score >= toxicity.THRESHOLD) != truth[d]]
    assert len(wrong) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.examples for d, r in got.items() if r.score >= toxicity.THRESHOLD)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, flipped)).collect()}
    assert again == {d: r.score for d, r in got.items()}
    kept = toxicity.reject(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.score < toxicity.THRESHOLD}


def test_nulls_empty_long_and_equal_texts(spark):
    rows = corpus(200)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "krudd " * 40000), (None, "vexpat here"), (1003, "vexpat here"), (1003, "vexpat here")], "doc_id long, text string")
    both = docs.union(extra)
    found = [(r.doc_id, r.score) for r in toxicity.score(both, toxicity.fit(both, labels)).collect() if r.doc_id is None or r.doc_id >= 1000]
    score = dict(found)
    assert len(found) == 6
    assert score[1000] == score[1001] < 0.5 and score[1002] >= 0.7
    assert score[None] == score[1003] >= 0.7


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.score for r in toxicity.score(some, toxicity.fit(some, labels)).collect()] == [0.5]
