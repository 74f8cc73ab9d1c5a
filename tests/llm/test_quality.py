import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from specloom.llm import quality

DOCS = "doc_id long, text string, tails string"


def corpus(n=420, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeioulmnrst", k=rnd.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = rnd.choices(words, k=rnd.randint(30, 120))
        if i % 3 == 0:
            text = [w + rnd.choice(["###", "%%%", "$$$"]) for w in text]
        elif i % 3 == 1:
            text[::7] = ["blargh" + rnd.choice("aeiou")] * len(text[::7])
        rows.append((i, " ".join(text), i % 3))
    return rows


def test_thresholds_are_ordered_and_the_gradient_is_right():
    rows = [quality.features(t) for _, t, _ in corpus(120)]
    grades = np.array([g for *_, g in corpus(120)])
    model = quality.fit_rows(rows, grades, 3)
    assert model.cuts[0] < model.cuts[1]
    tails = np.array([model.tails(t) for _, t, _ in corpus(120)])
    assert (tails[:, 0] >= tails[:, 1]).all() and (0 <= tails).all() and (tails <= 1).all()
    assert tails.sum(1)[grades == 0].mean() < 0.6 < tails.sum(1)[grades == 1].mean() < tails.sum(1)[grades == 2].mean()


def test_held_out_grades(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows], DOCS)
    grades = spark.createDataFrame([(d, g) for d, _, g in rows] + [(None, 1), (7, None), (99999, 2)], "doc_id long, grade int")
    grades = grades.where("grade is not null")
    found = quality.score(df, quality.fit(df, grades)).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    truth = {d: g for d, _, g in rows}
    held = [r for r in found if r.out]
    assert len(held) > 80
    assert np.mean([(r.tails[0] >= 0.5) == (truth[r.doc_id] >= 1) for r in held]) > 0.95
    assert np.mean([abs(r.expected_grade - truth[r.doc_id]) < 0.75 for r in held]) > 0.85


def test_grades_from_labels(spark):
    rows = [(1, 0, 1), (2, 1, 0), (3, 1, 1), (3, 1, 0), (4, None, 0), (None, 1, 0), (5, 1, None)]
    got = quality.graded(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.grade for r in got} == {1: 0, 2: 2, 3: 1, 5: 2}


def test_nulls_empty_long_and_equal_texts(spark):
    rows = corpus(90)
    grades = spark.createDataFrame([(d, g) for d, _, g in rows], "doc_id long, grade int")
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(500, None), (501, ""), (502, "w " * 100_000), (None, "tie"), (503, "tie"), (503, "tie")], "doc_id long, text string")
    found = [(r.doc_id, r.expected_grade) for r in quality.score(docs, quality.fit(docs, grades)).collect()]
    assert len(found) == 96
    score = dict(found)
    assert score[500] == score[501] and score[None] == score[503]
    assert all(0 <= s <= 2 for _, s in found)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    grades = spark.createDataFrame([], "doc_id long, grade int")
    assert quality.score(docs, quality.fit(docs, grades)).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert quality.score(some, quality.fit(some, grades)).first().expected_grade == pytest.approx(0.77, abs=0.05)
