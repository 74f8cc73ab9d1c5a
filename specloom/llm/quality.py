"""Quality by ordinal cumulative-link regression: hashed-text weights shared by all grades, ordered thresholds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, table, unit

#: Hash buckets of words, and the features of a text's shape that come after them.
BUCKETS = 1 << 14
SHAPE = 12
#: Graded rows that the weights are fitted on, about and at most (picked by a hash of the id).
MAX_GRADED = 8_000
STEPS, RATE, RIDGE = 240, 0.05, 2e-3
#: A text is selected if its grade is at least GRADE with this probability.
GRADE, THRESHOLD = 1, 0.5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MEMO: dict[str, int] = {}
_MEMO_MAX = 300_000


def _bucket(word: str) -> int:
    found = _MEMO.get(word)
    if found is None:
        kept = "".join("0" if c.isdigit() else c for c in word.lower().strip(".,;:!?\"'()"))
        found = zlib.crc32((kept[:4] or word[:4]).encode("utf-8", "surrogatepass")) % BUCKETS
        if len(_MEMO) < _MEMO_MAX:
            _MEMO[word] = found
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed word beginnings, damped and scaled to length one, and the shape of the text."""
    text = text or ""
    words = _WORD.findall(text)
    n, size = max(1, len(words)), max(1, len(text))
    counts: dict[int, int] = {}
    for w in words:
        b = _bucket(w)
        counts[b] = counts.get(b, 0) + 1
    index = np.fromiter(counts, np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= np.sqrt((value * value).sum()) or 1.0
    lines = text.split("\n")
    shape = (
        1.0 if not words else 0.0,
        min(np.log1p(len(words)) / 10, 1.5),
        len(set(words)) / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / len(lines),
        sum(c.isupper() for c in text) / size,
        sum(c.isdigit() for c in text) / size,
        sum(not (c.isalnum() or c.isspace()) for c in text) / size,
        sum(w[-1] in ".!?" for w in words) / n,
        sum(w[-1] in "#$%&*|<>{}=" for w in words) / n,
        min(size / n, 40) / 40,
        text.count("|") / n,
    )
    return np.concatenate((index, np.arange(BUCKETS, BUCKETS + SHAPE))), np.concatenate((value, shape))


@dataclass
class Model:
    """P(grade > j) = 1 / (1 + exp(cuts[j] - x @ weights)), with rising cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """The probabilities that the grade exceeds 0, 1, ...: falling."""
        index, value = features(text)
        return _sigmoid(float(value @ self.weights[index]) - self.cuts)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> Model:
    """Weights and cuts by full-batch Adam on the cumulative-link likelihood; grades weigh alike whatever their share."""
    dim = BUCKETS + SHAPE
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    share = np.bincount(grades, minlength=levels) / max(1, len(grades))
    worth = np.where(share[grades] > 0, 1 / np.maximum(share[grades], 0.02), 0) if len(grades) else np.zeros(0)
    worth = worth / worth.sum() if len(worth) else worth
    w, first, gaps = np.zeros(dim), np.zeros(1), np.zeros(levels - 2)
    params = [w, first, gaps]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1 if len(rows) else 1):
        cuts = np.concatenate((first, first + np.cumsum(np.exp(gaps))))
        score = np.bincount(at, value * w[index], len(rows))
        wide = np.concatenate(([-np.inf], cuts, [np.inf]))
        low, high = wide[grades], wide[grades + 1]
        over, under = _sigmoid(score - low), _sigmoid(score - high)
        mass = np.maximum(over - under, 1e-9)
        d_low, d_high = over * (1 - over) / mass, under * (1 - under) / mass
        g_score = -worth * (d_low - d_high)
        g_cuts = np.zeros(levels + 1)
        np.add.at(g_cuts, grades, worth * d_low)
        np.add.at(g_cuts, grades + 1, -worth * d_high)
        g_cuts = g_cuts[1:-1]
        g_w = np.bincount(index, value * g_score[at], dim) + RIDGE * w
        g_gaps = np.cumsum(g_cuts[::-1])[::-1][1:] * np.exp(gaps)
        for p, g, a, b in zip(params, (g_w, np.array([g_cuts.sum()]), g_gaps), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    return Model(w, np.concatenate((first, first + np.cumsum(np.exp(gaps)))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, quality, toxic): 0 low quality, 1 good but toxic, 2 good; the least of several."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2))
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade")).where("grade is not null")


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 1 modulo 3 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, grades: DataFrame, levels: int = 3) -> Model:
    """The model from the texts of ``docs`` with a grade (doc_id, grade from 0 to levels - 1) outside the held-out third.

    About MAX_GRADED rows at most are learnt from, picked by hashes of their ids; executors turn them into hashed
    features and the driver gets these. Without any, every grade is as likely as its place between even cuts says.
    """
    rows = settled(grades.where(~held_out(F.col("doc_id")) & F.col("grade").between(0, levels - 1)))
    part = MAX_GRADED / max(1, rows.count())
    rows = rows.where(unit("doc_id", F.lit(5)) < part)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [features(t.as_py()) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())), part.column(1), part.column(2)], names=["i", "v", "grade", "h"])

    sample = texts.join(F.broadcast(rows), "doc_id").select("text", F.col("grade").cast("int").alias("grade"), F.xxhash64("text").alias("h"))
    kept = sample.mapInArrow(run, "i array<int>, v array<float>, grade int, h long").toArrow()
    order = np.argsort(kept.column("h").to_numpy(), kind="stable")
    index, value, grade = kept.column("i").to_pylist(), kept.column("v").to_pylist(), kept.column("grade").to_numpy()
    return fit_rows([(np.array(index[k], np.int64), np.array(value[k])) for k in order], grade[order].astype(np.int64), levels)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, expected_grade and tails (P(grade > 0), P(grade > 1), ...) of every whole text.

    Null texts count as empty; empty texts are scored by their shape. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("expected_grade", T.DoubleType()).add("tails", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.tails(t.as_py()) for t in batch.column(len(keep))]
            new = [pa.array([float(x.sum()) for x in found], pa.float64()), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], names=[*keep, "expected_grade", "tails"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, graded(table(spark, sf_dir, "labels"))))
    tail = F.element_at("tails", GRADE)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", tail.alias("tail_probability"), (tail >= THRESHOLD).alias("selected"))
