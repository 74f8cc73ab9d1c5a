"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free, settled, table, unit

#: Labelled rows that the examples are drawn from, about and at most (picked by a hash of the id).
MAX_LABELLED = 24_000
#: Examples with at least one term that the index holds at most, and terms.
MAX_EXAMPLES = 20_000
MAX_TERMS = 4_096
#: Neighbours that vote.
NEIGHBOURS = 15
#: Examples in a block.
BLOCK = 64
#: Documents of class toxic that score at least this are predicted toxic.
THRESHOLD = 0.7
#: Votes of the prior: so many examples of the base rate join each vote.
PRIOR = 0.3
#: Examples whose votes by the others give the calibration, about; the ridge of its curve.
CALIBRATION, RIDGE = 2_000, 1.0
#: A term is kept if the lower confidence bound of its rate of toxic texts is over so many times the base rate.
LIFT, CONFIDENCE = 3.0, 2.4

_WORD = re.compile(r"\w+")
_KNOWN: dict[str, tuple[str, ...]] = {}
#: Words whose terms are remembered by a worker, and scores of texts.
_KNOWN_MAX, _SCORES_MAX = 60_000, 10_000


def terms_of_word(word: str) -> tuple[str, ...]:
    """A word's terms: itself if short, and its first four and six letters, which stand for its stem."""
    found = _KNOWN.get(word)
    if found is None:
        found = ((f"={word}",) if len(word) <= 6 else ()) + tuple(f"{word[:n]}+" for n in (4, 6) if len(word) > n)
        if len(_KNOWN) < _KNOWN_MAX:
            _KNOWN[word] = found
    return found


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _sketch(words: list[str]) -> int:
    """The least hash of a text's word five-grams: near copies mostly share it, so that they count once in training."""
    if len(words) <= 5:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(len(words) - 4)) >> 1


def _sketches(rows: DataFrame) -> DataFrame:
    """(h, toxic, sketch) for rows (text, toxic, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_sketch(words_of(t.as_py())) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), found], names=["h", "toxic", "sketch"])

    return rows.select("text", "toxic", "h").mapInArrow(run, "h long, toxic int, sketch long")


def _by_term(rows: DataFrame) -> DataFrame:
    """(term, n, a) from (text, toxic): texts with a term and toxic ones among them; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for term in {t for w in set(words_of(text.as_py())) for t in terms_of_word(w)}:
                    own = n.setdefault(term, [0, 0])
                    own[0] += 1
                    own[1] += toxic
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[t][0] for t in names], pa.int64()), pa.array([n[t][1] for t in names], pa.int64())], names=["term", "n", "a"])

    return rows.select("text", "toxic").mapInArrow(run, "term string, n long, a long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


class _Counter:
    """Counts the chosen terms of texts; remembers the chosen terms of words."""

    def __init__(self, known: dict[str, int]):
        self.known, self.memo = known, {}

    def __call__(self, text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        seen: dict[int, int] = {}
        memo = self.memo
        for word in words_of(text):
            hit = memo.get(word)
            if hit is None:
                hit = tuple(self.known[t] for t in terms_of_word(word) if t in self.known)
                if len(memo) < _KNOWN_MAX:
                    memo[word] = hit
            for t in hit:
                seen[t] = seen.get(t, 0) + 1
        order = tuple(sorted(seen))
        return order, tuple(seen[t] for t in order)


def _spread(texts: DataFrame, known: dict[str, int]) -> np.ndarray:
    """In how many of all rows each chosen term occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = _Counter(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for text in batch.column(0):
                for t in count(text.as_py())[0]:
                    n[t] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["t", "n"])

    out = np.zeros(len(known))
    for t, n in texts.mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n")).collect():  # a row per chosen term
        out[t] = n
    return out


@dataclass
class Index:
    """Examples as unit TF-IDF vectors: an inverted list per term, and per term and block of BLOCK examples its greatest weight.

    ``nearest`` is exact: blocks are taken by falling upper bound, the query's weights times the blocks' greatest
    ones, until no block left can reach the k-th score found. Of a block only the parts of the query terms' lists
    are read.
    """

    idf: np.ndarray
    base: float
    none: float  # score of a text without any chosen term
    good: np.ndarray = field(default_factory=lambda: np.zeros(0))  # clean texts of each example (equal vectors are one)
    bad: np.ndarray = field(default_factory=lambda: np.zeros(0))  # toxic texts of each example
    ids: list = field(default_factory=list)  # the least id of each example's texts
    most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # greatest weight by term and block
    lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # by term: example, weight, first place by block
    curve: tuple[float, float] = (1.0, 0.0)  # slope and height of the calibration, over the odds' logarithm

    def vector(self, terms, counts) -> list[tuple[int, float]]:
        raw = [(t, (1 + np.log(c)) * self.idf[t]) for t, c in zip(terms, counts, strict=True)]
        norm = np.sqrt(sum(w * w for _, w in raw)) or 1.0
        return [(t, float(w / norm)) for t, w in raw]

    def nearest(self, vector: list[tuple[int, float]], k: int) -> list[tuple[float, int]]:
        """The k best (cosine, example) of those that share a term, best first; ties go to the lower example."""
        if not vector or not self.lists:
            return []
        terms, weights = np.array([t for t, _ in vector]), np.array([w for _, w in vector])
        bounds = weights @ self.most[terms]
        top: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(top) == k and bounds[b] < -top[-1][0] - 1e-9):
                break
            scores = np.zeros(BLOCK)
            for t, w in vector:
                example, weight, first = self.lists[t]
                own = slice(first[b], first[b + 1])
                scores[example[own] - b * BLOCK] += w * weight[own]
            floor = -top[-1][0] - 1e-12 if len(top) == k else 0.0
            own = np.flatnonzero((scores > 0) & (scores >= floor))
            if len(own):
                top = sorted([*top, *((-float(scores[i]), b * BLOCK + int(i)) for i in own)])[:k]
        return [(-s, e) for s, e in top]

    def vote(self, terms, counts, k: int = NEIGHBOURS, but: int = -1) -> tuple[float, list, list[float]]:
        """The score, the ids of the examples that voted and their cosines; example ``but`` does not vote."""
        if not len(terms):
            return self.none, [], []
        top = [x for x in self.nearest(self.vector(terms, counts), k + (but >= 0)) if x[1] != but][:k]
        yes, every = PRIOR * self.base, PRIOR
        for cosine, e in top:
            weight = cosine**4
            yes += weight * float(self.bad[e])
            every += weight * float(self.good[e] + self.bad[e])
        score = float(yes / every)
        odds = self.curve[0] * math.log(score / (1 - score)) + self.curve[1]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))), [self.ids[e] for _, e in top], [c for c, _ in top]


def build(examples: list[tuple[list[int], list[int], int, int]], idf: np.ndarray, base: float, none: float) -> Index:
    """The index of (terms, counts, toxic, id) rows; rows with equal terms and counts are one example with both counts.

    The curve comes from the votes of the other examples on some of them (CALIBRATION): a logistic curve over the
    votes' odds, drawn towards the identity, so that a score is the share of toxic texts among those that get it.
    """
    index = Index(idf, base, none)
    merged: dict[tuple, list] = {}
    for terms, counts, toxic, own in examples:
        if len(terms):
            found = merged.setdefault((tuple(terms), tuple(counts)), [0, 0, own])
            found[toxic] += 1
            found[2] = own if found[2] is None or (own is not None and own < found[2]) else found[2]
    rows = sorted(merged)
    index.good, index.bad = (np.array([float(merged[r][i]) for r in rows]) for i in (0, 1))
    index.ids = [merged[r][2] for r in rows]
    blocks = -(-len(rows) // BLOCK)
    made: list[list[tuple[int, float]]] = [[] for _ in idf]
    for e, (terms, counts) in enumerate(rows):
        for t, w in index.vector(terms, counts):
            made[t].append((e, w))
    index.most = np.zeros((len(idf), blocks))
    for t, own in enumerate(made):
        example, weight = np.array([e for e, _ in own], np.int64), np.array([w for _, w in own])
        index.lists.append((example, weight, np.searchsorted(example, np.arange(blocks + 1) * BLOCK)))
        np.maximum.at(index.most[t], example // BLOCK, weight)
    part = range(0, len(rows), max(1, len(rows) // CALIBRATION))
    votes = np.array([index.vote(*rows[e], but=e)[0] for e in part])
    if len(votes):
        index.curve = _curve(np.log(votes / (1 - votes)), index.good[list(part)], index.bad[list(part)])
    return index


def _curve(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and height of the logistic curve of the toxic share over ``x``, by Newton steps; a ridge draws it to (1, 0)."""
    n = good + bad
    target = (bad + 0.5 * n / n.sum()) / (n + n / n.sum())
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(n * (p - target) * x).sum() + RIDGE * (a - 1), (n * (p - target)).sum() + RIDGE * b])
        h = np.array([[(w * x * x).sum() + RIDGE, (w * x).sum()], [(w * x).sum(), w.sum() + RIDGE]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - float(np.clip(step[0], -1, 1))), b - float(np.clip(step[1], -1, 1))
    return a, b


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Index, dict[str, int]]:
    """The index and its terms, from the texts of ``docs`` that ``labels`` marks (doc_id, toxic) outside the held-out third.

    Terms are those that labelled texts show to go with toxicity: near copies count once and the lower confidence
    bound of a term's toxic rate must be ``LIFT`` times the base rate. Their document frequencies come from all
    rows of ``docs``. About ``MAX_LABELLED`` labelled ids at most are learnt from, picked by their hashes; those
    with a chosen term, up to about ``MAX_EXAMPLES``, are the index. Null labels, null texts and labels without a
    document teach nothing; a document with several labels is toxic if any of them says so. Without any labelled
    text there are no terms and every score is the prior, one half.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = settled(marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    part = MAX_LABELLED / max(1, marked.count())
    marked = marked.where(unit("doc_id", F.lit(7)) < part)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = settled(texts.join(F.broadcast(marked), "doc_id").select("text", "toxic", F.xxhash64("text").alias("h"), "doc_id"))
    once = settled(_sketches(rows).groupBy("sketch", "toxic").agg(F.min("h").alias("h")))
    totals = dict(once.groupBy("toxic").count().collect())
    good, bad = totals.get(0, 0), totals.get(1, 0)
    base = (bad + 0.5) / (good + bad + 1)
    n, a, z = F.col("n"), F.col("a"), CONFIDENCE
    rate = (a + z * z / 2) / (n + z * z) - z / (n + z * z) * F.sqrt(a * (n - a) / n + z * z / 4)
    by_term = _by_term(rows.join(F.broadcast(once.select("h").distinct()), "h").dropDuplicates(["h", "toxic"]))
    chosen = by_term.where(rate > min(0.9, LIFT * base)).orderBy(F.desc(rate), F.desc("a"), "term").limit(MAX_TERMS).collect()
    known = {r["term"]: i for i, r in enumerate(sorted(chosen, key=lambda r: r["term"]))}
    spread = _spread(docs.select(F.col("text").cast("string").alias("text")), known)
    idf = np.log((docs.count() + 1) / (spread + 1)) + 1e-3
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(shared.value)
        for batch in batches:
            found = [count(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int32())), *(batch.column(i) for i in (1, 2))], names=["terms", "counts", "toxic", "h"])

    own = rows.groupBy("h", "toxic").agg(F.min("doc_id").alias("own"))
    made = rows.select("text", "toxic", "h").mapInArrow(vectors, "terms array<int>, counts array<int>, toxic int, h long").distinct()
    made = settled(made.join(own, ["h", "toxic"]).select("terms", "counts", "toxic", "h", "own"))
    blank = dict(made.where(F.size("terms") == 0).groupBy("toxic").count().collect())
    none = (blank.get(1, 0) + base) / (blank.get(0, 0) + blank.get(1, 0) + 1)
    made = made.where(F.size("terms") > 0)
    kept = made.where(unit("h", F.lit(8)) < MAX_EXAMPLES / max(1, made.count())).collect()
    return build([(r["terms"], r["counts"], r["toxic"], r["own"]) for r in kept], idf, base, none), known


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 1 modulo 3 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: tuple[Index, dict[str, int]], keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, score, the ids of the examples that voted and their cosines (evidence), for every row and whole text.

    Texts without any chosen term, null and empty ones too, get the rate of toxic examples without one. Equal
    texts get equal scores; ``prefix`` goes before the new names, where ``keep`` has columns of these names.
    """
    index, known = model
    shared = docs.sparkSession.sparkContext.broadcast((index, known))
    names = [*keep, *(() if "text" in keep else ("text",))]
    at, rows = names.index("text"), docs.select(*names)
    schema = docs.select(*keep).schema
    ids = docs.schema["doc_id"].dataType
    for name, kind in (("score", T.DoubleType()), ("examples", T.ArrayType(ids)), ("cosines", T.ArrayType(T.DoubleType()))):
        schema = schema.add(prefix + name, kind)
    made = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, terms = shared.value
        count, memo = _Counter(terms), {}
        for batch in batches:
            out = []
            for text in batch.column(at):
                key = count(text.as_py())
                found = memo.get(key)
                if found is None:
                    found = own.vote(*key)
                    if len(memo) < _SCORES_MAX:
                        memo[key] = found
                out.append(found)
            new = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.float64(), pa.list_(to_arrow_type(ids)), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], names=made)

    return rows.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as they are, whatever their names."""
    names, prefix = tuple(docs.columns), free(docs, "tox")
    while any(n.lower().startswith(prefix) for n in names):
        prefix += "_"
    return score(docs, fit(docs, labels), names, prefix).where(F.col(f"{prefix}score") < THRESHOLD).select(*names)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    voted = F.array_join(F.transform(F.arrays_zip("examples", "cosines"), lambda x: F.format_string("%s %.4f", x["examples"].cast("string"), x["cosines"])), ", ")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), voted.alias("evidence"))
