"""Hard negatives: for anchors and their nearest of the same label, the best others whose scores lie in a window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import settled, table

#: Positives of an anchor and negatives of a positive.
WANT = 5
#: Split points of the whole table, chosen from SAMPLE rows; split points of a node within a task; rows of a leaf.
SPLITS, SAMPLE, FAN, LEAF = 32, 2048, 12, 256
#: Rows and queries that meet in one task.
TILE, QUERIES = 4096, 4096
#: Distances are compared with this share of the largest norm as slack, well above their rounding.
SLACK = 1e-6
#: Below this, sums of products are exact in double precision.
EXACT = 1 << 53


class Space(NamedTuple):
    """How scores become distances: with a further component that gives all rows the norm ``m2`` (squared), a query's squared
    distance to a row is |q|^2 + m2 - 2 score. A window of scores so is an annulus around the query."""

    size: int
    m2: float
    exact: bool

    def rows(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        return np.concatenate((v, np.sqrt(np.maximum(self.m2 - (v * v).sum(1), 0))[:, None]), 1)

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate((v.astype(float), np.zeros((len(v), 1))), 1)

    def radius(self, q2: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q2 + self.m2 - 2 * score, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the first 3 n points, each the farthest from those before; fewer if the rest repeat them."""
    points = points[: 3 * n]
    chosen, gap = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < n and gap.max() > 0 and (best := int(gap.argmax())) not in chosen:
        chosen.append(best)
        gap = np.minimum(gap, distances(points, points[best : best + 1])[:, 0])
    return points[chosen]


def ranges(from_splits: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For split i and cell j the least and greatest distance of i to j's points; infinite and negative for empty cells."""
    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for j in np.unique(cell):
        own = from_splits[cell == j]
        low[:, j], high[:, j] = own.min(0), own.max(0)
    return low, high


def reached(to_splits: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Which cells each query must see: those of which no split point's range shows that they miss its annulus."""
    out = np.ones((len(to_splits), low.shape[1]), bool)
    for i in range(low.shape[0]):
        d = to_splits[:, i : i + 1]
        nearest, farthest = np.maximum(d - high[i], low[i] - d), d + high[i]
        out &= (nearest <= (outer + slack)[:, None]) & (farthest >= (inner - slack)[:, None])
    return out


class Tree:
    """A multiway hyperplane tree of the rows of one tile: nodes keep the ranges of each split point to each child."""

    def __init__(self, points: np.ndarray, of: np.ndarray):
        self.of, self.children = of, []
        if len(of) <= LEAF:
            return
        mine = points[of]
        self.splits = far_apart(mine, FAN)
        apart = distances(mine, self.splits)
        cell = apart.argmin(1)
        if (cell == cell[0]).all():
            return
        self.low, self.high = ranges(apart, cell, len(self.splits))
        self.children = [Tree(points, of[cell == j]) if (cell == j).any() else None for j in range(len(self.splits))]


class Search:
    """The best rows of a tile for queries with windows of scores; ties go to the row that comes first."""

    def __init__(self, space: Space, rows: dict, queries: dict, same: bool, want: int):
        self.space, self.same, self.want = space, same, want
        self.rows, self.queries = rows, queries
        self.points, self.at = space.rows(rows["v"]), space.queries(queries["v"])
        self.q2 = (self.at * self.at).sum(1)
        self.slack = SLACK * (np.sqrt(self.q2) + np.sqrt(space.m2)) + SLACK
        self.values, self.asked = rows["v"].astype(float), queries["v"].astype(float)
        self.inner = space.radius(self.q2, queries["hi"].astype(float))
        self.bound = queries["lo"].astype(float)
        n = len(self.q2)
        self.best, self.which = np.full((n, want), -np.inf), np.full((n, want), -1)

    def run(self) -> None:
        self.visit(Tree(self.points, np.arange(len(self.points))), np.arange(len(self.q2)))

    def visit(self, node: Tree, who: np.ndarray) -> None:
        if not node.children:
            for first in range(0, len(node.of), LEAF):
                self.leaf(node.of[first : first + LEAF], who)
            return
        apart = distances(self.at[who], node.splits)
        for j in np.argsort(np.where(np.isfinite(node.low).any(0), apart.mean(0), np.inf)):
            child = node.children[j]
            if child is not None:
                outer = self.space.radius(self.q2[who], self.bound[who])  # shrinks with what has been found
                seen = reached(apart, node.low[:, j : j + 1], node.high[:, j : j + 1], self.inner[who], outer, self.slack[who])[:, 0]
                if seen.any():
                    self.visit(child, who[seen])

    def leaf(self, of: np.ndarray, who: np.ndarray) -> None:
        score = self.asked[who] @ self.values[of].T
        alike = self.queries["label"][who][:, None] == self.rows["label"][of]
        good = (alike if self.same else ~alike) & (score >= self.queries["lo"][who][:, None]) & (score <= self.queries["hi"][who][:, None])
        good &= self.queries["row"][who][:, None] != self.rows["row"][of]
        some = np.flatnonzero(good.any(1))
        if not len(some):
            return
        who = who[some]
        scores = np.concatenate((self.best[who], np.where(good[some], score[some], -np.inf)), 1)
        which = np.concatenate((self.which[who], np.broadcast_to(of, (len(who), len(of)))), 1)
        order = np.lexsort((which, -scores), axis=1)[:, : self.want]
        self.best[who], self.which[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(which, order, 1)
        self.bound[who] = np.maximum(self.bound[who], self.best[who, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        query, place = np.nonzero(np.isfinite(self.best))
        return query, self.which[query, place], self.best[query, place].astype(np.int64).tolist()


def _plain(rows: dict, queries: dict, same: bool, want: int) -> tuple[list[int], list[int], list[int]]:
    """What ``Search`` finds, in integers of any size."""
    out: tuple[list[int], list[int], list[int]] = [], [], []
    values = [[int(x) for x in v] for v in rows["v"]]
    for n, own in enumerate(queries["v"]):
        own, kept = [int(x) for x in own], []
        for at, v in enumerate(values):
            score = sum(x * y for x, y in zip(own, v, strict=True))
            if (queries["label"][n] == rows["label"][at]) == same and queries["row"][n] != rows["row"][at] and queries["lo"][n] <= score <= queries["hi"][n]:
                kept.append((-score, at))
        for score, at in sorted(kept)[:want]:
            out[0].append(n), out[1].append(at), out[2].append(-score)
    return out


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(row, id, label, v): rows with whole vectors, components times ``scale`` and floored; shorter vectors end in zeros.

    Rows whose label or vector is null, or with a null or non-finite component, are left out. ``row`` tells repeated rows apart.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = chosen.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    kept = settled(kept.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long"))))
    size = kept.agg(F.max(F.size("v"))).first()[0] or 0
    return kept.withColumn("v", F.when(F.size("v") < size, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))).otherwise(F.col("v")))


class Index:
    """The upper level of the tree: every row in the cell of its nearest split point, the cells in tiles of bounded size.

    Split points come from SAMPLE rows at most, by hash; the ranges of each to each cell are taken over all rows.
    """

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))
        told = rows.agg(F.max(F.size("v")).alias("size"), F.max(square).alias("m2"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top"), F.count("*").alias("n")).first()
        size, top = told["size"] or 0, told["top"] or 0.0
        self.space = space = Space(size, (told["m2"] or 0.0) * (1 + 1e-12), size * top * top < EXACT)
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toPandas()["v"]
        points = space.rows(np.array([list(v) for v in sample], float).reshape(len(sample), size))
        splits = far_apart(points, SPLITS) if len(points) else np.zeros((1, size + 1))
        self.splits = sent = self.spark.sparkContext.broadcast(splits)
        n = len(splits)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = distances(space.rows(_matrix(pa.chunked_array([batch.column(3)]), size)), sent.value).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["row", "id", "label", "v", "cell"])

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
            for batch in batches:
                if batch.num_rows:
                    a, b = ranges(distances(space.rows(_matrix(pa.chunked_array([batch.column(0)]), size)), sent.value), batch.column(1).to_numpy(), n)
                    low, high = np.minimum(low, a), np.maximum(high, b)
            i, j = np.nonzero(np.isfinite(low))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(low[i, j]), pa.array(high[i, j])], names=["i", "j", "low", "high"])

        kinds = dict(rows.dtypes)
        placed = settled(rows.select("row", "id", "label", "v").mapInArrow(assign, f"row long, id {kinds['id']}, label {kinds['label']}, v array<long>, cell int"))
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for r in placed.select("v", "cell").mapInArrow(spans, "i int, j int, low double, high double").groupBy("i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            self.low[r["i"], r["j"]], self.high[r["i"], r["j"]] = r["low"], r["high"]
        tiles = {r["cell"]: 1 + r["count"] // TILE for r in placed.groupBy("cell").count().collect()}  # a row a split point
        self.tiles = self.spark.createDataFrame([(c, n) for c, n in tiles.items()] or [(0, 1)], "cell int, tiles long")
        self.rows = settled(placed.join(F.broadcast(self.tiles), "cell").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("long")).drop("tiles"))

    def _routed(self, queries: DataFrame, home: bool) -> DataFrame:
        """``queries`` with each cell they must see: their nearest split point's, or all others that ``reached`` leaves."""
        space, splits, low, high = self.space, self.splits, self.low, self.high
        at = {c: queries.columns.index(c) for c in ("v", "lo", "hi", "bound")}
        names = [*queries.columns, "cell"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                asked = space.queries(_matrix(pa.chunked_array([batch.column(at["v"])]), space.size))
                apart, q2 = distances(asked, splits.value), (asked * asked).sum(1)
                nearest = apart.argmin(1)
                if home:
                    who, cell = np.arange(len(nearest)), nearest
                else:
                    number = lambda c: batch.column(at[c]).to_numpy(zero_copy_only=False).astype(float)
                    slack = SLACK * (np.sqrt(q2) + np.sqrt(space.m2)) + SLACK
                    seen = reached(apart, low, high, space.radius(q2, number("hi")), space.radius(q2, np.maximum(number("lo"), number("bound"))), slack)
                    seen[np.arange(len(nearest)), nearest] = False
                    who, cell = np.nonzero(seen)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(who)) for c in batch.columns), pa.array(cell, pa.int32())], names=names)

        return queries.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in queries.dtypes) + ", cell int")

    def _met(self, queries: DataFrame, groups: int, same: bool, want: int) -> DataFrame:
        """(q, pos, id, row, score): of each tile the ``want`` best rows for each query that must see it."""
        space = self.space
        one = settled(queries).join(F.broadcast(self.tiles), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        one = one.withColumn("group", F.pmod(F.xxhash64("q", "pos"), F.lit(groups)).cast("long"))
        keys = ["cell", "tile", "group"]
        needed = one.select(*keys).distinct()
        rows = self.rows.join(needed, ["cell", "tile"]).select(F.col("cell").alias("_c"), F.col("tile").alias("_t"), F.col("group").alias("_g"), "row", "id", "label", "v")
        kind = dict(self.rows.dtypes)["id"]
        schema = pa.schema([("q", pa.int64()), ("pos", pa.int32()), ("id", to_arrow_type(self.rows.schema["id"].dataType)), ("row", pa.int64()), ("score", pa.int64())])

        def meet(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
            if not asked.num_rows or not rows.num_rows:
                return schema.empty_table()
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
            parts = [{c: t[c].to_numpy() for c in names} | {"v": _matrix(t["v"], space.size)} for t, names in ((rows, ("row", "label")), (asked, ("row", "label", "lo", "hi")))]
            if space.exact:
                search = Search(space, *parts, same, want)
                search.run()
                query, which, score = search.found()
            else:
                query, which, score = _plain(*parts, same, want)
            query, which = pa.array(query, pa.int64()), pa.array(which, pa.int64())
            return pa.table([asked["q"].take(query), asked["pos"].take(query), rows["id"].take(which), rows["row"].take(which), pa.array(score, pa.int64())], schema=schema)

        out = one.select(*keys, "q", "pos", "row", "label", "v", "lo", "hi").groupBy(*keys).cogroup(rows.groupBy("_c", "_t", "_g"))
        return out.applyInArrow(meet, f"q long, pos int, id {kind}, row long, score long")

    def best(self, queries: DataFrame, same: bool, want: int = WANT) -> DataFrame:
        """(q, pos, rank, id, score): for each of ``queries`` (q, pos, row, label, v, lo, hi) the best ``want`` rows but its own.

        Only rows with the query's label (``same``) or with another, and scores from lo to hi. First each query sees the cell of
        its nearest split point; the last score that it wants of these bounds its annulus for the others.
        """
        order = "row_number() over (partition by q, pos order by score desc, id nulls last, row)"
        cut = lambda df: df.withColumn("rank", F.expr(order)).where(F.col("rank") <= want)
        groups = 1 + queries.count() // QUERIES
        start = queries.withColumn("bound", F.col("lo"))
        near = settled(cut(self._met(self._routed(start, True), groups, same, want)))
        bounds = near.where(F.col("rank") == want).select("q", "pos", F.col("score").alias("bound"))
        again = queries.join(bounds, ["q", "pos"], "left").withColumn("bound", F.coalesce("bound", "lo"))
        far = self._met(self._routed(again, False), groups, same, want)
        return settled(cut(near.drop("rank").union(far)).select("q", "pos", "rank", "id", "score"))


def mined(rows: DataFrame, anchors, share: int = 80, want: int = WANT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (row, id, label, v).

    ``anchors`` is a condition on rows. An anchor's positives are its best ``want`` other rows of its label by integer inner product,
    a positive's negatives the best ``want`` of other labels with share * positive <= 100 * negative <= 100 * positive; ties go to the
    smaller id, null ids last. Windows of negative positives are empty. A repeated row is a row of its own, as anchor and as other;
    anchors without positives, and positives without negatives, give no rows, nor does an empty table. Scores must fit 64 bits.
    """
    rows = settled(rows)
    index = Index(rows)
    asked = settled(rows.where(anchors).select(F.col("row").alias("q"), F.lit(0).alias("pos"), "row", "label", "v", F.lit(-(1 << 63)).alias("lo"), F.lit((1 << 63) - 1).alias("hi"), F.col("id").alias("anchor_id")))
    plain = asked.drop("anchor_id")
    positives = index.best(plain, True, want).select("q", F.col("rank").cast("int").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    lowest = F.expr(f"cast((cast(positive_score as decimal(19, 0)) * {share} + 99) div 100 as long)")
    windows = positives.where(p >= 0).join(plain.drop("pos", "lo", "hi"), "q").select("q", "pos", "row", "label", "v", lowest.alias("lo"), p.alias("hi"))
    negatives = index.best(settled(windows), False, want)
    both = negatives.join(positives, ["q", "pos"]).join(asked.select("q", "anchor_id"), "q")
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors(rows.withColumn("label", label)), F.col("id") % 100 == 0)


ORACLE = """
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
         s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.rid = b.rid AS own, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
         p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS pos FROM s WHERE same AND NOT own QUALIFY pos <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.rid, pos ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
