"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, settled, table, unit

#: Weights of the sources in code-point order (null last), repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
#: Fractional documents that one task rounds together; each such group hands one residual up the tree.
FAN_IN = 256
#: Probabilities this close to 0 or 1 count as integral.
EPS = 1e-9


def _keys(doc_id: Column, text: Column, source: Column) -> list[Column]:
    """Two hashes that together name a document: rows alike in id, text and source have the same."""
    return [F.xxhash64(doc_id, text, source).alias("k1"), F.xxhash64(F.lit(1), source, text, doc_id).alias("k2")]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, k1, k2): the number of words of each document and its keys."""
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select("doc_id", source.alias("source"), size.alias("size"), *_keys(F.col("doc_id"), text, source))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size): weights share ``share`` of all sizes, none above ``most`` of its own.

    What a source cannot take is reshared among the others by weight until none is above its limit. The table has
    one row per source; each round of resharing brings two sums to the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.select("*", F.expr("row_number() over (order by source is null, source)").alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by = settled(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit")))
    total = (by.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, F.lit(False)
    while True:
        held, open_weight, n = by.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))
        ).first()
        if not open_weight:
            break
        level = (total - held) / open_weight
        full = full | (F.col("limit") <= F.col("weight") * level)
        if by.agg(F.sum(full.cast("int"))).first()[0] == n:
            break
    return by.select("source", "source_size", F.when(full, F.col("limit")).otherwise(F.col("weight") * level).alias("target"))


def _round_group(items: Column) -> Column:
    """Pivotal rounding of an array of (key, p, w, ...): the items with p settled at 0 or 1, the last one maybe not.

    Two fractional items meet; mass moves between them in words, so that the sum of p * w stays, up to the point
    where one of them is integral. Which way is drawn so that each p keeps its mean. The other one goes on.
    """

    def step(state: Column, new: Column) -> Column:
        old = state["now"]
        up = F.least((1 - old["p"]) * old["w"], new["p"] * new["w"])
        down = F.least(old["p"] * old["w"], (1 - new["p"]) * new["w"])
        moved = F.when(unit(old["key"], new["key"], old["w"], new["w"]) * (up + down) < down, up).otherwise(-down)
        moved = F.when(_whole(old["p"]), F.lit(0.0)).otherwise(moved)
        first = old["p"] + moved / old["w"]
        second = new["p"] - moved / new["w"]
        a, b = old.withField("p", first), new.withField("p", second)
        swap = ~_whole(first)
        return F.struct(F.when(swap, a).otherwise(b).alias("now"), F.concat(state["done"], F.array(F.when(swap, b).otherwise(a))).alias("done"))

    start = F.struct(F.element_at(items, 1).alias("now"), F.slice(items, 1, 0).alias("done"))
    end = F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)
    return F.concat(end["done"], F.array(end["now"]))


def _whole(p: Column) -> Column:
    return (p <= EPS) | (p >= 1 - EPS)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (words taken, repeats counted).

    Every document of a source has the same expected number of copies, target / source_size. Its whole part is
    certain; the fraction is rounded by ``_round_group`` in groups of about ``FAN_IN`` documents of one source,
    dealt by hash, so a hot source is spread over as many tasks as it needs. Each group leaves at most one
    fractional document, which meets those of other groups in the next level, until a source has one group; the
    last residual is drawn. A source's taken words so differ from its target by less than one document.

    Null texts have size 0, as empty ones; documents of size 0 and sources without words take 0. Null sources are
    one source, last in order. Rows alike in doc_id and text are told apart by a number within their like. An
    empty table gives no rows. Draws are hashes of the rows and ``seed``, so reruns agree.
    """
    rows = settled(sized(docs))
    goal = targets(rows.select("source", "size"), share, most, weights)
    goal = settled(_with_counts(goal, rows))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = F.expr("row_number() over (partition by k1, k2 order by size)")
    left = rows.select("*", F.xxhash64("k1", "k2", same, F.lit(seed)).alias("key"))
    known = F.broadcast(goal.withColumnRenamed("source", "s")) if goal.count() <= 100_000 else goal.withColumnRenamed("source", "s")
    left = left.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    left = left.withColumn("sure", F.floor(rate + EPS)).withColumn("p", F.greatest(rate - F.col("sure"), F.lit(0.0)))
    shown = ("doc_id", "source", "size", "source_size", "target", "sure", "k1", "k2")
    fixed = left.where((F.col("size") == 0) | _whole(F.col("p"))).select(*shown, F.lit(0.0).alias("p"))
    item = F.struct("key", "p", F.col("size").cast("double").alias("w"), *shown).alias("item")
    now = left.where((F.col("size") > 0) & ~_whole(F.col("p"))).select(item, F.col("source").alias("s"), F.col("n").alias("m"))
    parts, level = [fixed], 0
    while True:
        groups = F.ceil(F.col("m") / FAN_IN)
        dealt = now.withColumn("group", F.pmod(F.xxhash64("item.key", F.lit(level)), groups))
        rounded = dealt.groupBy("s", "m", "group").agg(_round_group(F.array_sort(F.collect_list("item"))).alias("items"))
        out = settled(rounded.select("s", groups.alias("m"), F.explode("items").alias("item")))
        whole = _whole(F.col("item.p"))
        last = whole | (F.col("m") <= 1)
        p = F.when(whole, F.round("item.p")).otherwise((unit("item.key", F.lit(seed + 1)) < F.col("item.p")).cast("double"))
        parts.append(out.where(last).select(*[f"item.{c}" for c in shown], p.alias("p")))
        now = out.where(~last)
        if now.isEmpty():
            break
        level += 1
    done = parts[0]
    for part in parts[1:]:
        done = done.union(part)
    times = (F.col("sure") + F.col("p")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), "k1", "k2")


def _with_counts(goal: DataFrame, rows: DataFrame) -> DataFrame:
    """``goal`` with the number of each source's documents that have words."""
    counts = rows.groupBy(F.col("source").alias("s")).agg(F.sum((F.col("size") > 0).cast("long")).alias("n"))
    return goal.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it (not at all, once or twice).

    Documents of size 0, of which no number adds words, stay once. Of rows alike in id, text and source, those with
    the least hashes of their further columns (as JSON) are taken first, so reruns agree.
    """
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    taken = mix(docs, **options).select("k1", "k2", times.alias("times")).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("times")).alias("_times"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = _keys(F.col("doc_id"), text, F.col("source").cast("string"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    both = docs.select(row, k1, k2).join(taken, ["k1", "k2"])
    nth = F.expr("row_number() over (partition by k1, k2 order by xxhash64(to_json(_row)))")
    some = both.select("_row", F.element_at("_times", nth).cast("int").alias("_n")).where("_n > 0")
    return some.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("_row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
