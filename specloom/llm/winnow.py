"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, settled, table

#: Words in a gram and grams in a window: a passage of GRAM + WINDOW - 1 words that two texts share is always found.
GRAM, WINDOW = 3, 4
#: Bits by which the rolling hash turns from word to word.
TURN = 21
#: Words of more code points than LONG are cut into their runs of SPAN code points, one for each place.
LONG, SPAN = 24, 4
#: Windows worked on at once: bounds the memory that a long text takes.
BLOCK = 4096
#: A gram is one long: 31 bits of hash, then 32 bits of place, counted backwards so that ties go to the rightmost.
_PLACE = (1 << 32) - 1
#: Documents in one bucket of ids, about.
IN_BUCKET = 1024
#: Bounds between buckets that are carried as literals at most.
MAX_BUCKETS = 1 << 16


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turned(h: Column, bits: int) -> Column:
    return h if not bits else F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def _grams(hashes: Column, first: Column, n: Column, gram: int) -> Column:
    """The packed grams that start at ``first`` and the ``n`` - 1 places after it; ``first`` counts from 0.

    The hash is a cyclic polynomial, which rolls: a gram's hash is that of the one before, turned by TURN bits, without
    the word that leaves and with the word that enters. Each word is hashed once; arrays have no running state,
    so the sum is written out over the gram's few words.
    """

    def one(i: Column) -> Column:
        h = _turned(F.get(hashes, i), TURN * (gram - 1) % 64)
        for j in range(1, gram):
            h = h.bitwiseXOR(F.coalesce(_turned(F.get(hashes, i + j), TURN * (gram - 1 - j) % 64), F.lit(0).cast("long")))
        return F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(F.lit(_PLACE) - i)

    return F.transform(F.sequence(first, first + n - 1), one)


def _select(hashes: Column, size: Column, gram: int, window: int) -> Column:
    """The distinct selected grams of ``size`` words' hashes, in order; one gram for fewer words than a gram has, none for none."""
    windows = size - (gram + window - 2)
    whole = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(BLOCK)), lambda s: _block(hashes, s, F.least(F.lit(BLOCK), windows - s), gram, window))
    few = F.array(F.array_min(_grams(hashes, F.lit(0), F.greatest(size - (gram - 1), F.lit(1)), gram)))
    none = F.array().cast("array<bigint>")
    return F.when(size == 0, none).when(windows <= 1, few).otherwise(F.array_distinct(F.flatten(whole)))


def _block(hashes: Column, first: Column, n: Column, gram: int, window: int) -> Column:
    """The distinct minima of ``n`` windows from the one that starts at ``first``.

    Minima of a few grams are found first; a window's minimum is that of those which cover it.
    """
    few = min(2, window)
    cover = sorted({*range(0, window - few + 1, few), window - few})

    def minima(values: Column, count: Column, steps) -> Column:
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.least(*[F.element_at(values, i + k) for k in steps]) if len(steps) > 1 else F.element_at(values, i))

    grams = _grams(hashes, first, n + (window - 1), gram)
    return _let(grams, lambda g: _let(minima(g, n + (window - few), range(few)), lambda m: F.array_distinct(minima(m, n, cover))))


def _place(gram: Column) -> Column:
    return F.lit(_PLACE) - gram.bitwiseAND(F.lit(_PLACE))


def _hash(gram: Column) -> Column:
    return F.shiftright(gram, 32)


def _string(grams: Column) -> Column:
    """place:hash of each gram in hexadecimal, in order of place."""
    return F.array_join(F.transform(F.array_sort(F.transform(grams, lambda g: F.shiftleft(_place(g), 31).bitwiseOR(_hash(g)))), lambda x: F.lower(F.concat(F.hex(F.shiftright(x, 31)), F.lit(":"), F.hex(x.bitwiseAND(F.lit((1 << 31) - 1)))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of the sets of hashes of two arrays of grams: 1 if both are empty."""
    x, y = (F.array_distinct(F.transform(v, _hash)) for v in (a, b))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def _words(text: Column) -> Column:
    """The words of a text without blanks around it; those of over LONG code points are cut into all their runs of SPAN.

    So texts that are written without blanks, long numbers and encoded data have grams of their own.
    """

    def cut(word: Column) -> Column:
        runs = _let(F.split(word, ""), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (SPAN - 1), F.lit(1))), lambda i: F.concat(*[F.get(c, i + j - 1) for j in range(SPAN)])))
        return F.when(F.length(word) > LONG, runs).otherwise(F.array(word))

    return _let(F.split(text, BLANK), lambda words: F.when(F.exists(words, lambda w: F.length(w) > LONG), F.flatten(F.transform(words, cut))).otherwise(words))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The selected grams of a text's words as packed longs; see ``show`` for their places and hashes.

    Null texts count as empty, which have none. Whole texts are read, in blocks of windows.
    """
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"^{BLANK}|{BLANK}$", "")
    return _let(plain, lambda p: F.when(p == "", F.array().cast("array<bigint>")).otherwise(_let(F.transform(_words(p), lambda w: F.xxhash64(w)), lambda h: _select(h, F.size(h), gram, window))))


def show(grams: Column) -> Column:
    """Packed grams as text: place:hash in hexadecimal, in order of place."""
    return _string(grams)


def _bounds(docs: DataFrame, id_col: str) -> list:
    """Ids that part the documents into buckets of about IN_BUCKET."""
    n = docs.count()
    parts = min(MAX_BUCKETS, n // IN_BUCKET + 1)
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(id_col, at, 20 * parts)).first()[0] or []
    return sorted(set(found))


def _bucket(id_col: Column, bounds: list) -> Column:
    """The number of bounds that are no greater than the id, by halving steps; null ids are in bucket 0."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal
    steps, size = [], 1
    while size <= len(bounds):
        steps.insert(0, size)
        size *= 2

    def step(at: Column, width: Column) -> Column:
        probe = F.element_at(array, F.least(at + width, F.lit(len(bounds))))
        return F.when((at + width <= len(bounds)) & (probe <= id_col), at + width).otherwise(at)

    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step), F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, text, grams, next_text, next_grams): each document beside the next by ascending id, the last beside the first.

    Documents are dealt to buckets of neighbouring ids; each bucket also gets the first document of the bucket after
    it, so that texts are shuffled once and no task holds more than a bucket. Ids that repeat go by the hash of
    their texts; null ids come before all others. A lone document is its own next.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = _bounds(docs.select(id_col), id_col)
    rows = rows.select(_bucket(F.col("id"), bounds).alias("bucket"), "id", F.xxhash64("text").alias("tie"), "text", F.lit(False).alias("extra"))
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")
    firsts = rows.groupBy("bucket").agg(F.min(order).alias("first"))  # a row per bucket, MAX_BUCKETS at most
    before = F.expr("coalesce(lag(bucket) over (order by bucket), max(bucket) over ())")
    firsts = settled(firsts.select(F.col("bucket").alias("b"), "first", before.alias("before")))
    lead = rows.join(F.broadcast(firsts), F.expr("bucket = b and tie = first.tie and id <=> first.id"))
    lead = lead.dropDuplicates(["bucket"]).select(F.col("before").alias("bucket"), "id", "tie", "text", F.lit(True).alias("extra"))
    every = rows.union(lead).repartition("bucket").withColumn("grams", fingerprint(F.col("text"), gram, window))
    by = "over (partition by bucket order by extra, id is not null, id, tie)"
    return every.select("id", "text", "grams", "extra", F.expr(f"lead(text) {by}").alias("next_text"), F.expr(f"lead(grams) {by}").alias("next_grams")).where(~F.col("extra")).drop("extra")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: id, n_chars, edited (text), grams, edited_grams, next_grams.

    The edited text is the first part of the document, up to its last floor(n_chars / 2) code points, and as many
    code points from the start of the next document.
    """
    rows = with_next(docs, id_col, text_col, gram, window)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "grams", "next_grams")
    return rows.select("id", "n_chars", "edited", "grams", fingerprint(F.col("edited"), gram, window).alias("edited_grams"), "next_grams")


def op4(spark, sf_dir: str) -> DataFrame:
    rows = edits(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        show(F.col("grams")).alias("fingerprint"),
        show(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"),
        likeness(F.col("grams"), F.col("next_grams")).alias("near_next"),
    )
