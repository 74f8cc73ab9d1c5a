"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits, found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, free, settled, stored, table

#: Shingles whose bits are counted at once: bounds a task's memory for very long texts.
BLOCK = 1 << 15
#: Shingles in a part of a text, on average and at most; the least number of parts; parts whose keys are compared.
PART, LEAST_PARTS, BANDS = 6, 16, 32
#: Keys up to this count may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Texts to be compared, up to this many of which are named by a broadcast, so that only they are shuffled; beyond it all texts are.
NAMED = 1_000_000
#: Fingerprints whose keys one task makes: bounds the memory of the minimum and maximum a key within a task.
IN_TASK = 8_000
#: Texts in a bucket up to which they are compared two by two; more go by their differences to the bucket's hub.
PAIRED = 16
#: Segments of the ring.
SEGMENTS = 8
#: Words of 64 bits in the odd sketch of a set of shingles.
ODD = 8


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in blocks; nothing for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    whole = b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(whole)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        starts, ends = cuts[: len(words) - width + 1].tolist(), (cuts[width:] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        part = [hashed(whole[s:e], 42) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        yield np.array(part, np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)


def _packed(ones: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text as a signed 64-bit integer; no words give zero."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, width):
        ones += _bits(hashes).sum(0, dtype=np.int32)
        n += len(hashes)
    return _packed(ones, n) if n else 0


def sketch(text: str | None, width: int = 5, bands: int = BANDS, similarity: float = 0.8) -> tuple[int, list[int], int]:
    """The SimHash of a text, its keys, and the number of its distinct shingles.

    Shingles are dealt by hash into parts, as many as a power of two so that a part has PART or fewer on average; a
    key is a hash of all shingles of one of the first ``bands`` parts. A text whose near copies may have more shingles
    than its number of parts goes to has keys of twice the number too: near copies so share a number, and a part
    agrees unless one of the few shingles dealt to it differs.
    """
    ones, n, seen = np.zeros(64, np.int64), 0, []
    for hashes in _hashes(text, width):
        ones += _bits(hashes).sum(0, dtype=np.int32)
        n += len(hashes)
        seen.append(np.unique(hashes))
    if not n:
        return 0, [], 0
    own = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]
    keys, parts = [], LEAST_PARTS
    while parts * PART < len(own):
        parts *= 2
    for level in (parts, parts * 2) if len(own) / similarity > parts * PART else (parts,):
        dealt = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(level)
        kept = dealt < bands
        dealt, mine = dealt[kept], own[kept]
        if not len(mine):
            continue
        order = np.argsort(dealt, kind="stable")
        dealt, mixed = dealt[order], mine[order] * np.uint64(0xC2B2AE3D27D4EB4F)
        starts = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1])))
        sums = np.add.reduceat((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25), starts)
        made = (sums ^ sums >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD) + dealt[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
        keys += made.view(np.int64).tolist()
    return _packed(ones, n), keys, len(own)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): one row per input row, whole texts, one row's words in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["id", "fp"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _ring(x: Column, limit: int, chain: int) -> Column:
    """Whether some chain of ``chain`` consecutive segments, wrapping round, keeps each of its prefixes within budget.

    With m segments and at most ``limit`` differing bits in all, some start has at most l * limit / m differing
    bits in its first l segments for every l; other candidates cannot be near and need no full count.
    """
    size = 64 // SEGMENTS
    each = [F.bit_count(x.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))) for mask in (((1 << size) - 1) << (size * i) for i in range(SEGMENTS))]
    starts = []
    for i in range(SEGMENTS):
        total, fits = None, None
        for n in range(1, chain + 1):
            step = each[(i + n - 1) % SEGMENTS]
            total = step if total is None else total + step
            within = total <= n * limit // SEGMENTS
            fits = within if fits is None else fits & within
        starts.append(fits)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def _near(a: Column, b: Column, limit: int) -> Column:
    x = a.bitwiseXOR(b)
    return _ring(x, limit, 3) & (F.bit_count(x) <= limit)


def _keyed(fps: DataFrame) -> DataFrame:
    """Each row under a key for every choice of half the segments: a hash of the bits of these segments and of the choice.

    Fingerprints that differ in as many bits as half the segments or fewer agree wholly on some such choice. Keys of
    other choices may be equal by chance; all that shares a key is compared in full.
    """
    size = 64 // SEGMENTS
    keys = []
    for n, choice in enumerate(combinations(range(SEGMENTS), SEGMENTS // 2)):
        mask = sum(((1 << size) - 1) << (size * i) for i in choice)
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))), F.lit(n)))
    return fps.select("*", F.explode(F.array(*keys)).alias("key"))


def _rooted(nodes: DataFrame, links: DataFrame, old: str, new: str) -> DataFrame:
    """``nodes`` with column ``new``: the root under ``links`` of column ``old``, itself where it has no link."""
    roots = connected(links).select(F.col("node").alias(old), F.col("root").alias("_r"))
    return nodes.join(roots, old, "left").select(*nodes.columns, F.coalesce("_r", old).alias(new))


def linked(fps: DataFrame, limit: int = 4) -> DataFrame:
    """(fp, root) for distinct fingerprints ``fps``; equal root if joined by links of at most ``limit`` <= 4 bits.

    Two fingerprints within the limit agree on four of eight segments and so meet under a key of ``_keyed``. Keys
    name 32 bits each, so few fingerprints share one that are not near.

    1. The least and the greatest fingerprint of each key, found by a pre-aggregated minimum and maximum. Keys of one
       fingerprint only are done. Ends within the limit are linked: dense groups become one component, or few,
       without their pairs being listed.
    2. Keys whose fingerprints have one component are dropped. Of the others, every fingerprint outside the key's
       largest component is first linked to the key's ends, where it is near, and then compared with all that share
       the key and still have another component: by the ring filter, then the full count. Every link between
       components has such an end.
    """
    if not 0 <= limit <= SEGMENTS // 2:
        raise ValueError(f"limit must be 0 to {SEGMENTS // 2}")
    dealt = fps.repartition(1 + fps.count() // IN_TASK)
    ends = stored(_keyed(dealt).groupBy("key").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y"))
    known = F.broadcast(ends) if ends.count() <= BROADCAST_KEYS else ends
    rows = stored(_keyed(dealt).join(known, "key"))  # key, fp, x, y of the keys that several share
    near = ends.where(_near(F.col("x"), F.col("y"), limit)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    one = stored(_rooted(rows.select("fp").distinct(), near, "fp", "c"))  # c: a component's name, a fingerprint of its own
    one = one.join(one.groupBy("c").agg(F.count("*").alias("n")), "c")  # n only chooses the largest of a key
    named = stored(rows.join(one.select("fp", "c", "n"), "fp"))
    several = named.groupBy("key").agg(F.max_by("c", "n").alias("lo"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2")
    mixed = stored(named.join(several.select("key", "lo"), "key").select("key", "fp", "c", "lo", "x", "y"))
    small = mixed.where("c <> lo")
    tips = small.select("fp", F.col("c").alias("d"), F.explode(F.array("x", "y")).alias("g")).where(_near(F.col("fp"), F.col("g"), limit)).select("d", "g").distinct()
    tips = tips.join(mixed.select(F.col("fp").alias("g"), "c").distinct(), "g").where("c <> d").select("c", "d").distinct()
    again = stored(_rooted(mixed.select("c").distinct(), tips, "c", "e"))
    mixed = stored(mixed.join(again, "c").join(again.select(F.col("c").alias("lo"), F.col("e").alias("main")), "lo").select("key", "fp", "c", "e", "main"))
    other = mixed.select("key", F.col("fp").alias("g"), F.col("c").alias("d"), F.col("e").alias("h"))
    pairs = mixed.where("e <> main").join(other, "key").where((F.col("e") != F.col("h")) & _near(F.col("fp"), F.col("g"), limit)).select("c", "d").distinct()
    every = stored(_rooted(one.select("c").distinct(), tips.union(pairs), "c", "root"))
    found = one.select("fp", "c").join(every, "c").select(F.col("fp").alias("_fp"), "root")
    return fps.join(found, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4) -> DataFrame:
    """One row per document: (id, fp, component_id), the least id reachable over links of at most ``limit`` bits.

    Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Null ids
    stay as rows and are never a component's id unless it has no other. Repeated rows give repeated rows. Columns
    of ``docs`` other than the two named play no part.
    """
    found = settled(fingerprints(docs, id_col, text_col, width))
    least = settled(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = settled(least.join(linked(least.select("fp"), limit), "fp"))
    named = settled(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    named = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
    of = roots.join(named, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return found.join(of, "fp").select("id", "fp", "component_id")


def jaccard(a: str | None, b: str | None, width: int = 5) -> float:
    """The similarity of two texts' sets of shingles; two texts without words are alike."""
    x, y = ({h for part in _hashes(t, width) for h in part.tolist()} for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _mixed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, h, size, c): rows (key, h, size) of ``buckets`` whose key has several components under ``links``; c is h's."""
    roots = connected(links).select(F.col("node").alias("h"), F.col("root").alias("r"))
    sizes = roots.groupBy("r").agg(F.count("*").alias("n"))
    of = roots.join(sizes, "r").select("h", F.struct((-F.col("n")).alias("n"), F.col("r").alias("r")).alias("c"))
    lone = F.struct(F.lit(-1).cast("long").alias("n"), F.col("h").alias("r"))
    rows = stored(buckets.select("key", "h", "size").join(of, "h", "left").select("key", "h", "size", F.coalesce("c", lone).alias("c")))
    several = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return stored(rows.join(several, "key", "left_semi"))


def _set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    parts = [np.unique(h) for h in _hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _odd(deltas: DataFrame) -> DataFrame:
    """``deltas`` with columns o0, o1, ...: bits that tell whether an odd number of the delta's shingles fall there.

    Two such sketches beside the same text differ in as many bits as the sketch of the shingles that only one of both
    texts has, hence in as many bits as there are such shingles, or fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                column = part.column(part.schema.get_field_index("delta"))
                rows = np.repeat(np.arange(part.num_rows), np.diff(column.offsets.to_numpy()))
                bits = column.flatten().to_numpy().view(np.uint64) * np.uint64(0x9FB21C651E98DF25) % np.uint64((1 << 61) - 1) % np.uint64(64 * ODD)
                odd = np.bincount(rows * 64 * ODD + bits.astype(np.int64), minlength=part.num_rows * 64 * ODD) & 1
                words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, ODD)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(w) for w in words.T)], names=[*part.schema.names, *(f"o{n}" for n in range(ODD))])

    kinds = ", ".join([*(f"{name} {kind}" for name, kind in deltas.dtypes), *(f"o{n} long" for n in range(ODD))])
    return deltas.mapInArrow(run, kinds)


def _meetings(deltas: DataFrame, similarity: float) -> DataFrame:
    """(b, a, g): texts a and g that may be similar, from rows (a, b, size, of, delta, c, outside): a text, one it is
    compared with by all its bucket, the sizes of their sets of shingles, the shingles that only one of both has, the
    component of a, and whether b has another.

    Let x be outside the component of b, hence not similar to b, and y another text beside b. At most
    L(x, y) = (|x| + |y|) (1 - s) / (1 + s) shingles may differ between similar x and y, and as many differ as in the
    two deltas together but for twice those in both. So the deltas must share some shingle, and at least
    (dx + dy - L) / 2 of them, where dx > L(x, b) and dy >= dx - L. By the prefix filter both then share one of their
    first ones: x of its dx - (dx - |x| (1 - s) / s) + 1, y of its dy - (dy + (|b| - |y|) (1 - s) / (1 + s)) / 2 + 1, in an
    order of all shingles beside b: first those that b lacks, which edits have made and few share, then b's own.
    Both are taken in one order, so where two texts meet at their first common shingle, what follows must hold the rest of
    those that they must share; other meetings go. So do those whose odd sketches (``_odd``) differ in more than L bits:
    copies of one text that lack the same word meet in many shingles, but few of them are similar.
    """
    d, ratio = F.size("delta"), (1 - similarity) / (1 + similarity)
    as_x = F.ceil(d - F.col("size") * ((1 - similarity) / similarity) - 1e-6)
    as_y = F.ceil((d + (F.col("of") - F.col("size")) * ratio) / 2 - 1e-6)
    prefix = lambda k: F.greatest(d - F.greatest(F.lit(1), k) + 1, F.lit(0)).cast("int")
    odd = [f"o{n}" for n in range(ODD)]
    sized = _odd(deltas).select("a", "b", "size", "c", "outside", d.alias("d"), prefix(as_x).alias("px"), prefix(as_y).alias("py"), "delta", *odd)
    longest = F.greatest("py", F.when(F.col("outside"), F.col("px")).otherwise(0))
    ranked = sized.select("a", "b", "size", "c", "outside", "d", "px", "py", *odd, F.posexplode(F.slice("delta", F.lit(1), longest)).alias("at", "s"))
    ranked = ranked.withColumn("rank", F.col("at") + 1)
    xs = ranked.where("outside and rank <= px").select("b", "s", "a", "size", "c", "d", F.col("rank").alias("i"), *odd)
    ys = ranked.where("rank <= py").select("b", "s", F.col("a").alias("g"), F.col("size").alias("z"), F.col("c").alias("e"), F.col("d").alias("f"), F.col("rank").alias("j"), *[F.col(o).alias(f"q{o}") for o in odd])
    most = (F.col("size") + F.col("z")) * ratio + 1e-6
    rest = 1 + F.least(F.col("d") - F.col("i"), F.col("f") - F.col("j"))  # shared ones at most, if this is the first of both
    may = (F.col("c") != F.col("e")) & (F.abs(F.col("d") - F.col("f")) <= most) & (2 * rest >= F.col("d") + F.col("f") - most)
    may = may & (sum((F.bit_count(F.col(o).bitwiseXOR(F.col(f"q{o}"))) for o in odd), F.lit(0)) <= most)
    return xs.join(ys, ["b", "s"]).where(may).select("b", F.greatest("a", "g").alias("a"), F.least("a", "g").alias("g")).distinct()


def _by_differences(deltas: DataFrame, similarity: float) -> DataFrame:
    """(a, b): similar texts of different components among the rows that ``_meetings`` takes, counted exactly from the deltas."""
    d, pairs = F.size("delta"), _meetings(deltas, similarity)
    own = deltas.select("a", "b", "size", "delta")
    both = pairs.join(own, ["a", "b"]).join(own.select(F.col("a").alias("g"), "b", F.col("size").alias("z"), F.col("delta").alias("other")), ["g", "b"])
    apart = d + F.size("other") - 2 * F.size(F.array_intersect("delta", "other"))
    total = F.col("size") + F.col("z")
    good = (total - apart) / (total + apart) >= similarity
    return both.where(good).select("a", F.col("g").alias("b")).distinct()


def similar(docs: DataFrame, width: int = 5, limit: int = 4, similarity: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(h, root): for each distinct text (h is its hash) of ``docs`` the component of near-duplicates it is in.

    Texts are linked if their SimHashes differ in at most ``limit`` bits, found by ``linked``. That alone finds few
    texts of similarity 0.8 to 0.95, so shingles are also dealt into parts by hash, more for longer texts (see
    ``sketch``), and near copies agree wholly in some of the parts compared: with the greatest number of shingles a
    part, 1 of 4400 pairs of similarity 0.8 agrees in none of 32 (of 16 parts, for texts of 50 to 96 shingles, 1 of
    60). Texts that share one, a bucket, and whose sizes allow it, are compared by the exact similarity of their sets
    of shingles:

    1. All with the least of the bucket.
    2. In buckets that still have several components, all with the text that has most links so far (the original of
       a group of copies), where their components differ. Groups become one component without all their pairs.
    3. In buckets that still have several, all texts of different components if they are few (PAIRED), else those
       that differ from one text in some same shingle, see ``_by_differences``: no link within a bucket is
       left out, and heavily edited copies are not paired with all. That text is the most linked of those of step 2
       in all buckets of the bucket's own, so the buckets of one group are compared once, beside its original.
    """
    kind = "h long, fp long, parts array<long>, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = list(zip(*[sketch(t.as_py(), width, bands, similarity) for t in part.column(1)], strict=True))
                made = [pa.array(x, k) for x, k in zip(found, [pa.int64(), pa.list_(pa.int64()), pa.int32()], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["h", "fp", "parts", "size"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard(x.as_py(), y.as_py(), width) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    made = stored(texts.mapInArrow(run, kind).dropDuplicates(["h"]))
    heads = stored(made.groupBy("fp").agg(F.min("h").alias("head")))
    roots = linked(heads.select("fp"), limit).join(heads, "fp")
    roots = stored(roots.join(roots.groupBy("root").agg(F.min("head").alias("least")), "root").select("fp", "least"))
    by_bits = made.select("h", "fp").join(roots, "fp").where("h <> least").select(F.col("h").alias("a"), F.col("least").alias("b"))
    parts = made.select("h", "size", F.explode("parts").alias("key"))
    least = parts.groupBy("key").agg(F.min(F.struct("h", "size")).alias("b"), F.max("h").alias("top")).where("b.h < top").drop("top")
    buckets = stored(parts.join(stored(least), "key").select("key", "h", "size", "b"))

    def fits(x: Column, y: Column) -> Column:
        """Whether sets of these sizes can be so similar."""
        return F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets = [(_set(x.as_py(), width), _set(y.as_py(), width)) for x, y in zip(part.column(2), part.column(3), strict=True)]
                new = [pa.array([len(x) for x, _ in sets], pa.int32()), pa.array([len(y) for _, y in sets], pa.int32())]
                deltas = pa.array([np.concatenate((np.setdiff1d(x, y, True), np.setdiff1d(y, x, True))).view(np.int64) for x, y in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new, deltas], names=["a", "b", "size", "of", "delta"])

    def beside(pairs: DataFrame) -> DataFrame:
        """The texts of pairs (a, b), each pair once: a, b, x, y."""
        pairs = stored(pairs.select("a", "b").distinct())
        needed = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        needed = F.broadcast(needed) if 2 * pairs.count() <= NAMED else needed
        own = texts.join(needed, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
        both = pairs.join(own.select(F.col("h").alias("a"), F.col("text").alias("x")), "a").join(own.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")
        return both.select("a", "b", "x", "y")

    def checked(pairs: DataFrame) -> DataFrame:
        return beside(pairs).mapInArrow(compare, "a long, b long, good boolean").where("good").select("a", "b")

    first = buckets.where((F.col("h") != F.col("b.h")) & fits(F.col("size"), F.col("b.size")))
    links = stored(by_bits.union(checked(first.select(F.col("h").alias("a"), F.col("b.h").alias("b")))))
    mixed = _mixed(buckets, links)
    degree = links.select(F.col("a").alias("h")).union(links.select("b")).groupBy("h").agg(F.count("*").alias("n"))
    linked_to = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "c", "size")
    hubs = mixed.join(degree, "h", "left").groupBy("key").agg(F.max(linked_to).alias("hub"))
    hubs = stored(hubs.select("key", F.col("hub.h").alias("b"), F.col("hub.c").alias("d"), F.col("hub.size").alias("s"), F.col("hub.n").alias("n")))
    near = mixed.join(hubs, "key").where((F.col("c") != F.col("d")) & fits(F.col("size"), F.col("s")))
    links = stored(links.union(checked(near.select(F.col("h").alias("a"), "b"))))
    mixed = _mixed(mixed, links)
    counts = mixed.groupBy("key").agg(F.count("*").alias("n"))
    mixed = stored(mixed.join(counts, "key"))
    few, many = mixed.where(F.col("n") <= PAIRED), mixed.where(F.col("n") > PAIRED)
    other = few.select("key", F.col("h").alias("g"), F.col("c").alias("d"), F.col("size").alias("s"))
    pairs = few.join(other, "key").where((F.col("h") > F.col("g")) & (F.col("c") != F.col("d")) & fits(F.col("size"), F.col("s")))
    paired = checked(pairs.select(F.col("h").alias("a"), F.col("g").alias("b")))
    of = many.select("h", "c").distinct()
    seen = stored(many.select("key", "h").join(hubs.select("key", "b", "n"), "key"))
    tops = seen.groupBy("h").agg(F.max(F.struct("n", "b")).alias("t")).select(F.col("h").alias("b"), F.col("t.b").alias("top"))
    against = seen.select("h", "b").distinct().join(tops, "b").where("h <> top").select(F.col("h").alias("a"), F.col("top").alias("b"))
    deltas = beside(against).mapInArrow(differ, "a long, b long, size int, of int, delta array<long>")
    deltas = deltas.join(of.select(F.col("h").alias("a"), "c"), "a").join(of.select(F.col("h").alias("b"), F.col("c").alias("e")), "b")
    total = F.col("size") + F.col("of")
    alike = (total - F.size("delta")) / (total + F.size("delta")) >= similarity
    deltas = stored(deltas.select("a", "b", "size", "of", "delta", F.col("c.r").alias("c"), (F.col("c") != F.col("e")).alias("other"), alike.alias("alike")))
    beyond = (F.col("other") & ~F.col("alike")).alias("outside")
    rest = _by_differences(deltas.select("a", "b", "size", "of", "delta", "c", beyond), similarity).union(deltas.where("other and alike").select("a", "b"))
    found = connected(links.union(paired).union(rest)).select(F.col("node").alias("h"), F.col("root").alias("r"))
    return made.select("h").join(found, "h", "left").select("h", F.coalesce("r", "h").alias("root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates as ``similar`` finds them: of each component the least doc_id stays.

    Rows are told apart by doc_id and text: a null doc_id comes last, so it stays only in a component without any
    other; rows that repeat the staying one whole stay with it. Null and empty texts are copies of each other.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h"))
    first = docs.select("doc_id", text.alias("h")).groupBy("h").agg(F.min(key).alias("key"))
    roots = similar(docs.select("text"), **options)
    name, own = free(docs, "d"), free(docs, "h")  # names that no column of docs has
    keep = first.join(roots, "h").groupBy("root").agg(F.min("key").alias("k")).select(F.col("k.d").alias(name), F.col("k.h").alias(own))
    return docs.join(stored(keep), docs["doc_id"].eqNullSafe(F.col(name)) & (text == F.col(own)), "left_semi")


def op5(spark, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
