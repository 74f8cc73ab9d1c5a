"""Best-fit packing: documents' tokens into as few sequences of bounded length as best-fit decreasing finds."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, table

#: Tokens of a sequence; the id that ends a document.
SIZE, END = 1024, 2
#: Pieces of one length that are numbered together.
IN_BUCKET = 100_000
#: Fixed value. How byte-level vocabularies of this family cut texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}


class Tokens:
    """Ids of texts as the tokenizers library gives them for a byte-level vocabulary file, without special tokens added.

    Where the file's merges make its ids in their order, a faster encoder takes the vocabulary as ranks; the result
    is the same. Texts that spell out a special token go through the library, and so does everything for other files.
    """

    def __init__(self, model_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_file)
        with open(model_file, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.fast = self._ranked(told)

    @staticmethod
    def _ranked(told: dict):
        model, split = told["model"], told.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        others = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges") or told.get("normalizer")
        if not plain or others:
            return None
        vocab, letters = model["vocab"], _letters()
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if made != list(range(256, 256 + len(made))) or any(c not in vocab for c in letters):
            return None
        import tiktoken

        special = {t["content"] for t in told.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): n for word, n in vocab.items() if word not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def load(model_file: str) -> Tokens:
    return Tokens(model_file)


def cut(n: int, size: int) -> list[int]:
    """Where the pieces of ``n`` tokens begin, and ``n``: all of ``size`` but the first, which has what is over."""
    return [0, *range((n - 1) % size + 1, n, size), n]


def token_pieces(docs: DataFrame, model_file: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and ``end``, cut into pieces of ``size`` at most.

    Whole texts, one at a time; a null text is empty and so has the one token ``end``. Null and repeated ids stay as
    they are. Other columns of ``docs`` play no part; an empty table gives no rows.
    """
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows, of = batch.slice(at, 512), [], []
                for n, text in enumerate(part.column(1)):
                    ids = np.array([*encoder.ids(text.as_py() or ""), end], "<u4")
                    cuts = cut(len(ids), size)
                    rows += [(k, s, e - s, zlib.crc32(ids[s:e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                    of += [n] * (len(cuts) - 1)
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *found], names=names)

    kind = docs.select(id_col).dtypes[0][1]
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Capacities:
    """Open bins by what is left in them: a segment tree over remaining capacities, runs of equal bins at its leaves."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.filled = [False] * (2 * self.half)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, left: int) -> None:
        at = self.half + left
        self.filled[at] = bool(self.runs[left])
        while at > 1:
            at //= 2
            self.filled[at] = self.filled[2 * at] or self.filled[2 * at + 1]

    def put(self, left: int, first: int, count: int) -> None:
        if left and count:
            self.runs[left].append((first, count))
            self._mark(left)

    def tightest(self, need: int) -> int:
        """The least remaining capacity of ``need`` or more that an open bin has, or 0: up the tree, then down."""
        at = self.half + need
        if self.filled[at]:
            return need
        while at > 1 and (at % 2 or not self.filled[at + 1]):
            at //= 2
        if at <= 1:
            return 0
        at += 1
        while at < self.half:
            at = 2 * at if self.filled[2 * at] else 2 * at + 1
        return at - self.half

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        self._mark(left)
        return run


def plan(counts: Mapping[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing of ``counts[length]`` pieces: rows (length, rank, bin, used, each).

    Pieces of a length, numbered from 0, go from number ``rank`` on into bins from ``bin`` on, ``each`` into one,
    after ``used`` tokens. Pieces of equal length change nothing if exchanged, and a bin that has taken one and has room
    for another is the tightest for it; so whole runs of equal pieces go into runs of equal bins at one descent of the
    tree, with the result that one descent a piece has. A length splits two runs at most, so the work depends on
    ``size`` and not on the number of pieces.
    """
    steps, bins, bin_id = [], Capacities(size), 0
    for length in range(size, 0, -1):
        n, rank = int(counts.get(length, 0)), 0
        while n:
            left = bins.tightest(length)
            if left:
                first, count = bins.take(left)
            else:
                left, count = size, -(-n // (size // length))
                first, bin_id = bin_id, bin_id + count
            each = left // length
            steps.append((length, rank, first, size - left, each))
            placed = min(n, count * each)
            full, more = divmod(placed, each)
            bins.put(left - each * length, first, full)
            if more:
                bins.put(left - more * length, first + full, 1)
            used = full + (more > 0)
            bins.put(left, first + used, count - used)
            n, rank = n - placed, rank + placed
    return np.array(steps, np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (length, from 1 to ``size``, and other columns) with sequence_id and offset, gapless from 0 in each sequence.

    Only the number of pieces of each length (``size`` rows at most) comes to the driver, where ``plan`` packs the whole
    table at once. Pieces get their numbers within their length by buckets, so that a length that many have is split.
    Which of equally long pieces goes where is open. Pieces of null, zero or greater length are an error.
    """
    spark = pieces.sparkSession
    rows = settled(pieces.select("*", F.monotonically_increasing_id().alias("_row")))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    if any(length is None or not 1 <= length <= size for length in counts):
        raise ValueError(f"pieces must have 1 to {size} tokens")
    steps = plan(counts, size)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    sent = spark.sparkContext.broadcast(steps[order])
    many = spark.createDataFrame([(k, 1 + v // IN_BUCKET) for k, v in counts.items()], "length long, buckets long")
    dealt = rows.join(F.broadcast(many), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "_bucket", F.expr("sum(n) over (partition by length order by _bucket rows between unbounded preceding and current row) - n").alias("_before"))
    numbered = dealt.withColumn("_number", F.expr("row_number() over (partition by length, _bucket order by _row) - 1")).join(before, ["length", "_bucket"])
    chosen = numbered.select(*pieces.columns, (F.col("_before") + F.col("_number")).alias("_rank"))
    at, names = chosen.columns.index("length"), [*pieces.columns, "sequence_id", "offset"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = sent.value
        keys = by[:, 0] << 44 | by[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, batch.num_columns - 1))
            _, start, first, used, each = by[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            into, nth = np.divmod(rank - start, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first + into), pa.array(used + nth * length)], names=names)

    schema = ", ".join(f"`{n}` {k}" for n, k in pieces.dtypes) + ", sequence_id long, offset long"
    return chosen.mapInArrow(assign, schema)


def pack(docs: DataFrame, model_file: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``; see both steps."""
    return packed(token_pieces(docs, model_file, size, end).withColumnRenamed("id", "doc_id"), size)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_model())
