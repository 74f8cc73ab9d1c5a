"""SentencePiece encoding and decoding of merge-type models by a table of each prefix's last token."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Words and pairs of tokens that a worker remembers at most.
WORDS_KEPT, PAIRS_KEPT, PARTS_KEPT = 300_000, 200_000, 100_000
SPACE = "▁"
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


class Pieces:
    """A merge-type model: merges join the neighbours whose join is the best-scored piece, leftmost first.

    The last token of each prefix of a text is unique. It is the one piece that ends there, begins where another
    prefix ends, and is compatible with that prefix's last token: the two, encoded as one string, stay two tokens.
    An automaton lists the pieces that end at each place; ids are read off the table from the end backwards.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = own.encode("  a  ①\n")
        if own.decode(normal) != "  a  ①\n":
            raise ValueError("only models that keep white space and do not normalise are supported")
        self.names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.bytes = {i: int(self.names[i][3:5], 16) for i in range(len(self.names)) if own.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        special = {i for i in range(len(self.names)) if own.is_control(i) or own.is_unknown(i) or own.is_unused(i)} | set(self.bytes)
        self.score = {p: (own.get_score(i), i) for i, p in enumerate(self.names) if i not in special}
        if len(self.byte_id) < 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("only models with byte fallback and words that begin at white space are supported")
        self.unknown = len(self.names)  # ids from here on: single characters that are no piece
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.score.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.bare: dict[str, bytes] = {}
        self.words: dict[str, tuple[int, bytes, str]] = {}
        self.parts: dict[str, list[int]] = {}
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}

    def _name(self, token: int) -> str:
        return self.names[token] if token < self.unknown else chr(token - self.unknown)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging step by step."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are what their joined text encodes to."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            left, right = self._name(a), self._name(b)
            found = self._merged(left + right) == [left, right]
            if len(self.pairs) < PAIRS_KEPT:
                self.pairs[key] = found
        return found

    def _single(self, token: int) -> bool:
        """Whether a piece, encoded as a text, is itself one token."""
        key = (token, -1)
        found = self.pairs.get(key)
        if found is None:
            found = self._merged(self._name(token)) == [self._name(token)]
            if len(self.pairs) < PAIRS_KEPT:
                self.pairs[key] = found
        return found

    def ids_of_word(self, word: str) -> list[int]:
        """The ids of an escaped text: its prefix table, read backwards."""
        n = len(word)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(word):
            ends[end + 1].append(found)
        for end in range(1, n + 1):
            char = word[end - 1]
            options = ends[end] if char in self.score else [*ends[end], (1, self.unknown + ord(char))]
            for size, token in options:
                start = end - size
                before = last[start]
                if self._single(token) if start == 0 else before >= 0 and self.compatible(before, token):
                    last[end], begin[end] = token, start
                    break
        out, end = [], n
        while end:
            token = last[end]
            out.extend([token] if token < self.unknown else [self.byte_id[b] for b in reversed(chr(token - self.unknown).encode("utf-8", "surrogatepass"))])
            end = begin[end]
        return out[::-1]

    def words_of(self, text: str) -> list[str]:
        """The text in words that encode by themselves, each without the white space before it.

        No piece goes on after white space, so words begin there; a run of white space stays with its word.
        """
        if "  " not in text and SPACE not in text and " " not in (text[:1], text[-1:]):
            return text.split(" ")
        return [w[1:] for w in _CUT.split(SPACE + text.replace(" ", SPACE))]

    def parts_of(self, word: str) -> list[str]:
        """An escaped word cut between characters that are neighbours in no piece."""
        joined, cuts = self.joined, [0]
        cuts += [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def ids(self, word: str) -> list[int]:
        out = []
        for part in self.parts_of(SPACE + word):
            found = self.parts.get(part)
            if found is None:
                found = self.ids_of_word(part)
                if len(self.parts) < PARTS_KEPT:
                    self.parts[part] = found
            out += found
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words_of(text) for i in self.ids(w)] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes decoded together, the first white space dropped."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(self.names[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        text = "".join(out)
        return text[1:] if ids and self.names[ids[0]].startswith(SPACE) else text

    def _known(self, word: str) -> tuple[int, bytes, str]:
        """Of a word: the number of ids, they in decimal with a comma after each, their text before trimming."""
        ids = self.ids(word)
        text = self.decode(ids)
        found = len(ids), b"".join(b"%d," % i for i in ids), (" " + text if self.names[ids[0]].startswith(SPACE) else text)
        if len(self.words) < WORDS_KEPT:
            self.words[word] = found
        return found

    def _packed(self, word: str) -> bytes:
        found = np.array(self.ids(word), "<i4").tobytes()
        if len(self.bare) < WORDS_KEPT:
            self.bare[word] = found
        return found

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the text that they decode to; whole words are looked up."""
        get, known = self.words.get, self._known
        found = [get(w) or known(w) for w in self.words_of(text)] if text else []
        ids = b"".join([f[1] for f in found])[:-1]
        back = "".join([f[2] for f in found])[1:]
        return sum([f[0] for f in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers; whole words are looked up."""
        get, known = self.bare.get, self._packed
        return b"".join([get(w) or known(w) for w in self.words_of(text)]) if text else b""


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@cache
def load(model_file: str) -> Pieces:
    """A worker loads a model once."""
    return Pieces(model_file)


def _rows(docs: DataFrame, keep: tuple[str, ...], extra: list[tuple[str, str, pa.DataType]], work) -> DataFrame:
    names = [*keep, *(() if "text" in keep else ("text",))]
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{n}` {k}" for n, k, _ in extra])
    made = [*keep, *(n for n, _, _ in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [work(t.as_py()) for t in part.column(at)]
                new = [pa.array([x[i] for x in found], kind) for i, (_, _, kind) in enumerate(extra)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], names=made)

    return docs.select(*names).mapInArrow(run, schema)


def encoded(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids (array<int>) of each whole text, without begin or end ids; null and empty texts have none."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    names = [*keep, *(() if "text" in keep else ("text",))]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [load(model_file).packed(t.as_py()) for t in part.column(at)]
                ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), ids], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def digests(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of each whole text: encoded, then decoded.

    Null texts count as empty: no ids, and the digests of nothing. Columns of ``docs`` beyond ``keep`` play no
    part; rows are worked on one by one, so repeated rows and ties need no care and an empty table gives no rows.
    """
    extra = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _rows(docs, keep, extra, lambda t: load(model_file).digest(t))


def decoded(rows: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of each row's ids; null ids give a null text."""
    found = F.pandas_udf(lambda column: column.map(lambda ids: None if ids is None else load(model_file).decode([int(i) for i in ids])), "string")
    return rows.select(*keep, found("ids").alias("text"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
