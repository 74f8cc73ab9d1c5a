"""Chroma fingerprints of audio columns: packed integers from pitch-class frames, aligned by offset histograms."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, table

#: Samples in a frame and from frame to frame, frames transformed at once.
FRAME, HOP, AT_ONCE = 4096, 1365, 512
#: Pitches looked at, in Hz.
LOWEST, HIGHEST = 28.0, 3520.0
#: Weights that smooth each pitch class over frames.
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Filters: kind, first pitch class, pitch classes, frames. Their differences are cut at +-CUT and 0 to two bits.
FILTERS = [(i % 6, (5 * i) % 12, 2 + i % 4, 4 + 4 * (i % 4)) for i in range(16)]
WIDEST, CUT = 16, 0.4
#: Recordings align if at one offset they share so many equal integers and differ in at most this share of bits.
HITS, BIT_ERRORS = 4, 0.2
#: Sound of a vector: samples a second, samples in a note.
SAMPLE_RATE, NOTE = 11025, 2048


def samples_of(media: bytes | None) -> tuple[np.ndarray, int]:
    """The samples (mixed to one channel, -1 to 1) and the rate of a PCM WAV file; nothing for null or other bytes."""
    try:
        with wave.open(io.BytesIO(media or b"")) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), 1
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        return np.zeros(0), 1
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Energy by frame and pitch class, smoothed over frames, each frame scaled to length one (silence stays zero)."""
    n = (len(x) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12))
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((pitch >= LOWEST) & (pitch <= HIGHEST))
    fold = np.zeros((len(used), 12))
    fold[np.arange(len(used)), np.round(12 * np.log2(pitch[used] / 440)).astype(int) % 12] = 1
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME)
    parts = [np.abs(np.fft.rfft(frames[i : i + AT_ONCE] * window)[:, used]) ** 2 @ fold for i in range(0, n, AT_ONCE)]
    every = np.concatenate(parts)
    smooth = sum(w * every[i : n - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.divide(smooth, size, out=np.zeros_like(smooth), where=size > 1e-6)


def packed(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each run of WIDEST frames: 16 filters over the integral image, two Gray-coded bits each."""
    n = len(image) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.int64)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.cumsum(np.cumsum(np.concatenate((image, image), 1), 0), 1)  # pitch classes go round
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[at + t1, y1] - total[at + t0, y1] - total[at + t1, y0] + total[at + t0, y0]

    out = np.zeros(n, np.int64)
    for kind, y, h, w in FILTERS:
        whole, half, mid = area(0, w, y, y + h), w // 2, h // 2
        if kind == 0:
            a, b = whole, area(0, w, y + h, y + 2 * h)
        elif kind == 1:
            a, b = area(0, w, y, y + mid), area(0, w, y + mid, y + h)
        elif kind == 2:
            a, b = area(0, half, y, y + h), area(half, w, y, y + h)
        elif kind == 3:
            a = area(0, half, y, y + mid) + area(half, w, y + mid, y + h)
            b = whole - a
        elif kind == 4:
            third = max(1, w // 3)
            a = area(third, 2 * third, y, y + h) * 2
            b = area(0, third, y, y + h) + area(2 * third, 3 * third, y, y + h)
        else:
            a, b = area(0, w, y, y + 1) * h, whole
        value = np.log((1 + a) / (1 + b))
        level = (value > -CUT).astype(np.int64) + (value > 0) + (value > CUT)
        out = (out << 2) | (level ^ (level >> 1))
    return out


#: The integer of frames without sound.
SILENT = int(packed(np.zeros((WIDEST, 12)))[0])


def fingerprint(media: bytes | None) -> np.ndarray:
    """The packed integers of one recording; none if it is null, no PCM WAV or shorter than about 2.5 seconds."""
    return packed(chroma(*samples_of(media)))


def recording(vector) -> bytes | None:
    """A WAV file in which a vector sounds: its halves are two voices, each component a note; null for none."""
    if vector is None or not len(vector):
        return None
    v = np.nan_to_num(np.array([0.0 if c is None else c for c in vector], float))
    v = np.clip(v / (np.sqrt((v * v).mean()) or 1.0), -3, 3)
    voices = np.array_split(v, 2)
    t = np.arange(NOTE) / SAMPLE_RATE
    out = np.zeros(max(map(len, voices)) * NOTE)
    for octave, voice in zip((110.0, 440.0), voices, strict=True):
        tones = np.sin(2 * np.pi * (octave * 2 ** (np.round(4 * (voice + 3)) / 12))[:, None] * t)
        out[: len(voice) * NOTE] += 0.4 * tones.reshape(-1)
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(SAMPLE_RATE)
            w.writeframes((out * 32000).astype("<i2").tobytes())
        return f.getvalue()


def fingerprints(rows: DataFrame, id_col: str, media_col: str, load: Callable = lambda media: media) -> DataFrame:
    """(id, fp array<long>) of every recording; ``load`` turns a cell into WAV bytes. One recording is in memory at a time."""
    kind = rows.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(load(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "fp"])

    return rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, fp array<long>")


def classes(found: DataFrame) -> DataFrame:
    """(id, fp, class_id): recordings with equal integers are one class, named by its least id."""
    least = found.groupBy("fp").agg(F.min("id").alias("class_id"))
    key = F.xxhash64(F.array_join("fp", ","))
    near = least.select("class_id", F.col("fp").alias("g"), key.alias("k"))
    return found.withColumn("k", key).join(near, "k").where("fp = g").select("id", "fp", "class_id")


def align(queries: DataFrame, every: DataFrame, hits: int = HITS, errors: float = BIT_ERRORS) -> DataFrame:
    """(query, other, offset, hits, bit_error_rate) for (id, fp) rows: pairs of different ids that align.

    Frames with equal integers, but for silent ones, vote for the offset between their recordings; the offset with most votes wins (then
    the one nearest to none, then the lesser) and must have ``hits``. At it, the share of different bits over all
    frames of the overlap must be at most ``errors``. Ids must be unique.
    """
    frames = lambda df, name, at: df.select(F.col("id").alias(name), F.posexplode("fp").alias(at, "value")).where(F.col("value") != SILENT)
    votes = frames(queries, "query", "i").join(frames(every, "other", "j"), "value").where("query <> other")
    votes = votes.groupBy("query", "other", (F.col("i") - F.col("j")).alias("offset")).agg(F.count("*").alias("hits")).where(F.col("hits") >= hits)
    order = F.struct(F.col("hits"), -F.abs("offset"), -F.col("offset"))
    best = votes.groupBy("query", "other").agg(F.max_by(F.struct("offset", "hits"), order).alias("b"))
    best = best.select("query", "other", F.col("b.offset").alias("offset"), F.col("b.hits").alias("hits"))
    both = best.join(queries.select(F.col("id").alias("query"), F.col("fp").alias("p")), "query").join(every.select(F.col("id").alias("other"), F.col("fp").alias("q")), "other")
    first, last = F.greatest(F.lit(0), F.col("offset")), F.least(F.size("p"), F.size("q") + F.col("offset"))
    bits = F.aggregate(F.sequence(first, last - 1), F.lit(0), lambda s, i: s + F.bit_count(F.get("p", i).bitwiseXOR(F.get("q", i - F.col("offset")))))
    return both.select("query", "other", "offset", "hits", (bits / (32.0 * (last - first))).alias("bit_error_rate")).where(F.col("bit_error_rate") <= errors)


def search(rows: DataFrame, id_col: str, media_col: str, every_nth: int = 50, load: Callable = lambda media: media) -> DataFrame:
    """One row per recording, and for representatives of classes one per aligned query class.

    Queries are all recordings whose id divides by ``every_nth``, against all recordings. Columns: id, class_id,
    frames, query_class, offset, hits, bit_error_rate; the last four are null for representatives that no other
    query class aligns with and for the other members of a class, which share its representative's rows. Null,
    broken and short recordings have no integers, form one class and align with nothing. Rows are told apart by id;
    a null id is never a query and is its own class's name only if all its members are null.
    """
    found = settled(fingerprints(rows, id_col, media_col, load))
    named = settled(classes(found))
    heads = settled(named.where("id = class_id").dropDuplicates(["id"]).select("id", "fp"))
    asked = named.where(F.col("id") % every_nth == 0).select(F.col("class_id").alias("id")).distinct()
    pairs = align(heads.join(asked, "id", "left_semi"), heads)
    pairs = pairs.select(F.col("other").alias("id"), F.col("query").alias("query_class"), "offset", "hits", "bit_error_rate")
    out = named.select("id", "class_id", F.size("fp").alias("frames"))
    return out.join(pairs, "id", "left").select("id", "class_id", "frames", "query_class", "offset", "hits", "bit_error_rate")


def op10(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", load=recording).withColumnRenamed("id", "vec_id")
