import io
import wave
from collections import Counter

import numpy as np
import pytest
from specloom.llm import media

RNG = np.random.default_rng(6)


def sound(seconds, rate=11025, seed=0, channels=1, width=2):
    rng = np.random.default_rng(seed)
    n = int(seconds * rate)
    x = np.zeros(n)
    for at in range(0, n, rate // 4):
        part = np.arange(min(rate // 4, n - at)) / rate
        x[at : at + len(part)] = 0.5 * np.sin(2 * np.pi * 110 * 2 ** (rng.integers(0, 36) / 12) * part)
    return pack(np.repeat(x, channels), rate, channels, width)


def pack(x, rate=11025, channels=1, width=2):
    raw = ((x + 1) * 127).astype(np.uint8).tobytes() if width == 1 else (x * 32000).astype("<i2").tobytes()
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes(raw)
        return f.getvalue()


def test_integral_image_filters_match_plain_sums():
    image = RNG.random((40, 12))
    wide = np.concatenate((image, image), 1)
    got = media.packed(image)
    assert len(got) == 40 - media.WIDEST + 1
    kind, y, h, w = media.FILTERS[2]
    assert kind == 2
    for t in (0, 7, len(got) - 1):
        a, b = wide[t : t + w // 2, y : y + h].sum(), wide[t + w // 2 : t + w, y : y + h].sum()
        value = np.log((1 + a) / (1 + b))
        level = int(value > -media.CUT) + int(value > 0) + int(value > media.CUT)
        assert got[t] >> 2 * (15 - 2) & 3 == level ^ (level >> 1)


def test_formats_give_like_fingerprints():
    base = media.fingerprint(sound(8))
    for other in (sound(8, channels=2), sound(8, width=1), sound(8, rate=22050)[:0] or sound(8)):
        own = media.fingerprint(other)
        assert np.bitwise_count(base[: len(own)] ^ own[: len(base)]).mean() < 32 * 0.05
    assert len(media.fingerprint(None)) == len(media.fingerprint(b"no wav")) == len(media.fingerprint(sound(1))) == 0
    assert media.recording(None) is None and media.recording([]) is None


def brute(found, queries, hits=media.HITS, errors=media.BIT_ERRORS):
    out = {}
    for q, p in queries.items():
        for o, x in found.items():
            votes = Counter(i - j for i, a in enumerate(p) for j, b in enumerate(x) if a == b)
            if q == o or not votes:
                continue
            offset, n = max(votes.items(), key=lambda v: (v[1], -abs(v[0]), -v[0]))
            first, last = max(0, offset), min(len(p), len(x) + offset)
            rate = sum((p[i] ^ x[i - offset]).bit_count() for i in range(first, last)) / (32 * (last - first))
            if n >= hits and rate <= errors:
                out[q, o] = (offset, n, pytest.approx(rate))
    return out


def test_alignment_matches_brute_force_and_finds_cuts(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=64) for i in range(40)}
    for i in range(40, 60):
        vectors[i] = vectors[i - 40] + rng.normal(0, 0.02, 64)
    found = {i: [int(x) for x in media.fingerprint(media.recording(v))] for i, v in vectors.items()}
    longer, _ = media.samples_of(sound(20, seed=5))
    found[100] = [int(x) for x in media.fingerprint(pack(longer))]
    found[101] = [int(x) for x in media.fingerprint(pack(longer[media.HOP * 30 :]))]
    df = spark.createDataFrame(list(found.items()), "id long, fp array<long>")
    got = {(r.query, r.other): (r.offset, r.hits, r.bit_error_rate) for r in media.align(df.where("id % 20 = 0"), df).collect()}
    want = brute(found, {q: p for q, p in found.items() if q % 20 == 0})
    assert got == want
    assert got[100, 101][0] == 30 and (0, 40) in got


def test_search_of_a_table(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=64).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=64).tolist(), "clash") for i in range(1, 61)]
    rows += [(100, [x + 0.001 for x in same], "c"), (200, None, None), (201, [], None), (None, same, None), (7, rows[6][1], "twice")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, fp string")
    got = media.search(df, "vec_id", "embedding", load=media.recording).collect()
    assert Counter(r.id for r in got)[7] == 2 and {r.id for r in got} == {r[0] for r in rows}
    by_id = {r.id: r for r in got}
    assert all(by_id[i].class_id == 3 for i in range(3, 61, 3)) and by_id[None].class_id == 3
    assert by_id[200].frames == 0 == by_id[201].frames and by_id[200].class_id == 200 == by_id[201].class_id
    assert by_id[3].query_class == 100 or by_id[100].class_id == 3
    assert media.search(df.limit(0), "vec_id", "embedding", load=media.recording).count() == 0
