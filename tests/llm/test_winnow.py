import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from specloom.llm import winnow

DOCS = "doc_id long, text string, grams string, extra int"


def brute(text, gram=winnow.GRAM, window=winnow.WINDOW):
    words = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        words += [w[i : i + winnow.SPAN] for i in range(len(w) - winnow.SPAN + 1)] if len(w) > winnow.LONG else [w]
    if not words:
        return []
    # rolled word by word
    turn = lambda h, n: (h << n % 64 | h >> 64 - n % 64) & (2**64 - 1) if n % 64 else h
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    first = 0
    for j in range(gram):
        first = turn(first, winnow.TURN) ^ (one[j] if j < len(one) else 0)
    rolled = [first]
    for i in range(gram, len(one)):
        rolled.append(turn(rolled[-1], winnow.TURN) ^ turn(one[i - gram], winnow.TURN * gram) ^ one[i])
    hashes = [h >> 33 for h in rolled]
    out = []
    for s in range(max(1, len(hashes) - window + 1)):
        part = hashes[s : s + window]
        low = min(part)
        at = s + max(i for i, h in enumerate(part) if h == low)
        if (at, low) not in out[-1:]:
            out.append((at, low))
    return out


def shown(grams):
    return " ".join(f"{p:x}:{h:x}" for p, h in grams)


def dice(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))


def brute_rows(rows, gram=winnow.GRAM, window=winnow.WINDOW):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, x = (brute(v, gram, window) for v in (t, edited, nxt))
        out.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), pytest.approx(dice(a, e)), pytest.approx(dice(a, x))))
    return sorted(out, key=lambda r: r[0])


def make(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], DOCS)


def got_rows(df):
    rows = winnow.edits(df)
    rows = rows.select(
        F.col("id"), "n_chars", F.sha2("edited", 256), winnow.show(F.col("grams")), winnow.show(F.col("edited_grams")),
        winnow.likeness(F.col("grams"), F.col("edited_grams")), winnow.likeness(F.col("grams"), F.col("next_grams")),
    )
    return sorted(((str(r[0]), *r[1:]) for r in rows.collect()), key=lambda r: r[0])


def texts(n, seed=5):
    rnd = random.Random(seed)
    alphabet = "aab  cé€😀\n"
    return [(3 * i, "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 2, 5, 11, 12, 13, 34, 35, 36, 37, 70, 71, 300])))) for i in range(n)]


def test_matches_brute_force(spark):
    rows = texts(120)
    rows += [(1000, None), (1001, "same text " * 30), (1002, "same text " * 30), (None, "without id " * 9), (1003, "a" * 500)]
    assert got_rows(make(spark, rows)) == brute_rows(rows)


def test_many_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(winnow, "IN_BUCKET", 7)
    monkeypatch.setattr(winnow, "BLOCK", 16)
    rows = texts(150, 9)
    assert got_rows(make(spark, rows).repartition(5)) == brute_rows(rows)


def test_shared_passages_are_found(spark):
    passage = " six words that both texts share "
    rows = [(1, "x " * 50 + passage + "yz " * 40), (2, "other beginning" + passage + "and end")]
    a, b = (set(h for _, h in brute(t)) for _, t in rows)
    assert a & b
    one = spark.createDataFrame(rows, "doc_id long, text string").select(winnow.show(winnow.fingerprint(F.col("text"))).alias("f")).collect()
    assert {x.split(":")[1] for x in one[0].f.split()} & {x.split(":")[1] for x in one[1].f.split()}


def test_lone_repeated_empty_and_long(spark):
    assert got_rows(make(spark, [(5, "alone " * 20)])) == brute_rows([(5, "alone " * 20)])
    assert got_rows(make(spark, [])) == []
    rows = [(5, "twice"), (5, "twice"), (6, "ab" * 100_000)]
    assert [r[:3] for r in got_rows(make(spark, rows))] == [r[:3] for r in brute_rows(rows)]


def test_texts_without_blanks_have_grams(spark):
    rnd = random.Random(2)
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    rows = [(1, han(200)), (2, han(200)), (3, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400))), (4, "short " + han(25) + " end")]
    got = got_rows(make(spark, rows))
    assert got == brute_rows(rows)
    assert all(0.3 < r[5] < 0.7 for r in got[:3])
