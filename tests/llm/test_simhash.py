import random

import numpy as np
import xxhash
from specloom.llm import simhash

DOCS = "doc_id long, text string, source string, fp string, component_id string"


def brute(rows, limit=4):
    fps = [int(simhash.fingerprint(t)) & (2**64 - 1) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def test_fingerprint_by_definition():
    text = "The  QUICK\tbrown fox\njumps over é É"
    words = "the quick brown fox jumps over é É".split(" ")
    grams = [" ".join(words[i : i + 4]).encode() for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint(" \n") == 0 == simhash.fingerprint(None)
    assert simhash.fingerprint("One two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_components_match_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = ["w%d" % i for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([5, 60, 300]))
        for _ in range(12):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (None, rows[0][1]), (3, rows[3][1]), (None, "all alone here"), (n + 3, "x " * 40000)]
    df = spark.createDataFrame([(d, t, None, "clash", "clash") for d, t in rows], DOCS)
    got = simhash.components(df).collect()
    have = sorted((str(r["id"]), f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in got)
    assert have == brute(rows)


def test_links_through_random_bit_flips(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for center in rng.integers(-(2**63), 2**63, 25, dtype=np.int64).tolist():
        for _ in range(20):
            x = center & (2**64 - 1)
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    a = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(1)
        if (new == label).all():
            break
        label = new
    got = {r["fp"]: r["root"] for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    groups = {}
    for f, x in zip(fps, label.tolist(), strict=True):
        groups.setdefault(x, set()).add(f)
    have = {}
    for f, r in got.items():
        have.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, have.values()))


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.components(empty).count() == 0
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (9, "q r s t u v"), (None, "a b c d e f"), (None, "lone text of nobody")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("2", "a b c d e f"), ("9", "q r s t u v"), ("None", "lone text of nobody")]


def test_similar_texts_share_a_root(spark):
    rnd = random.Random(11)
    vocabulary = ["w%d" % i for i in range(500)]
    texts, pairs = [], []
    for n in [40, 60, 100, 200, 400] * 8:
        base = rnd.choices(vocabulary, k=n)
        near = list(base)
        for _ in range(max(1, n // 60)):
            near[rnd.randrange(n)] = "edited"
        texts += [" ".join(base), " ".join(near)]
        pairs.append((texts[-2], texts[-1], simhash.jaccard(texts[-2], texts[-1])))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    roots = {r.h: r.root for r in simhash.similar(df).collect()}
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    close = [(a, b) for a, b, j in pairs if j >= 0.8]
    found = sum(roots[hashes[a]] == roots[hashes[b]] for a, b in close)
    assert len(close) > 15 and found >= 0.9 * len(close)
    bases = [roots[hashes[a]] for a, _, _ in pairs]
    assert len(set(bases)) == len(bases)


def partition(spark, texts, similarity=0.8):
    """The components of ``similar`` and those of all pairs compared one by one, as sorted groups of indices."""
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    roots = {r.h: r.root for r in simhash.similar(df).collect()}
    have, want = {}, list(range(len(texts)))
    for r in df.selectExpr("i", "xxhash64(text) h").collect():
        have.setdefault(roots[r.h], []).append(r.i)
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                want = [want[j] if w == want[i] else w for w in want]
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, []).append(i)
    return sorted(sorted(g) for g in have.values()), sorted(groups.values())


def test_stars_and_chains_become_one_component(spark):
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(2000)]
    star = rnd.choices(vocabulary, k=60)
    texts = [" ".join(star)]
    for i in range(300):  # each within 0.8 of the original only
        copy = list(star)
        copy[rnd.randrange(4, 56)] = f"edit{i}"
        texts.append(" ".join(copy))
    chain = rnd.choices(vocabulary, k=60)
    for i in range(100):  # each within 0.8 of its neighbours only
        chain[4 + 17 * i % 52] = f"step{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(rnd.choices(vocabulary, k=60)) for _ in range(20)]
    have, want = partition(spark, texts)
    assert len(want) == 22 and have == want


def test_long_near_copies_are_candidates(spark):
    rnd = random.Random(13)
    vocabulary = ["w%d" % i for i in range(5000)]
    texts = []
    for n, edits in [(20, 0), (30, 1), (90, 1), (100, 2), (400, 7), (400, 15), (800, 14), (800, 30), (1600, 16), (1600, 60)] * 6:
        base = rnd.choices(vocabulary, k=n)
        near = list(base)
        for i in rnd.sample(range(n), edits):
            near[i] = f"edited{len(texts)}"
        texts += [" ".join(base), " ".join([*near, *rnd.choices(vocabulary, k=rnd.choice([0, n // 40]))])]
    have, want = partition(spark, texts)
    close = [g for g in want if len(g) == 2]
    assert len(close) > 30
    assert sum(g in have for g in close) >= 0.98 * len(close)


def edited_copies(rnd, n, most):
    """Copies of one text, each edited at some words on its own; some are edits of edits."""
    vocabulary = ["w%d" % i for i in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = [base]
    for _ in range(n):
        copy = list(rnd.choice(rows) if rnd.random() < 0.3 else base)
        for _ in range(rnd.randrange(most)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.choice([0, 1, 1])] = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 1]))]
        rows.append(copy)
    return sorted({" ".join(r) for r in rows})


def test_differences_find_every_similar_pair(spark):
    texts = edited_copies(random.Random(8), 120, 8) + edited_copies(random.Random(9), 40, 12)
    sets = [set(simhash._set(t, 5).view(np.int64).tolist()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    for hub in (0, 30, len(texts) - 1):
        near = [alike(i, hub) for i in range(len(texts))]
        c = [0 if near[i] else i + 1 for i in range(len(texts))]
        rows = [(i, hub, len(sets[i]), len(sets[hub]), sorted(sets[i] ^ sets[hub]), c[i], not near[i]) for i in range(len(texts)) if i != hub]
        deltas = spark.createDataFrame(rows, "a long, b long, size int, of int, delta array<long>, c long, outside boolean")
        have = sorted((r.a, r.b) for r in simhash._by_differences(deltas, 0.8).collect())
        want = [(i, j) for i in range(len(texts)) for j in range(i) if hub not in (i, j) and c[i] != c[j] and alike(i, j)]
        assert have == want and len(want) > 20


def test_copies_that_lack_the_same_words_are_seldom_compared(spark):
    rnd = random.Random(17)
    base = ["w%d" % i for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(300):  # every word is missing in about 30 of them
        lacks = set(rnd.sample(range(150), 15))
        texts.append(" ".join(w for i, w in enumerate(base) if i not in lacks))
    texts += [" ".join(w for w in t.split() if w != "w%d" % rnd.randrange(150)) for t in texts[1:9]]
    sets = [set(simhash._set(t, 5).view(np.int64).tolist()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    assert not any(alike(i, 0) for i in range(1, len(texts)))
    rows = [(i, 0, len(sets[i]), len(sets[0]), sorted(sets[i] ^ sets[0]), i, True) for i in range(1, len(texts))]
    deltas = spark.createDataFrame(rows, "a long, b long, size int, of int, delta array<long>, c long, outside boolean")
    want = [(i, j) for i in range(1, len(texts)) for j in range(1, i) if alike(i, j)]
    assert len(want) >= 8 and sorted((r.a, r.b) for r in simhash._by_differences(deltas, 0.8).collect()) == want
    assert simhash._meetings(deltas, 0.8).count() <= 200 + len(want)


def test_heavily_edited_copies_match_brute_force(spark):
    texts = edited_copies(random.Random(21), 400, 9)
    have, want = partition(spark, texts)
    fps = [simhash.fingerprint(t, 5) & (2**64 - 1) for t in texts]
    for i in range(len(texts)):  # SimHashes within four bits are links too
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                one, other = (next(g for g in want if k in g) for k in (i, j))
                if one is not other:
                    want = [g for g in want if g is not one and g is not other] + [sorted(one + other)]
    assert 3 < len(want) < 400 and have == sorted(want)


def test_components_whose_hashes_agree_in_42_bits_stay_apart(spark):
    fps = [6760692, 8169631, 1601119, 4659074, 4509760, 11529635]
    got = simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert sorted(r["fp"] for r in got) == sorted(fps) and len({r["root"] for r in got}) == len(fps)


def test_keys_that_collide_change_nothing(spark, monkeypatch):
    real = simhash._keyed
    rng = np.random.default_rng(4)
    fps = set()
    for center in rng.integers(-(2**62), 2**62, 12, dtype=np.int64).tolist():
        fps |= {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (6, 2))}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {r.fp: r.root for r in simhash.linked(df).collect()}
    monkeypatch.setattr(simhash, "_keyed", lambda x: real(x).selectExpr("fp", "key % 5 as key"))
    assert {r.fp: r.root for r in simhash.linked(df).collect()} == want
    assert len(set(want.values())) == 12
