import random

import pytest
import xxhash

from opsdesk.llm import queries, simhash


def fingerprint(text, size):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, size, max_bits):
    fps = [fingerprint(t, size) for _, t in rows]
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    root = {rows[i][0]: rows[i][0] for i in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(known):
        for j in known[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return sorted((d if d is not None else -1, f"{fp:016x}", find(d) if d is not None else -1) for (d, _), fp in zip(rows, fps, strict=True))


def collected(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in df.collect())


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Émile", "naïve", "ÀB", "X Y", "日本"]
    rows, k = [], 0
    for size in (1, 2, 3, 4, 5, 30, 400):
        base = [r.choice(words) for _ in range(size)]
        for copies in range(30):
            other = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                other[r.randrange(size)] = r.choice(words)
            rows.append((k, (r.choice([" ", "\t", "\n", " \r\n "])).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in other)))
            k += 1
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, rows[5][1]), (None, None), (7, rows[100][1]), (7, "quite another text"), (1003, "quite another text"), (8, rows[8][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [16_384, 3])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SMALL", 64 if most > 3 else 2)
    rows = texts(5)
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], "doc_id long, text string, fingerprint string, rep string").repartition(3)
    assert collected(simhash.near_duplicates(df, most=most)) == brute(rows, 4, 4)


@pytest.mark.parametrize("most", [16_384, 60])
def test_links_of_chains_and_dense_families(spark, monkeypatch, most):
    """Points without texts: families within a few bits, chains of 4 bits a step, and strangers at 5."""
    r = random.Random(9)
    fps, family = set(), r.getrandbits(64)
    fps |= {family ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for _ in range(300)}
    fps |= {family ^ sum(1 << b for b in r.sample(range(10), 5)) for _ in range(200)}
    for _ in range(20):
        x = r.getrandbits(64)
        for step in range(6):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), 4 if step % 3 else 5))
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    points = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, id long")
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(signed):
        for j in range(i):
            if ((x ^ signed[j]) & (1 << 64) - 1).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [find(i) for i in range(len(signed))]
    got = {r.node: r.root for r in simhash.components(simhash.links(points, most=most)).collect()}
    assert [got.get(i, i) for i in range(len(signed))] == want
    assert len(set(want)) > 20


def test_counts_bound_the_bits_from_below():
    r = random.Random(1)
    import numpy as np

    x = np.array([r.getrandbits(64) for _ in range(2000)], np.uint64)
    counts = lambda v: [int(v) >> 2 * i & 1 for i in range(32)]
    u = simhash._unary(x.view(np.int64))
    for a, b in ((0, 1), (2, 3), (4, 5)):
        ones = lambda v: [(int(v) >> 2 * i & 3).bit_count() for i in range(32)]
        assert int(np.bitwise_count(u[a] ^ u[b])) == sum(abs(p - q) for p, q in zip(ones(x[a]), ones(x[b]), strict=True)) <= int(np.bitwise_count(x[a] ^ x[b]))
        assert ones(u[a]) == ones(x[a]) and len(counts(x[a])) == 32
    masks = simhash.grids(4)
    assert len(masks) == 35 and all(m.bit_length() <= 64 for m in masks)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id"]


def test_text_ids_and_long_text(spark):
    long = "lorem ipsum dolor sit " * 60_000
    df = spark.createDataFrame([("b", long), ("a", long.upper()), ("c", "something else than that")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_registered(spark):
    assert "op13_simhash" in queries.QUERIES
