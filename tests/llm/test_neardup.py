import random
import re

import numpy as np
import pytest

from opsdesk.llm import neardup

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets, root = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, k))
            root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def result(spark, rows, k, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as id", "2 as bands")
    return neardup.near_duplicates(df, words=k, percent=percent).collect()


def mutated(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice("new other fresh odd plain".split()) + str(r.randrange(1000))
    return words


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    r = random.Random(k)
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(3, 300))]
        for copy in range(r.choice([1, 1, 2, 3, 8])):
            rows.append((n, " ".join(mutated(r, base, 0 if copy % 3 == 1 else r.randint(0, max(1, len(base) // 40))))))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "İstanbul É é"), (n + 6, "İstanbul É é")]
    got = result(spark, rows, k)
    want = brute(rows, k, 80)
    assert {x.doc_id: x.component_id for x in got} == want
    assert {x.doc_id: x.n_shingles for x in got} == {i: len(shingle_set(t, k)) for i, t in rows}
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_variants_of_one_text_that_are_not_near_each_other(spark):
    """Every copy is near the original only: one component, though most pairs of it aren't linked."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base if i == 150 else mutated(r, base, 9))) for i in range(300)]
    want = brute(rows, 4, 80)
    got = {x.doc_id: x.component_id for x in result(spark, rows, 4)}
    assert got == want


def test_altered_copies_without_their_base(spark):
    """Around the threshold: most copies are linked to a few others only, and no copy is near all."""
    r, rows = random.Random(6), []
    for altered in (6, 7, 8, 9):
        base = [f"w{i}f{altered}" for i in range(400)]
        for _ in range(250):
            words = list(base)
            for at in r.sample(range(400), altered):
                words[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    assert {x.doc_id: x.component_id for x in result(spark, rows, 4)} == {k: v for i in range(0, 1000, 250) for k, v in brute(rows[i : i + 250], 4, 80).items()}


def test_repeated_ids_with_different_texts(spark):
    """Rows of one doc_id are one node: it is linked if one of its texts is."""
    r = random.Random(5)
    a, b, c = ([f"{x}{i}" for i in range(200)] for x in "abc")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (7, " ".join(mutated(r, a, 3))), (5, " ".join(mutated(r, b, 3))), (9, " ".join(c)), (1, " ".join(a)), (8, " ".join(b[:170]))]
    rows += [(20 + i, " ".join(mutated(r, (a, b, c)[i % 3], 9))) for i in range(60)]
    assert {x.doc_id: x.component_id for x in result(spark, rows, 4)} == brute(rows, 4, 80)


def test_family_without_a_central_text(spark):
    """Samples of one pool of passages: most pairs are below the threshold, links join any two of them, and the rounds of
    stars leave some out."""
    r = random.Random(3)
    passages = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(60)]
    rows = [(i, " ".join(passages[k] for k in sorted(r.sample(range(60), 51)))) for i in range(250)]
    assert {x.doc_id: x.component_id for x in result(spark, rows, 4)} == brute(rows, 4, 80)


def test_edge_cases(spark):
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (5, None)]
    got = result(spark, rows, 4)
    assert len(got) == len(rows)
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id) == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5)]
    assert [x.component_id for x in got if x.doc_id is None] == [None]
    assert result(spark, [], 4) == []


def test_signature_fills_every_bin():
    for n in (1, 2, 50, 5000):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        assert np.isin(neardup.signature(h), h).all()
