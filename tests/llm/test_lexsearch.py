import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from opsdesk.llm import lexsearch, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(documents, items, k):
    docs = [(d, Counter(terms(t))) for d, t in documents]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in wanted.items():
        scored = []
        for d, c in docs:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Émile", "É", "naïve", "日本語", "A1", "x_y", "don't", "3.5", "a b", "ǅ"]
    text = lambda size: r.choice([" ", "  ", "\n", "-"]).join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(size))
    documents = [(i, text(r.choice([0, 1, 3, 20, 200]))) for i in range(n)]
    documents += [(500 + i, documents[7][1]) for i in range(30)]  # ties
    documents += [(900, None), (901, "  \t"), (None, documents[7][1]), (None, text(30) + " nobodyelse"), (3, text(5)), (3, documents[3][1]), (3, documents[3][1]), (902, "w1 " * 5000)]
    r.shuffle(documents)
    items = [(i, text(r.choice([1, 4, 30]))) for i in range(25)] + [(3, "w1 w1 w2"), (100, None), (101, ""), (102, "nowhere"), (None, "w1"), (103, documents[7][1]), (104, "nobodyelse w2")]
    return documents, items


@pytest.mark.parametrize(("block", "max_terms"), [(2_000_000, 500_000), (50, 60)])
def test_against_brute_force(spark, monkeypatch, block, max_terms):
    documents, items = tables(4, 200)
    monkeypatch.setattr(lexsearch, "_BLOCK", block)
    d = spark.createDataFrame([(*x, 1, "clash") for x in documents], "doc_id long, text string, score int, term string").repartition(4)
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = collected(lexsearch.search(d, i, k=10, max_terms=max_terms))
    assert got == brute(documents, items, 10)
    assert any(r[2] is None for r in got) and len({r[0] for r in got}) > 20


def test_radix_order():
    r = np.random.default_rng(2)
    for top in (1, 300, 1 << 20, 1 << 45):
        keys = r.integers(0, top, 3000)
        assert (lexsearch.radix_order(keys, top) == np.argsort(keys, kind="stable")).all()


def test_counts_beyond_64_bits():
    one = np.zeros(2, np.int64)
    s = lexsearch._Scorer(10, 10**12, 10**13, np.array([7]), np.array([0, 1]), one, one + 1, 1)
    n, tf = np.array([10**9]), np.array([10**9])
    want = 7 * ((10**9 * 10**9) // (1000 * 10**9 + 8 * (25 + (75 * 10**9 * 10**12) // 10**13)))
    assert s._impacts(n, np.array([0]), np.array([0]), tf).tolist() == [want]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexsearch.search(d.limit(0), i).count() == 0
    assert lexsearch.search(d, i.limit(0)).count() == 0
    assert lexsearch.search(d, i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexsearch.search(d.withColumn("text", d.text.substr(1, 0)), i).count() == 0


def test_registered(spark):
    assert "op12_lexical_search" in queries.QUERIES and "op12_lexical_search" in queries.ORACLE_SQL
