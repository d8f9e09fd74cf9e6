import math
import random

import pytest
from pyspark.sql import functions as F

from opsdesk.llm import mixing


def corpus(spark, seed=1):
    r, rows = random.Random(seed), []
    for source, n in (("big", 400), ("mid", 60), ("small", 7), (None, 20)):
        rows += [(len(rows) + k, " ".join(["w"] * r.randint(1, 30)), source) for k in range(n)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    rows += [(None, "no id here", "mid"), (9001, None, "mid"), (9002, "  \t ", "big"), (9003, "same row", "mid"), (9003, "same row", "mid"), (9004, "", "silent"), (9005, "w " * 50_000, "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as block", "1 as t", "2 as n_tokens", "3 as s"), rows


def size(t):
    return len((t or "").split())


def test_readings_follow_the_weights(spark):
    docs, rows = corpus(spark)
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + size(t)
    for options in ({"max_repeats": 2.0}, {"target_entropy": 1.0, "max_repeats": 50.0}, {"budget": 3_000, "max_repeats": 4.0}):
        got = mixing.mix(docs, **options).collect()
        assert {c for c in mixing.mix(docs, **options).columns} == {"doc_id", "source", "n_tokens", "block", "start", "weight"}
        a = mixing.exponent(tokens, target_entropy=options.get("target_entropy"), max_repeats=options["max_repeats"], budget=options.get("budget"))
        w = mixing.weights(tokens, a)
        assert abs(sum(w.values()) - 1) < 1e-9
        total = options.get("budget") or mixing.least_budget(tokens, w)
        if "target_entropy" in options:
            assert abs(mixing.entropy(w) - 1.0) < 1e-6
        else:
            assert all(w[s] * total <= options["max_repeats"] * t * (1 + 1e-9) for s, t in tokens.items() if t)
        for s in tokens:
            read = sorted((r for r in got if r.source == s), key=lambda r: (r.start, r.n_tokens))
            quota = min(round(w[s] * total), int(options["max_repeats"] * tokens[s]))
            longest = max([size(t) for _, t, x in rows if x == s])
            assert quota <= sum(r.n_tokens for r in read) < quota + max(1, longest) or not tokens[s]
            at = 0
            for r in read:  # one document after the other, without gap or overlap
                assert r.start == at
                at += r.n_tokens
            whole = sorted((i, size(t)) if i is not None else (-1, size(t)) for i, t, x in rows if x == s)
            for b in range(1, quota // max(1, tokens[s]) + 1):
                assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in read if r.block == b) == whole or not tokens[s]


def test_orders_differ_between_blocks(spark):
    docs, _ = corpus(spark)
    got = mixing.mix(docs, max_repeats=3.0).where("source = 'small'").collect()
    orders = {}
    for r in sorted(got, key=lambda r: r.start):
        orders.setdefault(r.block, []).append(r.doc_id)
    assert len(orders) > 1 and orders[1] != orders[2][: len(orders[1])]


def test_bounds(spark):
    tokens = {"a": 1000, "b": 100, "c": 10}
    assert mixing.exponent(tokens, target_entropy=math.log(3), max_repeats=1e9, budget=None) < 1e-9
    assert mixing.weights(tokens, 0.0) == {s: 1 / 3 for s in tokens}
    assert abs(mixing.weights(tokens, 1.0)["a"] - 1000 / 1110) < 1e-12
    docs, _ = corpus(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string")), max_repeats=2.0).count() == docs.count()


def test_small_ranges_change_nothing_but_the_split(spark, monkeypatch):
    docs, _ = corpus(spark)
    one = sorted(map(str, mixing.mix(docs, max_repeats=2.0).collect()))
    monkeypatch.setattr(mixing, "_RANGE", 16)
    two = sorted(map(str, mixing.mix(docs, max_repeats=2.0).collect()))
    assert one == two


def test_realised_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, max_repeats=1.0)
    assert sorted((r.doc_id, r.text) for r in mixing.realise(docs, mixed).collect()) == [(i, f"text {i}") for i in range(20)]


def test_a_source_that_runs_out_is_named(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i == 0]) for i in range(10)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match=r"1 sources short of their weights, by 35 tokens: \{'b': 35\}"):
        mixing.mix(docs, target_entropy=math.log(2), budget=90, max_repeats=1.0, strict=True)
    with pytest.warns(UserWarning, match="short of their weights"):
        got = mixing.mix(docs, target_entropy=math.log(2), budget=90, max_repeats=1.0).collect()
    assert sum(r.n_tokens for r in got if r.source == "b") == 10 and 45 <= sum(r.n_tokens for r in got if r.source == "a") < 55


def test_rows_without_id_are_spread_and_keep_their_texts(spark):
    rows = [(None, "big", "one two three")] * 3000 + [(None, "big", f"text {i}") for i in range(200)] + [(None, None, None), (None, "small", ""), (5, "small", "a b"), (5, "small", "c d"), (5, "small", "c d")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("extra", F.length("text"))
    mixed = mixing.mix(docs, max_repeats=2.0).cache()
    got = mixing.realise(docs, mixed)
    assert got.count() == mixed.count() and {c for c in got.columns} == {*mixed.columns, "text", "extra"}
    assert got.where("not text <=> null and extra <> length(text)").count() == 0
    for block in (1,):
        once = sorted(((r.doc_id or 0), r.source or "", r.text or "") for r in got.where(F.col("block") == block).collect())
        assert once == sorted(((d or 0), s or "", t or "") for d, s, t in rows)
    starts = sorted((r.start, r.n_tokens) for r in mixed.where("source = 'big'").collect())
    at = 0
    for start, n in starts:
        assert start == at
        at += n
