import os
import random

import pytest
from pyspark.sql import functions as F

from opsdesk.llm import langid, queries, toxicity
from opsdesk.llm.common import crc_mod, read

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = read(spark, DATA, "labels").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    hits = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 40 and sum(hits) / len(hits) >= 0.93
    assert got.count() == read(spark, DATA, "documents").count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where((crc_mod(F.col("doc_id"), 5) == 0) != F.col("held_out")).count() == 0


def test_toxicity_edge_cases(spark):
    r = random.Random(1)
    good, bad = "the river runs past a quiet old mill".split(), "you filthy stupid awful idiot clown".split()
    rows = [(i, " ".join(r.choice(bad if i % 2 else good) for _ in range(12)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, ""), (902, "x" * 300_000), (903, rows[1][1]), (903, rows[1][1]), (None, rows[0][1])], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 150] + [(900, None), (None, 1), (0, 0), (901, 2)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    by = {x.doc_id: x.score for x in got}
    assert len(got) == 206 and all(0 <= x.score <= 1 for x in got)
    assert all((by[i] >= 0.5) == bool(t) for i, _, t in rows)
    assert abs(by[900] - by[901]) < 1e-12
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} >= {i for i, _, t in rows if not t} and left.where("doc_id = 903").count() == 0
    for some, score in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        assert all(abs(x.score - score) < 1e-6 for x in toxicity.score(docs, toxicity.fit(docs, some)).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.reject(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("aa bb cc dd ee ff".split()) + str(r.randrange(9)) for _ in range(20)), r.randrange(2)) for i in range(120)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    flipped = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (sorted((x.doc_id, round(x.score, 9)) for x in toxicity.score(docs, toxicity.fit(docs, x, learn=learn)).collect()) for x in (labels, flipped))
    assert one == two


@needs_data
def test_language_held_out(spark):
    got = queries.op5_language_id(spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(read(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert got.count() == read(spark, DATA, "documents").count() and got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edge_cases(spark):
    r = random.Random(1)
    words = {"aa": "the and river walking through morning".split(), "bb": "der und fluss gegangen durch morgen".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "aa"), (903, "the and the river", None), (904, "der und " * 30_000, None), (905, rows[0][1], None), (905, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    by = {x.doc_id: x.lang_pred for x in got}
    assert len(got) == len(rows) and all(by[i] == k for i, _, k in rows[:120])
    assert {by[900], by[901], by[902]} == {"und"} and by[903] == "aa" and by[904] == "bb" and by[905] == "aa"
    assert all(x.score == 0 for x in got if x.lang_pred == "und") and all(0 <= x.score <= 1 for x in got)
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.fit(docs.limit(0)).languages == []
    assert {x.lang_pred for x in langid.predict(docs, langid.fit(docs.where("lang = 'aa'"))).collect()} == {"aa", "und"}


def test_kernel_is_the_string_kernel():
    """Presence products over the landmarks' vocabulary equal set intersections over the roots of set sizes."""
    import numpy as np

    from opsdesk.llm.ngrams import hashed

    texts = [langid.normal(t) for t in ("the river walks", "the red river", "quite another thing")]
    grams = [np.unique(hashed(t, langid.SPECTRUM, langid.BITS)) for t in texts]
    vocabulary = np.unique(np.concatenate(grams))
    presence = np.array([[v in g for g in map(set, grams)] for v in vocabulary.tolist()], np.float32)
    root = np.sqrt([len(g) for g in grams])
    got = langid.Kernel(vocabulary, presence, root)(texts)
    want = [[len(set(a) & set(b)) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    assert np.allclose(got, want, atol=1e-5)


def test_toxicity_fit_holds_packed_features():
    import inspect
    import tracemalloc

    import numpy as np
    from opsdesk.llm import toxicity

    given = inspect.signature(toxicity.fit).parameters
    assert given["max_fit_rows"].default == 20_000 and given["n_features"].default == 8_192
    r, n, d = np.random.default_rng(1), 4_000, 8_192
    sizes = r.integers(0, 800, n)
    y, features = (r.random(n) < 0.5).astype(float), r.integers(0, d, sizes.sum()).astype(np.int16)
    tracemalloc.start()
    w, _ = toxicity._logistic(sizes, features, y, r.normal(size=d), 1e-4, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.any() and peak < 4 * features.nbytes
