import math
import random

import numpy as np
from pyspark.sql import functions as F

from opsdesk.llm import queries, vafile


def brute(rows, is_query, k, scale):
    usable = {}
    for i, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = (vec_id, [math.floor(scale * float(np.float32(x))) for x in v])
    out = {}
    for vec_id, v in usable.values():
        if is_query(vec_id) and vec_id not in out:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), other) for other, w in usable.values() if other != vec_id and len(w) == len(v))
            out[vec_id] = [(n + 1, other, -s) for n, (s, other) in enumerate(scores[:k])]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(400)]
    rows += [(500 + i, rows[20][1]) for i in range(60)]  # one very common vector: ties go to the smaller id
    rows += [(900, None), (None, rows[0][1]), (901, [1.0, None] + [0.0] * 10), (902, [math.nan] * 12), (920, [math.inf] + [0.0] * 11), (940, [1.0, 2.0, 3.0]), (941, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("rank", F.lit(1))
    want = brute(rows, lambda i: i % 20 == 0, 7, 64)
    for block, chunk in ((8192, 1024), (40, 5)):
        got = collected(vafile.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=block, chunk=chunk))
        assert got == {q: rows_ for q, rows_ in want.items() if rows_}
    assert [x[1] for x in got[940]] == [941]


def test_repeated_ids(spark):
    """A query's own rows must not stand in for others of its vector; copies of another id are candidates each."""
    v, w = [1.0, 0.5, -0.25], [2.0, 1.0, 1.0]
    rows = [(0, v)] * 25 + [(i, v) for i in range(1, 31)] + [(40 + i, [0.5 * i, 0.0, 1.0]) for i in range(5)] + [(7, w)] * 30 + [(20, w), (20, v), (60, [0.0, 9.0, 1.0]), (60, [1.0, 9.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for k in (20, 3):
        got = collected(vafile.top_k(df, F.col("vec_id") % 20 == 0, k=k, block=16, chunk=2))
        smallest = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1]))
        assert got == brute(smallest, lambda i: i % 20 == 0, k, 64)
    import duckdb

    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = {}
    for q, rank, vec, score in sorted(con.execute(queries.ORACLE_SQL["op2_vector_search"]).fetchall()):
        want.setdefault(q, []).append((rank, vec, score))
    assert want == collected(vafile.top_k(df, F.col("vec_id") % 20 == 0))


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, -1.0]), (2, [0.1, 0.1])], "vec_id long, embedding array<float>")
    got = collected(vafile.top_k(df, F.col("vec_id") == 0, k=20))
    assert [x[1] for x in got[0]] == [2, 1]
    assert vafile.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert vafile.top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_registered(spark):
    assert "op2_vector_search" in queries.QUERIES and "op2_vector_search" in queries.ORACLE_SQL
