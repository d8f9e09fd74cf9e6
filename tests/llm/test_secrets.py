from pyspark.sql import functions as F

from opsdesk.llm import secrets


def test_forest_tells_secrets_from_the_usual_false_positives(spark):
    findings = secrets.labelled_findings(spark)
    held = F.pmod(F.xxhash64("token"), F.lit(5)) == 0
    model = secrets.fit(findings.where(~held))
    from pyspark.ml.feature import VectorAssembler

    rows = model.transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(secrets.featured(findings.where(held)))).select("label", "prediction").collect()
    assert len(rows) > 800 and sum(r.label == r.prediction for r in rows) / len(rows) >= 0.97

    real = "q8Zr4TnV0pLw7XkD2mHs9YbJ5cGf1EaR"
    texts = [
        (1, f'set api_key = "{real}" before the start', "src/app.py"), (2, f"password={real} done", None), (3, "a very ordinary Verantwortungsbewusstsein of the people", "forum"),
        (4, "see commit 3f2a9c1b7d4e5f60718293a4b5c6d7e8f9012345 for it", "notes.txt"), (5, "visit https://www.example.com/path/to/page.html now", "forum"), (6, "api_key=your_api_key_here_please", "docs/README.md"),
        (7, None, "x"), (8, "", "x"), (9, "word " * 40_000 + f"token: ghp_{real}{real[:4]} end", "deploy/.env"), (10, f"password={real} done", "x"), (10, f"password={real} done", "x"), (None, f"password={real} done", "x"),
        (11, "password: Tr0ub4dor&3 is what it was", "notes.txt"), (12, 'the secret = "hunter2!"', "notes.txt"), (13, "note: whatever, title: ordinary words and color=lightblue", "forum"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").selectExpr("*", "'x' as value", "1 as features", "2.0 as probability", "3 as length")
    got = secrets.scan(docs, model)
    assert got.columns == ["doc_id", "nth", "name", "masked", "digest", "length", "score", "secret"]
    rows = got.collect()
    assert {r.doc_id for r in rows if r.secret} == {1, 2, 9, 10, 11, 12, None}
    assert sum(r.doc_id == 10 for r in rows if r.secret) == 2
    assert {r.name for r in rows if r.doc_id == 2} == {"password"}
    assert not any(real in r.masked for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert secrets.scan(docs.limit(0), model).count() == 0


def test_labels_other_than_0_and_1_are_left_out(spark):
    findings = secrets.labelled_findings(spark, 400)
    more = findings.union(spark.createDataFrame([("x" * 30, "", "p", None), ("y" * 30, None, None, 5.0), ("q8Zr4TnV0pLw7XkD2mHs", None, None, 1.0)], "token string, before string, path string, label double"))
    assert secrets.fit(more, trees=3, depth=3).getNumTrees == 3


def test_candidates_are_whole_and_in_order(spark):
    docs = spark.createDataFrame([(1, "short abcdefghijklmnopqrst two words zyxwvutsrqponmlkjihg, end\nQQQQQQQQQQQQQQQQ")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    got = [(r.nth, r.before.strip(), r.token, r.path) for r in secrets.candidates(docs).orderBy("nth").collect()]
    assert got == [(0, "short", "abcdefghijklmnopqrst", ""), (1, "two words", "zyxwvutsrqponmlkjihg,", ""), (2, "", "QQQQQQQQQQQQQQQQ", "")]


def test_values_go_to_their_quote_or_blank(spark):
    texts = ["password:    hunter2secret", "PASSWORD:\n  hunter2secret", "set pwd=ab:cd:ef:gh now", '{"password": "ab/cd:ef=gh1", "x": 1}', "secret: /9j/4AAQSkZJ==", "token = 'a b:c!'", 'key="hunter2!";', "see https://example.com/a", "a==bcdefg", "secret=/9j/4AAQSkZJ==", "api_key : q8Zr:4TnV"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {}
    for r in secrets.parts(secrets.candidates(df)).orderBy("doc_id", "nth").collect():
        got.setdefault(r.doc_id, []).append((r["name"], r.value))
    assert got[0] == [("password", "hunter2secret")] and got[1] == [("PASSWORD", "hunter2secret")] and got[2] == [("pwd", "ab:cd:ef:gh")]
    assert got[3] == [("password", "ab/cd:ef=gh1")] and got[4] == [("secret", "/9j/4AAQSkZJ==")] and got[6] == [("key", "hunter2!")]
    assert got[9] == [("secret", "/9j/4AAQSkZJ==")] and got[10] == [("api_key", "q8Zr:4TnV")]
    assert 8 not in got and all(name == "" for name, _ in got.get(7, []))


def test_the_scheme_of_a_header_is_no_secret(spark):
    real = "q8Zr4TnV0pLw7XkD2mHs9YbJ5cGf1EaR"
    texts = [f"Authorization: Bearer {real}", f'"Authorization": "Basic {real}"', f"authorization=bearer {real}", f"Authorization:\n  Negotiate {real}"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = secrets.scan(docs, secrets.fit(secrets.labelled_findings(spark, 2_000), trees=10)).collect()
    assert sorted(r.doc_id for r in got if r.length == len(real)) == [0, 1, 2, 3]
    assert not {r.length for r in got} & {len("basic"), len("bearer"), len("negotiate")}
