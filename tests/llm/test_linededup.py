import random

import pytest
from pyspark.sql import functions as F

from opsdesk.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def mutated(r, text, n):
    for _ in range(n):
        k = r.randrange(len(text))
        text = r.choice([text[:k] + text[k + 1 :], text[:k] + r.choice("abé") + text[k:], text[:k] + r.choice("xyü") + text[k + 1 :]])
    return text


def brute(lines, t):
    return {(a, b) for a in lines for b in lines if a < b and distance(a, b) <= t}


def test_edit_distance(spark):
    r = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("abcdé") for _ in range(r.randint(5, 30)))
        rows.append((a, mutated(r, a, r.randint(0, 5))))
    df = spark.createDataFrame([x for x in rows if x[1]], "a string, b string")
    for t in (1, 2, 3):
        for x in df.select("a", "b", linededup.edit_within("a", "b", t).alias("ok")).collect():
            assert x.ok == (distance(x.a, x.b) <= t), (x, t)


def found(spark, lines, t, min_chars=8):
    """Pairs of texts by links(), cliques written out, and the degrees and number of classes by line_classes()."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    name = {x.id: x.text for x in linededup.lines_of(df, 1).collect()}
    pairs, cliques = linededup.links(df, max_edits=t, min_chars=min_chars)
    got, held = {tuple(sorted((name[x.a], name[x.b]))) for x in pairs.collect()}, {}
    for x in cliques.collect():
        held.setdefault(x.clique, set()).add(name[x.id])
    got |= {(a, b) for c in held.values() for a in c for b in c if a < b}
    rows = linededup.line_classes(df, max_edits=t, min_chars=min_chars).collect()
    return got, {lines[x.doc_id]: x.n_links for x in rows}, len({(x.class_doc_id, x.class_line) for x in rows})


def check(spark, lines, t, min_chars=8):
    lines = sorted(set(lines))
    want = brute(lines, t)
    got, degree, classes = found(spark, lines, t, min_chars)
    assert got == want
    assert degree == {x: sum(x in p for p in want) for x in lines}
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[find(b)] = find(a)
    assert classes == len({find(x) for x in lines})


def test_links_match_brute_force(spark):
    r = random.Random(7)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(10, 40))).strip() + "end" for _ in range(40)]
    lines = {x.strip() for b in base for x in [b, *[mutated(r, b, r.randint(1, 3)) for _ in range(4)]]}
    for t in (1, 2):
        check(spark, [x for x in lines if len(x) >= 8], t)


def test_large_groups_are_split(spark):
    r = random.Random(9)
    head, lines = "a common beginning of many lines ", set()
    for _ in range(150):
        tail = "".join(r.choice("abcdefgh") for _ in range(len(head)))
        lines |= {head + tail, head + mutated(r, tail, 1)}
    check(spark, lines, 1)


@pytest.mark.parametrize("t", [1, 2])
def test_many_lines_around_one_text(spark, t):
    """Groups above the limit for pairs: one character at the end, at the beginning, none, two, and in the middle."""
    head = "the same text in each of the lines"
    marks = [chr(0x4E00 + i) for i in range(70)]
    lines = [head + c for c in marks] + [c + head for c in marks[:66]] + [head] + [head + c + d for c in marks[:3] for d in marks[:3]]
    check(spark, lines, t)


def test_short_lines_against_brute_force(spark):
    """Lines of 2 to 4 characters, where segments are one character or none."""
    r = random.Random(2)
    lines = {"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 4))) for _ in range(500)}
    check(spark, lines, 1, min_chars=2)


def test_documents(spark):
    long = "this line is long enough to take part"
    rows = [
        (1, f"{long}\nshort\nonly here in the first text"), (2, f"  {long}.\nshort\nwhat the second text alone has"),
        (3, long), (4, None), (5, ""), (6, f"{long}\n{long}"), (None, long), (7, "x" * 50_000 + "\n" + "x" * 50_001),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("n_chars", F.lit(0).cast("long"))
    got = {x.doc_id: x.text for x in linededup.dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "short\nwhat the second text alone has", 4: None, 5: "", None: long, 7: "x" * 50_000}
    classes = linededup.line_classes(df)
    assert {(x.class_doc_id, x.class_line) for x in classes.where("doc_id in (1, 2, 3, 6) and line = 0").collect()} == {(1, 0)}
    assert classes.where("doc_id = 2 and line = 0").first().n_links == 1
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_have_classes(spark):
    rows = [(1, "}\nshort\n\nx"), (2, " }\nshort \nsharp\n \t"), (3, "shorts\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {(x.doc_id, x.line): (x.class_doc_id, x.class_line, x.n_links, x.kept) for x in linededup.line_classes(df).collect()}
    own = {k: (*k, 0, True) for k in [(1, 0), (1, 1), (1, 3), (2, 2), (3, 0), (3, 1)]}
    assert exact == own | {(2, 0): (1, 0, 0, False), (2, 1): (1, 1, 0, False)}
    near = {(x.doc_id, x.line): (x.class_doc_id, x.class_line, x.n_links, x.kept) for x in linededup.line_classes(df, min_chars=2).collect()}
    assert near == exact | {(1, 1): (1, 1, 1, True), (2, 1): (1, 1, 1, False), (3, 0): (1, 1, 1, False)}
