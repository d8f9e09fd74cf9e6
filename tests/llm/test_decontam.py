import random

from opsdesk.llm import decontam

ITEM = "which of the following rivers flows through the largest number of countries on its way to the sea"


def plain_tiles(doc, item, least):
    """The same rule without hashes: every longest unmarked common run, again and again."""
    md, mi, out = [False] * len(doc), [False] * len(item), 0
    while True:
        best, found = least - 1, []
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not any(mi[i : i + best]) and not any(md[j : j + best]):
                mi[i : i + best] = md[j : j + best] = [True] * best
                out += best


def test_tiles_cover_what_the_plain_rule_covers():
    r = random.Random(2)
    for _ in range(150):
        item = [r.choice("abcd") for _ in range(r.randint(3, 25))]
        doc = [r.choice("abcd") for _ in range(r.randint(0, 40))]
        for least in (2, 3):
            tiles = decontam.tile(doc, item, least)
            assert all(item[i : i + n] == doc[j : j + n] for i, j, n in tiles)
            assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles) == len({x for _, j, n in tiles for x in range(j, j + n)})
            assert sum(n for *_, n in tiles) == plain_tiles(doc, item, least)


def tables(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as id", "2 as seed")
    return docs, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id")


def test_reordered_passages_and_edge_cases(spark):
    w = ITEM.split()
    rows = [
        (1, "intro words " + ITEM + " and after"), (2, " ".join(w[9:]) + " in between " + " ".join(w[:9])), (3, " ".join(w[:6])), (4, " ".join(random.Random(1).sample(w, len(w)))),
        (5, None), (6, ""), (7, ITEM.upper().replace(" ", ", ")), (7, ITEM), (None, ITEM), (8, "x " * 50_000 + ITEM), (9, "short answer"), (10, "a SHORT, answer!"),
    ]
    items = [(100, ITEM), (101, "short answer"), (102, None), (103, ""), (104, "?!"), (None, "intro words"), (100, ITEM)]
    docs, bench = tables(spark, rows, items)
    for limit in (500_000, 1):  # broadcast and joined
        got = sorted((r.doc_id, r.item_id, r.covered, r.item_tokens) for r in decontam.contaminated(docs, bench, max_broadcast_seeds=limit).collect())
        n = len(w)
        left = decontam.clean(docs, bench, max_broadcast_seeds=limit)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [3, 4, 5, 6]
        assert got == [(1, 100, n, n), (2, 100, n, n), (7, 100, n, n), (7, 100, n, n), (8, 100, n, n), (9, 101, 2, 2), (10, 101, 2, 2)]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_both_ways_agree(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 20)))) for i in range(12)]
    rows = [(i, " ".join(r.choice("abcdefghij") for _ in range(40)) + (" " + r.choice(items)[1] if i % 3 == 0 else "")) for i in range(40)]
    docs, bench = tables(spark, rows, items)
    one, two = (sorted(map(tuple, decontam.contaminated(docs, bench, min_match=3, max_broadcast_seeds=m).collect())) for m in (500_000, 1))
    assert one == two and len(one) > 5


def test_clean_keeps_the_same_rows_both_ways(spark):
    rows = [(None, ITEM), (None, "nothing of it"), (None, None), (1, ITEM), (1, "nothing of it"), (1, None), (2, "nothing of it"), (2, "nothing of it"), (3, ITEM), (3, ITEM)]
    docs, bench = tables(spark, rows, [(100, ITEM)])
    one, two = (sorted(((r.doc_id, r.text) for r in decontam.clean(docs, bench, max_broadcast_seeds=m).collect()), key=str) for m in (500_000, 0))
    assert one == two == sorted((x for x in rows if x[1] != ITEM), key=str)


def test_whole_query_against_the_plain_rule(spark):
    """Repeated items with different texts, null and repeated ids, both ways, against every document x item x text."""
    r = random.Random(8)
    word = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    items = [(i % 9, word(r.randint(1, 16))) for i in range(14)] + [(50, None), (None, "a b c d e f")]
    rows = [(i if i % 7 else None, word(30) + (" " + r.choice(items[:14])[1] if i % 3 == 0 else "")) for i in range(45)] + [(3, word(20)), (3, items[0][1]), (4, items[9][1]), (5, items[0][1])]
    want = []
    for d, text in rows:
        for i in {i for i, t in items if i is not None}:
            texts = [t.split() for k, t in items if k == i and t]
            covered = [(plain_tiles(text.split(), t, min(3, len(t))), len(t)) for t in texts]
            best = max(((c / n, c, n) for c, n in covered if c >= 0.5 * n), default=None)
            if best and d is not None:
                want.append((d, i, best[1], best[2]))
    docs, bench = tables(spark, rows, items)
    for limit in (500_000, 1):
        got = decontam.contaminated(docs, bench, min_match=3, max_broadcast_seeds=limit).collect()
        assert sorted((x.doc_id, x.item_id, x.covered, x.item_tokens) for x in got) == sorted(want)


def test_frequent_seeds_that_are_spared_lose_no_pair(spark):
    """Items that share a long phrase: with each share of coverage the join finds what the search in the tasks finds."""
    r = random.Random(11)
    phrase = " ".join(r.choice("abcdefghij") for _ in range(24))
    word = lambda n: " ".join(r.choice("klmnopqrst") for _ in range(n))
    items = [(i, f"{word(r.randint(0, 12))} {phrase} {word(r.randint(0, 12))}") for i in range(15)]
    rows = [(i, f"{word(5)} {' '.join(phrase.split()[: r.randint(4, 24)])} {word(5)} {' '.join(r.choice(items)[1].split()[r.randint(0, 8) :])}") for i in range(30)] + [(40, phrase), (40, phrase), (41, phrase + " " + phrase)]
    docs, bench = tables(spark, rows, items)
    for coverage in (0.3, 0.5, 0.8, 1.0):
        one, two = (sorted(map(tuple, decontam.contaminated(docs, bench, min_match=4, coverage=coverage, max_broadcast_seeds=m).collect())) for m in (500_000, 1))
        assert one == two and (coverage == 1.0 or len(one) > 20)
