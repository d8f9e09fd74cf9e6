"""The classifiers, the mix and the secret scan against plain versions of themselves, written without their code."""

import hashlib
import math
import os
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opsdesk.llm import langid, mixing, secrets, toxicity
from opsdesk.llm.common import crc_mod, read
from opsdesk.llm.ngrams import hashed


def spark_hash(*values) -> int:
    """xxhash64 of longs and texts, as Spark chains it; signed."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def grams(text: str, low: int, high: int, bits: int) -> set[int]:
    """Each n-gram of its own, one by one."""
    return {int(hashed(text[i : i + n], (n, n), bits)[0]) for n in range(low, high + 1) for i in range(len(text) - n + 1)}


def test_ratios_and_scores_of_toxicity(spark):
    r = random.Random(4)
    good, bad = "river mill quiet stone garden".split(), "idiot stupid filthy".split()
    rows = [(i, " ".join(r.choice(good + (bad if i % 3 == 0 else [])) for _ in range(r.randint(3, 9))), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, n_features=300, l2=1e-2)
    sets, y = [grams(f" {t} ", 3, 6, toxicity.BITS) for _, t, _ in rows], np.array([t for *_, t in rows], float)
    n1, n0 = y.sum(), (1 - y).sum()
    table = []
    for g in set().union(*sets):
        pos, neg = (sum(g in s and t == c for s, t in zip(sets, y, strict=True)) for c in (1, 0))
        pooled = (pos + neg + 1) / (n1 + n0 + 2)
        if pos + neg >= 3:
            table.append((-abs((pos / n1 - neg / n0) / math.sqrt(pooled * max(1 - pooled, 1e-6) + 1e-9)), g, math.log((pos + 1) / (n1 + 2)) - math.log((neg + 1) / (n0 + 2))))
    kept = sorted(table)[:300]
    assert {g for _, g, _ in kept} == set(model.buckets.tolist())
    x = np.array([[ratio * (g in s) for _, g, ratio in kept] + [1.0] for s in sets])
    ridge, w = np.append(np.full(300, 1e-2), 0), np.zeros(301)
    for _ in range(40):  # Newton's method on the whole matrix
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + np.diag(ridge + 1e-12), x.T @ (p - y) / len(y) + ridge * w)
    want = dict(zip([i for i, *_ in rows], 1 / (1 + np.exp(-x @ w)), strict=True))
    assert all(abs(s.score - want[s.doc_id]) < 1e-4 for s in toxicity.score(docs, model).collect())


@pytest.mark.parametrize("slab,pairs", [(1 << 15, 1 << 22), (64, 200)])
def test_language_scores(spark, monkeypatch, slab, pairs):
    """Landmarks, Nyström map, ridge and scores by sets; small matrices change nothing."""
    monkeypatch.setattr(langid, "_SLAB", slab)
    monkeypatch.setattr(langid, "_PAIRS", pairs)
    r = random.Random(2)
    words = {"aa": "the and river walking".split(), "bb": "der und fluss gehen".split(), "cc": "le et fleuve marcher".split()}
    rows = [(i, " ".join(r.choice(words[k] + words["aa"][:1]) for _ in range(r.randint(2, 12))), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, n_landmarks=11)
    sets = {i: grams(f" {t} ", 1, 3, langid.BITS) for i, t, _ in rows}
    marks = [i for k in sorted(words) for i in sorted((i for i, _, x in rows if x == k), key=spark_hash)[:4]]
    kernel = lambda a, b: len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b]))
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = value > 1e-8
    phi = np.array([[kernel(i, m) for m in marks] for i, *_ in rows]) @ (vector[:, keep] / np.sqrt(value[keep]))
    y = np.array([[1.0 if lang == k else -1.0 for k in sorted(words)] for *_, lang in rows])
    a = phi.T @ phi
    f = phi @ np.linalg.solve(a + 1e-3 * max(1.0, np.trace(a) / len(a)) * np.eye(len(a)), phi.T @ y)
    got = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    assert len(model.root) == len(marks) and model.presence.dtype == np.uint8
    for (i, *_), scores in zip(rows, f, strict=True):
        assert got[i].lang_pred == sorted(words)[scores.argmax()] and abs(got[i].score - min(1, max(0, (scores.max() + 1) / 2))) < 1e-4


def test_long_landmarks_stay_small():
    import pickle

    r = np.random.default_rng(1)
    texts = [" " + "".join(map(chr, r.integers(0x4E00, 0x9FFF, 60_000))) + " " for _ in range(10)]
    vocabulary, bits, root, shared = langid._landmarks(texts)
    assert len(vocabulary) > 400_000 and len(pickle.dumps((vocabulary, bits, root))) < 8 * len(vocabulary)
    assert np.allclose(langid.Kernel(vocabulary, bits, root)(texts), shared / np.outer(root, root), atol=1e-5)


@pytest.mark.parametrize("entropy,repeats,budget", [(None, 3.0, None), (1.1, 40.0, None), (0.9, 30.0, 5_000), (None, 2.5, 1_500)])
def test_mix_row_by_row(spark, entropy, repeats, budget):
    """Weights by a search of the exponent in ever finer steps, starts by sorting each block."""
    r, rows = random.Random(6), []
    for source, n in (("a", 120), ("b", 35), ("c", 9), (None, 4)):
        rows += [(len(rows) + k, " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(1, 20))), source) for k in range(n)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())

    def shares(e):
        p = {s: (n / sum(sizes.values())) ** e for s, n in sizes.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def fits(e):
        w = shares(e)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) <= entropy
        total = budget or max(math.ceil(n / w[s] - 1e-9) for s, n in sizes.items())
        return all(w[s] * total <= repeats * n for s, n in sizes.items())

    e, step = 0.0, 0.1
    while step > 1e-13:  # the least exponent that fits
        while not fits(e) and e < 1:
            e += step
        e, step = max(0.0, e - step), step / 10
    w = shares(e if fits(e) else e + 10 * step)
    total = budget or max(math.ceil(n / w[s] - 1e-9) for s, n in sizes.items())
    want = []
    for s, n in sizes.items():
        quota = min(round(w[s] * total), int(repeats * n))
        for block in range(1, -(-quota // n) + 1):
            at = (block - 1) * n
            for i, t, _ in sorted((x for x in rows if x[2] == s), key=lambda x: spark_hash(x[0], block, spark_hash(x[1]), 0)):
                if at < quota:
                    want.append((i, s, len(t.split()), block, at))
                at += len(t.split())
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), target_entropy=entropy, max_repeats=repeats, budget=budget).collect()
    assert sorted((x.doc_id, x.source or "", x.n_tokens, x.block, x.start) for x in got) == sorted((i, s or "", n, b, at) for i, s, n, b, at in want)
    assert all(abs(x.weight - w[x.source]) < 1e-9 for x in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_secrets_in_held_out_documents(spark):
    """Findings planted in a fifth of the documents (by crc32), in shapes written for this test: keys and passwords in code, settings and
    prose; commits, ids, checksums, numbers, paths, names and placeholders that are none."""
    r = random.Random(12)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    some, hexes = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "0123456789abcdef"
    yes = [
        lambda: ('export STRIPE_SECRET="{}"', "sk_live_" + pick(some, 24)), lambda: ("  db_password: {}", pick(some, 7) + "!" + pick("0123456789", 2)), lambda: ("api_token={}&page=2".split("&")[0], pick(some, 40)),
        lambda: ('{{"client_secret": "{}", "n": 1}}', pick(hexes, 32)), lambda: ("Authorization: Bearer {}", f"eyJ{pick(some, 20)}.eyJ{pick(some, 50)}.{pick(some, 43)}"), lambda: ("my access key is {} so keep it", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
    ]
    no = [
        lambda: ("fixed in commit {} last week", pick(hexes, 40)), lambda: ("request_id={}", "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))), lambda: ("sha256: {}", pick(hexes, 64)), lambda: ("password = {}", r.choice(("changeme", "your_password_here", "${DB_PASSWORD}", "xxxxxxxx"))),
        lambda: ("path: {}", f"/var/lib/{r.choice(('app', 'data'))}/releases/current/module.py"), lambda: ("call {} first", r.choice(("initialize_default_connection", "load_template_from_source", "validateUserSessionState"))), lambda: ("order number {} shipped", pick("0123456789", 18)),
        lambda: ("see {} for more", f"https://www.site{r.randrange(99)}.org/articles/{r.randrange(9999)}/index.html"),
    ]
    docs = read(spark, "/root/testdata/sf0.01", "documents").where(crc_mod(F.col("doc_id"), 5) == 0).select("doc_id", "source", "text").orderBy("doc_id").collect()
    planted, rows = {}, []
    for k, d in enumerate(docs * 4):
        frame, value = r.choice(yes if k % 2 else no)()
        planted[k] = value, k % 2
        rows += [(2 * k, f"{d.text or ''}\n{frame.format(value)}\n{d.text or ''}", d.source), (2 * k + 1, f"{d.text or ''}\n\n{d.text or ''}", d.source)]
    held = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {}
    for x in secrets.scan(held, secrets.fit(secrets.labelled_findings(spark))).where("secret").select("doc_id", "digest").collect():
        found.setdefault(x.doc_id, set()).add(x.digest)
    # What is flagged with the planted line and not without it comes from that line, whatever part of it was taken.
    new = {k: found.get(2 * k, set()) - found.get(2 * k + 1, set()) for k in planted}
    true = sum(hashlib.sha256(v.encode()).hexdigest() in new[k] for k, (v, label) in planted.items() if label)
    recall, precision = true / sum(label for _, label in planted.values()), true / sum(map(len, new.values()))
    print(f"planted findings: {len(planted)}, recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.85 and precision >= 0.85
