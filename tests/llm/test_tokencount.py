import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from opsdesk.llm import tokencount  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = tokencount.counter(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", " thing", "  ", "\n\n\n", "'ll", "'re", " ", "don't", "é", "日本", "123", "!?", "<|endoftext|>", "<|end", "　", "x" * 20, "\t", "ß", "'", "🙂", "."]), max_size=12).map("".join))
def test_every_prefix_counts_as_the_library_counts_it(text):
    counts = OWN.prefixes(text)
    assert counts.tolist() == [library(text[:k]) for k in range(len(text) + 1)]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OWN.prefixes(text).tolist() == [library(text[:k]) for k in range(len(text) + 1)]


def test_table(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (4, "long word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, tokencount.token_counts(df, PATH, limit=100).collect()))
    assert [r[:4] for r in got] == sorted((i, len((t or "").encode()), library(t or ""), library(t or "") > 100) for i, t in rows)
    cut = dict((r[0], r[4]) for r in got)[4]
    assert library(rows[4][1][:cut]) <= 100 < library(rows[4][1][: cut + 5])
    stored = tokencount.prefix_counts(df, PATH)
    for limit in (0, 1, 2, 50):
        fits = dict(stored.select("doc_id", tokencount.fitting_chars(limit)).collect())
        assert all(fits[i] == max(k for k in range(min(len(t or ""), 400) + 1) if library((t or "")[:k]) <= limit) for i, t in rows)
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0


def test_long_pieces_and_refused_files(spark, tmp_path):
    import json

    text = "a" * 3000 + " " + "=" * 700 + "é" * 300
    assert OWN.prefixes(text)[[0, 100, 2999, 3001, 3500, len(text)]].tolist() == [library(text[:k]) for k in (0, 100, 2999, 3001, 3500, len(text))]
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokencount.PrefixCounter(str(tmp_path / "other.json"))


def test_pieces_whose_count_crosses_255_both_ways(spark):
    import random

    words, texts = "the and ing hello world con qz station international government zxq information understanding rq".split(), []
    r = random.Random(2)
    long = "".join(r.choice(words) for _ in range(400))
    counts = [library(long[:k]) for k in range(900, 1500)]
    falls = [900 + k for k in range(1, len(counts)) if counts[k] == 255 and counts[k - 1] == 256]
    rises = [900 + k for k in range(1, len(counts)) if counts[k] == 256 and counts[k - 1] == 255]
    assert falls and rises
    texts = [long[:k] for k in (*falls, *rises, falls[0] - 1, falls[0] + 1)]
    for t in texts:
        assert OWN.prefixes(t)[[-1, -2, -3, 1000]].tolist() == [library(t), library(t[:-1]), library(t[:-2]), library(t[:1000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, PATH).collect()} == {i: library(t) for i, t in enumerate(texts)}


def test_stored_steps_give_back_the_counts(spark):
    import numpy as np

    for counts in ([0], [0, 1, 1, 2], [0, 5, 4, 300, 2], [0, 1, 70_000, 1]):
        assert tokencount.unpacked(tokencount.packed(np.array(counts))).tolist() == counts
    texts = ["hello world's  \n\n end", None, "", "日本 🙂" * 50]
    table = tokencount.prefix_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    for r in table.collect():
        t = texts[r.doc_id] or ""
        assert tokencount.unpacked(r.steps).tolist() == [library(t[:k]) for k in range(len(t) + 1)] and r.n_tokens == library(t)
