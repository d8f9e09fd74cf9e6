"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (all n of a blended spectrum) present in both, over the
root of the product of their numbers of distinct n-grams. ``n_landmarks`` texts, spread over the languages, give a
Nyström approximation; one-versus-rest ridge regression on it is solved from sums that each task adds up. A batch is
scored by two matrix products: presence x landmarks, then kernel x coefficients.

Learned from a bounded, hash-chosen sample of ``max_fit_rows`` rows in expectation. The landmarks of each language are the
first of its texts in a hashed order, whatever their length; every text is read whole.

Defined results: null texts and texts without a letter give ``und`` with score 0; rows without a language aren't
learned from; without any learnable row every text is ``und``; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_below
from .ngrams import Distinct, hashed, slices

SPECTRUM = (1, 3)
BITS = 20
ROWS = 256  # of one matrix product
_SLAB = 1 << 15  # columns of one matrix product
_PAIRS = 1 << 22  # texts' n-grams held at once
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


@dataclass
class Model:
    vocabulary: np.ndarray  # buckets of the landmarks' n-grams
    presence: np.ndarray  # vocabulary x landmarks, eight landmarks a byte
    root: np.ndarray  # of each landmark's number of n-grams
    coefficients: np.ndarray  # landmarks x languages
    languages: list[str]


def normal(text: str | None) -> str:
    """Letters only, in lower case, with single spaces around the words; empty if there is no letter."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if _LETTER.search(words) else ""


class Kernel:
    """Kernel values of texts against the landmarks. A batch is a product of its presence matrix with that of the landmarks, ``_SLAB``
    columns of the vocabulary at a time, and at most about ``_PAIRS`` (text, n-gram) pairs at once; the landmarks' matrix is kept in bits. So
    neither long texts nor long landmarks make a large matrix. Sums are counts below 2^24, exact in single precision."""

    def __init__(self, vocabulary: np.ndarray, presence: np.ndarray, root: np.ndarray):
        self.at = np.full(1 << BITS, -1, np.int32)
        self.at[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
        self.bits = presence if presence.dtype == np.uint8 else np.packbits(presence > 0, axis=1)
        self.root, self.distinct = root, Distinct(1 << BITS)
        self.slabs = list(slices(len(vocabulary), _SLAB))
        self.only = _unpacked(self.bits, len(root)) if len(self.slabs) == 1 else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, norm = np.zeros((len(texts), len(self.root)), np.float32), np.ones(len(texts))
        held: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            grams = self.distinct(hashed(text, SPECTRUM, BITS))
            norm[i] = np.sqrt(max(1, len(grams)))
            k = self.at[grams]
            held.append((i, k[k >= 0]))
            if sum(len(k) for _, k in held) > _PAIRS:
                self._add(out, held)
                held = []
        self._add(out, held)
        return out / (norm[:, None] * self.root)

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        if not held:
            return
        columns = np.concatenate([k for _, k in held])
        rows = np.repeat(np.arange(len(held), dtype=np.int32), [len(k) for _, k in held])
        if len(self.slabs) > 1:
            order = np.argsort(columns, kind="stable")
            rows, columns = rows[order], columns[order]
        for s in self.slabs:
            a, b = (0, len(columns)) if self.only is not None else np.searchsorted(columns, [s.start, s.stop])
            x = np.zeros((len(held), s.stop - s.start), np.float32)
            x[rows[a:b], columns[a:b] - s.start] = 1
            out[[i for i, _ in held]] += x @ (self.only if self.only is not None else _unpacked(self.bits[s], len(self.root)))


def _unpacked(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=n).astype(np.float32)


def _landmarks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary of the landmarks, their presence in bits, the roots of their sizes, and how many n-grams each two share. The texts are
    gone through twice, so that one text's n-grams are held at a time."""
    distinct, seen, sizes = Distinct(1 << BITS), np.zeros(1 << BITS, bool), []
    for t in texts:
        grams = distinct(hashed(t, SPECTRUM, BITS))
        seen[grams] = True
        sizes.append(len(grams))
    vocabulary = np.flatnonzero(seen).astype(np.int32)
    bits = np.zeros((len(vocabulary), -(-len(texts) // 8)), np.uint8)
    for j, t in enumerate(texts):
        bits[np.searchsorted(vocabulary, distinct(hashed(t, SPECTRUM, BITS))), j // 8] |= 128 >> j % 8
    shared = np.zeros((len(texts), len(texts)))
    for s in slices(len(vocabulary), _SLAB):
        u = _unpacked(bits[s], len(texts))
        shared += u.T @ u
    return vocabulary, bits, np.sqrt(sizes), shared


def _sums(kernel_of: Callable[[], Kernel], whiten: np.ndarray, languages: list[str]) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel, m, c = kernel_of(), whiten.shape[1], len(languages)
        a, b, index = np.zeros((m, m)), np.zeros((m, c)), {x: i for i, x in enumerate(languages)}
        for pdf in frames:
            texts, langs = [normal(t) for t in pdf.text], [index.get(x, -1) for x in pdf.lang]
            use = [i for i, t in enumerate(texts) if t and langs[i] >= 0]
            for s in slices(len(use), ROWS):
                phi = kernel([texts[i] for i in use[s]]) @ whiten
                y = -np.ones((len(phi), c))
                y[np.arange(len(phi)), [langs[i] for i in use[s]]] = 1
                a += phi.T @ phi
                b += phi.T @ y
        yield pd.DataFrame({"sums": [np.concatenate([a.ravel(), b.ravel()])]})

    return run


def fit(documents: DataFrame, *, learn: Column | None = None, n_landmarks: int = 96, max_fit_rows: int = 20_000, ridge: float = 1e-3) -> Model:
    """learn: which rows may be learned from (a condition on doc_id)."""
    rows = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    rows = rows if learn is None else rows.where(learn)
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(n)
    if not languages:
        return Model(np.zeros(0, np.int32), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0)), [])
    each = -(-n_landmarks // len(languages))

    def sampled(per_language: float, seed: int) -> DataFrame:
        test = F.lit(False)
        for lang in languages:
            test = test | ((F.col("lang") == lang) & hash_below(F.col("doc_id"), per_language / n[lang], seed))
        return rows.where(test)

    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "text")
    letter = F.col("text").rlike(r"\p{L}")
    few = sampled(4 * each + 20, 7).where(letter).select("lang", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= each).orderBy("lang", "k").toPandas()
    texts = list(filter(None, map(normal, few.text))) or [" a "]
    vocabulary, presence, root, shared = _landmarks(texts)
    value, vector = np.linalg.eigh(shared / np.outer(root, root))
    keep = value > 1e-8
    whiten = vector[:, keep] / np.sqrt(value[keep])
    got = sampled(max_fit_rows / len(languages), 11).mapInPandas(_sums(lambda: Kernel(vocabulary, presence, root), whiten, languages), "sums array<double>")
    # One row for each task: added up by Spark, element by element, so that the driver gets one row.
    m, c = whiten.shape[1], len(languages)
    total = got.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toPandas().x.to_numpy()
    a, b = total[: m * m].reshape(m, m), total[m * m :].reshape(m, c)
    w = np.linalg.solve(a + ridge * max(1.0, np.trace(a) / m) * np.eye(m), b)
    return Model(vocabulary, presence, root, whiten @ w, languages)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of documents."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel, names = Kernel(model.vocabulary, model.presence, model.root), np.array(model.languages, object)
        for pdf in frames:
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            texts = [normal(t) for t in pdf.text]
            use = np.array([i for i, t in enumerate(texts) if t and len(names)], int)
            for s in slices(len(use), ROWS):
                f = kernel([texts[i] for i in use[s]]) @ model.coefficients
                best = f.argmax(1)
                lang[use[s]], score[use[s]] = names[best], np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "lang_pred": lang, "score": score})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
