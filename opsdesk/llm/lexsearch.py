"""Ranked lexical search by sort-based accumulation.

The items' terms and their repeats are a table; chunks of at most about ``max_terms`` of its rows are sent to the tasks, one
after the other, so what is sent is bounded whatever the number of items. For a chunk, one pass over the texts writes the
postings: for each document its number of terms, and the chunk's terms in it with their frequencies. The statistics that
weights need (documents, terms, documents that hold a term) are aggregates of that table. A second pass over the postings
scores: arrays of matched items, documents and impacts are concatenated, in blocks of about ``_BLOCK`` entries or one
document; the packed (item, document) keys are radix sorted, impacts of equal keys are summed by reduceat, and a heap of k
for each item keeps the task's best. Every task holds a range of documents, so that no sum crosses tasks, and gives at most k
rows an item; those of all tasks are dealt by item and ranked.

Scores and frequencies are 64-bit integers (exact Python numbers where a product would not fit).

Defined results: a null or empty text has no terms, is no document of the statistics and no result; rows that repeat a
doc_id are separate documents (equal ones in any order); rows without doc_id are documents too, last among equal scores;
rows that repeat an item_id are one item with the terms of all of them; items without item_id or terms have no results.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

_BLOCK = 2_000_000
#: A-Z in lower case, digits, and all bytes of characters beyond ASCII are parts of terms; other bytes part them.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PARTS).split()


def _item_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(item, t, n) for item, text in zip(pdf.item_id, pdf.text, strict=True) for t, n in Counter(terms(text)).items()]
        yield pd.DataFrame(rows, columns=["item_id", "term", "n"])


def _postings(vocabulary: dict[bytes, int]):
    """For each document with terms, its number of terms, and the vocabulary's terms in it, ascending, with their frequencies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.get
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                ts = terms(text)
                if ts:
                    hits, tf = np.unique(np.array([h for h in map(known, ts) if h is not None], np.int32), return_counts=True)
                    rows.append((doc, len(ts), hits, tf))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tf"])

    return run


def radix_order(keys: np.ndarray, top: int) -> np.ndarray:
    """The stable order of non-negative keys up to ``top``, by 16 bits at a time, the lowest first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # a radix sort for this type
    shift = 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _fits(*factors: int) -> bool:
    return math.prod(int(x) for x in factors) < 1 << 62


class _Scorer:
    """Scores one task's documents for all items of a chunk. starts, items, repeats: for each term a stretch of items."""

    def __init__(self, k: int, n_docs: int, n_terms: int, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, repeats: np.ndarray, n_items: int):
        self.k, self.n_docs, self.n_terms, self.weights = k, n_docs, n_terms, weights
        self.starts, self.items, self.repeats = starts, items, repeats
        self.best: list[list[tuple]] = [[] for _ in range(n_items)]

    def _impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if not _fits(75, n.max(initial=0), self.n_docs) or not _fits(10**9, tf.max(initial=0)):
            n, tf = n.astype(object), tf.astype(object)
        length = 25 + (75 * n * self.n_docs) // self.n_terms
        return (self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))).astype(np.int64)

    def add(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("doc_id", na_position="last", kind="stable")
        sizes = pdf.terms.map(len).to_numpy()
        if not sizes.sum():
            return
        doc = np.repeat(np.arange(len(pdf)), sizes)
        term, tf = np.concatenate(pdf.terms.to_numpy()), np.concatenate(pdf.tf.to_numpy()).astype(np.int64)
        impact = self._impacts(pdf.n.to_numpy(), doc, term, tf)
        ids = [(x is not None and x == x, x) for x in pdf.doc_id]
        rows = np.append(0, np.cumsum(sizes))
        entries = np.append(0, np.cumsum(self.starts[term + 1] - self.starts[term]))[rows]
        a = 0
        while a < len(pdf):  # whole documents, one at least
            b = max(a + 1, int(np.searchsorted(entries, entries[a] + _BLOCK, "right")) - 1)
            if rows[b] > rows[a]:
                self._block(doc[rows[a] : rows[b]], term[rows[a] : rows[b]], impact[rows[a] : rows[b]], ids)
            a = b

    def _block(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: list) -> None:
        n = self.starts[term + 1] - self.starts[term]
        end = np.cumsum(n)
        row = np.repeat(np.arange(len(term)), n)
        at = np.arange(end[-1]) - np.repeat(end - n, n) + np.repeat(self.starts[term], n)
        base = int(doc[0])
        width = int(doc[-1]) - base + 1
        keys, values = self.items[at] * width + (doc[row] - base), impact[row] * self.repeats[at]
        order = radix_order(keys, len(self.best) * width)
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        scores, keys = np.add.reduceat(values, first), keys[first]
        item, where = keys // width, keys % width + base
        edge = np.flatnonzero(np.append(True, item[1:] != item[:-1])).tolist() + [len(item)]
        for s, e in zip(edge, edge[1:]):
            self._keep(int(item[s]), scores[s:e], where[s:e], ids)

    def _keep(self, item: int, scores: np.ndarray, where: np.ndarray, ids: list) -> None:
        """Documents come in the order of their ids, so of equal scores the first k are enough."""
        heap = self.best[item]
        least = heap[0][0] if len(heap) == self.k else 1
        if len(scores) > self.k:
            least = max(least, int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k]))
        chosen = np.append(np.flatnonzero(scores > least), np.flatnonzero(scores == least)[: self.k])
        for i in chosen.tolist():
            known, doc = ids[where[i]]
            entry = (int(scores[i]), known, _Falling(doc) if known else 0)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


class _Falling:
    """Orders ids of any kind the other way."""

    __slots__ = ("doc",)

    def __init__(self, doc):
        self.doc = doc

    def __lt__(self, other: _Falling) -> bool:
        return other.doc < self.doc

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Falling) and other.doc == self.doc


def _scored(make, names: list):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in frames:
            scorer.add(pdf)
        rows = [(names[i], doc.doc if known else None, score) for i, heap in enumerate(scorer.best) for score, known, doc in heap]
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])

    return run


def _chunk(documents: DataFrame, wanted: pd.DataFrame, k: int, schema: str, doc_kind: str) -> DataFrame:
    """Each task's best documents for the items of one chunk (item_id, term, n)."""
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(map(bytes, wanted.term)))}
    names = wanted.item_id.drop_duplicates().tolist()
    place = {item: i for i, item in enumerate(names)}
    term = np.array([vocabulary[bytes(t)] for t in wanted.term], np.int64)
    order = np.argsort(term, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(vocabulary))))
    items, repeats = np.array([place[x] for x in wanted.item_id], np.int64)[order], wanted.n.to_numpy(np.int64)[order]
    postings = cut(documents.select("doc_id", "text").mapInPandas(_postings(vocabulary), f"doc_id {doc_kind}, n long, terms array<int>, tf array<int>"))
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most a chunk's terms
        held[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    n_items, n_terms = len(names), n_terms or 1
    make = lambda: _Scorer(k, n_docs, n_terms, weights, starts, items, repeats, n_items)
    out = cut(postings.where(F.size("terms") > 0).mapInPandas(_scored(make, names), schema))
    drop(postings)
    return out


def search(documents: DataFrame, items: DataFrame, *, k: int = 10, max_terms: int = 500_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text), with scores above 0."""
    spark = documents.sparkSession
    item_kind, doc_kind = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").mapInPandas(_item_terms, f"item_id {item_kind}, term binary, n long")
    wanted = cut(rows.groupBy("item_id", "term").agg(F.sum("n").alias("n")))
    chunks = -(-wanted.count() // max_terms)
    schema = f"item_id {item_kind}, doc_id {doc_kind}, score long"
    found = spark.createDataFrame([], schema)
    for c in range(chunks):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).toPandas()  # max_terms rows on average
        if len(some):
            found = found.unionByName(_chunk(documents, some, k, schema, doc_kind))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.where("score > 0").withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
