"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item become candidates if they share a seed, ``min_match`` tokens in a row. Candidates are
tiled: the longest common token runs that overlap nothing marked so far are found by running Karp-Rabin hashes and
marked, then shorter ones, down to ``min_match``. The order of the runs doesn't matter, so reordered passages count.
A document is contaminated if its tiles cover ``coverage`` or more of an item's tokens.

The benchmark's token ids and seed hashes are sent to the tasks while they are fewer than ``max_broadcast_seeds``
(checked by a count); the documents are then read once, without a shuffle. A larger benchmark is joined instead: seeds
of the documents with the rarer seeds of the items (all but as many as a covered item must share with the document
besides), and the texts to the pairs found. Both ways give the same rows.

Defined results: tokens are runs of letters, digits and underscores in lower case; null and empty texts match nothing;
an item with fewer than ``min_match`` tokens is matched as one run of its own length, and one without tokens by nothing;
repeated documents are judged each; an item_id with several texts has one row at most, for the text that is covered best
(by share, then by tokens).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, wide

_WORD = re.compile(r"\w+").findall
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
OUT = "doc_id long, item_id long, covered int, item_tokens int, coverage double, tiles int"


def tokens(text: str | None) -> list[str]:
    return _WORD((text or "").lower())


def _rolling(tokens_: list, size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin: (start, hash) of each window, each from the one before it."""
    h, top = 0, pow(_BASE, size - 1, _PRIME)
    for i, t in enumerate(tokens_):
        if i >= size:
            h = (h - hash(tokens_[i - size]) % _PRIME * top) % _PRIME
        h = (h * _BASE + hash(t)) % _PRIME
        if i >= size - 1:
            yield i - size + 1, h


def tile(doc: list, item: list, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of non-overlapping common runs, longest first."""
    marked_doc, marked_item, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        longest, found = min_match, []
        at = defaultdict(list)
        for i, h in _rolling(item, min_match):
            if not any(marked_item[i : i + min_match]):
                at[h].append(i)
        last: dict[int, int] = {}  # a run that starts inside one just found on its diagonal is part of it
        for j, h in _rolling(doc, min_match):
            for i in at.get(h, ()):
                if last.get(j - i, -1) > j or any(marked_doc[j : j + min_match]):
                    continue
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not marked_item[i + n] and not marked_doc[j + n]:
                    n += 1
                last[j - i] = j + n
                if n > longest:
                    longest, found = n, [(i, j, n)]
                elif n == longest:
                    found.append((i, j, n))
        if not found:
            return tiles
        for i, j, n in found:
            if not any(marked_item[i : i + n]) and not any(marked_doc[j : j + n]):
                marked_item[i : i + n] = marked_doc[j : j + n] = [True] * n
                tiles.append((i, j, n))


def _judged(doc: list, item: list, min_match: int, coverage: float) -> tuple | None:
    """covered, item_tokens, coverage and tiles, if that is enough."""
    found = tile(doc, item, min(min_match, len(item)))
    covered = sum(n for _, _, n in found)
    return (covered, len(item), covered / len(item), len(found)) if covered >= coverage * len(item) else None


def _best(doc: list, texts: list[list], min_match: int, coverage: float) -> tuple | None:
    return max((r for x in texts if (r := _judged(doc, x, min_match, coverage))), key=lambda r: (r[2], r[0], -r[3]), default=None)


class Seeds:
    """Which items share a seed with a document: one dictionary look-up for each token, the rest in numpy."""

    def __init__(self, items: dict[int, list[list[str]]], min_match: int):
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for texts in items.values() for t in texts for w in t}))}
        self.by: dict[int, dict[tuple, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.coded = {i: [[self.ids[w] for w in t] for t in texts] for i, texts in items.items()}
        for i, texts in self.coded.items():
            for t in texts:
                k = min(min_match, len(t))
                for a in range(len(t) - k + 1):
                    self.by[k][tuple(t[a : a + k])].add(i)
        self.firsts = {k: np.isin(np.arange(len(self.ids) + 1), [s[0] for s in seeds]) for k, seeds in self.by.items()}

    def __call__(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The document as token ids (0: no item has it; runs of those count as one token), and its candidate items."""
        x = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        found: set[int] = set()
        for k, seeds in self.by.items():
            run = np.convolve(x > 0, np.ones(k, np.int8), "valid") == k if len(x) >= k else np.zeros(0, bool)
            for a in np.flatnonzero(run & self.firsts[k][x[: len(run)]]).tolist():
                found |= seeds.get(tuple(x[a : a + k].tolist()), set())
        if not found:
            return [], []
        keep = (x > 0) | (np.append(0, x[:-1]) > 0)
        return np.where(x[keep] > 0, x[keep], -1).tolist(), sorted(found)


def _scan(items: dict[int, list[list[str]]], min_match: int, coverage: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Seeds(items, min_match)
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                doc, found = seeds(tokens(text))
                rows += [(doc_id, i, *r) for i in found if (r := _best(doc, seeds.coded[i], min_match, coverage))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def _hashes(words: list[str], k: int) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest("\0".join(words[a : a + k])) - (1 << 63) for a in range(len(words) - k + 1 if k else 0)]


def _item_seeds(min_match: int, coverage: float) -> Callable:
    """Seeds of the items with the places each has in its text, and how many places a text can spare: tiles of at least k
    tokens that cover the share c of n tokens have c * n / k places or more, so that a text which shares none of the other
    places isn't covered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for item, part, text in zip(pdf.item_id, pdf.part, pdf.item, strict=True):
                w = tokens(text)
                k = min(min_match, len(w))
                spare = max(0, math.ceil(coverage * len(w) / k - 1e-9) - 1) if k else 0
                rows += [(item, part, h, k, times, spare) for h, times in Counter(_hashes(w, k)).items()]
            yield pd.DataFrame(rows, columns=["item_id", "part", "seed", "k", "times", "spare"])

    return run


def _doc_seeds(sizes: list[int]) -> Callable:
    """(doc_id, seed, k) of each distinct seed, of all sizes that items have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, text in zip(pdf.doc_id, pdf.text, strict=True):
                w = tokens(text)
                rows += [(key, h, k) for k in sizes for h in set(_hashes(w, k))]
            yield pd.DataFrame(rows, columns=["doc_id", "seed", "k"])

    return run


def _pairs(min_match: int, coverage: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pairs = zip(pdf.doc_id, pdf.same, pdf.text, pdf.item_id, pdf.part, pdf.item, strict=True)
            rows = [(d, h, i, p, *r) for d, h, t, i, p, x in pairs if (w := tokens(x)) and (r := _judged(tokens(t), w, min_match, coverage))]
            yield pd.DataFrame(rows, columns=["doc_id", "same", "item_id", "part", "covered", "item_tokens", "coverage", "tiles"])

    return run


def _without(items: dict[int, list[list[str]]], min_match: int, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items, min_match)
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                doc, found = seeds(tokens(text))
                keep.append(not any(_best(doc, seeds.coded[i], min_match, coverage) for i in found))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _held(items: DataFrame, max_broadcast_seeds: int) -> dict[int, list[list[str]]] | None:
    """The items' tokens, if they are few enough to be sent to the tasks."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # characters: no fewer than tokens or seeds
    if size > max_broadcast_seeds:
        return None
    held: dict[int, list[list[str]]] = defaultdict(list)
    for r in items.orderBy("item_id", "text").collect():
        if t := tokens(r.text):
            held[r.item_id].append(t)
    return dict(held)


def _items(benchmark: DataFrame) -> DataFrame:
    """Each different text of each item."""
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.5, max_broadcast_seeds: int = 500_000) -> DataFrame:
    """One row for each document and item of which it covers ``coverage`` or more: doc_id, item_id, covered tokens,
    item_tokens, coverage and the number of tiles."""
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark)
    held = _held(items, max_broadcast_seeds)
    if held is not None:
        return docs.mapInPandas(_scan(held, min_match, coverage), OUT)
    return _joined(docs, items, min_match, coverage)


def _joined(docs: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """The rows of contaminated() for a benchmark of any size; doc_id may be of any type. Of each text of an item the most
    frequent seeds, as many as it can spare, aren't joined: a phrase of many items meets few documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = items.select("item_id", F.xxhash64("text").alias("part"), F.col("text").alias("item"))
    seeds = cut(parts.mapInPandas(_item_seeds(min_match, coverage), "item_id long, part long, seed long, k int, times long, spare long"))
    often = seeds.groupBy("seed", "k").agg(F.sum("times").alias("often"))
    rarest_last = Window.partitionBy("item_id", "part").orderBy(F.desc("often"), "seed", "k").rowsBetween(Window.unboundedPreceding, 0)
    wanted = cut(seeds.join(wide(often), ["seed", "k"]).withColumn("upto", F.sum("times").over(rarest_last)).where("upto > spare").select("item_id", "part", "seed", "k"))
    sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # min_match numbers at most
    of_docs = docs.mapInPandas(_doc_seeds(sizes), f"doc_id {id_type}, seed long, k int")
    pairs = of_docs.join(wide(wanted), ["seed", "k"]).select("doc_id", "item_id", "part").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("same"), "text").join(wide(pairs), "doc_id").join(wide(parts), ["item_id", "part"])
    judged = texts.mapInPandas(_pairs(min_match, coverage), f"doc_id {id_type}, same long, item_id long, part long, covered int, item_tokens int, coverage double, tiles int")
    # The best text of each item, once for each equal row of a document.
    result = F.struct("coverage", "covered", (-F.col("tiles")).alias("tiles"), "item_tokens")
    each = judged.groupBy("doc_id", "same", "item_id", "part").agg(F.max(result).alias("x"), F.count(F.lit(1)).alias("rows"))
    best = each.groupBy("doc_id", "same", "item_id").agg(F.max("x").alias("x"), F.max("rows").alias("rows"))
    best = best.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return best.select("doc_id", "item_id", "x.covered", "x.item_tokens", "x.coverage", (-F.col("x.tiles")).alias("tiles"))


def clean(documents: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.5, max_broadcast_seeds: int = 500_000) -> DataFrame:
    """The documents, with all their columns, that aren't contaminated. With a benchmark that is sent to the tasks each row
    is judged by its own text in one map; else by a key of doc_id and text, so that both ways keep the same rows."""
    held = _held(_items(benchmark), max_broadcast_seeds)
    if held is not None:
        return documents.mapInArrow(_without(held, min_match, coverage), documents.schema)
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))), 256)
    keyed = documents.withColumn("_row", key)
    leaks = _joined(keyed.where("text is not null").select(F.col("_row").alias("doc_id"), "text"), _items(benchmark), min_match, coverage).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(wide(cut(leaks)), "_row", "left_anti").select(*documents.columns)
