"""Near-duplicate documents by SimHash: fingerprints of 64 bits that differ in at most a few.

A fingerprint is mapped to the numbers of ones in each of its 32 segments of two bits. The Manhattan distance of two such
vectors is never more than the number of bits that the fingerprints differ in, so links are found among the points within
``max_bits`` of each other, and confirmed on the bits. Counts are kept in unary (0, 1, 2 as 00, 01, 11): then the Manhattan
distance is the number of ones of an exclusive or.

The range join works on a grid. The segments are dealt into max_bits + 3 groups; points within max_bits have the same
counts in all segments of three groups or more. So each choice of three groups is a grid whose cells are the counts
there, a point lies in one cell of each grid, and every pair within range shares a cell. Cells are streamed in the order
of a sort: a small one is compared pair by pair, of a larger one only a spanning set of links is made (each point reached
leaves the comparison), so its rows are linear in its size. A cell of more than ``most`` points is cut into blocks, and
each pair of blocks is a task of its own. No cell, point or pair is left out.

Rows of one fingerprint are folded before the grid. Defined results: a null or blank text has fingerprint zero, which is linked like
any other; with fewer words than a shingle has, the whole sequence is the one shingle; a bit set in exactly half of the
shingles is 0; rows that repeat a doc_id are one node; a row without doc_id has a fingerprint, no component, and links nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, wide
from .graph import components
from .neardup import words_of

SEED = 42
SEGMENTS = 32  # of two bits
AGREE = 3  # groups that make a cell
SMALL = 64  # points of a cell that are compared pair by pair
_LOW = 0x5555555555555555
_STEP = 1 << 16


def fingerprint(words: list[bytes], size: int) -> int:
    """The SimHash of the word shingles, repeats included, as a signed number."""
    if not words:
        return 0
    text, k = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for a in range(0, n, _STEP):
        h = np.array([digest(text[s:e], SEED) for s, e in zip(starts[a : a + _STEP], stops[a : a + _STEP], strict=True)], np.uint64)
        for b in range(0, len(h), 255):  # that many fit into a byte
            ones += np.unpackbits(h[b : b + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _printed(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": [fingerprint(words_of(t), size) for t in pdf.text]})

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def unary_counts(fp: Column) -> Column:
    """The ones of each segment of two bits, in unary: some are set in its low bit, both in its high bit too."""
    low, shifted = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    x, low = fp.astype(np.int64).view(np.uint64), np.uint64(_LOW)
    y = x >> np.uint64(1)
    return ((x | y) & low) | ((x & y & low) << np.uint64(1))


def grids(max_bits: int) -> list[int]:
    """For each choice of AGREE groups of segments, the bits of its cells."""
    n = max_bits + AGREE
    ends = [2 * (g * SEGMENTS // n) for g in range(n + 1)]
    group = [((1 << ends[g + 1]) - 1) ^ ((1 << ends[g]) - 1) for g in range(n)]
    return [_signed(sum(group[g] for g in chosen)) for chosen in combinations(range(n), AGREE)]


def _close(u: np.ndarray, fp: np.ndarray, other_u, other_fp, max_bits: int) -> np.ndarray:
    """Where the Manhattan distance of the counts allows a link, and the bits confirm it."""
    near = np.bitwise_count(u ^ other_u) <= max_bits
    near[near] = np.bitwise_count((fp ^ other_fp)[near]) <= max_bits
    return near


def spanning_links(fp: np.ndarray, ids: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that the links among these points join, one less than points at most."""
    bits, u, left, a, b = fp.astype(np.int64).view(np.uint64), _unary(fp), np.arange(len(fp)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = _close(u[left], bits[left], u[p], bits[p], max_bits)
            found = left[near]
            if len(found):
                a.append(np.repeat(ids[p : p + 1], len(found)))
                b.append(ids[found])
                front.extend(found.tolist())
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def _links(a, b, rows: pd.DataFrame | None = None) -> pd.DataFrame:
    none = pd.Series([None] * len(a))
    return pd.DataFrame({"a": a, "b": b, "grid": none, "cell": none, "fp": none})


def _cells(max_bits: int, most: int):
    """Rows in the order of their cells: links, or the rows themselves (as a, without b) where a cell has more than ``most``."""

    def linked(x: pd.DataFrame, run: np.ndarray) -> Iterator[pd.DataFrame]:
        """x: whole cells; run: the number of the cell of each row."""
        sizes = np.bincount(run)
        fp, ids, size = x.fp.to_numpy(), x.id.to_numpy(), sizes[run]
        at = np.flatnonzero((size > 1) & (size <= SMALL))
        bits, u, r = fp[at].view(np.uint64), _unary(fp[at]), run[at]
        for step in range(1, int(size[at].max(initial=1))):
            i = np.flatnonzero(r[:-step] == r[step:])
            near = i[_close(u[i], bits[i], u[i + step], bits[i + step], max_bits)]
            if len(near):
                yield _links(ids[at[near]], ids[at[near + step]])
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(sizes > SMALL):
            rows = slice(ends[k] - sizes[k], ends[k])
            if sizes[k] > most:
                yield x[rows].rename(columns={"id": "a"}).assign(b=None)
            else:
                yield _links(*spanning_links(fp[rows], ids[rows], max_bits))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, passed = None, None
        for pdf in frames:
            x = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            grid, cell = x.grid.to_numpy(), x.cell.to_numpy()
            new = np.append(True, (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]))
            number, first = np.cumsum(new) - 1, int(np.flatnonzero(new)[-1])
            if passed == (grid[0], cell[0]):  # more of a cell that goes on as rows
                n = first if number[-1] == 0 else int(np.flatnonzero(new)[1])
                n = len(x) if number[-1] == 0 else n
                yield x[:n].rename(columns={"id": "a"}).assign(b=None)
                x, number, first = x[n:].reset_index(drop=True), number[n:] - 1, first - n
                held = None
                if not len(x):
                    continue
            passed = None
            yield from linked(x[:first], number[:first]) if first else ()
            held = x[first:].reset_index(drop=True)
            if len(held) > most:
                yield held.rename(columns={"id": "a"}).assign(b=None)
                passed, held = (held.grid[0], held.cell[0]), None
        if held is not None:
            yield from linked(held, np.zeros(len(held), np.int64))

    return run


def _blocks(rows: DataFrame, kind: str, max_bits: int, most: int) -> DataFrame:
    """Links of the cells that hold more than ``most`` points: dealt by a hash of the fingerprint into blocks of about half as
    many, each pair of blocks compared by itself."""
    key = ["grid", "cell"]
    n = cut(rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) * 2 / most).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    x = rows.join(wide(n), key).withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("x <> y")
    pair = x.select(*key, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "fp", "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(pdf.fp.to_numpy(), pdf.id.to_numpy(), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    return pair.groupBy(*key, "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def links(points: DataFrame, *, max_bits: int = 4, most: int = 16_384) -> DataFrame:
    """points: fp, each once, and id. a, b: links that join what all pairs within max_bits join."""
    kind = points.schema["id"].dataType.simpleString()
    u = unary_counts(F.col("fp"))
    cells = points.select(F.posexplode(F.array(*[u.bitwiseAND(F.lit(m)) for m in grids(max_bits)])).alias("grid", "cell"), "fp", "id")
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell")
    found = cut(dealt.mapInPandas(_cells(max_bits, most), f"a {kind}, b {kind}, grid int, cell long, fp long"))
    large = found.where("b is null").select("grid", "cell", "fp", F.col("a").alias("id"))
    out = found.where("b is not null").select("a", "b")
    return out if large.isEmpty() else out.unionByName(cut(_blocks(large, kind, max_bits, most)))


def fingerprints(documents: DataFrame, *, words: int = 4) -> DataFrame:
    """doc_id and fp of each row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(_printed(words), f"doc_id {kind}, fp long")


def near_duplicates(documents: DataFrame, *, words: int = 4, max_bits: int = 4, most: int = 16_384) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable over links of at most max_bits
    differing bits) of each row of documents."""
    printed = cut(fingerprints(documents, words=words))
    known = printed.where("doc_id is not null")
    points = cut(known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")))
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id")
    same = known.join(wide(cut(several)), "doc_id", "left_semi").join(wide(points.select("fp", "id")), "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    groups = cut(components(links(points.select("fp", "id"), max_bits=max_bits, most=most).unionByName(same)))
    copies = cut(points.where("id < last").select("fp", F.col("id").alias("rep")))
    out = printed.join(wide(copies), "fp", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(wide(groups.withColumnRenamed("node", "rep")), "rep", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("root", "rep").alias("component_id"))
