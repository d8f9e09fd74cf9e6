"""Near-duplicate documents by one-permutation hashing.

One hash of each word shingle gives the whole signature: its high bits choose one of ``BINS`` bins, each bin keeps its
smallest value, and an empty bin borrows from a bin that a hash of its own number picks (optimal densification).
``ROWS`` bins make a band, and documents that agree in a band share a bucket. A bucket gives star-shaped candidate
edges, from one centre to each member, so that their number is linear in its size. The centre is the member that meets
most others over all its buckets (in a family of variants of one text, the text itself or the least altered variant); this
order is the same in all buckets, so a large family's buckets share their centres and its edges repeat. Every edge is
confirmed on the full shingle sets, and the components of the confirmed ones are the groups so far.

Stars alone miss links between two members that are no centres, so stars (all that share a bucket with one centre, each
once) that still hold several groups are closed:
each member outside of a star's largest group (a stranger) is held against the members of other groups there, and a pair
becomes a candidate unless bounds rule it out. They need three numbers of each member: its set's size n, how far it is from
the centre (d, the size of the symmetric difference, known from its edge), and how many of its shingles no other of these
members has (u). Two sets share at most min(n - u) shingles, and as the centre is the same for both, what they differ in is
at least d + d' - 2 min(d - u, d' - u). The bounds are part of the join's condition: pairs are counted, not made, until one
survives, and survivors are confirmed in full. No bucket or candidate is left out, so the groups are those of all pairs
that share a bucket.

With 32 bands of 4 bins a pair at similarity 0.8 shares no bucket with a chance of about 5e-8. Documents whose words
are the same are folded into one before banding, so groups of exact copies cost one row each.

Defined results: a null or blank text has an empty set and is linked with nothing; with fewer words than a shingle has,
the whole sequence is the one shingle; rows that repeat a doc_id are one node; a row without doc_id is its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, wide
from .graph import components

BINS, ROWS = 128, 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[4]
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _ODD[0] + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << shift)
    full = np.append(first[1:], len(hashes)) > first
    values = np.zeros(BINS, np.uint64)
    values[full] = hashes[first[full]]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        donor = (_mix((empty.astype(np.uint64) + np.uint64(1)) * _ODD[1] + np.array([attempt], np.uint64) * _ODD[2]) % np.uint64(BINS)).astype(int)
        values[empty[full[donor]]] = values[donor[full[donor]]]
        empty = empty[~full[donor]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    v = values.reshape(-1, ROWS)
    h = np.arange(len(v), dtype=np.uint64) * _ODD[3] + np.uint64(1)
    for j in range(ROWS):
        h = _mix(h * _ODD[0] + v[:, j])
    return h.view(np.int64)


def _signed(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                words = words_of(text)
                s, d = shingles(words, size), xxhash.xxh3_128_digest(b" ".join(words))
                rows.append((doc, len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), bands(signature(s)) if len(s) else []))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _sets(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "s": [shingles(words_of(t), size).view(np.int64) for t in pdf.text]})

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n (sum of the sizes) and x (shared shingles) of each pair of sets of the pairs a, b of documents."""
    both = pairs.join(wide(sets.toDF("a", "sa")), "a").join(wide(sets.toDF("b", "sb")), "b")
    return cut(both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("x")))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("x") >= percent * (F.col("n") - F.col("x"))).select("a", "b")


def _members(folded: DataFrame) -> DataFrame:
    """key, id, low and high (smallest and largest set of the document) and centre, centre_low, centre_high of each document
    in each bucket that several share."""
    rows = folded.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "c"))
    held = cut(rows.join(wide(shared), "key"))
    meets = cut(held.groupBy("id").agg(F.sum("c").alias("d"), F.min("n").alias("low"), F.max("n").alias("high")))
    members = cut(held.select("key", "id").distinct().join(wide(meets), "id"))
    best = F.max(F.struct("d", "id", "low", "high")).alias("c")
    centre = cut(members.groupBy("key").agg(best).select("key", F.col("c.id").alias("centre"), F.col("c.low").alias("centre_low"), F.col("c.high").alias("centre_high")))
    out = cut(members.join(wide(centre), "key").drop("d"))
    drop(shared, held, meets, members, centre)
    return out


def _fit(low: str, high: str, other_low: str, other_high: str, percent: int) -> Column:
    """Sizes alone don't rule out the pair."""
    return (100 * F.col(high) >= percent * F.col(other_low)) & (100 * F.col(other_high) >= percent * F.col(low))


def _own(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """id and own (shingles that no other node has; null for a document with several sets) of each node."""
    held = cut(sets.join(wide(nodes), sets["doc_id"] == nodes["id"], "left_semi"))
    one = held.select(F.explode("s").alias("x"), "doc_id").groupBy("x").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low = high")
    own = one.groupBy(F.col("low").alias("id")).agg(F.count(F.lit(1)).alias("own"))
    several = held.groupBy(F.col("doc_id").alias("id")).agg((F.min(F.xxhash64("s")) < F.max(F.xxhash64("s"))).alias("several"))
    return cut(several.join(wide(cut(own)), "id", "left").select("id", F.when(~F.col("several"), F.coalesce("own", F.lit(0))).alias("own")))


def _rest(members: DataFrame, groups: DataFrame, tested: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of different groups that share a centre (so all that share a bucket), were not tested, and pass the bounds."""
    star = members.select("centre", "id", "low", "high").distinct()
    rows = cut(star.join(wide(groups.toDF("id", "root")), "id", "left").withColumn("root", F.coalesce("root", "id")))
    per = rows.groupBy("centre", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = cut(per.groupBy("centre").agg(F.max(F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("c")).where("k > 1 and c > 2").select("centre", F.col("main.root").alias("main")))
    rows = cut(rows.join(wide(mixed), "centre").where("id <> centre"))  # a centre's pairs are tested
    own = _own(cut(rows.select("id").distinct()), sets)
    far = tested.select(F.col("a").alias("centre"), F.col("b").alias("id"), (F.col("n") - 2 * F.col("x")).alias("d"))
    nodes = rows.join(wide(own), "id").where(f"own is null or 100 * own <= {100 - percent} * high")
    nodes = cut(nodes.join(wide(cut(far)), ["centre", "id"], "left").select("centre", "id", "root", "main", "low", "high", "own", F.when(F.col("own").isNotNull(), F.col("d")).alias("d")).distinct())
    x = nodes.where("root <> main").select("centre", *[F.col(c).alias(f"x_{c}") for c in ("id", "root", "low", "high", "own", "d")])
    y = nodes.select("centre", "main", *[F.col(c).alias(f"y_{c}") for c in ("id", "root", "low", "high", "own", "d")])
    n = F.col("x_low") + F.col("y_low")  # bounds are for documents with one set
    share = (100 + percent) * F.least(F.col("x_low") - F.col("x_own"), F.col("y_low") - F.col("y_own")) >= percent * n
    apart = F.col("x_d") + F.col("y_d") - 2 * F.least(F.col("x_d") - F.col("x_own"), F.col("y_d") - F.col("y_own"))
    near = (100 + percent) * apart <= (100 - percent) * n
    once = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_id") < F.col("y_id")))
    fits = _fit("x_low", "x_high", "y_low", "y_high", percent) & F.coalesce(share, F.lit(True)) & F.coalesce(near, F.lit(True))
    pairs = x.join(wide(y), "centre").where(once & fits).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = cut(cut(pairs.distinct()).join(wide(cut(known)), ["a", "b"], "left_anti"))
    drop(rows, mixed, own, nodes)
    return out


def _groups(members: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """node and root of the components of all confirmed candidates."""
    ends = cut(members.select(F.col("id").alias("doc_id")).distinct())
    sets = cut(documents.join(wide(ends), "doc_id").mapInPandas(_sets(size), "doc_id long, s array<long>"))
    fits = _fit("low", "high", "centre_low", "centre_high", percent)
    stars = cut(members.where((F.col("id") != F.col("centre")) & fits).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    tested = _compared(stars, sets)
    links = _linked(tested, percent)
    groups = cut(components(links))
    pairs = _rest(members, groups, tested, sets, percent)
    if not pairs.isEmpty():
        groups = cut(components(cut(links.union(_linked(_compared(pairs, sets), percent)))))
    drop(ends, sets, stars, tested, pairs, members)
    return groups


def near_duplicates(documents: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of percent/100 similarity or more) and
    kept (the row is its component's smallest) for each row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null and text is not null")
    signed = cut(docs.mapInPandas(_signed(words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    part = signed.where("n_shingles > 0 and doc_id is not null")
    copies = cut(part.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    folded = part.join(wide(copies), ["k1", "k2"], "left").where("rep is null or rep = doc_id")
    groups = _groups(_members(folded), known, words, percent)
    rep = F.coalesce("rep", "doc_id")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(wide(copies), ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), rep).otherwise(F.col("doc_id")).alias("rep"))
    out = out.join(wide(groups.withColumnRenamed("node", "rep")), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
