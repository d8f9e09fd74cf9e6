"""Duplicate lines within a few edits, by a segment-partition edit join in DataFrame functions only.

Lines within ``max_edits`` = t edits of each other share at least one of the t+1 even segments of the shorter one, at
nearly the same place. Every line of length l gives a key for each of its segments (the index), and keys for those of its
substrings that may meet a segment of a line of l-t to l characters (the probes; only the places that the multi-match
bounds allow). Equal keys make candidates, which a banded bit-parallel edit distance verifies. Exact copies
have one hash and are one line from the start.

Keys that more than ``_GROUP`` lines share (a common beginning with many endings) aren't paired. What is left of such
lines without the shared segment must still be within t edits, so it is split and keyed again, group by group, until the
groups are small. Rests of t characters or fewer are too short for segments. Those that were cut at the same places all
along differ in no more than these characters: they form a clique, each within t edits of each other, which is kept as
its members and never as pairs. Rests cut at other places, and longer ones up to 2t characters that share a character,
are paired with them and verified. (For t = 1 only one rest of a group can be cut elsewhere, so that these pairs are a
star; for larger t they are as many as the different short rests around one shared text.)

A line is known by 128 bits of hash. Lines are compared without blanks at both ends. Lines under ``min_chars`` characters,
or of no more than ``max_edits`` (edits make any of them out of any other), are in one class with their exact copies only.
Classes are the connected components of the links, and a class's first occurrence (by doc_id, then line number) is kept.
Links are counted from cliques by signature: lines in the same cliques are counted together, and a verified pair counts only
if no clique holds both.

Defined results: null texts have no lines; empty texts have one blank line, and blank lines take no part; occurrences in
rows that repeat a doc_id are told apart by nothing, and so share their decision; rows without doc_id are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, wide
from .graph import components

_GROUP = 64


def lines_of(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line (from 0), text (trimmed), n (characters), id (two hashes) of each line that takes part."""
    each = documents.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    each = each.select("doc_id", "line", F.trim("raw", F.lit(" \t\r\f\x0b")).alias("text")).withColumn("n", F.length("text")).where(F.col("n") >= min_chars)
    return each.withColumn("id", F.struct(F.xxhash64("text", "n").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")))


def _once(lines: DataFrame) -> DataFrame:
    """id and text of each different line: copies fold here, so that no later step meets a common line twice."""
    return cut(lines.select("id", "text").groupBy("id").agg(F.first("text").alias("text")))


def _places(n: Column, t: int) -> Column:
    """Array of (length, i, own, start, size): where a text of n characters has its segments (own) and its probes for the i-th
    segment of a line of that length. Places beyond the text's ends are among them."""
    out = []
    for shorter in range(t + 1):
        length = n - shorter  # of the indexed line
        base, extra = F.floor(length / (t + 1)).cast("int"), (length % (t + 1)).cast("int")
        for i in range(1, t + 2):
            late = F.greatest(F.lit(0), extra - (t + 2 - i))  # longer segments before it
            size = base + F.when(F.lit(i) > (t + 1 - extra), 1).otherwise(0)
            start = base * (i - 1) + 1 + late
            for off in range(-(i - 1), i):
                if shorter - (t + 1 - i) <= off <= shorter + (t + 1 - i):
                    out.append(F.struct(length.alias("length"), F.lit(i).alias("i"), F.lit(shorter == 0 and off == 0).alias("own"), (start + off).alias("start"), size.alias("size")))
    return F.array(*out)


def _keyed(level: DataFrame, t: int) -> DataFrame:
    """node, shape, id, key, own, start, size: the index and probe keys of each text (node, shape, id, text, n)."""
    places = level.select("node", "shape", "id", "text", "n", F.explode(_places(F.col("n"), t)).alias("p")).where("p.length >= 1 and p.start >= 1 and p.start + p.size - 1 <= n")
    key = F.xxhash64("node", "p.length", "p.i", F.substring("text", F.col("p.start"), F.col("p.size")))
    return places.select("node", "shape", "id", key.alias("key"), "p.own", "p.start", "p.size")


def edit_within(a: str, b: str, t: int) -> Column:
    """True if the edit distance of two text columns is t at most: Hyyrö's bit-parallel recurrence on a band of 2t+1
    diagonals, one step for each character of b. A lambda over one element binds a value that is used more than once."""
    band = (1 << (2 * t + 1)) - 1
    meets = " | ".join(f"if(get(z.x, i - {t} + {k}) = c, {1 << k}L, 0L)" for k in range(2 * t + 1))
    hp, hn, down = "(q.vn | ~(d0 | q.vp))", "(d0 & q.vp)", "shiftright(d0, 1)"
    at = lambda x: f"(shiftrightunsigned({x}, cast(greatest(size(z.x) - q.j + {t}, 0) as int)) & 1L)"
    return F.expr(f"""abs(length({a}) - length({b})) <= {t} and element_at(transform(
        array(named_struct('x', split({a}, ''), 'y', split({b}, ''))),
        z -> aggregate(
            transform(z.y, (c, i) -> {meets}),
            named_struct('j', 1, 'd', cast({t} as bigint), 'vp', {band & ~((1 << t) - 1)}L, 'vn', 0L),
            (s, pm) -> aggregate(
                array(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {band}L),
                s,
                (q, d0) -> named_struct(
                    'j', q.j + 1,
                    'd', if(size(z.x) - q.j >= {t}, q.d + 1L - (shiftrightunsigned(d0, {2 * t}) & 1L), q.d + {at(hp)} - {at(hn)}),
                    'vp', ({hn} | ~({down} | {hp})) & {band}L,
                    'vn', {down} & {hp} & {band}L)),
            s -> s.d <= {t})), 1)""")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _short_pairs(rest: DataFrame, t: int) -> DataFrame:
    """Candidates of a group's rests too short for segments with those that are in no clique with them."""
    short = rest.where(F.col("n") <= t).select("node", "id", "clique", "text")
    one = short.select("node", F.col("id").alias("x"), F.col("clique").alias("xc"))
    two = short.select("node", F.col("id").alias("y"), F.col("clique").alias("yc"))
    across = one.join(wide(two), "node").where("xc < yc and x <> y").select(*_pair("x", "y"))
    chars = F.explode(F.array_distinct(F.split("text", "")))
    longer = rest.where((F.col("n") > t) & (F.col("n") <= 2 * t)).select("node", F.col("id").alias("y"), chars.alias("c"))
    return across.union(short.select("node", F.col("id").alias("x"), chars.alias("c")).join(wide(longer), ["node", "c"]).where("x <> y").select(*_pair("x", "y")))


def _candidates(lines: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of lines that share a key, and cliques (clique, id). lines: id, text."""
    level = lines.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("shape"), "id", "text", F.length("text").alias("n"))
    # Each level's pairs are a table of their own, so that no plan grows with the number of levels.
    pairs, cliques = [], level.select(F.col("node").alias("clique"), "id").limit(0)
    while True:
        rows = _keyed(level.where(F.col("n") > t), t)
        shared = cut(rows.groupBy("key").agg(F.min("id.h").alias("low"), F.max("id.h").alias("high"), F.max("own").alias("own")).where("own and low <> high").select("key"))
        if shared.isEmpty():
            break
        members = cut(rows.join(wide(shared), "key"))
        size = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")))
        few = members.join(wide(size.where(F.col("c") <= _GROUP)), "key")
        own = few.where("own").select("key", F.col("id").alias("x"))
        pairs.append(cut(own.join(wide(few.select("key", F.col("id").alias("y"))), "key").where("x <> y").select(*_pair("x", "y")).distinct()))
        many = cut(members.join(wide(size.where(F.col("c") > _GROUP).select("key")), "key"))
        drop(shared, members, size)
        if many.isEmpty():
            break
        left = level.select("node", "shape", "id", "text").join(wide(many), ["node", "shape", "id"])
        text = F.concat(F.expr("substring(text, 1, start - 1)"), F.expr("substring(text, start + size)"))
        rest = left.select(F.col("key").alias("node"), F.xxhash64("shape", "start").alias("shape"), "id", text.alias("text")).withColumn("n", F.length("text"))
        level = cut(rest.withColumn("clique", F.xxhash64("node", "shape", "n")).distinct())
        drop(many)
        cliques = cliques.union(level.where(F.col("n") <= t).select("clique", "id"))
        pairs.append(cut(_short_pairs(level, t).distinct()))
    none = lines.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    every = cut(reduce(DataFrame.union, pairs, none).distinct())
    drop(*pairs)
    return every, cliques.distinct()


def links(documents: DataFrame, *, max_edits: int = 1, min_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """Links of different lines within max_edits edits: verified pairs a < b of ids, and cliques (clique, id) whose members
    are all linked with each other. A pair may also be in a clique, and a clique in another."""
    lines = _once(lines_of(documents, max(min_chars, max_edits + 1)))
    pairs, cliques = _candidates(lines, max_edits)
    cliques = cut(cliques)
    real = cliques.groupBy("clique").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("clique")
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = cut(lines.join(wide(ends), "id", "left_semi"))
    both = pairs.join(wide(texts.toDF("a", "x")), "a").join(wide(texts.toDF("b", "y")), "b")
    return cut(both.where(edit_within("x", "y", max_edits)).select("a", "b")), cut(cliques.join(wide(cut(real)), "clique"))


def _degrees(pairs: DataFrame, cliques: DataFrame) -> DataFrame:
    """node and n_links of each line with a link. A line's signature is the cliques that it is in (no more than it has
    keys); the lines of its own and of every signature that shares a clique with it are its links."""
    ends = F.explode(F.array("a", "b")).alias("node")
    if cliques.isEmpty():
        return pairs.select(ends).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of = cut(cliques.groupBy(F.col("id").alias("node")).agg(F.sort_array(F.collect_set("clique")).alias("s")))
    each = cut(of.groupBy("s").agg(F.count(F.lit(1)).alias("m")))
    held = each.select("s", "m", F.explode("s").alias("clique"))
    meets = held.select("clique", F.col("s").alias("x")).join(wide(held.select("clique", "s", "m")), "clique").select("x", "s", "m").distinct()
    inside = of.join(wide(meets.groupBy(F.col("x").alias("s")).agg((F.sum("m") - 1).alias("n_links"))), "s").select("node", "n_links")
    held = pairs.join(wide(of.toDF("a", "sa")), "a", "left").join(wide(of.toDF("b", "sb")), "b", "left")
    outside = held.where(~F.coalesce(F.arrays_overlap("sa", "sb"), F.lit(False))).select(ends).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return inside.union(outside).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def line_classes(documents: DataFrame, *, max_edits: int = 1, min_chars: int = 20, shortest: int = 1) -> DataFrame:
    """doc_id, line, class_doc_id and class_line (the class's first occurrence), n_links (different lines within max_edits
    of this one) and kept, for each line of ``shortest`` characters or more: each that isn't blank, by default."""
    pairs, cliques = links(documents, max_edits=max_edits, min_chars=min_chars)
    where = cut(lines_of(documents, max(shortest, 1)).select("doc_id", "line", "id"))
    centre = cut(cliques.groupBy("clique").agg(F.min("id").alias("a")))
    stars = cliques.join(wide(centre), "clique").select("a", F.col("id").alias("b"))
    root = components(pairs.union(stars))
    degree = _degrees(pairs, cliques)
    known = cut(root.join(wide(degree), "node", "full"))  # lines with a link: the root has none of its own in root
    where = where.join(wide(known), where["id"] == known["node"], "left").select("doc_id", "line", F.coalesce("root", "id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    where = cut(where)
    lead = where.groupBy("class").agg(F.min("doc_id").alias("class_doc_id"))
    lead = cut(where.join(wide(cut(lead)), "class").where(F.col("doc_id") == F.col("class_doc_id")).groupBy("class", "class_doc_id").agg(F.min("line").alias("class_line")))
    first = (F.col("doc_id") == F.col("class_doc_id")) & (F.col("line") == F.col("class_line"))
    return where.join(wide(lead), "class").select("doc_id", "line", "class_doc_id", "class_line", "n_links", first.alias("kept"))


def dedup_lines(documents: DataFrame, *, max_edits: int = 1, min_chars: int = 20) -> DataFrame:
    """The documents without the lines that line_classes doesn't keep; a document that loses its last line goes. Shorter
    lines than min_chars (brackets, single words) stay, repeated or not: they are part of what is around them."""
    gone = line_classes(documents, max_edits=max_edits, min_chars=min_chars, shortest=min_chars).where("not kept")
    gone = cut(gone.groupBy("doc_id").agg(F.collect_set("line").alias("_gone")))
    left = documents.join(wide(gone), "doc_id", "left").withColumn("_lines", F.split("text", "\n"))
    kept = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> get(_lines, i))")
    left = left.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept)).where("_gone is null or exists(_kept, x -> trim(x) <> '')")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    size = {"n_chars": F.length("text").cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {}
    return left.withColumn("text", text).withColumns(size).select(*documents.columns)
