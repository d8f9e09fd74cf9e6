"""Duplicates, fingerprints and manifests of file sets (AGG20, AGG21, JN10, JN11, WIN2, WIN3, WIN8, SNK5-SNK7, STR9-STR13).

A file set is a DataFrame of path, bytes (length), content or hash, mtime, as sources.files gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import case_style
from .ranks import positions

_ENTRIES = "path string, bytes long, hash string, mtime timestamp, leaf int, branch int"
FAN, LEVELS = 32, 3  # of a tree of digests: 32,768 leaves


def duplicates(files: DataFrame, *, keep: str = "first") -> DataFrame:
    """AGG20, WIN3: path, bytes, hash, n (copies), rank (1 is kept: first, oldest, newest or shortest path).

    Sizes that occur once are dropped first, by an aggregate that doesn't touch the content; only the rest is hashed."""
    same_size = files.groupBy("bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bytes")
    hashed = files.join(same_size, "bytes", "left_semi").withColumn("hash", F.sha2("content", 256)).drop("content")
    groups = hashed.groupBy("bytes", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = {"first": ["path"], "oldest": ["mtime", "path"], "newest": [F.desc("mtime"), "path"], "shortest": [F.length("path"), "path"]}[keep]
    ranked = positions(hashed.join(groups.hint("merge"), ["bytes", "hash"]), ["bytes", "hash"], order, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def reclaimable(dups: DataFrame) -> DataFrame:
    """SRT5: groups by what deleting their copies would free."""
    return dups.groupBy("hash").agg(F.max("n").alias("n"), (F.max("bytes") * (F.max("n") - 1)).alias("reclaimable")).orderBy(F.desc("reclaimable"), "hash")


def manifest(files: DataFrame) -> DataFrame:
    """SNK5: path, bytes, hash, mtime of every file."""
    return files.select("path", "bytes", F.sha2("content", 256).alias("hash"), "mtime")


def root_hash(entries: DataFrame, *, buckets: int = 1_024, max_flat: int = 1_000_000) -> DataFrame:
    """AGG21: n_files, bytes, root. With several buckets the root is the sha256 of the buckets' digests in order, and a bucket's
    digest that of the lines (path, bytes, hash) of its paths in order; a path's bucket is a remainder of its crc32. So no task
    holds more than its share of the lines. buckets=1 is the flat digest of all lines in path order, which is one long text;
    it is refused beyond max_flat files."""
    if buckets == 1 and entries.limit(max_flat + 1).count() > max_flat:
        raise ValueError(f"more than {max_flat} files: use several buckets")
    line = F.concat(F.concat_ws("\0", "path", F.col("bytes").cast("string"), F.coalesce("hash", F.lit(""))), F.lit("\n"))
    rows = entries.select((F.crc32(F.col("path").cast("binary")) % buckets).alias("b"), "bytes", F.struct("path", line.alias("line")).alias("x"))
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.line), ""), 256)
    parts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), digest.alias("digest"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "digest"))), lambda x: x.digest), "")
    root = F.first("digest") if buckets == 1 else F.sha2(ordered, 256)
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(root, F.sha2(F.lit(""), 256)).alias("root"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN10, JN11: path and status: added, removed, modified, touched (only the time differs), unchanged. Sizes decide before
    hashes; a missing hash of equal sizes is unknown. Joins all entries; compare_snapshots() only what changed."""
    a = old.select("path", F.struct(F.lit(1).alias("x"), "bytes", "hash", "mtime").alias("a"))
    b = new.select("path", F.struct(F.lit(1).alias("x"), "bytes", "hash", "mtime").alias("b"))
    status = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.bytes") != F.col("b.bytes"), "modified").when(F.col("a.hash").isNull() | F.col("b.hash").isNull(), "unknown")
        .when(F.col("a.hash") != F.col("b.hash"), "modified").when(~F.col("a.mtime").eqNullSafe(F.col("b.mtime")), "touched").otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def _leaf() -> Column:
    return (F.crc32(F.col("path").cast("binary")) % FAN**LEVELS).cast("int")


def snapshot(entries: DataFrame, folder: str) -> None:
    """Keeps a manifest (path, bytes, hash, mtime) below folder: its entries, in folders by the first branch of their leaf, and a
    tree of digests (level, node, n, digest). A leaf's digest is that of its lines in order of paths, a node's that of its FAN
    children; level 0 is the root. A leaf holds one in 32,768 of the entries."""
    line = F.concat_ws("\0", "path", F.col("bytes").cast("string"), F.coalesce("hash", F.lit("")), F.coalesce(F.col("mtime").cast("string"), F.lit("")))
    rows = entries.select("path", F.col("bytes").cast("long").alias("bytes"), "hash", F.col("mtime").cast("timestamp").alias("mtime"), _leaf().alias("leaf")).withColumn("branch", F.floor(F.col("leaf") / FAN ** (LEVELS - 1)).cast("int"))
    rows.repartition("branch", F.floor(F.col("leaf") / FAN)).sortWithinPartitions("branch", "leaf").write.partitionBy("branch").parquet(f"{folder}/entries")
    level = rows.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))
    for depth in range(LEVELS, -1, -1):
        level.select(F.lit(depth).alias("level"), "node", "n", "digest").write.mode("append").parquet(f"{folder}/tree")
        children = level.withColumn("parent", F.floor(F.col("node") / FAN).cast("int")).groupBy("parent")
        ordered = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = children.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", F.transform(ordered, lambda x: F.concat_ws(" ", x.node.cast("string"), x.digest))), 256).alias("digest")).withColumnRenamed("parent", "node")


def compare_snapshots(spark: SparkSession, old: str, new: str) -> DataFrame:
    """JN10, JN11: compare() of two snapshots without the unchanged entries. Descends both trees: of each level only the children of
    nodes whose digests differ are met, and entries are read of the branches, and joined in the leaves, that differ."""
    trees = [spark.read.parquet(f"{folder}/tree") for folder in (old, new)]
    differ = [0]
    for depth in range(LEVELS + 1):
        a, b = (t.where(F.col("level") == depth).select("node", F.col("digest").alias(side)) for t, side in zip(trees, "ab", strict=True))
        if depth:
            a, b = (x.where(F.floor(F.col("node") / FAN).isin(differ)) for x in (a, b))
        both = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        differ = [r.node for r in both.select("node").collect()]  # FAN**LEVELS numbers at most
    branches = sorted({leaf // FAN ** (LEVELS - 1) for leaf in differ})
    a, b = (spark.read.schema(_ENTRIES).parquet(f"{folder}/entries").where(F.col("branch").isin(branches) & F.col("leaf").isin(differ)).drop("branch", "leaf") for folder in (old, new))
    return compare(a, b).where("status <> 'unchanged'")


def rename_plan(files: DataFrame, *, style: str | None = None, find: str | None = None, replace: str = "", regex: bool = False, template: str | None = None, start: int = 1, pad: int = 3, order: str = "path") -> DataFrame:
    """dir, name, new_name, problem (empty, forbidden, taken or null). {name}, {ext}, {seq}, {date} and {time} in template;
    numbers follow each folder's order."""
    x = files.select(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "mtime", "bytes", "path")
    x = x.withColumn("stem", F.when(F.col("name").rlike(r"^.+\.[^.]*$"), F.regexp_extract("name", r"^(.+)\.[^.]*$", 1)).otherwise(F.col("name"))).withColumn("ext", F.expr("substring(name, length(stem) + 1)"))
    out = F.col("stem")
    if find is not None:
        out = F.regexp_replace(out, find, replace) if regex else F.replace(out, F.lit(find), F.lit(replace))
    if style:
        out = case_style(out, style)
    x = x.withColumn("out", out)
    if template:
        x = positions(x, ["dir"], [order, "path"], "seq").withColumn("seq", F.col("seq") + start - 1)
        number = F.col("seq").cast("string")  # lpad cuts what is longer
        values = {"name": F.col("out"), "ext": F.regexp_replace("ext", r"^\.", ""), "seq": F.lpad(number, F.greatest(F.length(number), F.lit(pad)), F.lit("0")), "date": F.date_format("mtime", "yyyyMMdd"), "time": F.date_format("mtime", "HHmmss")}
        new = F.lit(template)
        for k, v in values.items():
            new = F.replace(new, F.lit("{%s}" % k), v)
        x = x.withColumn("new_name", new)
    else:
        x = x.withColumn("new_name", F.concat("out", "ext"))
    names = x.groupBy("dir", "new_name").agg((F.count(F.lit(1)) > 1).alias("taken"))
    problem = F.when(F.trim("new_name").isin("", "."), "empty").when(F.col("new_name").rlike(r'[/\\:*?"<>|]'), "forbidden").when(F.col("taken"), "taken")
    return x.join(names.hint("merge"), ["dir", "new_name"]).select("dir", "name", "new_name", problem.alias("problem"))
