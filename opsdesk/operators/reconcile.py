"""Matching two ledgers (JN6-JN9, AGG13): equal amounts within days one to one, sums of a few, then near misses.

Entries are (line, cents, d); a line number is one entry of its side. Only equal amounts can match, so the greedy choice runs
on each amount by itself; a popular amount is cut further where a gap of more than ``days`` separates its dates, beyond
which nothing interacts. Such a stretch of at most ``group_rows`` entries is matched in a stream; of a larger one that many
entries at a time, in the order of lines, so that no task holds it, with the same result.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_gap
from ..shared import discard, sized, written
from .ranks import joined, positions


def _pairs_of(a: list[tuple], b: list[tuple], days: int) -> Iterator[tuple[int, int, int]]:
    """In a's order: the unused entry of b with the smallest gap, of equals the first; a missing date is no gap. The unused
    entries of a date are taken in their order, whoever takes them."""
    free, order, taken, first = defaultdict(deque), [line for line, _ in b], set(), 0
    day_of = dict(b)
    for line, day in b:
        free[day].append(line)
    for line, day in a:
        found = None
        if day is None:
            while first < len(order) and order[first] in taken:
                first += 1
            found = (order[first], 0) if first < len(order) else None
        else:
            for gap in range(days + 1):
                near = {day - gap, day + gap, *([None] if gap == 0 else [])}
                heads = [free[d][0] for d in near if free.get(d)]
                if heads:
                    found = min(heads), gap
                    break
        if found:
            taken.add(found[0])
            free[day_of[found[0]]].popleft()
            yield line, *found


def _greedy(days: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of group, side and line: one group is held at a time."""
        group, sides, out = None, ([], []), []

        def done(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["line_a", "line_b", "gap"])

        for pdf in frames:
            dated = pdf.day.notna().tolist()
            for cents, part, side, line, day, has in zip(pdf.cents.tolist(), pdf.part.tolist(), pdf.side.tolist(), pdf.line.tolist(), pdf.day.tolist(), dated, strict=True):
                if (cents, part) != group:
                    out += _pairs_of(*sides, days)
                    group, sides = (cents, part), ([], [])
                sides[side].append((line, int(day) if has else None))
            yield done(out)
            out = []
        yield done(list(_pairs_of(*sides, days)))

    return run


def _in_blocks(rows: DataFrame, days: int, block: int) -> DataFrame:
    """The same choice for groups of any size, by blocks of a's lines. The used entries of b with one date are always the first
    of that date, so how many they are is all that a block has to know of the ones before. Of a date a block can use no
    more entries than it has entries that see the date, the next ones in order; its undated entries none but the next ``block``
    of all. Groups take their blocks side by side: as many steps as the largest group has blocks."""
    spark, group, date = rows.sparkSession, ["cents", "part"], ["cents", "part", "day"]
    a = positions(rows.where("side = 0").select("line", *date), group, ["line"], "k")
    a = written(a.select("line", *date, F.floor((F.col("k") - 1) / block).cast("int").alias("block")), "block")
    b = written(positions(rows.where("side = 1").select("line", *date), date, ["line"], "k"))
    used = spark.createDataFrame([], "cents long, part long, day int, used long")
    out = spark.createDataFrame([], "line_a long, line_b long, gap int")

    def matched(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        sides = [[(line, None if pd.isna(d) else int(d)) for line, d in zip(s.line.tolist(), s.day.tolist(), strict=True)] for s in (x.sort_values("line"), y.sort_values("line"))]
        return pd.DataFrame(list(_pairs_of(*sides, days)), columns=["line_a", "line_b", "gap"])

    for i in range((a.agg(F.max("block")).first()[0] or 0) + 1):
        now = a.where(F.col("block") == i).drop("block")
        around = F.when(F.col("day").isNotNull(), F.array_append(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda g: F.col("day") + g), F.lit(None).cast("int")))
        sees = now.groupBy(*date).agg(F.count(F.lit(1)).alias("n")).where("day is not null").select(*group, F.explode(around).alias("day"), "n").groupBy(*date).agg(F.sum("n").alias("n"))
        left = joined(b, used, date, "left").where("k > coalesce(used, 0)")
        usable = joined(left, sees, date).where("k <= coalesce(used, 0) + n").select("line", *date)
        undated = now.where("day is null").select(*group).distinct()
        if not undated.isEmpty():
            rank = F.row_number().over(Window.partitionBy(*group).orderBy("line"))
            any_date = left.join(undated.hint("merge"), group).withColumn("nth", rank).where(F.col("nth") <= block)
            usable = usable.union(any_date.select("line", *date)).distinct()
        pairs = written(now.groupBy(*group).cogroup(usable.groupBy(*group)).applyInPandas(matched, "line_a long, line_b long, gap int"))
        more = pairs.select(F.col("line_b").alias("line")).join(b.hint("merge"), "line").groupBy(*date).agg(F.count(F.lit(1)).alias("used"))
        before, used = used, written(used.union(more.select(used.columns)).groupBy(*date).agg(F.sum("used").alias("used")))
        discard(before)
        out = out.union(pairs)
    discard(a, b)
    return out


def match_exact(a: DataFrame, b: DataFrame, *, days: int = 3, group_rows: int = 500_000) -> DataFrame:
    """JN6: line_a, line_b, gap."""
    both = a.select(F.lit(0).alias("side"), "line", "cents", F.unix_date("d").alias("day")).union(b.select(F.lit(1).alias("side"), "line", "cents", F.unix_date("d").alias("day"))).where("cents is not null")
    # One row for each amount and date: an amount has as many as the calendar has days.
    dates = both.groupBy("cents", "day").agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"))
    amount = Window.partitionBy("cents")
    gap = F.col("day") - F.lag("day").over(amount.orderBy("day"))
    undated = F.max(F.col("day").isNull()).over(amount)  # such an entry can meet any date
    dates = dates.withColumn("cut", F.when(~undated & (gap > days), 1).otherwise(0)).withColumn("part", F.sum("cut").over(amount.orderBy("day")))
    whole = Window.partitionBy("cents", "part")
    dates = dates.withColumns({"a": F.sum("n_a").over(whole), "b": F.sum("n_b").over(whole)}).where("a > 0 and b > 0").select("cents", "day", "part", (F.col("a") + F.col("b")).alias("size"))
    rows = joined(both, dates, ["cents", "day"])
    small = rows.where(F.col("size") <= group_rows).drop("size").repartition("cents", "part").sortWithinPartitions("cents", "part", "side", "line")
    out = small.mapInPandas(_greedy(days), "line_a long, line_b long, gap int")
    large = rows.where(F.col("size") > group_rows)
    return out if large.isEmpty() else out.unionByName(_in_blocks(large, days, group_rows))


def leftover(side: DataFrame, matched: DataFrame, column: str) -> DataFrame:
    """JN8."""
    return side.join(matched.select(F.col(column).alias("line")), "line", "left_anti")


def _sums(pool: list[tuple], parts: int) -> dict[int, list[tuple[int, list[int]]]]:
    """pool: cents of each entry. For each sum of two to ``parts`` entries their sets, in the order of the search: by first
    member, then second, ..., a set before those that go on from it. A member may not exceed what is missing, and has the sign of
    the sum; only where nothing is missing can any follow."""
    sign = lambda v: (v > 0) - (v < 0)
    out = defaultdict(list)
    for c in sorted(c for n in range(2, parts + 1) for c in combinations(range(len(pool)), n)):
        total = left = sum(pool[i] for i in c)
        for k, i in enumerate(c):
            v = pool[i]
            if (left and v and sign(v) != sign(total)) or (abs(v) > abs(left) and sign(v) == sign(left)) or (left == 0 and k > 1):
                break
            left -= v
        else:
            out[total].append(c)
    return out


def match_split(a: DataFrame, b: DataFrame, *, days: int = 3, parts: int = 3, pool: int = 60) -> DataFrame:
    """JN7: entries of a that two to ``parts`` unused entries of b add up to, for pools of at most ``pool`` entries;
    a larger pool gives no result. In the order of a's lines, each entry has the first set of the search among those that are
    left, and takes it if all its dates are within days. line_a, lines_b.

    The sums of the pool are a table of bounded size that side a is joined with. An entry's set is final when no earlier entry
    takes a member of it; so a round settles all entries before the first whose set meets one that was taken in it. A round takes
    two entries of b at least, so rounds are at most half as many as the pool's entries."""
    spark = a.sparkSession
    nothing = spark.createDataFrame([], "line_a long, lines_b array<long>")
    entries = b.where("cents is not null").select("line", "cents", F.unix_date("d").alias("day")).orderBy("line").limit(pool + 1).collect()
    if len(entries) > pool:
        return nothing
    if sum(math.comb(pool, n) for n in range(2, parts + 1)) > 100_000:
        raise ValueError("the sums of such a pool are too many for a table that is sent to all tasks")
    sums = _sums([e.cents for e in entries], parts)
    found, used, after = [], 0, None
    known = spark.createDataFrame([(t,) for t in sums], "cents long")
    x = written(a.join(F.broadcast(known), "cents", "left_semi").select("line", "cents", F.unix_date("d").alias("day")))
    while True:
        rows = []
        for total, sets in sums.items():
            for c in sets:
                mask = sum(1 << i for i in c)
                if not mask & used:
                    dates = [entries[i].day for i in c if entries[i].day is not None]
                    rows.append((total, mask, min(dates, default=None), max(dates, default=None)))
                    break
        first = spark.createDataFrame(rows, "cents long, mask long, low int, high int")
        fits = F.coalesce((F.col("day") - F.col("low") <= days) & (F.col("high") - F.col("day") <= days), F.lit(True))
        asked = x.join(F.broadcast(first), "cents").select("line", "mask", fits.alias("fits"))
        asked = asked if after is None else asked.where(F.col("line") >= after)
        takers = asked.where("fits").orderBy("line").limit(pool // 2 + 1).collect()
        # The first entry whose set meets an earlier one of this round.
        taken, meets = 0, F.lit(False)
        for t in takers:
            meets |= (F.col("line") > t.line) & (F.col("mask").bitwiseAND(F.lit(t.mask)) != 0)
        after = asked.where(meets).agg(F.min("line")).first()[0] if takers else None
        for t in takers:
            if after is None or t.line < after:
                taken |= t.mask
                found.append((t.line, [e.line for i, e in enumerate(entries) if t.mask >> i & 1]))
        used |= taken
        if after is None:
            break
    discard(x)
    return spark.createDataFrame(found, nothing.schema)


def _grouped(side: DataFrame, block: int, hot: bool) -> DataFrame:
    """cents, d, block, lines: the entries of each amount and date, of a common one (hot: there are such) in blocks of about so
    many."""
    value, part = ["cents", "d"], F.lit(0).cast("long")
    if hot:
        common = side.groupBy(*value).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).where("blocks > 1")
        side, part = joined(side, common, value, "left"), F.pmod(F.xxhash64("line"), F.coalesce("blocks", F.lit(1)))
    return side.groupBy(*value, part.alias("block")).agg(F.collect_list(F.struct("line")).alias("lines"))


def near_misses(a: DataFrame, b: DataFrame, *, days: int = 3, ratio: float = 0.01, block: int = 4096, pairs: int = 1 << 28) -> DataFrame:
    """JN9: pairs of one sign, within days, that differ by at most max(100, ratio * |a|) cents but not by nothing. Entries of
    one amount and date have the same partners, so these are joined as one row with a list of at most ``block`` lines or so, and
    the lists are multiplied out after the join, where nothing is dealt again.

    Keys of the join are the sign, a bucket of a logarithmic scale of amounts and one of a scale of days + 1; a's rows are repeated
    for the buckets that their tolerance reaches. Undated entries meet any date: those of b have a bucket of their own that all
    of a look into, those of a one that all dated ones of b look into. A cell of more than ``pairs`` pairs is cut: the side with
    more rows is dealt over its cuts, the other is repeated for each."""
    step = 2 * math.log1p(ratio)  # so that the tolerance reaches into two buckets, about
    size = lambda c: F.floor(F.log(c + 100 / ratio) / step).cast("long")
    week = lambda d: F.floor(d / (days + 1)).cast("long")
    whole, day, dated, zero = F.abs("cents"), F.unix_date("d"), F.col("d").isNotNull(), F.lit(0).cast("long")
    tolerance = F.greatest(F.lit(100), F.round(whole * ratio)).cast("long")
    undated_a, undated_b = F.lit(1 << 40), F.lit((1 << 40) + 1)  # beyond all dates
    key, value, up = ["up", "s", "w"], ["cents", "d"], (F.col("cents") > 0).alias("up")

    def cells_a(df: DataFrame) -> DataFrame:
        most = F.least(whole, F.lit((1 << 63) - 1) - tolerance) + tolerance
        df = df.select("*", up, F.explode(F.sequence(size(F.greatest(whole - tolerance, zero)), size(most))).alias("s"))
        return df.withColumn("w", F.explode(F.when(dated, F.array_append(F.sequence(week(day - days), week(day + days)), undated_b)).otherwise(F.array(undated_a, undated_b))))

    def cells_b(df: DataFrame) -> DataFrame:
        return df.select("*", up, size(whole).alias("s"), F.explode(F.when(dated, F.array(week(day), undated_a)).otherwise(F.array(undated_b))).alias("w"))

    sides = [(cells_a, a.select("line", *value).where("cents <> 0")), (cells_b, b.select("line", *value).where("cents <> 0"))]
    counts = [cells(side.groupBy(*value).agg(F.count(F.lit(1)).alias("n"))).select(*key, "n", F.ceil(F.col("n") / block).alias("blocks"), F.lit(i).alias("side")) for i, (cells, side) in enumerate(sides)]
    n, rows = ([F.sum(F.when(F.col("side") == i, F.col(c)).otherwise(0)) for i in (0, 1)] for c in ("n", "blocks"))
    cuts = F.least(F.ceil(n[0].cast("double") * n[1] / pairs), F.greatest(*rows))
    loads = counts[0].union(counts[1]).groupBy(*key).agg(cuts.alias("cuts"), (rows[0] >= rows[1]).alias("deal_a"), (F.max("blocks") > 1).alias("hot"))
    loads = written(loads.where("cuts > 1 or hot"))
    heavy, hot = loads.where("cuts > 1"), {x.hot for x in loads.select("hot").distinct().collect()}
    cut = bool(hot) and not heavy.isEmpty()
    if not cut:
        discard(loads)

    def dealt(i: int) -> DataFrame:
        cells, side = sides[i]
        df = cells(_grouped(side, block, True in hot))
        if not cut:
            return df.withColumn("cut", zero)
        one, each = F.array(F.pmod(F.xxhash64(*value, "block"), "cuts")), F.sequence(zero, F.col("cuts") - 1)
        return df.join(sized(heavy, 100_000), key, "left").withColumn("cut", F.explode(F.when(F.col("cuts").isNull(), F.array(zero)).when(F.col("deal_a") == (i == 0), one).otherwise(each)))

    left = dealt(0).select(*key, "cut", F.col("cents").alias("cents_a"), F.col("d").alias("d_a"), F.col("lines").alias("lines_a"), tolerance.alias("most"))
    right = dealt(1).select(*key, "cut", F.col("cents").alias("cents_b"), F.col("d").alias("d_b"), F.col("lines").alias("lines_b"))
    apart, gap = F.abs(F.col("cents_a") - F.col("cents_b")), day_gap(F.col("d_a"), F.col("d_b"))
    met = left.join(right.hint("merge"), [*key, "cut"]).where((apart > 0) & (apart <= F.col("most")) & (gap <= days)).withColumn("gap", gap)
    met = met.select(F.explode("lines_a").alias("a"), "lines_b", "cents_a", "cents_b", "gap").select("a", F.explode("lines_b").alias("b"), "cents_a", "cents_b", "gap")
    return met.select(F.col("a.line").alias("line_a"), F.col("b.line").alias("line_b"), "cents_a", "cents_b", "gap")


def totals(side: DataFrame) -> DataFrame:
    """AGG13."""
    return side.agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
