"""Quotation linking: conversations rebuilt from what messages quote, in DataFrame functions only.

A line's quote level is the number of ``>`` marks it starts with (blanks between them allowed). Neighbouring lines of one
level that aren't blank make a passage. Passages are normalised (marks off, lower case, punctuation and runs of blanks and
breaks as one blank) and hashed: whole, by sentence, and by line, so that a quote is found if it was wrapped anew, if it
repeats a sentence of a longer paragraph, and if it repeats single lines. The hashes are joined to those of what the
messages wrote themselves, so that a reply is linked to the earliest earlier message of its scope (the conversation, by
default) that wrote what it quotes. The parent is the message that wrote most characters of the outermost level with
a known origin, by whole passages, sentences or lines, whichever finds most; ties go to the later message. Sentences and
lines of ``min_chars`` normalised characters or more are hashed, and whole passages likewise, so that "yes" or "ok" links
nothing.

Threads are the trees of parents; a message without a linked quote starts one. Ancestors are found by doubling, so a
chain of n replies takes log n joins. ``path`` (turns from the thread's start to the message) orders a conversation
by replies: rows sorted by scope and path read every answer below what it answers.

Defined results: null text counts as empty; a message of quotes only keeps an empty text; quotes of unknown origin are
removed and their lines counted in ``unlinked`` (short ones too): those of passages that have no known origin as a whole or
by a sentence, and that have none themselves; rows that repeat a turn are told apart by nothing and share parent and path; rows
without scope or turn link to nothing and have no path; a message never quotes itself or a later turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, wide

_MARKS = r"^[ \t]*((?:>[ \t]*)+)"
_SENTENCE = r"(?<=[.!?。！？])\s+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def passages(messages: DataFrame, scope: str, turn: str) -> DataFrame:
    """scope, turn, pos, level and lines (without marks) of each passage of each message. Every line is in one slice."""
    strip = lambda x: F.regexp_replace(x, _MARKS, "")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(_level(x).alias("level"), strip(x).alias("line")))
    kind = F.transform("lines", lambda x: F.when(F.trim(x["line"], F.lit(" \t\r\f\x0b")) == "", -1).otherwise(x["level"]))
    changes = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("kind", i) != F.get("kind", i - 1)))
    base = messages.select(F.col(scope).alias("scope"), F.col(turn).cast("long").alias("turn"), lines.alias("lines")).where("scope is not null and turn is not null")
    base = base.withColumn("kind", kind).withColumn("starts", changes)
    runs = F.transform("starts", lambda s, k: F.struct(F.get("kind", s).alias("level"), F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s).alias("part")))
    each = base.select("scope", "turn", F.posexplode(F.filter(runs, lambda r: r["level"] >= 0)).alias("pos", "p"))
    return each.select("scope", "turn", "pos", "p.level", F.transform("p.part", lambda x: x["line"]).alias("lines"))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[\p{Punct}\s]+", " ")), " +", " "))


def units(parts: DataFrame) -> DataFrame:
    """scope, turn, pos, level, kind, norm and chars of each whole passage ('w'), sentence ('s') and line ('l')."""
    body = F.array_join("lines", " ")
    of = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), _normal(x).alias("norm")))
    each = F.explode(F.concat(of("w", F.array(body)), of("s", F.split(body, _SENTENCE)), of("l", F.col("lines")))).alias("u")
    return parts.select("scope", "turn", "pos", "level", each).select("scope", "turn", "pos", "level", "u.kind", "u.norm", F.length("u.norm").alias("chars"))


def link_quotes(messages: DataFrame, *, scope: str = "conv_id", turn: str = "turn", min_chars: int = 12) -> DataFrame:
    """The messages with text (quotes removed), parent_turn, depth, path, quoted_lines and unlinked (quoted lines of no
    known origin) in place of their own columns of those names."""
    every = units(passages(messages, scope, turn))
    hashed = every.where(F.col("chars") >= min_chars).withColumn("h", F.xxhash64("norm", "chars"))
    # One row for each text and scope: a phrase that everybody writes folds before the exchange.
    own = hashed.where("level = 0").groupBy("scope", "h").agg(F.min("turn").alias("author"))
    quoted = cut(hashed.where("level > 0").select("scope", "turn", "pos", "level", "kind", "h", "chars"))
    wanted = quoted.groupBy("scope", "h", "turn", "level", "kind").agg(F.sum("chars").alias("chars"))
    linked = cut(wanted.join(wide(cut(own)), ["scope", "h"]).where("author < turn"))
    votes = linked.groupBy("scope", "turn", "level", "author", "kind").agg(F.sum("chars").alias("chars")).groupBy("scope", "turn", "level", "author").agg(F.max("chars").alias("chars"))
    best = votes.groupBy("scope", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "author")).alias("x")).select("scope", "turn", F.col("x.author").alias("parent"))
    parents = cut(best)
    known = cut(linked.select("scope", "turn", "h", "level", F.lit(True).alias("known")).distinct())
    found = quoted.join(wide(known), ["scope", "turn", "h", "level"], "left").groupBy("scope", "turn", "pos").agg(F.coalesce(F.bool_or(F.col("known") & (F.col("kind") != "l")), F.lit(False)).alias("whole"), F.count_if(F.col("known") & (F.col("kind") == "l")).alias("lines"))
    size = every.where("level > 0 and kind = 'l'").groupBy("scope", "turn", "pos").agg(F.count(F.lit(1)).alias("all"))
    left = size.join(wide(cut(found)), ["scope", "turn", "pos"], "left")
    counts = left.groupBy("scope", "turn").agg(F.sum(F.when(F.coalesce("whole", F.lit(False)), 0).otherwise(F.col("all") - F.coalesce("lines", F.lit(0)))).alias("unlinked"))

    # Doubling: up is the ancestor reached so far, below the turns after it down to the message.
    step = parents.select("scope", "turn", F.col("parent").alias("up"), F.array("turn").alias("below"))
    while True:
        higher = step.select("scope", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("below").alias("between"))
        joined = cut(step.join(wide(higher), ["scope", "up"], "left"))
        step = joined.select("scope", "turn", F.coalesce("next", "up").alias("up"), F.when(F.col("next").isNull(), F.col("below")).otherwise(F.concat("between", "below")).alias("below"))
        if joined.where("next is not null").isEmpty():
            break
    tree = parents.join(wide(step), ["scope", "turn"]).select("scope", "turn", "parent", F.concat(F.array("up"), "below").alias("tree_path"))
    facts = cut(tree.join(wide(counts), ["scope", "turn"], "full"))

    split = F.split(F.coalesce("text", F.lit("")), "\n")
    quoted = F.filter(split, lambda x: x.rlike(_MARKS))
    free = F.array_join(F.filter(split, lambda x: ~x.rlike(_MARKS)), "\n")
    new = ("parent_turn", "depth", "path", "quoted_lines", "unlinked")
    keep = [c for c in messages.columns if c not in new]
    base = messages.select(*keep, F.size(quoted).alias("_quoted")).withColumn("_free", F.when(F.col("_quoted") > 0, F.trim(free, F.lit(" \t\r\n"))).otherwise(F.coalesce("text", F.lit(""))))
    facts = facts.select(F.col("scope").alias("_scope"), F.col("turn").alias("_turn"), F.col("parent").alias("_parent"), F.col("tree_path").alias("_tree"), F.col("unlinked").alias("_unlinked"))
    out = base.join(wide(facts), (base[scope] == facts["_scope"]) & (base[turn].cast("long") == facts["_turn"]), "left")
    alone = F.when(F.col(scope).isNotNull() & F.col(turn).isNotNull(), F.array(F.col(turn).cast("long")))
    return out.withColumn("path", F.coalesce("_tree", alone)).select(
        *[F.col("_free").alias("text") if c == "text" else F.col(c) for c in keep],
        F.col("_parent").alias("parent_turn"),
        (F.greatest(F.size("path"), F.lit(1)) - 1).alias("depth"),
        "path",
        F.col("_quoted").alias("quoted_lines"),
        F.coalesce("_unlinked", F.lit(0)).cast("long").alias("unlinked"),
    )
