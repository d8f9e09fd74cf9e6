"""Markdown, subtitles and JSON as tables of lines, cues and values (RUL9, TXT8-TXT10, SRC18, SNK2, SNK4, SNK8, JSN1-JSN3, AGG25)."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import subtitle_ms, subtitle_time
from ..functions.text import WIDE, display_width, markdown_cell, numericish
from ..sources.files import front_matter
from .ranks import positions

#: Texts that a task holds as Python objects at a time.
SLICE = 256
_FENCE = re.compile(r"\s*(```+|~~~+)(.*)", re.S)
#: What a line outside of fences is tested for; headings, list items and other lines each have their own rules.
_ANY_LINE = {"MD009": r"[ \t]+$", "MD010": r"^\t"}
_HEADING = {"MD019": r"^#{1,6}\s{2,}", "MD021": r"^#{1,6}\s+$", "MD026": r"^#{1,6}\s.*[。！？，；：]\s*$"}
_ITEM = {"MD027": r"^\s*[-*+]\s{2,}\S"}
_OTHER = {"MD039": (r"\[\s*\]\([^)]*\)", r"\[\s+[^\]]|\S\s+\]\("), "MD034": r"(?s)^(?!.*<https?://)(?!.*\]\(https?:).*(?:^|[\s(])https?://\S"}
_RULES = {k: [(code, re.compile(p)) for code, ps in rules.items() for p in ((ps,) if isinstance(ps, str) else ps)] for k, rules in (("any", _ANY_LINE), ("heading", _HEADING), ("item", _ITEM), ("other", _OTHER))}
_MARK = re.compile(r"(\s*)([-*+])(\s+)(\S.*)", re.S)


def _states(rows: list[str]) -> Iterator[tuple[str, bool, str]]:
    """Each line with whether it belongs to a code fence and what it does to it: opens, closes or nothing."""
    mark = ""
    for row in rows:
        m = _FENCE.match(row)
        if m and not mark:
            mark = m[1][0]
            yield row, True, "opens"
        elif m and m[1][0] == mark:
            mark = ""
            yield row, True, "closes"
        else:
            yield row, bool(mark), ""


def _cells(row: str) -> list[str]:
    """table_cells() for the Arrow path."""
    return [c.strip(" \t\r") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", row.strip()))]


def _ruled(cells: list[str]) -> bool:
    return all(re.fullmatch(":?-+:?", c) for c in cells)


def _tables(rows: list[str]) -> list[tuple[int, list[list[str]]]]:
    """First line (from 0) and cells of each run of two lines or more that begin with a pipe."""
    runs = [(piped, [k for k, _ in group]) for piped, group in groupby(enumerate(rows), lambda x: x[1].lstrip().startswith("|"))]
    return [(ks[0], [_cells(rows[k]) for k in ks]) for piped, ks in runs if piped and len(ks) > 1]


def _lint(text: str) -> list[tuple[int, str]]:
    rows, out = text.split("\n"), []
    level, titled, item, fence = 0, False, "", 0
    for line, (row, inside, does) in enumerate(_states(rows), 1):
        if inside:
            fence = line if does == "opens" else 0 if does == "closes" else fence
            if does == "opens" and not _FENCE.match(row)[2].strip():
                out.append((line, "MD040"))
            continue
        head, mark = re.match(r"(#{1,6})\s", row), _MARK.match(row)
        kind = "heading" if head else "item" if mark else "other"
        out += [(line, code) for code, p in (*_RULES["any"], *_RULES[kind]) if p.search(row)]
        if head:
            now = len(head[1])
            out += [(line, "MD001")] * (0 < level < now - 1) + [(line, "MD025")] * (titled and now == 1)
            level, titled = now, titled or now == 1
        elif mark:
            out += [(line, "MD004")] * (item not in ("", mark[2]))
            item = mark[2]
        elif row.strip() and not re.match(r"\s*[0-9]", row):
            item = ""
    out += [(fence, "MD031")] * (fence > 0)
    for first, cells in _tables(rows):
        ruled = _ruled(cells[1])
        wrong = [first] * (not ruled) + [first + k for k, c in enumerate(cells) if k > ruled and len(c) != len(cells[0])]
        out += [(k + 1, "MD056") for k in wrong]
    if text:
        out += [(len(rows), "MD012")] * text.endswith("\n\n") + [(len(rows), "MD047")] * (not text.endswith("\n"))
    return sorted(out)


def _each_text(documents: DataFrame, rows_of: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """doc_id and the rows that a function finds in each text, in one pass of Arrow batches. Texts and rows are Python objects for
    SLICE texts at a time only."""
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*[(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                rows = [(n, *x) for n, t in enumerate(part.column("text").to_pylist()) for x in rows_of(t or "")]
                nth, *columns = zip(*rows, strict=True) if rows else [()] * (1 + len(names))
                doc_id = part.column("doc_id").take(pa.array(nth, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, columns, types)], names=["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {schema}")


def markdown_lines(documents: DataFrame) -> DataFrame:
    """WIN6: doc_id, line (from 1), row, in_fence, opens, closes."""
    return _each_text(documents, lambda t: [(k, row, inside, does == "opens", does == "closes") for k, (row, inside, does) in enumerate(_states(t.split("\n")), 1)], "line int, row string, in_fence boolean, opens boolean, closes boolean")


def lint(documents: DataFrame) -> DataFrame:
    """RUL9, WIN5: doc_id, line, code of the line rules, of heading levels (MD001, MD025), list marks (MD004), fences (MD031,
    MD040), tables (MD056: no separator in the second line, or a row of another width) and the end of the text (MD012, MD047).
    But for tables nothing inside a fence is judged. One pass over each text, linear in its lines."""
    return _each_text(documents, _lint, "line int, code string")


def _width(cell: str) -> int:
    return len(cell) + len(re.findall(WIDE, cell))


def _rebuilt(cells: list[list[str]]) -> list[str]:
    """The lines of a table with its separator, all rows filled up and aligned."""
    size = max(map(len, cells))
    body = [c + [""] * (size - len(c)) for k, c in enumerate(cells) if k != 1 or not _ruled(c)]
    widths = [max(3, *map(_width, column)) for column in zip(*body, strict=True)]
    line = lambda row: f"| {' | '.join(c + ' ' * (w - _width(c)) for c, w in zip(row, widths, strict=True))} |"
    return [line(body[0]), line(["-" * w for w in widths]), *map(line, body[1:])]


def _fixed(text: str) -> str:
    if not text:
        return text
    rows, free, usual, closed, opened = [], [], "", True, ""
    for row, inside, does in _states(text.split("\n")):
        if not inside:
            row = re.sub(r"^\t+", lambda m: "  " * len(m[0]), row.rstrip(" \t"))
            if mark := _MARK.fullmatch(row):
                usual = usual or mark[2]
                row = f"{mark[1]}{usual} {mark[4]}"
        if does:
            closed, opened = does == "closes", _FENCE.match(row)[1][0] * 3
        rows.append(row)
        free.append(row if not inside else "")
    for first, cells in reversed(_tables(free)):
        rows[first : first + len(cells)] = _rebuilt(cells)
    return "\n".join(rows).rstrip("\n") + "\n" + ("" if closed else f"{opened}\n")


def fix(text: Column | str) -> Column:
    """TXT8: outside of code fences blanks at line ends go, leading tabs become two blanks each, list marks become the first
    one that the text uses, tables get their separator, full rows and aligned columns; a fence left open is closed; one line
    end at the end. Linear in the lines of a text. Rows go to Python some hundred at a time: an Arrow batch of ten thousand long
    texts, twice, is too much for a worker."""
    fixed = F.udf(lambda t: t if t is None else _fixed(t), "string", useArrow=False)
    return fixed(F.col(text) if isinstance(text, str) else text)


def links(documents: DataFrame) -> DataFrame:
    """The link targets of each text that name files: doc_id, line (from 1), target without its anchor, and the other columns but
    text. Web, mail and data addresses and anchors are none (TXT10, MD053)."""
    kept = [c for c in documents.columns if c != "text"]
    lines = documents.where(F.col("text").contains("](")).select(*kept, F.posexplode(F.split("text", "\n")).alias("line", "_row"))
    found = lines.select(*kept, (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("_row", F.lit(r"\]\(([^)]+)\)"), F.lit(1))).alias("target"))
    found = found.where(~F.trim("target").rlike(r"^(https?:|mailto:|#|data:)"))
    return found.withColumn("target", F.split_part(F.trim("target"), F.lit("#"), F.lit(1))).where("target <> ''")


def resolved(path: Column) -> Column:
    """A path without empty parts, "." and the ".." that leave one of its folders; an absolute one keeps its slash."""
    leaves = lambda done, part: (part == "..") & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("..")) != "..")
    up = lambda done, part: F.when(part.isin("", "."), done).when(leaves(done, part), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def dead_links(documents: DataFrame, paths: DataFrame, *, folder: str | None = None) -> DataFrame:
    """TXT10, MD053: links whose target is neither among paths (path) nor a folder above one. A target has its %xx decoded, and is resolved against the text's folder: a column of documents, or the top of the tree."""
    found = links(documents)
    # try_url_decode takes a plus sign for a blank, as forms do.
    name = F.coalesce(F.try_url_decode(F.replace(F.col("target"), F.lit("+"), F.lit("%2B"))), "target")
    base = F.coalesce(F.col(folder), F.lit("")) if folder else F.lit("")
    full = F.when(name.startswith("/"), name).when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))
    there = paths.select(resolved(F.col("path")).alias("_path"))
    parts = F.split("_path", "/")
    above = there.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_path")).distinct()
    return found.withColumn("_path", resolved(full)).where("_path <> ''").join(above.hint("merge"), "_path", "left_anti").drop("_path")


def _aligned(df: DataFrame, order: list[str], cell: Callable[[Column], Column], frame: Callable[[list[Column]], Column], rule: Callable[[Column, Column], Column], least: int, right: list[str] | None) -> DataFrame:
    """The lines (line, text) of a table of equal widths: the head, a rule and the rows, in the order of the given columns. Columns
    of numbers, or those in right, stand to the right."""
    names = df.columns
    numbered = positions(df, [], order, "_line").select((F.col("_line") + 1).alias("line"), *[cell(F.col(f"`{c}`").cast("string")).alias(f"_c{k}") for k, c in enumerate(names)])
    widths, numeric = [], []
    for k, c in enumerate(names):
        x = F.col(f"_c{k}")
        widths.append(F.greatest(F.coalesce(F.max(display_width(x)), F.lit(0)), display_width(F.lit(c)), F.lit(least)).alias(f"_w{k}"))
        to_right = F.max(F.lit(c in right)) if right is not None else F.bool_and(numericish(x) | (x == "")) & F.bool_or(x != "")
        numeric.append(F.coalesce(to_right, F.lit(False)).alias(f"_n{k}"))
    size = numbered.agg(*widths, *numeric)

    def padded(x: Column, k: int, head: bool = False) -> Column:
        blanks = F.repeat(F.lit(" "), F.col(f"_w{k}") - display_width(x))
        left = F.concat(x, blanks)
        return left if head and right is not None else F.when(F.col(f"_n{k}"), F.concat(blanks, x)).otherwise(left)

    columns = range(len(names))
    top = size.select(F.lit(0).cast("long").alias("line"), frame([padded(F.lit(c), k, True) for k, c in enumerate(names)]).alias("text"))
    below = size.select(F.lit(1).cast("long").alias("line"), frame([rule(F.col(f"_w{k}"), F.col(f"_n{k}")) for k in columns]).alias("text"))
    return top.union(below).union(numbered.join(F.broadcast(size)).select("line", frame([padded(F.col(f"_c{k}"), k) for k in columns]).alias("text")))  # one row of widths


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """SNK4: the lines (line, text) of an aligned Markdown table in the order of the given columns: cells escaped, numeric
    columns to the right, widths of at least 3. The order should tell any two rows apart."""
    frame = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rule = lambda w, n: F.concat(F.repeat(F.lit("-"), w - n.cast("int")), F.when(n, ":").otherwise(""))
    return _aligned(df, order, markdown_cell, frame, rule, 3, None)


def console_table(df: DataFrame, order: list[str], right: list[str]) -> DataFrame:
    """SNK2: the lines (line, text) of a table for a terminal in the order of the given columns: two blanks between the columns,
    wide characters counted twice, those in right to the right below a head that stays left. A null cell is a dash."""
    rule = lambda w, n: F.repeat(F.lit("-"), w)
    return _aligned(df, order, lambda c: F.coalesce(c, F.lit("—")), lambda cells: F.concat_ws("  ", *cells), rule, 0, right)


_TIMES = r"(?m)^\s*((?:\d+:)?\d{1,2}:\d{1,2}[,.]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{1,2}[,.]\d{1,3})[^\n]*$"


def cues(documents: DataFrame) -> DataFrame:
    """SRC18: doc_id, nth, start_ms, end_ms, text of SRT and WebVTT texts; blocks without a time line are skipped."""
    return documents.select("doc_id", F.explode(_blocks(F.col("text"))).alias("c")).select("doc_id", "c.nth", "c.start_ms", "c.end_ms", "c.text")


def _blocks(text: Column) -> Column:
    """The cues of an SRT or WebVTT text, as an array."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^﻿?(WEBVTT[^\n]*\n)?", ""), r"\n[ \t]*\n+")
    body = lambda b: F.regexp_replace(F.regexp_extract(b, r"-->[^\n]*\n([\s\S]*)$", 1), r"\s+$", "")
    time = lambda b, k: subtitle_ms(F.regexp_extract(b, _TIMES, k))
    one = lambda b, i: F.struct(i.alias("nth"), time(b, 1).cast("long").alias("start_ms"), time(b, 2).cast("long").alias("end_ms"), body(b).alias("text"), F.lit(None).cast("string").alias("style"), F.regexp_extract(b, _TIMES, 1).alias("at"))
    found = F.filter(F.transform(blocks, one), lambda c: c["at"] != "")
    return F.transform(found, lambda c: F.struct(*[c[k].alias(k) for k in ("nth", "start_ms", "end_ms", "text", "style")]))


def subtitle_format(text: Column | str, path: Column | str | None = None) -> Column:
    """SRC18: srt, vtt or ass: by the ending of the path, else by what the text begins with or holds; null for neither."""
    t = F.col(text) if isinstance(text, str) else text
    by_text = F.when(t.rlike(r"^﻿?\s*WEBVTT"), "vtt").when(t.rlike(r"(?mi)^\[(Script Info|Events)\]"), "ass").when(t.rlike(_TIMES), "srt")
    if path is None:
        return by_text
    ending = F.regexp_extract(F.lower(F.col(path) if isinstance(path, str) else path), r"\.(srt|vtt|ass|ssa)$", 1)
    return F.when(ending.isin("ass", "ssa"), "ass").when(ending != "", ending).otherwise(by_text)


def any_cues(documents: DataFrame, *, path: str = "path") -> DataFrame:
    """SRC18: doc_id, format, nth, start_ms, end_ms, text, style of the cues of a table of SRT, WebVTT and ASS texts. Each text goes to its own
    reader in one scan; notes of WebVTT and texts of no format have no cues."""

    @F.pandas_udf("array<struct<nth: int, a: string, b: string, text: string, style: string>>")
    def events(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(("nth", "a", "b", "text", "style"), x, strict=True)) for x in _ass_events(t)])

    x = documents.select("doc_id", "text", subtitle_format("text", path).alias("format")).where("format is not null")
    plain = F.when(F.col("format") == "vtt", F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"(?m)(^|\n)NOTE\b[\s\S]*?(\n[ \t]*\n|\z)", "$1\n")).when(F.col("format") == "srt", F.col("text"))
    ass = F.transform(events(F.when(F.col("format") == "ass", F.col("text"))), lambda c: F.struct(c.nth.alias("nth"), subtitle_ms(c.a).cast("long").alias("start_ms"), subtitle_ms(c.b).cast("long").alias("end_ms"), c.text.alias("text"), c.style.alias("style")))
    found = x.select("doc_id", "format", F.explode(F.when(F.col("format") == "ass", ass).otherwise(_blocks(plain))).alias("c"))
    return found.select("doc_id", "format", "c.*").where("start_ms is not null and end_ms is not null")


def _ass_events(text: str) -> list[tuple]:
    """nth, start, end, text, style of each dialogue line."""
    out, on, at = [], False, {}
    for k, row in enumerate(map(str.strip, text.splitlines())):
        name, _, rest = row.partition(":")
        if row.startswith("[") and row.endswith("]"):
            on, at = row.lower() == "[events]", {}
        elif on and name.lower() == "format":
            at = {f.strip().lower(): n for n, f in enumerate(rest.split(","))}
        elif on and name.lower() == "dialogue" and at:
            cell = rest.split(",", len(at) - 1)
            get = lambda f: cell[at[f]].strip() if at.get(f, len(cell)) < len(cell) else ""  # noqa: B023, E731
            out.append((k, get("start"), get("end"), re.sub(r"\\[Nn]", "\n", re.sub(r"\{[^}]*\}", "", get("text"))), get("style") or None))
    return out


def ass_cues(documents: DataFrame) -> DataFrame:
    """SRC18, STR21: doc_id, nth, start_ms, end_ms, text, style of the [Events] of ASS texts, by the fields that their Format line
    names; tags off, \\N as line ends. Cues before a Format line or without times are left out."""
    x = _each_text(documents, _ass_events, "nth int, a string, b string, text string, style string")
    return x.select("doc_id", "nth", subtitle_ms("a").alias("start_ms"), subtitle_ms("b").alias("end_ms"), "text", "style").where("start_ms is not null and end_ms is not null")


#: The head of an ASS text and its one style.
ASS_STYLES = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\nStyle: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1"
ASS_HEAD = f"[Script Info]\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\n{ASS_STYLES}\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def subtitles(cue_rows: DataFrame, style: str = "srt") -> DataFrame:
    """SNK8, TXT9: doc_id and text in srt, vtt or ass; cues in time order, numbered anew in srt. ass keeps centiseconds and the
    styles of its cues."""
    named = F.coalesce("style", F.lit("Default")) if "style" in cue_rows.columns else F.lit("Default")
    one = F.struct("start_ms", "end_ms", "nth", "text", named.alias("style"))
    listed = cue_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("c"))  # of one film
    t = lambda x: subtitle_time(x, style)
    if style == "ass":
        block = lambda x, i: F.concat(F.lit("Dialogue: 0,"), t(x.start_ms), F.lit(","), t(x.end_ms), F.lit(","), x.style, F.lit(",,0,0,0,,"), F.replace(x.text, F.lit("\n"), F.lit("\\N")))
        head, gap = ASS_HEAD, "\n"
    else:
        number = (lambda i: F.concat((i + 1).cast("string"), F.lit("\n"))) if style == "srt" else (lambda i: F.lit(""))
        block = lambda x, i: F.concat(number(i), t(x.start_ms), F.lit(" --> "), t(x.end_ms), F.lit("\n"), x.text)
        head, gap = ("" if style == "srt" else "WEBVTT\n\n"), "\n\n"
    return listed.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("c", block), gap), F.lit("\n")).alias("text"))


def subtitle_losses(cue_rows: DataFrame, style: str = "srt") -> DataFrame:
    """TXT9: doc_id, cues, and how many of them lose a style (srt, vtt) or milliseconds (ass) in the form to be written."""
    styled = F.col("style").isNotNull() & (F.col("style") != "Default") if "style" in cue_rows.columns else F.lit(False)
    cut = (F.col("start_ms") % 10 != 0) | (F.col("end_ms") % 10 != 0)
    return cue_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cues"), F.count_if(styled if style != "ass" else F.lit(False)).alias("styles_lost"), F.count_if(cut if style == "ass" else F.lit(False)).alias("times_cut"))


def json_validity(df: DataFrame, column: str) -> DataFrame:
    """JSN2: the rows with valid, true if the text is JSON (a byte-order mark is tolerated)."""
    return df.withColumn("valid", F.expr(f"try_parse_json(regexp_replace({column}, '^\\uFEFF', '')) is not null"))


def json_shape(df: DataFrame, column: str) -> DataFrame:
    """AGG25: key, n (objects that have it) and optional (not all do) of the top-level keys."""
    objects = df.select(F.col(column).alias("j"), F.json_object_keys(column).alias("k")).where("k is not null")
    total = objects.agg(F.count(F.lit(1)).alias("total"))
    keys = objects.select(F.explode("k").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).select("key", "n", (F.col("n") < F.col("total")).alias("optional"))  # one row


def json_sorted(df: DataFrame, column: str) -> DataFrame:
    """JSN3, SNK11: minified; the variant form keeps the keys of each object in order."""
    return df.withColumn(column, F.expr(f"to_json(try_parse_json({column}))"))


def json_errors(df: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """JSN1: key, line, column, message, snippet of the first error of each text that isn't JSON."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, text in zip(pdf.k, pdf.t, strict=True):
                text = (text or "").removeprefix("\ufeff")
                try:
                    json.loads(text)
                except ValueError as e:
                    rows.append((k, getattr(e, "lineno", 1), getattr(e, "colno", 1), getattr(e, "msg", str(e)), text.split("\n")[getattr(e, "lineno", 1) - 1][:120]))
            yield pd.DataFrame(rows, columns=[key, "line", "column", "message", "snippet"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(run, f"`{key}` {kind}, line int, column int, message string, snippet string")


def json_pretty(df: DataFrame, column: str, *, indent: int | None = 2, sort_keys: bool = False) -> DataFrame:
    """SNK11, JSN3: the column formatted (minified with indent None), keys sorted at every depth if asked for; null where it
    isn't JSON."""

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(json.loads((t or "").removeprefix("\ufeff")), ensure_ascii=False, indent=indent, sort_keys=sort_keys, separators=(",", ": " if indent else ":"))
            except ValueError:
                return None

        return texts.map(one)

    return df.withColumn(column, pretty(F.col(column)))


def json_types(df: DataFrame, column: str) -> DataFrame:
    """AGG25, JSN4: path, kind, n: how many values of each kind (null, boolean, number, string, array, object) stand at each place of a column of
    JSON texts. A path's steps are .key and [] (any element), the whole text's is empty. Tables of parts of the rows add up to
    that of all: counts are folded in each task and summed. Texts that aren't JSON have no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in frames:
            for text in pdf.t:
                try:
                    stack = [((), json.loads((text or "").removeprefix("\ufeff")))]
                except (ValueError, RecursionError):
                    continue
                while stack:
                    path, v = stack.pop()
                    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
                    counts[path, kind] += 1
                    if kind == "object":
                        stack += [((*path, f".{k}"), x) for k, x in v.items()]
                    elif kind == "array":
                        stack += [((*path, "[]"), x) for x in v]
        yield pd.DataFrame([(list(p), k, n) for (p, k), n in counts.items()], columns=["path", "kind", "n"])

    parts = df.select(F.col(column).alias("t")).mapInPandas(run, "path array<string>, kind string, n long")
    return parts.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def interfaces(df: DataFrame, column: str, name: str = "Root", *, max_paths: int = 100_000) -> str:
    """JSN4, SNK10: TypeScript interfaces for a column of JSON texts. A place with several kinds is a union, its parts in order; keys that
    not every object of a place has are optional, at any depth; the objects of an array make one interface. Interfaces of one
    name and body are one. Only the table of json_types() reaches the driver, after a check of its size."""
    rows = json_types(df, column).limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} places and kinds: keys that are data make no interface")
    kinds: dict[tuple, dict[str, int]] = {}
    keys: dict[tuple, list[str]] = {}
    for r in rows:
        kinds.setdefault(tuple(r.path), {})[r.kind] = r.n
    for path in kinds:
        if path and path[-1] != "[]":
            keys.setdefault(path[:-1], []).append(path[-1])
    names: dict[str, str] = {}
    blocks: list[str] = []

    def pascal(x: str) -> str:
        parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x)
        return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", parts) if p) or "Item"

    def one(x: str) -> str:
        return re.sub("ies$", "y", x) if x.endswith("ies") else re.sub("es$", "", x) if re.search("(ch|sh|ss|x|s)es$", x) else re.sub("([^s])s$", r"\1", x)

    def declared(path: tuple, hint: str) -> str:
        n, lines = kinds[path]["object"], []
        for step in sorted(keys.get(path, [])):
            key, child = step[1:], (*path, step)
            label = key if re.fullmatch("[A-Za-z_$][A-Za-z0-9_$]*", key) else json.dumps(key, ensure_ascii=False)
            lines.append(f"  {label}{'?' * (sum(kinds[child].values()) < n)}: {union(child, key)};")
        body, label, k = "\n".join(lines), pascal(hint), 2
        while names.get(label, body) != body:
            label, k = f"{pascal(hint)}{k}", k + 1
        if label not in names:
            names[label] = body
            blocks.append(f"export interface {label} {{\n{body}\n}}\n")
        return label

    def union(path: tuple, hint: str) -> str:
        parts = []
        for kind in kinds.get(path, {}):
            if kind == "array":
                inner = union((*path, "[]"), one(hint) if one(hint) != name else f"{name}Item")
                parts.append(f"({inner})[]" if " | " in inner else f"{inner}[]")
            else:
                parts.append(declared(path, hint) if kind == "object" else kind)
        return " | ".join(sorted(parts)) or "unknown"

    root = union((), name)
    return "\n".join(blocks) + ("" if root == pascal(name) else f"export type {pascal(name)} = {root};\n")


def package_findings(documents: DataFrame, required: tuple[str, ...] = ("name", "description", "version")) -> DataFrame:
    """RUL10: doc_id, field, problem (missing, or no version number) of texts that must begin with such fields."""
    fields = front_matter(documents).where(F.col("value") != "")
    wanted = documents.select("doc_id", F.explode(F.array(*map(F.lit, required))).alias("key"))
    missing = wanted.join(fields, ["doc_id", "key"], "left_anti").select("doc_id", F.col("key").alias("field"), F.lit("missing").alias("problem"))
    wrong = fields.where("key = 'version'").where(~F.col("value").rlike(r"^\d+\.\d+\.\d+$"))
    return missing.unionByName(wrong.select("doc_id", F.col("key").alias("field"), F.lit("version").alias("problem")))


#: Fields that a package must have, and should have.
PACKAGE_FIELDS = ("name", "description", "description_zh", "description_en", "version", "author")
RECOMMENDED_FIELDS = ("category", "scenarios", "roles")


def package_report(packages: DataFrame, *, required: tuple[str, ...] = PACKAGE_FIELDS, recommended: tuple[str, ...] = RECOMMENDED_FIELDS) -> DataFrame:
    """RUL10: package, level, field, problem of packages (package: its folder's name, text: its head file, null if it has none, which is the
    only finding then): E missing and version (not of three numbers), W missing (recommended) and folder (its name is another). Of a
    repeated field the first counts; quotes go. One map over the texts, whose heads are cut out once."""
    head = F.regexp_extract(F.regexp_replace("text", "\r", ""), r"(?s)\A(?:.*?\n)??---[ \t]*(?=\n|\z)(.*?)(?:\n---[ \t]*(?=\n|\z)|\z)", 1)
    value = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_extract("_head", rf"\n{re.escape(k)}:[ \t]*([^\n]*)", 1), "[\"']", ""), r"\s+$", "")
    fields = {k: f"_v{n}" for n, k in enumerate(dict.fromkeys((*required, *recommended, "version", "name")))}
    heads = packages.select("package", F.col("text").isNull().alias("_none"), head.alias("_head"))
    read = heads.select("package", "_none", *[value(k).alias(v) for k, v in fields.items()])
    of = lambda k: F.col(fields[k])
    finding = lambda when, level, field, problem: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(problem).alias("problem")))
    rules = [finding(of(k) == "", level, k, "missing") for level, ks in (("E", required), ("W", recommended)) for k in ks]
    rules.append(finding((of("version") != "") & ~of("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), "E", "version", "version"))
    rules.append(finding((of("name") != "") & (of("name") != F.col("package")), "W", "name", "folder"))
    found = F.when(F.col("_none"), F.array(finding(F.lit(True), "E", "file", "missing"))).otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return read.select("package", F.explode(found).alias("x")).select("package", "x.*")


def package_tree_findings(files: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """RUL10: package, problem of the file lists (package, path within it) of packages: deep (more than one folder below the
    root), junk (.DS_Store); with versions (package, version, old_version, altered) also stale: altered without a new version."""
    deep = files.where(F.size(F.split("path", "/")) > 2).select("package", F.lit("deep").alias("problem"))
    junk = files.where(F.col("path").rlike(r"(^|/)\.DS_Store$")).select("package", F.lit("junk").alias("problem"))
    out = deep.union(junk)
    if versions is not None:
        out = out.union(versions.where(F.col("altered") & F.col("version").eqNullSafe(F.col("old_version"))).select("package", F.lit("stale").alias("problem")))
    return out.distinct()
