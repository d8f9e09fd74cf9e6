"""Personal data, credentials and word lists in text (RUL4-RUL8, TXT1-TXT7, JN13, AGG22, AGG23).

Counts and findings are regular expressions in the JVM over lines or whole texts. Spans of several types, whose overlaps have to
be settled, come from a small Arrow function for each batch of texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from datetime import date
from hashlib import sha256

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import CREDIT_ALPHABET, ID_CHECKS, ID_WEIGHTS, credit_code, id_number, ipv4, luhn
from ..functions.text import FULL, HALF, half_width

_A, _Z = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: Shapes of personal data; and what decides about a match.
PII = {
    "idcard": (r"[0-9]{17}[0-9Xx]", id_number),
    "phone": (r"1[3-9][0-9]{9}", None),
    "bank": (r"[0-9]{16,19}", luhn),
    "uscc": (r"[0-9A-HJ-NP-RT-Ya-hj-np-rt-y]{18}", credit_code),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", None),
    "plate": (r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4,6}", None),
    "ipv4": (_A + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _Z, ipv4),
}
#: What every text with a match of that type has.
_TRACES = {"idcard": "[0-9]{17}", "bank": "[0-9]{16}", "uscc": "(?<![0-9A-Za-z])[0-9A-Za-z]{18}", "email": "@", "plate": "[一-鿿][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4}", "ipv4": r"[0-9]\.[0-9]"}
DEFAULT_PII = ("idcard", "phone", "bank", "email", "plate", "ipv4")
#: What stands for a secret without being one.
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*{3,}|(?:your|my|the|some)(?:[-_]\w*)?|example\w*|placeholder|changeme|<[^>]*>|\{\{?\w*\}?\}?|todo|\.{3,}|null|none|test|dummy|sample|\$\{[^}]*\}|\$[A-Z_]+|process\.env\S*)", re.I | re.A)
_B = r"(?a:\b)"
#: Fixed values, rule: shape, level, and a cheap pattern that every text with a match has.
LEAKS = {
    "aws_ak": (_B + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _B, "high", "AKIA|ASIA"),
    "aliyun_ak": (_B + r"LTAI[A-Za-z0-9]{16,24}" + _B, "high", "LTAI"),
    "tencent_ak": (_B + r"AKID[A-Za-z0-9]{32}" + _B, "high", "AKID"),
    "github_token": (_B + r"gh[pousr]_[A-Za-z0-9]{36,255}" + _B, "high", "gh[pousr]_"),
    "slack_token": (_B + r"xox[baprs]-[A-Za-z0-9-]{10,}" + _B, "high", "xox[baprs]-"),
    "private_key": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "high", "PRIVATE KEY-----"),
    "jwt": (_B + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}" + _B, "medium", "eyJ"),
    "db_url": (_B + r"(?i:[a-z][a-z0-9+.-]*://[^\s:@/]+:[^\s@/]+@[^\s/]+)", "high", "://"),
    "generic_secret": (_B + r"(?i:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|token|auth)" + _B + r"\s*[:=]\s*[\"']?[^\s\"'`,;)]{6,64}", "medium", "(?i:password|passwd|secret|key|token|auth)\\s*[:=]"),
    "idcard": (_B + r"[0-9]{17}[0-9Xx]" + _B, "high", "[0-9]{17}"),
    "phone": (_B + r"1[3-9][0-9]{9}" + _B, "medium", "1[3-9][0-9]{9}"),
    "bank": (_B + r"[0-9]{16,19}" + _B, "high", "[0-9]{16}"),
    "email": (_B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + _B, "low", "@"),
}


def chosen_types(spec: str | None = None) -> tuple[str, ...]:
    """PRJ14: types by a list with commas, all of them, or without a list those that are looked for by default."""
    if spec is None or not spec.strip():
        return DEFAULT_PII
    wanted = tuple(dict.fromkeys(x.strip().lower() for x in spec.split(",") if x.strip()))
    if unknown := [x for x in wanted if x not in (*PII, "all")]:
        raise ValueError(f"no type {', '.join(unknown)}; there are: {', '.join(PII)}, all")
    return tuple(PII) if "all" in wanted else wanted


def pii_counts(documents: DataFrame, types: tuple[str, ...] = DEFAULT_PII, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """TXT1: doc_id and the number of valid matches of each type; overlaps between types are not settled here."""
    def n(kind: str) -> Column:
        shape, valid = PII[kind]
        found = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
        found = F.when(F.col(text).rlike(_TRACES[kind]), found) if kind in _TRACES else found
        return F.coalesce(F.array_size(found if valid is None else F.filter(found, lambda x: F.coalesce(valid(x), F.lit(False)))), F.lit(0)).alias(kind)

    return documents.select(id_column, *[n(k) for k in types])


def _luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def _id_number(s: str) -> bool:
    """id_number() for the Arrow path."""
    if ID_CHECKS[sum(int(c) * w for c, w in zip(s, ID_WEIGHTS, strict=False)) % 11] != s[17].upper() or s[17] == "2":
        return False
    try:
        born = date(int(s[6:10]), int(s[10:12]), int(s[12:14]))
    except ValueError:
        return False
    return 1900 <= born.year and born <= date.today()


def _credit_code(s: str) -> bool:
    """credit_code() for the Arrow path."""
    at = [CREDIT_ALPHABET.find(c) for c in s.upper()]
    return min(at) >= 0 and (31 - sum(x * pow(3, k, 31) for k, x in enumerate(at[:17])) % 31) % 31 == at[17]


_VALID = {"idcard": _id_number, "bank": _luhn, "uscc": _credit_code, "ipv4": lambda s: all(int(x) <= 255 for x in s.split("."))}
_MASKS = {
    "idcard": lambda s: "*" * 14 + s[-4:],
    "phone": lambda s: s[:3] + "****" + s[-4:],
    "bank": lambda s: "*" * (len(s) - 4) + s[-4:],
    "uscc": lambda s: s[:2] + "*" * 12 + s[-4:],
    "email": lambda s: s[0] + "***" + s[s.index("@") :],
    "plate": lambda s: s[:2] + "***" + s[-2:],
    "ipv4": lambda s: ".".join([*s.split(".")[:2], "*", "*"]),
}


def _spans(text: str | None, shapes: dict[str, re.Pattern]) -> list[tuple[str, int, int, str]]:
    hits = [(m.start(), -m.end(), k, m[0]) for k, p in shapes.items() for m in p.finditer(text or "") if _VALID.get(k, bool)(m[0])]
    out, end = [], 0
    for start, neg, kind, value in sorted(hits):  # earliest first, of those the longest
        if start >= end:
            out.append((kind, start, -neg, _MASKS[kind](value)))
            end = -neg
    return out


def pii_spans(documents: DataFrame, types: tuple[str, ...] = DEFAULT_PII) -> DataFrame:
    """TXT1, RUL4, WIN7: doc_id, type, start, stop (characters), line, masked; check digits, birth dates and octets decide what
    counts; overlaps go to the earliest, then longest match."""
    shapes = {k: re.compile(PII[k][0]) for k in types}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for d, t in zip(pdf.doc_id, pdf.text, strict=True):
                line, seen = 1, 0
                for k, a, b, m in _spans(t, shapes):
                    line, seen = line + t.count("\n", seen, a), a
                    rows.append((d, k, a, b, line, m))
            yield pd.DataFrame(rows, columns=["doc_id", "type", "start", "stop", "line", "masked"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, type string, start int, stop int, line int, masked string")


def redacted(documents: DataFrame, types: tuple[str, ...] = DEFAULT_PII, text: str = "text") -> DataFrame:
    """TXT5, SNK9: the documents with the spans of pii_spans masked in their text; other columns as they are."""
    shapes = {k: re.compile(PII[k][0]) for k in types}

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            out, end = [], 0
            for _, a, b, m in _spans(t, shapes):
                out += [t[end:a], m]
                end = b
            return "".join([*out, t[end:]]) if out else t

        return texts.map(one)

    return documents.withColumn(text, masked(F.col(text)))


def redact(text: Column | str, types: tuple[str, ...] = ("email", "phone", "ipv4")) -> Column:
    """TXT5: masks of types that a shape alone decides, one replacement after the other, in the JVM. Types that need a check
    digit or whose overlaps count go through redacted()."""
    c = F.col(text) if isinstance(text, str) else text
    rules = {
        "email": (r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***$2"),
        "phone": (r"(1[3-9][0-9])[0-9]{4}([0-9]{4})", "$1****$2"),
        "plate": (f"({PII['plate'][0][: PII['plate'][0].index(']') + 1]}[A-HJ-NP-Z])[A-HJ-NP-Z0-9]{{2,4}}([A-HJ-NP-Z0-9]{{2}})", "$1***$2"),
        "ipv4": (_A + r"([0-9]{1,3}\.[0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}" + _Z, "$1.*.*"),
    }
    if unknown := [k for k in types if k not in rules]:
        raise ValueError(f"{unknown} need redacted(): a shape alone doesn't decide about them")
    for k in types:
        c = F.regexp_replace(c, *rules[k])
    return c


def _secret(match: str) -> str:
    """The value of an assignment."""
    return re.split(r"[:=]\s*[\"']?", match, maxsplit=1)[1]


def _generic(match: str) -> bool:
    v = _secret(match)
    return not (_PLACEHOLDER.fullmatch(v) or v[-1] in ":=" or re.fullmatch(r"[0-9]+", v) or (re.fullmatch("[a-z]+", v) and len(v) < 12))


#: Which matches of a rule count; of other rules all do.
_LEAK_KEPT = {
    "db_url": lambda m: not _PLACEHOLDER.fullmatch(m.split("@")[0].split("//", 1)[1].split(":", 1)[1]),
    "generic_secret": _generic,
    "idcard": _id_number,
    "bank": _luhn,
    "email": lambda m: not re.search(r"@(?:example|test|localhost|domain)\.", m, re.I),
}


def _starred(s: str) -> str:
    """mask() for the Arrow path."""
    return "*" * len(s) if len(s) <= 8 else s[:4] + "*" * min(12, len(s) - 8) + s[-4:]


def leak_findings(documents: DataFrame, rules: tuple[str, ...] = tuple(LEAKS), *, id_column: str = "doc_id", keep: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """TXT2, TXT7, RUL5, SRT7: id_column (and the columns to keep), line and column (from 1), nth (of the rule, in whose order
    findings are listed), rule, level, masked for each match; placeholders and impossible numbers are left out; with digest also the
    SHA-256 of the whole match. Texts without a trace of any rule stay in the JVM; in the others each rule looks only at the lines around its traces."""
    shapes = [(k, rule, re.compile(LEAKS[rule][0]), LEAKS[rule][1], _LEAK_KEPT.get(rule)) for k, rule in enumerate(rules, 1)]
    hints = [re.compile(LEAKS[rule][2]) for rule in rules]

    def found(text: str) -> Iterator[tuple]:
        for (k, rule, shape, level, kept), hint in zip(shapes, hints, strict=True):
            line, seen, at = 1, 0, hint.search(text)
            while at:  # from trace to trace, a line at a time
                start, stop = text.rfind("\n", 0, at.start()) + 1, text.find("\n", at.start())
                stop = len(text) if stop < 0 else stop
                line, seen = line + text.count("\n", seen, start), start
                for m in shape.finditer(text[start:stop]):
                    if kept is None or kept(m[0]):
                        yield line, m.start() + 1, k, rule, level, _starred(m[0]), *([sha256(m[0].encode()).hexdigest()] if digest else [])
                at = hint.search(text, stop)

    names = [id_column, *keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*ids, *x) for *ids, t in pdf.itertuples(index=False, name=None) for x in found(t)]
            yield pd.DataFrame(rows, columns=[*names, "line", "column", "nth", "rule", "level", "masked", *(["digest"] if digest else [])])

    traced = documents.where(F.col("text").rlike("|".join(f"(?:{LEAKS[r][2]})" for r in rules)))
    kinds = "".join(f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in names)
    return traced.select(*names, "text").mapInPandas(run, f"{kinds}line int, column int, nth int, rule string, level string, masked string{', digest string' if digest else ''}")


#: The rules for secrets; the others are for personal data.
SECRET_RULES = tuple(r for r in LEAKS if r not in ("idcard", "phone", "bank", "email"))


def history_findings(added: DataFrame, rules: tuple[str, ...] = SECRET_RULES) -> DataFrame:
    """TXT7: rule, level, masked, commit, date, author, file, line, commits of each secret that a history (sources.files.added_lines) brought in:
    equal findings are folded to the first commit by date, and commits says how many brought it in. Dates as texts are compared in ISO form."""
    rows = added.withColumn("id", F.struct("commit", "date", "author", "file", F.col("line").alias("at")))
    lines = rows.select(F.to_json("id").alias("doc_id"), "text")
    found = leak_findings(lines, rules, digest=True).withColumn("id", F.from_json("doc_id", "commit string, date string, author string, file string, at int"))
    first = F.min(F.struct("id.date", "id.commit", "id.file", "id.at", "column", "id.author", "masked")).alias("x")
    groups = found.groupBy("rule", "level", "digest").agg(first, F.count_distinct("id.commit").alias("commits"))
    return groups.select("rule", "level", "x.masked", "x.commit", "x.date", "x.author", "x.file", F.col("x.at").alias("line"), "commits")


#: Characters that don't keep a word from being found, and characters of no width.
IGNORED = r"[\s　·•●◆★☆▪▫◾◽。．.,、，;；:：!！?？~～\-_—*＊'\"“”‘’()（）\[\]【】<>《》/\\|@＠#＃❤♥♡♠♣♦]"
ZERO_WIDTH = r"[\u200B-\u200F\u202A-\u202E\uFEFF]"


_DROPPED = "".join(c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c not in "\x1c\x1d\x1e\x1f\x85\xa0" and (re.match(ZERO_WIDTH, c) or re.match(IGNORED.replace(r"\s", " \\t\\n\\x0b\\f\\r"), c)))


def plain_text(text: Column | str) -> Column:
    """STR23: half-width, lower case, without ignorable and zero-width characters; one table for all of it."""
    pairs = [(f, h) for f, h in zip(FULL, HALF, strict=True) if f not in _DROPPED and h not in _DROPPED]
    gone = _DROPPED + "".join(f for f, h in zip(FULL, HALF, strict=True) if h in _DROPPED and f not in _DROPPED)
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.translate(c, "".join(f for f, _ in pairs) + gone, "".join(h for _, h in pairs)))


def word_hits(documents: DataFrame, words: DataFrame, *, normalise: bool = True, max_entries: int = 100_000) -> DataFrame:
    """TXT3, TXT4, JN13: doc_id, category, word, n for each entry (category, word, variants) of a list that a text holds, under
    any of its variants; n adds up the places of each variant that don't overlap. The list goes to the tasks after a check of
    its size; there one automaton finds all variants in one pass over a text, however long the list."""
    prepare = plain_text if normalise else (lambda c: c)
    variants = words.select("category", "word", F.explode(F.array_union(F.array("word"), F.coalesce("variants", F.array()))).alias("v")).withColumn("v", prepare(F.col("v"))).where("v <> ''").distinct()
    listed = variants.limit(max_entries + 1).collect()
    if len(listed) > max_entries:
        raise ValueError(f"a word list of more than {max_entries} entries; split it")
    owners: dict[str, list[tuple[str, str]]] = {}
    for r in listed:
        owners.setdefault(r.v, []).append((r.category, r.word))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for v in owners:
            automaton.add_word(v, v)
        if owners:
            automaton.make_automaton()
        for pdf in frames:
            rows = []
            for d, t in zip(pdf.doc_id, pdf.t, strict=True):
                free: dict[str, int] = {}
                counts: Counter = Counter()
                for stop, v in automaton.iter(t) if owners else ():
                    if stop - len(v) >= free.get(v, -1):
                        free[v] = stop
                        counts.update(owners[v])
                rows += [(d, *owner, n) for owner, n in counts.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "category", "word", "n"])

    texts = documents.select("doc_id", prepare(F.col("text")).alias("t")).where("t is not null")
    return texts.mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, category string, word string, n long")


def clause_coverage(documents: DataFrame, clauses: DataFrame, *, max_clauses: int = 10_000) -> DataFrame:
    """AGG22: doc_id, clause, required, hits, line (of the first hit), sample (up to three keywords that are there), missing for
    each clause (clause, required, keywords) of a contract profile, which goes to the tasks after a check of its size. There one
    automaton finds the keywords of all clauses in one pass over a text. A keyword's places don't overlap; a null text has none."""
    profile = clauses.select("clause", "required", "keywords").limit(max_clauses + 1).collect()
    if len(profile) > max_clauses:
        raise ValueError(f"a profile of more than {max_clauses} clauses; split it")
    profile = [(c, r, [k for k in ks or [] if k]) for c, r, ks in profile]
    words = {k for *_, ks in profile for k in ks}

    def review(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple]:
        n, first, free = Counter(), {}, {}
        for stop, k in automaton.iter(text) if words else ():
            start = stop + 1 - len(k)
            if start >= free.get(k, 0):
                free[k] = stop + 1
                n[k] += 1
                first.setdefault(k, start)
        ends = [m.start() for m in re.finditer("\n", text)] if n else []
        for clause, required, keywords in profile:
            there = [k for k in keywords if k in n]
            hits = sum(n[k] for k in there)
            line = bisect_left(ends, min(first[k] for k in there)) + 1 if there else None
            yield clause, required, hits, line, there[:3], bool(required) and not hits

    names = ["doc_id", "clause", "required", "hits", "line", "sample", "missing"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for k in words:
            automaton.add_word(k, k)
        if words:
            automaton.make_automaton()
        for pdf in frames:
            rows = []
            for d, t in zip(pdf.doc_id, pdf.t, strict=True):
                rows += [(d, *x) for x in review(t, automaton)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names).astype({"line": "Int32"})
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"line": "Int32"})

    texts = documents.select("doc_id", F.coalesce(half_width("text"), F.lit("")).alias("t"))
    return texts.mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, clause string, required boolean, hits long, line int, sample array<string>, missing boolean")


def placeholders(documents: DataFrame) -> DataFrame:
    """TXT6: doc_id and the blanks left to fill in."""
    shape = r"[_＿]{2,}|[（(]\s*[）)]|[【\[]\s*[】\]]|待填|TBD|待定"
    return documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(shape), F.lit(0))).alias("nth", "found"))


def party_pairs(documents: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """AGG23: doc_id, pair, status (both, single) of the party names a text holds."""
    state = [F.struct(F.lit(f"{a}/{b}").alias("pair"), F.when(F.contains("text", F.lit(a)) & F.contains("text", F.lit(b)), "both").when(F.contains("text", F.lit(a)) | F.contains("text", F.lit(b)), "single").alias("status")) for a, b in pairs]
    return documents.select("doc_id", F.explode(F.filter(F.array(*state), lambda x: x.status.isNotNull())).alias("x")).select("doc_id", "x.*")
