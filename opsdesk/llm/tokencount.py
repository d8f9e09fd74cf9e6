"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

A sequence of byte-pair tokens is the encoding of its bytes exactly if each pair of neighbours is the encoding of its
own bytes. So the last token of each prefix of a piece (a stretch between the pre-tokeniser's cuts) is the one token
that ends there and may follow the last token of what precedes it, and its count is one more than theirs. Pieces recur:
the counts at all prefixes of each are worked out once for each Python worker and kept, up to ``_KEEP`` pieces; those
of a text are put together from its pieces'.

The counts are those of the tokenizers library for the same file, without added special tokens; an added string inside
a text counts as one token, as by the library's default. ``prefix_table`` stores the counts at every prefix of every
text, as the steps from each to the next (mostly one byte a character, of few values), and ``token_counts`` answers size, truncation and budget
from that table, without splitting or encoding anything again; ``prefix_counts`` gives them as arrays.
A file with another pre-tokeniser, a normaliser or added strings with rules of their own is refused.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; texts of any length
are processed whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_KEEP = 1_000_000
#: Stands between pieces; no token holds it.
_GAP = chr(256)
_SPACE = regex.compile(r"\s")
#: Common last characters of pieces that are no blanks.
_BLACK = frozenset("abcdefghijklmnopqrstuvwxyz.,")
_ROWS = 256  # of one frame with counts for every character


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of the prefixes of texts under one byte-level tokenizers file."""

    #: The pre-tokeniser's fixed pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        self.tokens: dict[bytes, int] = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {tuple(bytes(byte[c] for c in x) for x in m): k for k, m in enumerate(merges)}
        self.names = {i: t for t, i in self.tokens.items()}
        self.ending = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.ending.add_word(t.decode("latin-1"), (len(t), i))
        self.ending.make_automaton()
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level files with the usual pattern and no normaliser are counted")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added strings with rules of their own")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(self.PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes | list[int]] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """The encoding of a short byte string by applying the merges in order."""
        parts, rank, none = [data[i : i + 1] for i in range(len(data))], self.rank.get, 1 << 30
        while len(parts) > 1:
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == none:
                break
            best = ranks.index(least)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _follows(self, a: int, b: int) -> bool:
        if len(self.pairs) > 4 * _KEEP:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        known = self.pairs[a << 20 | b] = self._merge(x + y) == [x, y]
        return known

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """For each piece, counts[k]: tokens of its first k bytes. One pass over all tokens that end at each byte."""
        data = [p.encode("utf-8", "surrogatepass").decode("latin-1") for p in pieces]
        text = _GAP.join(data)
        counts, last, pairs = [0] * (len(text) + 1), [-1] * (len(text) + 1), self.pairs
        for end, (size, token) in self.ending.iter(text):
            end += 1
            if last[end] < 0:  # exactly one of the tokens that end here fits
                before = last[end - size]
                if before >= 0:
                    fits = pairs.get(before << 20 | token)
                    if not (self._follows(before, token) if fits is None else fits):
                        continue
                last[end], counts[end] = token, counts[end - size] + 1
        out, at = [], 0
        for d in data:
            out.append(counts[at : at + len(d) + 1])
            at += len(d) + 1
        return out

    def learn(self, pieces: set[str]) -> None:
        """Tokens of the first 1, 2, ... characters of each piece: as bytes, or a list where 255 is too little."""
        if len(self.kept) > _KEEP:
            self.kept.clear()
        order = list(pieces)
        for piece, counts in zip(order, self.pieces(order), strict=True):
            if len(counts) > len(piece) + 1:  # at the ends of characters only
                counts = [0, *np.array(counts)[np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])].tolist()]
            self.kept[piece] = bytes(counts[1:]) if max(counts) < 256 else counts[1:]  # a prefix may have more than the whole

    def total(self, piece: str) -> int:
        """Tokens of a whole piece."""
        if piece not in self.kept:
            self.learn({piece})
        return int(self.kept[piece][-1])

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text, and whether each is a special string."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def _plain(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text without added strings, the empty one first."""
        pieces = self.split(text)
        if not pieces:
            return np.zeros(1, np.int64)
        parts = list(map(self.kept.get, pieces))
        if None in parts:
            self.learn({p for p, known in zip(pieces, parts, strict=True) if known is None})
            parts = [self.kept[p] if known is None else known for p, known in zip(pieces, parts, strict=True)]
        try:
            inside = np.frombuffer(b"".join(parts), np.uint8)
        except TypeError:
            inside = np.concatenate([np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.array(x) for x in parts])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        total = inside[end - 1].astype(np.int64)
        base = np.cumsum(total) - total
        out = np.empty(len(text) + 1, np.int64)
        out[0], out[1:] = 0, inside + np.repeat(base, size)
        for k, piece in enumerate(pieces):
            if piece[0] == "'" and piece[1:2].isalpha():
                # A cut contraction is a quote mark and letters of their own.
                for j in range(2, len(piece)):
                    out[end[k] - size[k] + j] = base[k] + self.total("'") + self.total(piece[1:j])
            if piece[-1] not in _BLACK and k + 1 < len(pieces) and _SPACE.match(piece[-1]) and _SPACE.match(pieces[k + 1][0]):
                # The last blank of a run belongs to the piece that follows, unless the text ends right after it.
                out[end[k] + 1] = base[k] + self.total(piece + pieces[k + 1][0])
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """counts[k]: tokens of the first k characters, as the library gives them for that prefix alone."""
        if not (self.special and self.special.search(text)):
            return self._plain(text)
        out, base, before = [np.zeros(1, np.int64)], 0, ""
        for x, special in self.segments(text):
            if special:
                partial = self._plain(before + x[:-1])
                out.append(np.append(base - partial[len(before)] + partial[len(before) + 1 :], base + 1))
                base, before = base + 1, ""
            else:
                counts = self._plain(x)
                out.append(base + counts[1:])
                base, before = base + int(counts[-1]), x
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker."""
    return PrefixCounter(path)


def prefix_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and counts, the tokens of the first 0, 1, 2, ... characters of each text. Written as a table, it
    answers any later question on truncation and budgets.

    path: a byte-level tokenizers file at the same place on every machine."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for pdf in frames:
            for a in range(0, len(pdf), _ROWS):
                part = pdf[a : a + _ROWS]
                texts = [t or "" for t in part.text]
                yield pd.DataFrame({"doc_id": part.doc_id, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "counts": [c.prefixes(t).astype(np.int32) for t in texts]})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, counts array<int>")


def packed(counts: np.ndarray) -> bytes:
    """The steps between neighbouring counts, after one byte that tells the bytes of each."""
    steps = np.diff(counts)
    most = int(np.abs(steps).max(initial=0))
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpacked(steps: bytes) -> np.ndarray:
    return np.append(0, np.cumsum(np.frombuffer(steps, f"<i{steps[0]}", offset=1), dtype=np.int64))


def prefix_table(documents: DataFrame, path: str) -> DataFrame:
    """A written table of doc_id, n_bytes, n_tokens and steps, from which unpacked() gives the tokens of the first 0, 1, 2, ...
    characters of each text. path as for prefix_counts."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for pdf in frames:
            for a in range(0, len(pdf), _ROWS):
                part = pdf[a : a + _ROWS]
                texts = [t or "" for t in part.text]
                counts = [c.prefixes(t) for t in texts]
                yield pd.DataFrame({"doc_id": part.doc_id, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [int(x[-1]) for x in counts], "steps": [packed(x) for x in counts]})

    return cut(documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, steps binary"))


def fitting_chars(limit: int) -> Column:
    """Over prefix_counts: the characters of the longest prefix of at most ``limit`` tokens."""
    return F.expr(f"if(element_at(counts, -1) <= {int(limit)}, size(counts) - 1, array_max(transform(counts, (x, i) -> if(x <= {int(limit)}, i, 0))))")


def token_counts(documents: DataFrame, path: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix within the limit), all read from
    prefix_table."""
    return answered(prefix_table(documents, path), limit=limit)


def answered(table: DataFrame, *, limit: int = 1024) -> DataFrame:
    """token_counts for a prefix_table."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            over = pdf.n_tokens > limit
            fits = [int(np.flatnonzero(unpacked(x) <= limit)[-1]) if more else (len(x) - 1) // x[0] for x, more in zip(pdf.steps, over, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": pdf.n_bytes, "n_tokens": pdf.n_tokens, "over_limit": over, "fit_chars": fits})

    return table.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
