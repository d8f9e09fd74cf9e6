"""Column references by name, position or meaning (PRJ1, PRJ2, JN3, STR4), resolved while a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def resolve(df: DataFrame, ref: str | int) -> str:
    """Exact name, then 1-based position, then name without regard to case."""
    names = df.columns
    if ref in names:
        return ref
    if str(ref).isdigit() and 1 <= int(ref) <= len(names):
        return names[int(ref) - 1]
    for n in names:
        if n.lower() == str(ref).lower():
            return n
    raise KeyError(f"no column {ref!r}; there are: {', '.join(names)}")


def plain_name(name: str) -> str:
    """A header without blanks, brackets and colons, in lower case."""
    return re.sub(r"[\s()（）\[\]【】:：]", "", name).lower()


def resolve_meaning(df: DataFrame, aliases: list[str]) -> str | None:
    """The column whose plain name is one of the aliases, else the first that contains one."""
    plain = {c: plain_name(c) for c in df.columns}
    wanted = [plain_name(a) for a in aliases]
    for a in wanted:
        for c, p in plain.items():
            if p == a:
                return c
    for a in wanted:
        for c, p in plain.items():
            if a in p:
                return c
    return None


def column_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Names only in a, names only in b."""
    return [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]
