"""Version requirements: ``*``, ``1.2.*``, ``=``, ``^``, ``~``, comparators, and lists with commas.

A bare version means ``^``.  A prerelease matches only if a comparator names a
prerelease of the same three numbers.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = re.compile(r"^(\d+)\.(\d+)\.(\d+)(?:\.\d+)?(?:-([0-9A-Za-z.-]+))?$")
_PART = re.compile(r"^(=|\^|~|>=|<=|>|<)?\s*([0-9]+|[*xX])(?:\.([0-9]+|[*xX]))?(?:\.([0-9]+|[*xX]))?(?:-([0-9A-Za-z.-]+))?$")


class Comparator(NamedTuple):
    op: str
    numbers: tuple[int, ...]
    pre: str


def _pre_key(pre: str) -> tuple:
    """Orders prereleases; none is above all."""
    if not pre:
        return (1,)
    return (0, *((0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split(".")))


def parse_version(text: str) -> tuple[tuple[int, int, int], str] | None:
    m = _VERSION.match(text)
    return ((int(m[1]), int(m[2]), int(m[3])), m[4] or "") if m else None


def parse_requirement(text: str) -> list[Comparator] | None:
    """Comparators that all must hold; None if it is no requirement."""
    out = []
    for part in text.split(","):
        m = _PART.match(part.strip())
        if not m:
            return None
        raw = [x for x in m.groups()[1:4] if x is not None]
        wild = [k for k, x in enumerate(raw) if x in "*xX"]
        if wild and any(x not in "*xX" for x in raw[wild[0] :]):
            return None
        numbers = tuple(int(x) for x in raw[: wild[0] if wild else None])
        if m[5] and len(numbers) < 3:
            return None
        out.append(Comparator(m[1] or ("*" if wild else "^"), numbers, m[5] or ""))
    return out


def _holds(c: Comparator, numbers: tuple[int, int, int], pre: str) -> bool:
    n = len(c.numbers)
    head = numbers[:n]
    full = n == 3
    here, there = (numbers, _pre_key(pre)), ((*c.numbers, *(0,) * (3 - n)), _pre_key(c.pre))
    if c.op in ("*", "="):
        return head == c.numbers and (not full or c.op == "*" or pre == c.pre)
    if c.op == ">":
        return here > there if full else head > c.numbers
    if c.op == ">=":
        return here >= there if full else head >= c.numbers
    if c.op == "<":
        return here < there if full else head < c.numbers
    if c.op == "<=":
        return here <= there if full else head <= c.numbers
    if here < there and full or not full and head < c.numbers:
        return False
    if c.op == "~":
        return numbers[: min(n, 2)] == c.numbers[:2]
    # A caret keeps the numbers up to the first that isn't zero.
    keep = next((k + 1 for k, x in enumerate(c.numbers) if x), n)
    return numbers[:keep] == c.numbers[:keep]


def matches(requirement: str, version: str) -> bool | None:
    """Whether the version meets the requirement; None if either can't be read."""
    cs, v = parse_requirement(requirement), parse_version(version)
    if cs is None or v is None:
        return None
    numbers, pre = v
    if pre and not any(c.pre and c.numbers == numbers for c in cs):
        return False
    return all(_holds(c, numbers, pre) for c in cs)


def requirement_matches(requirement: Column, version: Column) -> Column:
    """Null where either can't be read."""

    @F.pandas_udf("boolean")
    def run(rs: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or v is None else matches(r, v) for r, v in zip(rs, vs, strict=True)], dtype=object)

    return run(requirement, version)
