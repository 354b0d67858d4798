"""Blocks of a script, and a text with its blocks put in a given order.

A block is the outermost object under one of the given keywords.  It begins with
its keyword's line, or with the comment lines directly above, and ends with its
closing brace and the rest of that line if that is blank or a comment.  A text
stays as it is if its blocks can't be told apart safely: shared lines, an id
that is missing, not on a line of its own, or found twice.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.script import Tree, Unreadable, scan

_ID_LINE = re.compile(rb"^[ \t]*id\s*=\s*\"?[^\s{\"#]+\"?[ \t]*(?:#[^\r\n]*)?\r?$", re.M)
_COMMENT = re.compile(rb"\s*#")
_LINE_REST = re.compile(rb"[ \t]*(?:#[^\r\n]*)?(?=\r?\n|\r?\Z)")
_LINE_END = re.compile(rb"[ \t]*\r?\n|")


class Block(NamedTuple):
    start: int
    end: int
    id: str | None


def find(text: str, keywords: tuple[str, ...], tree: Tree | None = None) -> list[Block] | None:
    """Blocks in order of place; None if they can't be moved safely.  ``tree``: the text's, if it is parsed already."""
    tree = tree or scan(text)
    data = tree.data
    tops: list[int] = []
    inside: set[int] = set()
    ids: dict[int, str] = {}
    outermost: set[int] = set()
    for n, (parent, key, scalar) in enumerate(zip(tree.parent, tree.key, tree.scalar, strict=True)):
        if parent in outermost and key == "id" and scalar is not None:
            ids[parent] = scalar
        if scalar is not None:
            continue
        if parent in inside or parent in outermost:
            inside.add(n)
        elif key in keywords:
            outermost.add(n)
            tops.append(n)
    out: list[Block] = []
    for n in tops:
        begin, close = tree.start[n], tree.end[n]
        line = data.rfind(b"\n", 0, begin) + 1
        if data[line:begin].strip():
            return None
        start = line
        while start:
            above = data.rfind(b"\n", 0, start - 1) + 1
            if not _COMMENT.match(data, above, start - 1):
                break
            start = above
        rest = _LINE_REST.match(data, close)
        end = close
        if rest:
            end = rest.end() if rest[0].strip() else end
            end = _LINE_END.match(data, end).end()
        if out and start < out[-1].end:
            return None
        body = data[line:end]
        out.append(Block(start, end, ids.get(n) if _ID_LINE.search(body) else None))
    return [b for b in out if b.id is not None]


def reorder(text: str, blocks: list[Block], ordered: list[str]) -> str:
    """Puts the block with the i-th id into the i-th slot; blank gaps become one empty line, others stay in place."""
    if not blocks or len(blocks) != len(ordered):
        return text
    data = text.encode()
    by_id = {b.id: b for b in blocks}
    if len(by_id) != len(blocks) or set(by_id) != set(ordered):
        return text
    newline = b"\r\n" if b"\r\n" in data else b"\n"
    out = [data[: blocks[0].start]]
    for slot, name in enumerate(ordered):
        own = by_id[name]
        out += [data[own.start : own.end].rstrip(b"\r\n"), newline]
        if slot + 1 < len(blocks):
            gap = data[blocks[slot].end : blocks[slot + 1].start]
            out.append(gap if gap.strip() else newline)
    out.append(data[blocks[-1].end :])
    return b"".join(out).decode()


def in_order(text: str, tree: Tree | None, ordered: list[str], keywords: tuple[str, ...]) -> str:
    """``text`` with its blocks in the order of the ids; unchanged where that isn't safe."""
    found = find(text, keywords, tree) if tree and ordered else None
    return reorder(text, found, ordered) if found else text


def rewritten(text: Column, ordered: Column, keywords: tuple[str, ...]) -> Column:
    """``text`` with its blocks in the order of the ids; unchanged where that isn't safe."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, orders: pd.Series) -> pd.Series:
        out = []
        for t, ids in zip(texts, orders, strict=True):
            try:
                found = find(t, keywords) if ids is not None and len(ids) else None
            except Unreadable:
                found = None
            out.append(reorder(t, found, list(ids)) if found else t)
        return pd.Series(out)

    return run(text, ordered)
