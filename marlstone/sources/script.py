"""Nested key/value scripts as one flat relation of nodes.

Choices where the format is loose: quoted text has no escapes; a stray closing
brace is ignored; an unclosed brace or quote makes the file unreadable, and it
gives no nodes.  Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NODES = "path string, node_id int, parent_id int, depth int, ord int, key_path array<string>, ids array<int>, key string, kind string, scalar string, start long, end long, hit long, key_hit long"
#: A batch goes back to Spark after so many rows, or the rows of so many files or bytes of text; a file's own rows stay together.
BATCH_ROWS = 8192
BATCH_FILES = 256
BATCH_BYTES = 1 << 22
#: Spark bounds the rows of a batch it hands over, but hardly their bytes; so a text goes over in pieces of at most so many bytes.
PIECE = 1024

_BOM = b"\xef\xbb\xbf"
_SKIP = rb"[\s;]*+(?:\#[^\r\n]*+[\s;]*+)*+"
_WORD = rb"""(?:"[^"]*+"|(?:[^\s;{}=<>\#"!?]++|[!?](?!=))++)"""
_OP = rb"(?:[<>=!?]=|[<>=])"
_REST = re.compile(_SKIP)
# One node or closing brace a match; an operator without a word before it is passed over.
_STATEMENT = re.compile(
    rb"%(skip)s(?:(?P<word>%(word)s)%(skip)s(?:(?:%(op)s%(skip)s)++(?:(?P<value>%(word)s)|(?P<named>\{)|(?P<none>))|(?P<bare>\{)|)|(?P<close>\})|(?P<open>\{)|%(op)s)"
    % {b"skip": _SKIP, b"word": _WORD, b"op": _OP}
)
_LONE, _VALUE, _NAMED, _NONE, _BARE, _CLOSE, _OPEN = (_STATEMENT.groupindex[x] for x in ("word", "value", "named", "none", "bare", "close", "open"))


class Unreadable(ValueError):
    pass


class Tree(NamedTuple):
    """A file's bytes and its nodes in document order, a list for each field; -1 is above the first level, an object has no scalar."""

    data: bytes
    parent: list[int]
    key: list[str | None]
    scalar: list[str | None]
    start: list[int]
    end: list[int]


def _text(word: bytes) -> str:
    return (word[1:-1] if word[0] == 34 else word).decode()


def scan(text: str) -> Tree:
    """Nodes in document order; an object's ``end`` is after its closing brace."""
    data = text.encode()
    tree = Tree(data, [], [], [], [], [])
    parents, keys, scalars, starts, ends = tree[1:]
    above = [-1]
    at = len(_BOM) if data.startswith(_BOM) else 0
    for m in iter(_STATEMENT.scanner(data, at).match, None):
        at = m.end()
        what = m.lastindex
        if what == _VALUE:
            parents.append(above[-1])
            keys.append(_text(m[_LONE]))
            scalars.append(_text(m[_VALUE]))
            starts.append(m.start(_LONE))
            ends.append(at)
        elif what == _CLOSE:
            if len(above) > 1:
                ends[above.pop()] = at
        elif what == _NAMED or what == _BARE or what == _OPEN:
            node = len(parents)
            parents.append(above[-1])
            # `name {` without an operator still names the object.
            keys.append(None if what == _OPEN else _text(m[_LONE]))
            scalars.append(None)
            starts.append(m.start(_OPEN if what == _OPEN else _LONE))
            ends.append(at)
            above.append(node)
        elif what == _LONE:
            # A word that no operator followed was a value.
            word = _text(m[_LONE])
            parents.append(above[-1])
            keys.append(None)
            scalars.append(word)
            starts.append(m.start(_LONE))
            ends.append(m.start(_LONE) + len(word.encode()))
    at = _REST.match(data, at).end()
    if at < len(data):
        raise Unreadable(f"byte {at}")
    if len(above) > 1:
        raise Unreadable("unclosed brace")
    return tree


def parse(text: str) -> list[dict]:
    """The nodes of ``scan`` with their paths, each a dict."""
    return _described(scan(text))


def _described(tree: Tree) -> list[dict]:
    out: list[dict] = []
    top = {"node_id": -1, "depth": -1, "key_path": [], "ids": [], "count": 0}
    for k, (parent, key, scalar, start, end) in enumerate(zip(*tree[1:], strict=True)):
        over = out[parent] if parent >= 0 else top
        out.append({"node_id": k, "parent_id": parent, "depth": over["depth"] + 1, "ord": over["count"], "key_path": [*over["key_path"], key or ""], "ids": [*over["ids"], k], "key": key, "kind": "object" if scalar is None else "scalar", "scalar": scalar, "start": start, "end": end, "count": 0})
        over["count"] += 1
    return out


def hit(tree: Tree, what: str, second: bool = False) -> int:
    """The bytes before the first occurrence anywhere in the text, which need not be a node, or before the one after it if there is one."""
    word = what.encode()
    at = max(tree.data.find(word), 0)
    return max(tree.data.find(word, at + len(word)), at) if second else at


def pieces(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, *carry, last, piece): the texts' bytes in pieces, those of a file one after the other."""
    size = F.octet_length("text")
    # The bytes are bound once, so that a piece costs its own length and not the whole text's.
    cut = F.transform(
        F.array(F.col("text").cast("binary")),
        lambda b: F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(PIECE)), lambda at: F.struct((at + PIECE > size).alias("last"), F.substring(b, at, F.lit(PIECE)).alias("piece"))),
    )
    return files.select("path", *carry, F.inline(F.get(cut, F.lit(0))).alias("last", "piece"))


def per_file(files: DataFrame, fields: str, rows: Callable[..., Iterable[tuple]], carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, *fields, *carry): the rows that ``rows(text, tree, *carried)`` gives of each file (path, text).

    ``tree`` is None for an unreadable file.  Parsed nodes live no longer than their file's turn, texts come in pieces
    and rows go out in bounded batches, so that memory follows the largest file and neither how many nor how long all are.
    """
    kind = T.StructType([files.schema["path"], *T.StructType.fromDDL(fields), *(files.schema[c] for c in carry)])
    schema = to_arrow_schema(kind)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], kind.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        parts: list[bytes] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_FILES):
                for *file, last, piece in zip(*(c.to_pylist() for c in batch.slice(at, BATCH_FILES).columns), strict=True):
                    parts.append(piece)
                    if last:
                        yield b"".join(parts), *file
                        parts = []
            # The next one comes in before this name is bound again.
            del batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        n_files = n_bytes = 0
        for data, path, *carried in whole(batches):
            text = data.decode()
            try:
                tree = scan(text)
            except Unreadable:
                tree = None
            out += [(path, *row, *carried) for row in rows(text, tree, *carried)]
            n_files, n_bytes = n_files + 1, n_bytes + len(data)
            if len(out) >= BATCH_ROWS or n_files >= BATCH_FILES or n_bytes >= BATCH_BYTES:
                if out:
                    yield made(out)
                out, n_files, n_bytes = [], 0, 0
        if out:
            yield made(out)

    return pieces(files, carry).mapInArrow(run, kind)


def nodes(files: DataFrame, hits: tuple[str, ...] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of files (path, text); unreadable files give none.

    ``ids`` are the node ids along ``key_path``.  For nodes under a top key of ``hits``,
    ``hit`` and ``key_hit`` are the bytes before the first occurrence of the scalar and of
    the key anywhere in the text, which need not be the node itself.  Columns to ``carry``
    come along from the file.
    """

    names = [f.name for f in T.StructType.fromDDL(NODES)][1:]

    def rows(text: str, tree: Tree | None, *carried: object) -> Iterator[tuple]:
        places: dict[str, int] = {}
        for n in _described(tree) if tree else ():
            wanted = hits is not None and n["key_path"][0] in hits
            for to, what in (("hit", n["scalar"]), ("key_hit", n["key"])):
                if not wanted or what is None:
                    n[to] = None
                    continue
                if what not in places:
                    places[what] = hit(tree, what)
                n[to] = places[what]
            yield tuple(n[x] for x in names)

    return per_file(files, NODES.partition(", ")[2], rows, carry)
