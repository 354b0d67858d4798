"""Byte-level BPE as a streaming transducer with bounded lookahead.

Splitting.  A text is cut into pieces by the published rule, slab by slab: a piece
is taken once it ends ``PEEK`` characters before the slab's end, the furthest that
the rule looks, and the next slab goes on behind it.

Encoding.  A merge at the right end of a token can only be prevented or caused
by merges of lower rank to its right, which in turn depend on still lower ranks
further right.  ``sufficient_lookahead`` follows those chains through the merge
list and returns how many bytes beyond a token settle it.  The transducer reads a
piece's bytes chunk by chunk into one window, merges it, emits every token that
ends at least that many bytes before the window's end, and goes on from the last
one emitted.  That is right since a token sequence's suffix from any token boundary
is itself the encoding of its text.  Every id comes from the transducer; what it
gave for a short piece is remembered in a table of bounded size.

Decoding.  Ids become bytes, and an incremental decoder turns them into text
block by block; a character cut by a block's end waits for its rest, and bytes
that are no UTF-8 become U+FFFD as in the usual lossy decoding.

Beside the text itself, which its row holds, memory is constant: ids go to the
digest and to the decoder in blocks of ``BLOCK_BYTES`` or so, whatever the text's
length and however long a piece without blanks is.  Only ``encode`` and ``decode``
hold a row's ids, as they return them.

Defined results: a null text is encoded as an empty one (no ids).  Special
tokens found in a text become their ids.  Rows are handled alone, so repeats,
ties and empty tables need no care; very long texts are read whole; extra columns
pass through ``encode`` and ``decode``, and one that is named as the result is
replaced by it.  ``digests`` gives its four columns alone.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches

#: Entries of the older and of the newer table of short pieces.
REMEMBERED = 250_000
#: Characters of a piece beyond which it isn't remembered.
SHORT = 48
#: Characters split at once, and how far the splitting rule looks beyond a piece.
SLAB = 1 << 16
PEEK = 3
#: Bytes of packed ids handed on at once, about.
BLOCK_BYTES = 1 << 18

# White space, and letters and numbers below U+0250, as character classes.
SPACE = r"\t-\r \x85\xa0  -     　"
LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")


def _pattern(letters: str, numbers: str) -> str:
    """The published splitting rule of byte-level BPE, over given classes."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


_LATIN = re.compile(_pattern(LATIN_LETTERS, LATIN_NUMBERS))
_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}"))


def pieces(text: str, start: int = 0, end: int | None = None) -> Iterator[list[str] | tuple[int, int]]:
    """The pieces of a part of the text, slab by slab; a longer one comes alone, as the place where it begins and ends."""
    rule = _ANY if _BEYOND_LATIN.search(text, start) else _LATIN
    end = len(text) if end is None else end
    while start < end:
        stop = min(start + SLAB, end)
        found = rule.findall(text, start, stop)
        if stop < end:
            # The last pieces may look different with what follows.
            while found and stop > min(start + SLAB, end) - PEEK:
                stop -= len(found.pop())
            if not found:
                stop = rule.match(text, start, end).end()
                yield start, stop
        if found:
            yield found
        start = stop


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or the next free character from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary, its merges by rank, and the lookahead that they need."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        stand_in = byte_alphabet()
        raw = lambda s: bytes(stand_in[c] for c in s)
        self.special = special
        self.text = {i: raw(s) for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.byte = {stand_in[c]: vocab[c] for c in stand_in}
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        #: Rank of a pair, keyed by both ids in one number.
        self.rank: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(self.merges):
            self.rank.setdefault(a << 32 | b, rank)
        self.longest = max(len(t) for t in self.text.values())
        self.lookahead = sufficient_lookahead(self)
        self.window = max(64, 4 * (self.lookahead + self.longest))

    @classmethod
    def from_json(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def merged(self, data: bytes) -> list[int]:
        """Applies the merges, lowest rank and then leftmost first."""
        byte, rank_of, none = self.byte, self.rank.get, len(self.merges)
        ids = [byte[b] for b in data]
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            ids[at : at + 2] = [self.merges[rank][2]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(ids[at] << 32 | ids[at + 1], none)
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 32 | ids[at], none)
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece, each given out as soon as it is settled; the piece's bytes come in chunks."""
        rest, held, ended = iter(chunks), b"", False
        while not ended or held:
            while not ended and len(held) <= self.window:
                more = next(rest, None)
                ended = more is None
                held += more or b""
            whole = ended and len(held) <= self.window
            window = held[: self.window]
            settled = len(window) if whole else len(window) - self.lookahead
            end = 0
            for token in self.merged(window):
                size = len(self.text[token])
                if end + size > settled:
                    break
                end += size
                yield token
            held = held[end:]


def sufficient_lookahead(m: Merges) -> int:
    """Bytes beyond a token's end after which no merge changes it any more.

    ``after[s]``: the furthest reach of the merges seen so far that take symbol
    ``s`` as their left part.  ``spine[s]``: the furthest reach of merges that
    could have taken one of the symbols at the right end of ``s`` before ``s``
    was made.  A merge of (s, c) is open until c is certain, hence its reach is
    c's length plus what settles c among lower ranks.
    """
    after: dict[int, int] = {}
    spine: dict[int, int] = {}
    for a, b, made in m.merges:
        reach = len(m.text[b]) + max(after.get(b, 0), spine.get(b, 0))
        spine[made] = max(spine.get(made, 0), after.get(b, 0), spine.get(b, 0))
        after[a] = max(after.get(a, 0), reach)
    return max((max(after.get(t, 0), spine.get(t, 0)) for t in m.text), default=0)


class _Known(dict):
    """Piece to packed ids.  Two generations of bounded size: a full one becomes the old one."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.old = merges, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = np.fromiter(self.merges.stream((piece.encode("utf-8", "surrogatepass"),)), "<u4").tobytes()
            if len(piece) > SHORT:
                return got
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Codec:
    def __init__(self, merges: Merges):
        self.merges, self.known = merges, _Known(merges)
        self.cut = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def _parts(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """(begin, end, id) of the special tokens and, without id, of what lies between."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield at, m.start(), None
            yield m.start(), m.end(), self.merges.special[m[0]]
            at = m.end()
        yield at, len(text), None

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, block by block."""
        if not text:
            return
        known, done, size = self.known, [], 0
        for begin, end, special in self._parts(text):
            if special is not None:
                done.append(struct.pack("<I", special))
                continue
            for found in pieces(text, begin, end):
                if isinstance(found, list):
                    done.append(b"".join([known[p] for p in found]))
                else:
                    ids = self.merges.stream(text[k : min(k + SLAB, found[1])].encode("utf-8", "surrogatepass") for k in range(*found, SLAB))
                    for some in iter(lambda: np.fromiter(islice(ids, BLOCK_BYTES // 4), "<u4").tobytes(), b""):
                        yield b"".join(done)
                        done, size = [some], 0
                size += len(done[-1])
                if size >= BLOCK_BYTES:
                    yield b"".join(done)
                    done, size = [], 0
        yield b"".join(done)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text."""
        return b"".join(self.blocks(text))

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text, block by block of ids."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = self.merges.text
        for block in blocks:
            for lo in range(0, len(block), BLOCK_BYTES):
                yield machine.decode(b"".join([text[i] for i in np.frombuffer(block[lo : lo + BLOCK_BYTES], "<u4").tolist()]))
        yield machine.decode(b"", True)


    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number and SHA-256 of the ids, and of the text decoded from them; a block goes on before the next is made."""
        of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0

        def noted() -> Iterator[bytes]:
            nonlocal n
            for block in self.blocks(text):
                of_ids.update(block)
                n += len(block) // 4
                yield block

        for part in self.decode(noted()):
            of_text.update(part.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(Merges.from_json(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str | None = None, text: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts, an array of long."""
    path = path or default_path()
    small_batches(df.sparkSession)

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([np.frombuffer(c.encode(t), "<u4").astype(np.int64) for t in texts])

    return df.withColumn(to, run(F.col(text)))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; a null list gives an empty text."""
    path = path or default_path()
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series(["" if x is None else "".join(c.decode((np.asarray(x).astype("<u4").tobytes(),))) for x in lists])

    return df.withColumn(to, run(F.col(ids)))


def digests(df: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so that no ids travel."""
    path = path or default_path()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            count, ids_sum, text_sum = [], [], []
            for t in batch.column(1):
                n, of_ids, of_text = c.digest(t.as_py())
                count.append(n)
                ids_sum.append(of_ids)
                text_sum.append(of_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
