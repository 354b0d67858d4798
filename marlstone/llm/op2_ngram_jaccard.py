"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two documents link when ``100 * |A and B| >= threshold * |A or B|`` for their sets
of word shingles.  Under one global order of n-grams two linked documents share an
n-gram among the ``n - ceil(threshold * n / 100) + 1`` first of each, their
prefixes; the postings of a prefix n-gram are a column of the incidence.  Any order
is right; a count sketch of fixed size puts frequent n-grams last, so common
passages hardly ever meet.

Equal sets fold into one node first, so copies never meet each other.  Then:

1. star: the smallest node of a column, its lead, meets the others of it, which is
   linear in the postings.  Pairs are discarded by size and by a parity bitmap (the
   popcount of the XOR is a lower bound of the symmetric difference; for long sets
   it is as wide as the set, as a narrow one fills up and tells nothing), and the
   rest are counted exactly.  Components of the links found contract.
2. columns that still hold several components beside their lead are multiplied.
   Columns with one lead have much the same members, so together they are a family,
   whose members meet in blocks of bounded size.  The size and bitmap bounds come
   first and leave the members that have any possible partner in another component.
3. the whole sets of those go to their block, where overlap counts are accumulated
   panel by panel as a matrix product over the n-grams that both panels have.
   Links contract at once, and a block gives out a spanning forest of its links: at
   most one pair a member, however many pairs link.

Hashes of n-grams have 64 bits.  A set's name has 64 as well, and 64 more that
check it: names that several sets have are told apart by those.

Defined results: a document without words (null, empty or blank text) has
size 0 and links with nothing, not even another such.  Repeated rows are one
node and all get its component.  A row without an id takes part; a component's
id is the smallest id in it that is not null, and null if it has none.  Rows
that share an id but not the text are documents of their own.  Empty tables
give empty results, very long texts are read whole, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, empty, free_name
from .textvec import U, buffers, chunks, distinct, grams, mix, words

WIDTH = 4
THRESHOLD = 85
SKETCH_LOG2 = 22
SKETCH_ROWS = 64
#: 64-bit words of a parity bitmap, and their columns.
BITMAP = [f"w{k}" for k in range(16)]
#: Members of a family's block, and shingles of them all; larger families are cut into blocks that meet pairwise.
BLOCK = 4096
BLOCK_SHINGLES = 2_000_000
#: Members multiplied at once, and n-grams.
PANEL = 512
PANEL_GRAMS = 4096
#: Members of small families in one task, and shingles.
TASK_ROWS = 5_000
TASK_SHINGLES = 500_000
#: Ids sent to all executors at most; beyond that the texts are joined with a shuffle.
BROADCAST_IDS = 500_000
#: Rows whose repeats a task recognises before it sends their postings.
SEEN = 1_000_000


def _sets(col: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hashes ascending by row, index of each row's first hash)."""
    data, offs = buffers(col)
    for lo, hi in chunks(offs):
        w = words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        h, r = distinct(*grams(w, width))
        yield lo, hi - lo, h, np.searchsorted(r, np.arange(hi - lo + 1))


def _sums(h: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(salt)), dtype=U)])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U))


class _Names:
    """Names of sets: 64 bits, 0 for empty ones; ``clash`` has the names that several sets would have."""

    def __init__(self, bits: int = 64):
        self.shift, self.clash = U(64 - bits), np.zeros(0, np.int64)

    def checks(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sums(h, first, 0x3C79AC492BA7B653)

    def __call__(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        name = _sums(h, first, 0xA5A5A5A55A5A5A5A) >> self.shift
        if len(self.clash):
            name ^= np.where(np.isin(name.view(np.int64), self.clash), self.checks(h, first), U(0))
        return np.where(np.diff(first) > 0, name, U(0))


def _bitmaps(h: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Parity of the hashes in each of 64 bins a word, by row; a column for each word."""
    rows, bits = len(first) - 1, 64 * len(BITMAP)
    row = np.repeat(np.arange(rows), np.diff(first))
    bins = np.bincount(row * bits + (h >> U(7)).astype(np.int64) % bits, minlength=rows * bits)
    packed = np.packbits((bins & 1).astype(np.uint8).reshape(rows, bits), axis=1).view(np.int64)
    return [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(len(BITMAP))]


def _wide(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """The same for sets that would fill the columns: as many bins as members, rounded up to a power of two; else null."""
    out: list[np.ndarray | None] = [None] * (len(first) - 1)
    for row in np.flatnonzero(np.diff(first) > 64 * len(BITMAP)):
        mine = h[first[row] : first[row + 1]]
        bits = 1 << (len(mine) - 1).bit_length()
        bins = np.bincount(((mine >> U(7)) & U(bits - 1)).astype(np.int64), minlength=bits)
        out[row] = np.packbits((bins & 1).astype(np.uint8)).view(np.int64)
    return pa.array(out, pa.list_(pa.int64()))


def _scan(width: int, names_of: _Names, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*carried, "node", "check", "n", *BITMAP, "wide", "part", "blob"]
        sketch = np.zeros(1 << SKETCH_LOG2, np.uint32)
        for batch in batches:
            own = batch.select(carried)
            for lo, rows, h, first in _sets(batch.column("text"), width):
                np.add.at(sketch, (h >> U(64 - SKETCH_LOG2)).astype(np.int64), 1)
                none = pa.nulls(rows)
                yield pa.RecordBatch.from_arrays([*own.slice(lo, rows).columns, pa.array(names_of(h, first).view(np.int64)), pa.array(names_of.checks(h, first).view(np.int64)), pa.array(np.diff(first)), *_bitmaps(h, first), _wide(h, first), none.cast(pa.int32()), none.cast(pa.binary())], names)
        for part, piece in enumerate(np.split(sketch, SKETCH_ROWS)):
            if piece.any():
                blob = zlib.compress(piece.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in own.columns), *[pa.nulls(1, pa.int64())] * (3 + len(BITMAP)), pa.nulls(1, pa.list_(pa.int64())), pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names)

    return run


def _merged(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_LOG2) // SKETCH_ROWS, np.uint64)
    for blob in table.column("blob"):
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    out = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pa.table({"part": table.column("part")[:1], "salt": table.column("salt")[:1], "blob": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})


def _levels(pieces: DataFrame) -> np.ndarray:
    """Of each sketch slot: 0, or how many times (as a power of two) it exceeds a usual one.

    Tasks' sketches are summed in two steps, so no task gets one from every task.
    """
    kind = "part int, salt int, blob binary"
    once = pieces.groupBy("part", "salt").applyInArrow(_merged, kind)
    rows = once.withColumn("salt", F.lit(0)).groupBy("part").applyInArrow(_merged, kind).collect()
    sketch = np.zeros((SKETCH_ROWS, (1 << SKETCH_LOG2) // SKETCH_ROWS))
    for r in rows:
        sketch[r["part"]] = np.frombuffer(zlib.decompress(r["blob"]), np.uint32)
    usual = 2 * sketch.mean() + 8
    return np.where(sketch > usual, np.log2(np.maximum(sketch, 1) / usual) + 1, 0).astype(np.uint8).reshape(-1)


def _first_seen(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which names are new to this task; a full table lets repeats pass, which later steps fold."""
    fresh = np.zeros(len(node), bool)
    for i, name in enumerate(node.tolist()):
        if name not in seen:
            fresh[i] = True
            if len(seen) < SEEN:
                seen.add(name)
    return fresh


def _postings(width: int, threshold: int, levels, names_of: _Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            for _, rows, h, first in _sets(batch.column("text"), width):
                n, node = np.diff(first), names_of(h, first)
                fresh = (n > 0) & _first_seen(node, seen)
                row = np.repeat(np.arange(rows), n)
                use = fresh[row]
                h, row = h[use], row[use]
                order = np.lexsort((h, level[(h >> U(64 - SKETCH_LOG2)).astype(np.int64)], row))
                h, row = h[order], row[order]
                at = np.arange(len(h)) - np.searchsorted(row, row)
                prefix = n - -(-threshold * n // 100) + 1
                use = at < prefix[row]
                h, row = h[use], row[use]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[row].view(np.int64))], ["gram", "node"])

    return run


def _sets_of(width: int, names_of: _Names):
    """The sets of texts that go to a target: rows (text, node, target, ...), grams instead of text; without a node, any set does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            wanted, target = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("node", "target"))
            rest = batch.select([c for c in batch.schema.names if c not in ("text", "node")])
            for lo, rows, h, first in _sets(batch.column("text"), width):
                node, to = names_of(h, first).view(np.int64), target[lo : lo + rows]
                ask = wanted[lo : lo + rows]
                # Only what is sent counts as seen: a text also meets the requests for others of its id.
                fresh = (ask == node) | (ask == 0)
                fresh[fresh] = _first_seen((mix(node.view(U)) ^ to.view(U))[fresh], seen)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), sets, *rest.slice(lo, rows).columns], ["node", "grams", *rest.schema.names]).filter(pa.array(fresh))

    return run


def _least_overlap(total: np.ndarray, threshold: int) -> np.ndarray:
    """Overlap that a linked pair of so many members in all must have."""
    return -(-threshold * total // (100 + threshold))


def _blocks_of(table: pa.Table, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of both sides of each pair of blocks, by size; one block that meets itself is both sides."""
    tile, side = table.column("tile").to_numpy(), table.column("side").to_numpy()
    order = np.lexsort((n, tile))
    for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        if len(rows):
            yield rows[side[rows] != 1], rows[side[rows] != 0]


def _panels(p: np.ndarray, q: np.ndarray, n: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of both sides whose sizes can link; of a block that meets itself, each pair of parts once."""
    same, sizes = len(p) == len(q) and bool((p == q).all()), n[q]
    for lo in range(0, len(p), PANEL):
        i = p[lo : lo + PANEL]
        begin = max(int(np.searchsorted(sizes, -(-threshold * n[i[0]] // 100))), lo if same else 0)
        end = int(np.searchsorted(sizes, 100 * n[i[-1]] // threshold, "right"))
        for at in range(begin, end, PANEL):
            yield i, q[at : min(at + PANEL, end)]


def _wide_differ(x: np.ndarray | None, y: np.ndarray | None) -> int:
    """Bins in which two wide bitmaps differ, one folded to the other's width; 0 if one is missing or over twice as wide."""
    if x is None or y is None:
        return 0
    if len(x) > len(y):
        x, y = y, x
    if len(y) == 2 * len(x):
        y = y[: len(x)] ^ y[len(x) :]
    return int(np.bitwise_count(x ^ y).sum()) if len(x) == len(y) else 0


def _possible(threshold: int):
    """The members that have a partner in another component that size and bitmap allow."""

    def run(table: pa.Table) -> pa.Table:
        comp, n = table.column("comp").to_numpy(), table.column("n").to_numpy()
        bits = np.stack([table.column(w).to_numpy() for w in BITMAP], axis=1).view(U)
        lists = table.column("wide").combine_chunks()
        words_of, at = lists.values.to_numpy(zero_copy_only=False).view(U), np.asarray(lists.offsets)
        wide = [words_of[lo:hi] if hi > lo else None for lo, hi in zip(at, at[1:], strict=False)]
        use = np.zeros(len(n), bool)
        for p, q in _blocks_of(table, n):
            for i, j in _panels(p, q, n, threshold):
                ni, nj = n[i][:, None], n[j][None, :]
                ok = (comp[i][:, None] != comp[j][None, :]) & (100 * np.minimum(ni, nj) >= threshold * np.maximum(ni, nj))
                if not ok.any():
                    continue
                most = ni + nj - 2 * _least_overlap(ni + nj, threshold)
                differ = np.zeros(ok.shape, np.int32)
                for w in range(len(BITMAP)):
                    differ += np.bitwise_count(bits[i, w][:, None] ^ bits[j, w][None, :])
                ok &= differ <= most
                for a, b in zip(*np.nonzero(ok & (np.minimum(ni, nj) > 64 * len(BITMAP))), strict=True):
                    ok[a, b] = _wide_differ(wide[i[a]], wide[j[b]]) <= most[a, b]
                use[i[ok.any(axis=1)]] = True
                use[j[ok.any(axis=0)]] = True
        return table.select(["tile", "side", "node", "comp", "n"]).filter(pa.array(use))

    return run


class _Incidence:
    """Members by n-grams; an n-gram that one member has alone counts for nothing and is left out."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        names, col, times = np.unique(h, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        use = times[col] > 1
        self.row, self.col = row[use], col[use]
        self.first = np.searchsorted(self.row, np.arange(len(first)))
        self.place = np.full(len(names), -1, np.int32)

    def _entries(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among the members, column)."""
        n = self.first[members + 1] - self.first[members]
        at = np.repeat(self.first[members] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(members)), n), self.col[at]

    def overlaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Counts of common n-grams, accumulated over blocks of them; exact, as floats hold whole numbers to 2**24."""
        out = np.zeros((len(i), len(j)), np.int64)
        (ri, ci), (rj, cj) = self._entries(i), self._entries(j)
        both = np.intersect1d(ci, cj)
        for lo in range(0, len(both), PANEL_GRAMS):
            now = both[lo : lo + PANEL_GRAMS]
            self.place[now] = np.arange(len(now))
            sides = []
            for r, c, size in ((ri, ci, len(i)), (rj, cj, len(j))):
                to = self.place[c]
                dense = np.zeros((size, len(now)), np.float32)
                dense[r[to >= 0], to[to >= 0]] = 1
                sides.append(dense)
            out += (sides[0] @ sides[1].T).astype(np.int64)
            self.place[now] = -1
        return out


def _product(threshold: int):
    """A spanning forest of the links between components in each pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        # A member can come from several documents that have its text.
        _, once = np.unique(np.stack([table.column(c).to_numpy() for c in ("tile", "node")], axis=1), axis=0, return_index=True)
        table = table.take(pa.array(once)).combine_chunks()
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        sets = table.column("grams").combine_chunks()
        found: list[tuple[int, int]] = []
        n = np.diff(np.asarray(sets.offsets)).astype(np.int64)
        for p, q in _blocks_of(table, n):
            own = np.union1d(p, q)
            p, q = np.searchsorted(own, p), np.searchsorted(own, q)
            mine = sets.take(pa.array(own))
            size, _, label = n[own], *np.unique(comp[own], return_inverse=True)
            incidence = _Incidence(mine.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]))
            for i, j in _panels(p, q, size, threshold):
                if (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
                    continue
                both = incidence.overlaps(i, j)
                linked = 100 * both >= threshold * (size[i][:, None] + size[j][None, :] - both)
                for a in np.flatnonzero(linked.any(axis=1)):
                    near = j[linked[a]]
                    labels, first = np.unique(label[near], return_index=True)
                    for x, k in zip(labels, near[first], strict=True):
                        if x != label[i[a]]:
                            found.append((int(node[own[i[a]]]), int(node[own[k]])))
                            label[label == x] = label[i[a]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs.min(axis=1, initial=2**63 - 1)), "b": pa.array(pairs.max(axis=1, initial=-(2**63)))})

    return run


def _differing(a: str, b: str):
    """Bins in which two wide bitmaps differ, one folded to the other's width; null if one is null or over twice as wide."""
    width = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda c: F.when(F.size(c) > width, F.zip_with(F.slice(c, F.lit(1), width), F.slice(c, width + 1, width), xor)).otherwise(F.col(c))
    count = F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.greatest(F.size(a), F.size(b)) <= width * 2), count)


class _Join:
    def __init__(self, docs: DataFrame, width: int, threshold: int, name_bits: int = 64):
        self.all, self.docs, self.width, self.threshold = docs, docs.select("doc_id", "text"), width, threshold
        self.carried = [c for c in docs.columns if c != "text"]
        self.scratch = Scratch(docs.sparkSession, "ngram-join")
        self.names = _Names(name_bits)

    def scan(self) -> None:
        kind = f"node long, check long, n long, {' long, '.join(BITMAP)} long, wide array<long>, part int, blob binary"
        kind = ", ".join([*(f"{c} {self.all.schema[c].dataType.simpleString()}" for c in self.carried), kind])
        self.rows = self.scratch.table(self.all.mapInArrow(_scan(self.width, self.names, self.carried), kind).withColumn("salt", F.spark_partition_id() % 64), "scan")
        self.texts = self.rows.filter("part is null").select(*self.carried, "node", "check", "n", *BITMAP, "wide")
        self.nodes = self.folded()
        # Very few names are expected to be those of several sets: one pair in 2**64.
        clash = [r["node"] for r in self.nodes.filter("low <> high").select("node").collect()]
        if clash:
            self.names.clash = np.array(clash, np.int64)
            apart = F.broadcast(self.docs.sparkSession.createDataFrame([(x,) for x in clash], "node long")).withColumn("clash", F.lit(True))
            self.texts = self.texts.join(apart, "node", "left").withColumn("node", F.when(F.col("clash"), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node"))).drop("clash")
            self.nodes = self.folded()
        self.wide = self.scratch.table(self.texts.filter("wide is not null").select("node", "wide").dropDuplicates(["node"]), "wide")

    def folded(self) -> DataFrame:
        checks = [F.min("check").alias("low"), F.max("check").alias("high")]
        return self.scratch.table(self.texts.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), *checks, *(F.max(w).alias(w) for w in BITMAP)), "nodes")

    def columns(self) -> DataFrame:
        """(gram, lead, m, node), m being the size, of the prefix n-grams that several nodes have."""
        levels = self.docs.sparkSession.sparkContext.broadcast(_levels(self.rows.filter("part is not null").select("part", "salt", "blob")))
        postings = self.scratch.table(self.docs.select("text").mapInArrow(_postings(self.width, self.threshold, levels, self.names), "gram long, node long"), "postings")
        leads = postings.groupBy("gram").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("m")).filter("lead <> last").drop("last")
        shared = self.scratch.table(postings.join(leads, "gram"), "columns")
        self.scratch.drop(postings)
        return shared

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and bitmaps allow."""
        end = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), *(F.col(w).alias(f"{w}_{c}") for w in BITMAP))
        both = pairs.distinct().join(end("a"), "a").join(end("b"), "b")
        need = F.ceil(F.lit(self.threshold) * (F.col("n_a") + F.col("n_b")) / (100 + self.threshold))
        differ = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in BITMAP), F.lit(0))
        size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.threshold
        most = F.col("n_a") + F.col("n_b") - need * 2
        near = both.filter(size).filter(differ <= most).select("a", "b", most.alias("most"))
        for c in ("a", "b"):
            near = near.join(self.wide.toDF(c, f"wide_{c}"), c, "left")
        return near.filter(F.coalesce(_differing("wide_a", "wide_b") <= F.col("most"), F.lit(True))).select("a", "b")

    def sets(self, want: DataFrame) -> DataFrame:
        """``want`` (node, target, ...) with the set of each node; some rows may come twice."""
        want = self.scratch.table(want.join(self.nodes.select("node", "doc_id"), "node"), "wanted")
        known, lost = want.filter("doc_id is not null"), want.filter("doc_id is null").drop("doc_id")
        rest = [f for f in lost.schema if f.name != "node"]
        kind = f"node long, grams array<long>, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rest)}"
        if known.count() <= BROADCAST_IDS:
            known = F.broadcast(known)
        ask = ["text", "node", *(f.name for f in rest)]
        out = self.docs.join(known, "doc_id").select(*ask).mapInArrow(_sets_of(self.width, self.names), kind)
        if not empty(lost):
            free = self.docs.filter("doc_id is null").select("text", *(F.lit(None).cast("long").alias(c) for c in ("node", "target")))
            sets = free.mapInArrow(_sets_of(self.width, self.names), "node long, grams array<long>, target long").drop("target")
            out = out.unionByName(sets.join(lost, "node"))
        return self.scratch.table(out, "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose counted overlap links them."""
        pairs = self.scratch.table(pairs, "pairs")
        if empty(pairs):
            return pairs
        # b's set goes to a's, and a's own set is there once.
        sets = self.sets(pairs.select(F.col("b").alias("node"), F.col("a").alias("target")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("target")).distinct()))
        own = sets.filter("node = target").select(F.col("target").alias("a"), F.col("grams").alias("x")).dropDuplicates(["a"])
        sent = sets.filter("node <> target").select(F.col("target").alias("a"), F.col("node").alias("b"), F.col("grams").alias("y")).join(own, "a").withColumn("both", F.size(F.array_intersect("x", "y")))
        linked = sent.filter(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * self.threshold)
        links = self.scratch.table(linked.select("a", "b"), "links")
        self.scratch.drop(sets)
        return links

    def families(self, shared: DataFrame, links: DataFrame) -> DataFrame:
        """(lead, node, comp) of the members, beside the lead, of columns that hold several components.

        The lead met them all, so its pairs are decided.
        """
        parts = connected_components(links, self.scratch)
        named = shared.filter("m > 2 and node <> lead").join(parts, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        named = self.scratch.table(named.select("gram", "lead", "node", "comp"), "named")
        mixed = named.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("gram")
        return self.scratch.table(named.join(mixed, "gram").select("lead", "node", "comp").distinct(), "families")

    def possible(self, members: DataFrame) -> DataFrame:
        """(tile, side, node, comp, n) of the members with a possible partner; a tile is a pair of blocks of one family."""
        sized = members.join(self.nodes.select("node", "n", *BITMAP), "node").join(self.wide, "node", "left")
        plan = sized.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
        # A member lies in one of k blocks of its family, which meets each of the k blocks once, itself included.
        own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
        met = sized.join(plan, "lead").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        tile = F.xxhash64("lead", F.least("own", "other"), F.greatest("own", "other"))
        tasks = max(8, members.count() // TASK_ROWS)
        rows = met.select(tile.alias("tile"), side.cast("int").alias("side"), "node", "comp", "n", *BITMAP, "wide", "k")
        # Small families share a task; each pair of blocks of a large one has its own.
        rows = rows.withColumn("task", F.when(F.col("k") > 1, F.col("tile")).otherwise(F.pmod("tile", F.lit(tasks)))).drop("k")
        return self.scratch.table(rows.groupBy("task").applyInArrow(_possible(self.threshold), "tile long, side int, node long, comp long, n long"), "possible")

    def rest(self, shared: DataFrame, links: DataFrame) -> DataFrame:
        """Links between components that the star left out: enough of them to contract those."""
        near = self.possible(self.families(shared, links))
        if empty(near):
            return near.select(F.col("node").alias("a"), F.col("node").alias("b"))
        tasks = max(8, near.agg(F.sum("n")).first()[0] // TASK_SHINGLES)
        weight = near.groupBy("tile").agg(F.sum("n").alias("weight"))
        task = F.when(F.col("weight") > TASK_SHINGLES, F.col("tile")).otherwise(F.pmod("tile", F.lit(tasks)))
        sets = self.sets(near.join(weight, "tile").select("node", F.col("tile").alias("target"), "tile", "side", "comp", task.alias("task")))
        return self.scratch.table(sets.drop("target").groupBy("task").applyInArrow(_product(self.threshold), "a long, b long"), "links")

    def run(self) -> tuple[DataFrame, DataFrame]:
        self.scan()
        shared = self.columns()
        links = self.verified(self.bounded(shared.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))))
        links = links.unionByName(self.rest(shared, links))
        return links, connected_components(links, self.scratch)


def link(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id", name_bits: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, and the columns to carry along."""
    own = [F.col(c).alias(f"_{k}") for k, c in enumerate(carry)]
    join = _Join(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *own), width, threshold, name_bits)
    _, parts = join.run()
    named = join.nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "component", "doc_id")
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = join.scratch.table(named.join(ids, "component").select("node", "component", "component_id"), "members")
    out = join.texts.join(of_node, "node", "left")
    shown = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), shown.alias("component_id"), *(F.col(f"_{k}").alias(c) for k, c in enumerate(carry)), *([F.col("component").alias("class")] if carry else []))


def one_of_each(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one document of each component, and all rows without words.

    It is the one with the smallest id (rows without an id come last), and of equal ids the
    smallest digest of id and text.  Rows that share an id but not the text are documents
    of their own; of rows that share both, one stays.
    """
    key = free_name(docs, "digest")
    digest = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")))
    keyed = docs.withColumn(key, digest)
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    parts = link(keyed, width, threshold, carry=(key,)).filter("n_shingles > 0")
    # Grouped minimum, folded in each task first: a component with a third of all rows is one row a task.
    first = parts.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("first")).select(F.col("first")[key].alias(key))
    # Repeats fold in each task before the texts move, by the same key as the join.
    kept = keyed.filter(has_words).dropDuplicates([key]).join(first.distinct(), key, "left_semi")
    return kept.select(*docs.columns).unionByName(docs.filter(~has_words))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql_components(source: str = "documents", width: int = WIDTH, threshold: int = THRESHOLD) -> str:
    """The whole result over ``source``, whose ids are unique, in DuckDB's SQL: every pair with a common shingle is counted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from {source}),
s as (select distinct doc_id, unnest(case when len(w) >= {width} then list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as gram from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n i on i.doc_id = x join n j on j.doc_id = y where 100 * c >= {threshold} * (i.n + j.n - c)),
e as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from d union select r.x, e.y from r join e on e.x = r.y),
m as (select x, min(y) as least from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.least as component_id from d left join n on n.doc_id = d.doc_id join m on m.x = d.doc_id"""
