"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Symbols are pairs of neighbouring words, lower-cased, since single words are too
common to tell windows apart.  The CGK random walk reads a window: each step
gives out the current symbol and moves on if a random bit of (step, symbol) is set.
Two windows at small edit distance get sequences at small Hamming distance,
since walks that were pushed apart by an edit meet again.  A repetition samples
``COORDINATES`` steps; windows whose sampled symbols agree collide.  The numbers of
walks and of repetitions in each follow from the target recall and from the share of
equal steps that walks over windows at the edit limit have, which ``equal_steps``
measures: the longer the windows, the more walks it takes, as some never meet again.

Windows are sized by the passages: those of ``least`` to twice as many words have
windows of half of ``least``.  A passage's windows start at each of its words, a
document's at every ``stride``-th, a sixth of ``least``, so that any occurrence holds
three windows that start at the same word on both sides.

Passages of fewer than ``WALKED`` words have too few windows for that, and are
found by seeds without loss: each of ``k`` edits spoils at most ``q`` of the
``n - q + 1`` runs of ``q`` words, so rows that share fewer than
``n - q + 1 - q * k`` of them hold no occurrence, and the others are verified
wherever a run agrees.  Each collision is verified exactly: the
edit distance in words between the whole passage and the closest stretch of
the document around the collision must be at most ``1 - SIMILARITY`` of the
passage's words.

A block has at most ``BLOCK_ITEMS`` passages of at most ``BLOCK_BYTES`` together,
which bounds what the driver gathers and what is broadcast.  One block is searched
in one pass that marks the documents.  More blocks are a stage each, one after the
other; each writes what it found by the digest of the text, and in the end those
marks are joined to the documents.

Defined results: each row of documents gives one row, repeated ones included.
Null or empty texts are clean.  Passages that are null or have no word identify
nothing and are ignored; one of up to four words is found where it occurs word for
word, as no edit is allowed it, and ``least_words`` leaves out shorter ones; equal
passages are all reported.  Item ids come sorted; a passage without an id can mark
a document but isn't listed.  Empty tables give no or only clean rows.  Very long
texts are read whole.  Extra columns pass through; ``find`` replaces those named as
its two, ``clean`` none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, free_name, small_batches
from .textvec import U, buffers, chunks, mix, words

SIMILARITY = 0.8
TARGET_RECALL = 0.999
COORDINATES = 2
#: Pairs of windows that shares of equal steps are measured on, and walks at most.
MEASURED = 4000
MOST_WALKS = 12
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
#: Marked texts sent to all executors at most; beyond that they are joined with a shuffle.
BROADCAST_MARKS = 200_000
SEED = 0x51ED270B


class Span(NamedTuple):
    """Windows of ``words`` words, in documents at every ``stride``-th word, read in ``steps`` steps."""

    least: int  # passages from so many words on
    below: float
    words: int
    stride: int
    steps: int


#: Passages of so many words are found by walks, shorter ones by seeds.
WALKED = 25
#: Passages of so many words or more share the longest windows.
LONGEST = 16 * WALKED


def _spans() -> tuple[Span, ...]:
    """Length classes, each twice the one before."""
    out, least = [], WALKED
    while least <= LONGEST:
        out.append(Span(least, 2 * least if 2 * least <= LONGEST else math.inf, least // 2, least // 6, least // 2 * 2))
        least *= 2
    return tuple(out)


SPANS = _spans()


def walk(symbols: np.ndarray, start: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK sequences, a column for each window; walks that run past the last symbol read zeros."""
    coins = np.concatenate([mix(symbols ^ U(seed)), np.zeros(steps, U)])
    at, out = start.astype(np.int64), np.empty((steps, len(start)), np.uint32)
    for step in range(steps):
        here = coins.take(at)
        out[step] = here
        at += ((here >> U(32 + step)) & U(1)).view(np.int64)
    return out


def _walk_seed(span: Span, walk_no: int) -> int:
    return SEED + 7919 * walk_no + span.words


@lru_cache(64)
def equal_steps(span: Span, similarity: float = SIMILARITY, pairs: int = MEASURED) -> np.ndarray:
    """For each walk and each pair of a window and its edited copy, at the edit limit: the share of steps that agree.

    Windows of random words; edits are substitutions, insertions and deletions alike.
    """
    rng = np.random.default_rng(SEED)
    share = (1 - similarity) * span.words
    most = math.ceil(share)
    size = span.words + most + span.steps
    sides: list[list[np.ndarray]] = [[], []]
    for _ in range(pairs):
        own = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        copy = own.tolist()
        for at in rng.integers(0, span.words, int(share + rng.random())).tolist():
            kind = int(rng.integers(0, 3))
            copy[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 63))]
        sides[0].append(own)
        sides[1].append(np.array((copy + [0] * most)[:size], U))
    first = np.arange(pairs + 1) * size
    a, b = (_symbols(np.concatenate(x), first) for x in sides)
    seeds = [_walk_seed(span, v) for v in range(MOST_WALKS)]
    return np.stack([(walk(a, first[:-1], span.steps, seed) == walk(b, first[:-1], span.steps, seed)).mean(axis=0) for seed in seeds])


@lru_cache(64)
def repetitions(span: Span, recall: float = TARGET_RECALL, similarity: float = SIMILARITY, k: int = COORDINATES) -> tuple[int, int]:
    """Walks, and repetitions in each, that find the target share of occurrences, whose windows on the grid each may collide.

    Of those that do, the ones with the least work, where a repetition counts as much as three steps of a walk.
    """
    windows = max(1, (span.least - span.words + 1) // span.stride)
    lost, best = np.ones(MEASURED), (math.inf, 0, 0)
    for walks, share in enumerate(equal_steps(span, similarity), 1):
        lost = lost * (1 - share**k)
        reps = 1
        while (cost := walks * (span.steps + 3 * reps)) < best[0]:
            if (lost**reps).mean() ** windows <= 1 - recall:
                best = (cost, walks, reps)
            elif best[1] or reps < MEASURED:
                reps += 1
            else:
                break
    if not best[1]:
        raise ValueError(f"windows of {span.words} words at a similarity of {similarity} don't reach a recall of {recall}")
    return best[1:]


def _samples(span: Span, seed: int, reps: int) -> np.ndarray:
    """Steps of each repetition: one out of each equal part of the walk, so that they show different symbols."""
    rng = np.random.default_rng(seed)
    cuts = np.linspace(0, span.steps, COORDINATES + 1).astype(int)
    return np.stack([rng.integers(lo, hi, reps) for lo, hi in zip(cuts, cuts[1:], strict=False)], axis=1)


def _symbols(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word with the next one of its row; a row's last word stands alone."""
    nxt = np.append(ids[1:], U(0))
    ends = first[1:][np.diff(first) > 0] - 1
    nxt[ends] = 0
    return mix(ids * U(0x9FB21C651E98DF25) + nxt)


def _keys(seq: np.ndarray, steps: np.ndarray) -> np.ndarray:
    key = seq[steps[0]].astype(U)
    for s in steps[1:]:
        key *= U(0x9FB21C651E98DF25)
        key += seq[s]
    key *= U(0xD6E8FEB86659FD93)
    return key


def _runs(ids: np.ndarray, q: int) -> np.ndarray:
    """Hashes of ``q`` words from each word on, whatever the rows."""
    n = max(0, len(ids) - q + 1)
    h = np.zeros(n, U)
    for k in range(q):
        h = mix(h * U(0x9FB21C651E98DF25) + ids[k : n + k])
    return h


class Index:
    """Windows of a block of passages by their sampled words."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY, least_words: int = 1):
        self.items, self.plans = [], []
        for item_id, text in items:
            raw = text.encode()
            w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(w.ids) >= max(1, least_words):
                self.items.append((item_id, w.ids, int((1 - similarity) * len(w.ids) + 1e-9)))
        for span in SPANS:
            chosen = [k for k, (_, ids, _) in enumerate(self.items) if span.least <= len(ids) < span.below]
            if not chosen:
                continue
            sizes = np.array([len(self.items[k][1]) for k in chosen])
            base = np.concatenate([[0], np.cumsum(sizes)])
            ids = _symbols(np.concatenate([self.items[k][1] for k in chosen]), base)
            start = np.concatenate([base[i] + np.arange(n - span.words + 1) for i, n in enumerate(sizes)])
            which = np.repeat(np.arange(len(chosen)), sizes - span.words + 1)
            shift = start - base[which]
            walks, reps = repetitions(span, similarity=similarity)
            for v in range(walks):
                seed = _walk_seed(span, v)
                seq = walk(ids, start, span.steps, seed)
                tables = []
                for steps in _samples(span, seed, reps):
                    keys = _keys(seq, steps)
                    order = np.argsort(keys, kind="stable")
                    top = U(64 - max(12, int(len(keys) * 16).bit_length()))
                    filled = np.zeros(1 << int(64 - top), bool)
                    filled[keys >> top] = True
                    tables.append((steps, top, filled, keys[order], np.array(chosen)[which][order], shift[order]))
                self.plans.append((span, seed, tables))
        self.seeds = []
        least = np.zeros(len(self.items), np.int64)
        short: dict[int, list[int]] = {}
        for k, (_, ids, most) in enumerate(self.items):
            if len(ids) < WALKED:
                # The longest runs of two or three words that ``most`` edits cannot spoil all.
                q = next((q for q in (3, 2) if len(ids) - q + 1 - q * most > 0), 1)
                least[k] = max(1, len(ids) - q + 1 - q * most)
                short.setdefault(q, []).append(k)
        self.least = least
        for q, chosen in short.items():
            runs = [_runs(self.items[k][1], q) for k in chosen]
            keys = np.concatenate(runs)
            order = np.argsort(keys, kind="stable")
            top = U(64 - max(12, int(len(keys) * 16).bit_length()))
            filled = np.zeros(1 << int(64 - top), bool)
            filled[keys >> top] = True
            item, shift = np.repeat(chosen, [len(r) for r in runs]), np.concatenate([np.arange(len(r)) for r in runs])
            self.seeds.append((q, top, filled, keys[order], item[order], shift[order]))
        self.masks = []
        for _, ids, _ in self.items:
            masks: dict[int, int] = {}
            for k, x in enumerate(ids.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)

    def closest(self, item: int, stretch: list[int]) -> int:
        """Least edit distance in words between the passage and any part of the stretch, bit-parallel."""
        masks, m = self.masks[item], len(self.items[item][1])
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = full, 0, m, m
        for x in stretch:
            eq = masks.get(x, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = (mv | ~(xh | pv)) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv
            best = min(best, score)
        return best

    def seeded(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(row, passage, where it would begin) of the rows that share enough runs with a short passage."""
        out = [np.zeros((0, 3), np.int64)]
        for q, top, filled, keys, item, shift in self.seeds:
            key = _runs(ids, q)
            hit = np.flatnonzero(filled.take((key >> top).view(np.int64)))
            lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            row = np.searchsorted(first, hit, "right") - 1
            times = np.where(hit + q <= first[row + 1], hi - lo, 0)
            at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            row, begin = np.repeat(row, times), np.repeat(hit, times) - shift[at]
            if not len(at):
                continue
            pair = row * len(self.items) + item[at]
            shared = np.unique(np.stack([pair, shift[at]], axis=1), axis=0)[:, 0]
            name, count = np.unique(shared, return_counts=True)
            use = count[np.searchsorted(name, pair)] >= self.least[item[at]]
            out.append(np.unique(np.stack([row[use], item[at][use], begin[use]], axis=1), axis=0))
        return np.concatenate(out)

    def matches(self, ids: np.ndarray, first: np.ndarray) -> list[set[int]]:
        """Passages found in each row of words."""
        found: list[set[int]] = [set() for _ in range(len(first) - 1)]
        tried: set[tuple[int, int, int]] = set()

        def verify(r: int, k: int, begin: int) -> None:
            size, most = len(self.items[k][1]), self.items[k][2]
            # A part within `most` edits that is aligned here begins and ends within `most` words of the passage.
            stretch = ids[max(int(first[r]), begin - most) : min(int(first[r + 1]), begin + size + 2 * most)].tolist()
            # Each word of the passage that the stretch lacks is an edit.
            masks, there = self.masks[k], 0
            for x in masks.keys() & stretch:
                there |= masks[x]
            if there.bit_count() >= size - most and self.closest(k, stretch) <= most:
                found[r].add(k)

        for r, k, begin in self.seeded(ids, first).tolist():
            if k not in found[r]:
                verify(r, k, begin)
        symbols = _symbols(ids, first)
        for span, seed, tables in self.plans:
            # One grid for all rows: a walk may run into the next row, but the check stays within its own.
            start = np.arange(0, len(ids), span.stride)
            seq = walk(symbols, start, span.steps, seed)
            for steps, top, filled, keys, item, shift in tables:
                key = _keys(seq, steps)
                hit = np.flatnonzero(filled.take((key >> top).view(np.int64)))
                lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                for h, a, b in zip(hit[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                    r = int(np.searchsorted(first, start[h], "right")) - 1
                    for e in range(a, b):
                        k, begin = int(item[e]), int(start[h]) - int(shift[e])
                        if k in found[r] or (r, k, begin) in tried:
                            continue
                        tried.add((r, k, begin))
                        verify(r, k, begin)
        return found


def _search(index, text: str, hit: str, items: str, only_hits: bool):
    """Rows with what was found in their text; ``only_hits`` leaves out the text and the rows without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            data, offs = buffers(batch.column(text))
            out: list[list[int]] = []
            marked: list[bool] = []
            for lo, hi in chunks(offs):
                w = words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for got in own.matches(w.ids, w.first):
                    names = {own.items[k][0] for k in got}
                    out.append(sorted(x for x in names if x is not None))
                    marked.append(bool(got))
            rest = batch.select([c for c in batch.schema.names if c != text]) if only_hits else batch
            found = pa.RecordBatch.from_arrays([*rest.columns, pa.array(marked, pa.bool_()), pa.array(out, pa.list_(pa.int64()))], [*rest.schema.names, hit, items])
            yield found.filter(found.column(hit)) if only_hits else found

    return run


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """Number of blocks, and the passages of each, bounded in number and size."""
    items = benchmark.filter(F.col("text").isNotNull())
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-(n or 0) // (BLOCK_ITEMS // 2)), -(-(size or 0) // (BLOCK_BYTES // 2)))

    def each() -> Iterator[list[tuple[int | None, str]]]:
        for b in range(blocks):
            part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            yield [(r[0], r[1]) for r in part.select(F.col("item_id").cast("long"), "text").collect()]

    return blocks, each()


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = 1, hit: str = "contaminated", items: str = "item_ids") -> DataFrame:
    """``docs`` with ``contaminated`` and the sorted ``item_ids`` of the passages found."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(hit, items)
    more = f"{hit} boolean, {items} array<long>"
    blocks, each = _blocks(benchmark)
    if blocks == 1:
        index = spark.sparkContext.broadcast(Index(next(each), similarity, least_words=least_words))
        kind = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields])
        return docs.mapInArrow(_search(index, "text", hit, items, False), kind)
    scratch, found = Scratch(spark, "decontaminate"), None
    key = free_name(docs, "digest")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    for passages in each:
        index = spark.sparkContext.broadcast(Index(passages, similarity, least_words=least_words))
        texts = docs.select(digest.alias(key), F.col("text").alias("text"))
        now = scratch.table(texts.mapInArrow(_search(index, "text", hit, items, True), f"{key} string, {more}").dropDuplicates([key]), "found")
        index.destroy()
        found = now if found is None else found.unionByName(now)
    marks = found.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    marks = scratch.table(marks, "marks")
    if marks.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    marked = docs.withColumn(key, digest).join(marks.withColumn(hit, F.lit(True)), key, "left")
    none = F.array().cast("array<long>")
    return marked.select(*docs.columns, F.coalesce(hit, F.lit(False)).alias(hit), F.coalesce(items, none).alias(items))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` in which no passage is found."""
    hit, items = free_name(docs, "contaminated"), free_name(docs, "item_ids")
    return find(docs, benchmark, similarity, least_words, hit, items).filter(~F.col(hit)).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, benchmark).select("doc_id", "contaminated", "item_ids")
