"""Language ID with bit-sliced Bloom filters of character n-grams.

One filter per language; all share their hash positions, so slot ``i`` of every
filter lies in one machine word whose bit ``l`` belongs to language ``l``.  An
n-gram's words ANDed together are the bitmask of all languages that contain it.
A text's popcount per language is corrected for the filter's false positives,
``(hits - n * fp) / (1 - fp)``, and the largest decides.

Fitting reads a bounded sample of labelled rows: of each language's distinct
(doc_id, text) the ``fit_rows`` whose hash comes first.  A threshold on the hash,
from the language's number of rows, leaves a few times as many to rank, so no task
gets a language whole; a language whose rows are mostly repeats may give fewer.
``fit_rows`` is the only bound on rows, and of those the n-grams in at least
``least_share`` of a language's rows make its filter.  The driver holds these
n-grams; the filter sent to executors has a fixed ``2 ** slots_log2`` words for each
64 languages.

Defined results: a text that is null, empty or without any letter is ``und``
with score 0.  Ties go to the first language in alphabetical order.  With no
labelled row at all, or an empty table, each text is ``und``.  Very long texts
are read whole.  Repeated rows get equal results and count once in the fit; so do
rows that share an id, if their texts are equal.  Extra columns pass through
``predict``, which replaces those named as its two, and through ``keep``, which
replaces none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import free_name, small_batches
from .textvec import U, buffers, chunks, mix

GRAM_BYTES = 5
#: Distinct labelled rows of a language that a fit reads at most, and how many times as many are ranked.
FIT_ROWS = 400
RANKED = 4
#: Least share of these rows that an n-gram of the filter is in.
LEAST_SHARE = 0.005
SLOTS_LOG2 = 18
HASHES = 3
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def _letters(texts: list[str | None]) -> list[str]:
    """Lower-cased words of letters, one blank around each; "" without letters."""
    out = []
    for t in texts:
        s = _OTHER.sub(" ", t.lower()).strip() if t else ""
        # The pattern also leaves numbers such as superscripts, which are no letters.
        out.append(f"  {s}  " if any(map(str.isalpha, s)) else "")
    return out


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the bytes from each position on, and its row."""
    n = len(data) - GRAM_BYTES + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key = np.zeros(n, U)
    for k in range(GRAM_BYTES):
        key = (key << U(8)) | data[k : k + n]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok = row[:n] == row[GRAM_BYTES - 1 :]
    return mix(key[ok]), row[:n][ok]


class BitSliced:
    """The filters of all languages; 64 languages to a word."""

    def __init__(self, profiles: dict[str, np.ndarray], slots_log2: int = SLOTS_LOG2, hashes: int = HASHES):
        self.languages = sorted(profiles)
        self.bits, self.hashes = slots_log2, hashes
        groups = max(1, -(-len(self.languages) // 64))
        self.words = np.zeros((groups, 1 << slots_log2), U)
        for at, lang in enumerate(self.languages):
            bit = U(1 << (at % 64))
            for slot in self._slots(profiles[lang].astype(U)):
                self.words[at // 64][slot] |= bit
        fill = [((self.words[at // 64] >> U(at % 64)) & U(1)).mean() for at in range(len(self.languages))]
        self.false_rate = np.array(fill) ** hashes

    def _slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.hashes):
            yield ((h >> U(21 * k)) & U((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, h: np.ndarray, group: int) -> np.ndarray:
        """Of each n-gram: the languages of the group that contain it."""
        out = None
        for slot in self._slots(h):
            got = self.words[group][slot]
            out = got if out is None else out & got
        return out

    def counts(self, h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits by row and language, and n-grams by row."""
        total = np.bincount(row, minlength=rows)
        hits = np.zeros((rows, len(self.languages)))
        for group in range(len(self.words)):
            mask = self.masks(h, group)
            for at in range(group * 64, min(len(self.languages), group * 64 + 64)):
                has = ((mask >> U(at % 64)) & U(1)).astype(bool)
                hits[:, at] = np.bincount(row[has], minlength=rows)
        fixed = (hits - total[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        return np.maximum(fixed, 0), total

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = pa.array(_letters(texts), pa.large_string())
        data, offs = buffers(clean)
        langs, scores = [], []
        for lo, hi in chunks(offs):
            at = offs[lo : hi + 1] - offs[lo]
            h, row = _grams(data[offs[lo] : offs[hi]], at)
            if not self.languages:
                langs += [UNKNOWN] * (hi - lo)
                scores += [0.0] * (hi - lo)
                continue
            hits, total = self.counts(h, row, hi - lo)
            best = hits.argmax(axis=1)
            # A text of letters whose n-grams are all unknown still gets the first language, with score 0.
            share = hits[np.arange(hi - lo), best] / np.maximum(total, 1)
            some = np.diff(at) > 0
            langs += [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            scores += [float(min(1.0, x)) if s else 0.0 for x, s in zip(share, some, strict=True)]
        return langs, scores


def _profile(least_share: float):
    def of_language(table: pa.Table) -> pa.Table:
        """The n-grams that enough rows contain."""
        lang = table.column("lang")[0].as_py()
        seen = np.zeros(0, U)
        times = np.zeros(0, np.int64)
        clean = pa.array(_letters(table.column("text").to_pylist()), pa.large_string())
        data, offs = buffers(clean)
        for lo, hi in chunks(offs):
            h, row = _grams(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            got, n = np.unique(h[new], return_counts=True)
            every, inverse = np.unique(np.concatenate([seen, got]), return_inverse=True)
            times = np.bincount(inverse, weights=np.concatenate([times, n]), minlength=len(every)).astype(np.int64)
            seen = every
        top = seen[times >= least_share * table.num_rows]
        return pa.table({"lang": pa.array([lang] * len(top), pa.string()), "gram": pa.array(top.view(np.int64))})

    return of_language


def sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of at most ``fit_rows`` distinct rows (doc_id, text, lang) of each language."""
    own = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    # A row for each language: a bound that does not grow with the rows.
    share = own.groupBy("lang").agg((F.lit(float(RANKED * fit_rows)) / F.count("*")).alias("share"))
    drawn = own.join(F.broadcast(share), "lang").filter((F.col("key") / F.lit(2.0**64) + 0.5) < F.col("share"))
    # Keys fold in each task before they move; RANKED * fit_rows of a language are left, about.
    first = Window.partitionBy("lang").orderBy("key")
    keys = drawn.select("lang", "key").distinct().withColumn("at", F.row_number().over(first)).filter(F.col("at") <= fit_rows).select("lang", "key")
    return own.join(F.broadcast(keys), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "text")


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, least_share: float = LEAST_SHARE) -> BitSliced:
    """The filters, from rows (doc_id, text, lang) whose lang is known."""
    got = sample(rows, fit_rows).groupBy("lang").applyInArrow(_profile(least_share), "lang string, gram long").toArrow()
    langs, grams = np.array(got.column("lang").to_pylist(), object), got.column("gram").to_numpy()
    return BitSliced({x: grams[langs == x].view(U) for x in dict.fromkeys(langs.tolist())})


def _classified(spark: SparkSession, model: BitSliced, text: str):
    """struct(lang, score) as a column."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def classify(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        langs, scores = sent.value.classify([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": langs, "score": scores})

    return classify(F.col(text))


def predict(df: DataFrame, model: BitSliced, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the language and the score."""
    got = free_name(df, "told")
    told = df.withColumn(got, _classified(df.sparkSession, model, text))
    rest = [c for c in df.columns if c not in (lang, score)]
    return told.select(*rest, F.col(got)["lang"].alias(lang), F.col(got)["score"].alias(score))


def keep(df: DataFrame, model: BitSliced, least_score: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a language, with at least that score."""
    got = free_name(df, "told")
    told = df.withColumn(got, _classified(df.sparkSession, model, text))
    return told.filter((F.col(got)["lang"] != UNKNOWN) & (F.col(got)["score"] >= least_score)).select(*df.columns)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
