"""Token counts of a unigram vocabulary, by Viterbi without a back-trace.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position;
dynamic programming keeps, for each position, the best score and the number of
pieces on its path.  The rules are those of the public unigram tokenizer: a
character that is no piece by itself may be unknown, at the least score less 10;
neighbouring unknowns count once; on equal scores the piece that starts first
stays; scores add up from the left.  Only as many positions are kept as the
longest piece has characters.

Blanks become ``▁`` and a text is cut before each of them, as by the public
pre-tokenizer, so each cut is counted alone; short ones are remembered in a table
of bounded size.

No unigram model is among the public tokenizer files, so the default vocabulary
is the pieces of ``piece_bpe_32k.model`` with log-probabilities by Zipf's law of
their rank; any list of (piece, score) can be given instead.

Defined results: null and empty texts have no tokens.  Rows are counted alone,
so repeats, ties and empty tables need no care; long texts are read whole, and
extra columns pass through ``count_tokens`` unless one is named as its result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Cuts up to this length are remembered; entries of each of two generations.
SHORT = 32
REMEMBERED = 250_000


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model, scored by rank; the unknown piece is first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(plain))))
    return [("<unk>", 0.0), *((p, -math.log(k + 1) - total) for k, p in enumerate(plain))]


class Counter:
    """``vocabulary``: (piece, score), the unknown piece first."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        scores = dict(vocabulary[1:])
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.longest = max(map(len, scores), default=1)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def viterbi(self, cut: str) -> int:
        """Pieces of the best path through one cut."""
        ring = self.longest + 1
        score, count, unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(cut)
        ahead = next(matches, None)
        for end, char in enumerate(cut):
            best = None
            pieces, was = 0, False
            # Pieces ending here come longest first, which is in order of their start.
            while ahead is not None and ahead[0] == end:
                n, s = ahead[1]
                k = (end + 1 - n) % ring
                total = score[k] + s
                if best is None or total > best:
                    best, pieces = total, count[k] + 1
                ahead = next(matches, None)
            if char not in self.single:
                k = end % ring
                total = score[k] + self.unknown
                if best is None or total > best:
                    best, pieces, was = total, count[k] + (not unknown[k]), True
            k = (end + 1) % ring
            score[k], count[k], unknown[k] = best, pieces, was
        return count[len(cut) % ring]

    def cut(self, cut: str) -> int:
        got = self.known.get(cut)
        if got is None:
            got = self.older.get(cut)
            if got is None:
                got = self.viterbi(cut)
                if len(cut) > SHORT:
                    return got
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[cut] = got
        return got

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        cuts = marked.split(SPACE)
        if marked[0] == SPACE:
            del cuts[0]
        # Cuts are remembered without their mark, which all have.
        known, count = self.known.get, 0
        for c in cuts:
            got = known(SPACE + c)
            count += self.cut(SPACE + c) if got is None else got
        return count


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(zipf_vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its texts."""
    path = path or default_path()
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    return df.withColumn(to, run(F.col(text)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_tokens")
