"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in functions run; there is no user function and no shuffle, so each
row is judged where it is read and nothing grows with the corpus.

Defined results: a null or empty text has no words, zero counts, fails the base
rules (fewer than 50 words) and is not kept.  Very long texts are read whole;
window counting is O(n log n) in a text's words.  Rows are judged alone, so
repeated rows get equal results and ties cannot arise; an empty table gives an
empty result.  Clashing names: the operator's own columns replace input columns
of the same name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Sentence marks removed before a word is looked up as a stop word.
MARKS = ",.;:!?"
# Frequent function words of the languages in the corpus.
STOP_WORDS = {
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with"],
    "fr": ["au", "aux", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
    "de": ["als", "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "más", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
}


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high``, compared as integers; None is unbounded.

    The bounds are hundredths.  A zero denominator passes.
    """

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


#: The default table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 30),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("shouted_words", "n_shouted", "n_words", None, 50),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            at = F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
            return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(tagged, of_sorted))

    def windows_of(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows_of(words), covered)).cast("long")


def _counts(text: Column, then) -> Column:
    """``then`` of a struct of the counts that rules refer to.

    Words and lines are bound inside one expression, so the optimizer can't put
    their definition into a lambda that runs for each of them.
    """
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    t = F.coalesce(text, F.lit(""))
    solid = lambda c: F.translate(c, BLANKS, "")

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(solid(t)).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(F.translate(w, MARKS, "")).isin(stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: (F.char_length(w) > 3) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_shouted"),
        )

    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: solid(x) != "")
    return _let(words, lambda w: _let(lines, lambda l: _let(of(w, l), then)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouted")


def passes(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the counts."""
    out = F.lit(True)
    for r in rules:
        have, per = counts[r.numerator] * 100, counts[r.denominator]
        if r.low is not None:
            out = out & ((per == 0) | (have >= per * r.low))
        if r.high is not None:
            out = out & ((per == 0) | (have <= per * r.high))
    return out


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts, ``base_failed`` and ``kept``: the whole table as one expression."""

    def then(c: Column) -> Column:
        base = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)
        return F.struct(*(c[n].alias(n) for n in COUNTS), base.alias("base_failed"), (~base & passes(c, rules)).alias("kept"))

    return _counts(text, then)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``kept``."""
    return df.drop(*COUNTS, "base_failed", "kept").withColumn("_verdict", verdict(F.col(text), rules)).select("*", "_verdict.*").drop("_verdict")


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, unchanged."""
    return df.filter(F.coalesce(verdict(F.col(text), rules)["kept"], F.lit(False)))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(*RESULT)


def sql_kept(source: str = "documents") -> str:
    """The whole result over ``source`` in DuckDB's SQL, with ``RULES``."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    bounds = []
    for r in RULES:
        bounds += [f"({r.denominator} = 0 or 100 * {r.numerator} >= {r.low} * {r.denominator})"] if r.low is not None else []
        bounds += [f"({r.denominator} = 0 or 100 * {r.numerator} <= {r.high} * {r.denominator})"] if r.high is not None else []
    blanks = r"[\x20\x09-\x0D]"
    return f"""
with split as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{blanks}', '', 'g') <> '') as l
  from {source}),
win as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from split),
keyed as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from win),
again as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt
          from (select doc_id, i, count(*) over (partition by doc_id, g) as n from keyed) where n > 1),
reps as (select doc_id, sum(least(3, coalesce(nxt - i, 3)))::bigint as n_repeat_words from again group by doc_id),
counts as (
  select s.doc_id, len(w)::bigint as n_words,
         length(regexp_replace(t, '{blanks}', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: lower(regexp_replace(x, '[,.;:!?]', '', 'g')) in ({stop})))::bigint as n_stop_words,
         len(list_filter(w, lambda x: length(x) > 3 and upper(x) = x and lower(x) <> x))::bigint as n_shouted
  from split s left join reps r on s.doc_id = r.doc_id),
based as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(bounds)} as kept
from based"""
