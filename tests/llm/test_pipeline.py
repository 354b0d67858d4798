"""The pipeline's stages against a brute-force version of each, and with odd rows and columns."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_links, edit, split

import corpus_pipeline as pipeline
from marlstone.llm import op5_bpe_codec, op7_quality_rules, op10_language_id

SF = "/root/testdata/sf0.001"
CLASH = ("score", "lang_pred", "contaminated", "item_ids", "_id", "_items", "_hit", "digest", "told", "kept", "node", "component_id", "class")


def test_stages_are_those_asked_for():
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def good(rows):
    """Rows (doc_id, text, ...) that SQL keeps."""
    con = duckdb.connect()
    con.execute("create table rows_(doc_id bigint, text varchar)")
    con.executemany("insert into rows_ values (?, ?)", [(k, r["text"]) for k, r in enumerate(rows)])
    kept = {i for i, k in con.sql(f"select doc_id, kept from ({op7_quality_rules.sql_kept('rows_')})").fetchall() if k}
    return [r for k, r in enumerate(rows) if k in kept]


def grams(text):
    data = op10_language_id._letters([text])[0].encode()
    n = op10_language_id.GRAM_BYTES
    return [data[k : k + n] for k in range(len(data) - n + 1)]


def told(rows):
    """Rows whose language plain sets of n-grams explain."""
    sets = collections.defaultdict(dict)
    for r in rows:
        if r["lang"] and r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sets[r["lang"]][r["doc_id"], r["text"]] = set(grams(r["text"]))
    known = {}
    for lang, own in sets.items():
        assert len(own) <= op10_language_id.FIT_ROWS
        seen = collections.Counter(g for s in own.values() for g in s)
        known[lang] = {g for g, n in seen.items() if n >= op10_language_id.LEAST_SHARE * len(own)}
    return [r for r in rows if (g := grams(r["text"] or "")) and max(sum(x in k for x in g) for k in known.values()) >= pipeline.LEAST_LANGUAGE_SCORE * len(g)]


def apart(rows):
    """One row of each component, and all without words."""
    numbered = [(k, r["text"]) for k, r in enumerate(rows)]
    of = collections.defaultdict(list)
    for k, n, part in brute_links(numbered):
        if n:
            of[part].append(k)
    key = lambda r: hashlib.md5(f"{'-' if r['doc_id'] is None else r['doc_id']}|{r['text']}".encode()).digest()
    first = [min((rows[k] for k in own), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, key(r))) for own in of.values()]
    return first + [r for r in rows if not split(r["text"])]


def clean(rows):
    ids = collections.defaultdict(lambda: len(ids))
    items = [np.array([ids[x] for x in split(t)]) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    return [r for r in rows if not any(edit(p, np.array([ids[x] for x in split(r["text"])])) <= int(0.2 * len(p)) for p in items)]


def named(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.filter("length(text) between 300 and 900").orderBy("doc_id").limit(12).collect()
    extra = [r.asDict() | more for r in own[:6] for more in ({}, {"doc_id": None}, {"doc_id": 7}, {"doc_id": own[0]["doc_id"], "lang": None})]
    extra += [own[0].asDict() | {"doc_id": 90_000 + k, "text": t} for k, t in enumerate((None, "", " \n", "12 34 " * 40, "ok"))]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.md5("text"), F.lit("-"))) for c in CLASH})
    rows = docs.collect()
    for k, ((name, stage), brute) in enumerate(zip(pipeline.STAGES[:-1], (good, told, apart, clean), strict=True)):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        want = brute(rows)
        assert got.columns == docs.columns and len(want) < len(rows) or name == "language ID", name
        docs, rows = got, got.collect()
        assert named(rows) == named(want), name
        assert all(r[c] == f"{c} {hashlib.md5(r['text'].encode()).hexdigest()}" for r in rows for c in CLASH)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op5_bpe_codec.default_path())
    want = collections.Counter()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, pipeline.encoding(spark, docs, SF).collect())) == want


def test_run_chains_the_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for brute in (good, told, apart, clean):
        rows = brute(rows)
    assert {r["doc_id"] for r in pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in rows}


def test_empty_and_odd_tables(spark):
    rows = [(1, None, "en", "s", 0, 1), (None, "x", "en", "s", 1, 1), (2, "", None, None, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for df in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()
    assert pipeline.ngram_join(spark, docs.withColumn("text", F.lit(None).cast("string")), SF).count() == 3
