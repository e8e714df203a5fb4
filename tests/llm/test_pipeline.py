import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fragspark.llm import entries
from fragspark.llm.shared import stored
from llm_helpers import WORD, corpus, words
from test_search import jaccard_brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    # short and symbol-laden texts are bad, the rest is good
    labels = [(r[0], int(len(words(r[1])) > 60), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_one_by_one(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, path), f"test{i}")
        assert docs.columns == columns, name
        old, new = before.collect(), docs.collect()
        if i == 0:
            assert {r.doc_id for r in new} <= {r.doc_id for r in old} and {r.text for r in new} <= {r.text for r in old}
        if i == 1:
            expected = {root for n, root in jaccard_brute([tuple(r) for r in old], 5, 80).values()}
            assert {r.doc_id for r in new} == expected and len(new) == len(expected)
        if i == 2:
            assert {r.doc_id for r in new} == {r.doc_id for r in old} and all(r.n_chars == len(r.text) for r in new)
        if i == 3:
            from fragspark.llm.op3_mixing import mix

            taken = {r.doc_id: r.taken for r in mix(before).collect()}
            got = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
            assert got == {k: v for k, v in taken.items() if v}
    assert corpus_pipeline.packing(spark, docs, path).agg(F.sum("length")).first()[0] > 0


def test_stages_take_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_stages_take_odd_tables(spark, folder, odd):
    path, _ = folder
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns
        out.collect()


def test_run_and_entries(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    assert [int(n[2:].split("_")[0]) for n in entries.queries()] == list(range(1, 11))
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_near_duplicates_keep_each_text_of_an_id_once(spark, folder):
    path, _ = folder
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, a), (3, None), (3, None), (None, a), (None, a), (4, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (1, b), (3, None), (None, a), (None, a), (4, "")], key=str)


def test_repeated_passages_of_over_50_words_go(spark, folder):
    path, _ = folder
    rng = random.Random(5)
    prose = lambda n, most: [rng.choice("bcdfghjk") + "".join(rng.choice("aeiou") for _ in range(rng.randrange(most))) for _ in range(n)]
    middle, short, kept = " ".join(prose(51, 9)), " ".join(prose(51, 1)), " ".join(prose(50, 9))
    solid = "".join(rng.choice("lmnp") for _ in range(400))
    assert len(middle) < 400 and len(short) == 101
    ends = [f"{a * 40} {{}} {b * 40}" for a, b in ("qr", "st", "vw", "xy", "QR", "ST", "VW", "XY")]
    texts = [e.format(p) for e, p in zip(ends, [x for x in (middle, short, kept, solid) for _ in range(2)])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, spark.createDataFrame(rows, SCHEMA), path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t if i in (4, 5) else t[:40] + t[-40:]), i


def test_runs_like_brute_force(spark, folder):
    path, rows = folder
    texts = {r[0]: (r[1] or "").encode() for r in rows if len(r[1] or "") < 9000}
    count = Counter(t[i : i + 101] for t in texts.values() for i in range(len(t) - 100))
    docs = spark.createDataFrame([r for r in rows if r[0] in texts], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, docs, path).collect()}
    gone = 0
    for i, t in texts.items():
        left, at = bytearray(t), 0
        keep = [True] * len(t)
        while at < len(t) - 100:
            end = at
            while end < len(t) - 100 and count[t[end : end + 101]] > 1:
                end += 1
            if end > at:
                run = range(at, end + 100)
                whole = sum(m.start() >= run.start and m.end() <= run.stop for m in WORD.finditer(t))
                if whole > 50 or len(run) >= 400:
                    gone += len(run) < 400
                    for k in run:
                        keep[k] = False
            at = end + 1
        left = bytes(b for b, k in zip(t, keep) if k).decode("utf-8", "ignore")
        assert (got[i] or "") == left, i
    assert gone
