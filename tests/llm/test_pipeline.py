"""The pipeline's stages."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(corpus_pipeline.COLUMNS) < set(out.columns)
    assert 0 < out.count() < docs.count()
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0
    assert out.where("copies NOT IN (1, 2)").count() == 0


def test_stages_keep_the_columns_and_clean_documents(spark):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(30)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    edited = base[0].split()
    edited[40] = "changed"
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(100, base[1], "en"), (101, " ".join(edited), "en"), (102, f"{base[2][:200]} {item}", "en"), (103, None, "en"), (104, "???", "en")]
    docs = made(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    for f in list(stage.values())[:-1]:
        assert f(spark, docs, SF).columns == corpus_pipeline.COLUMNS
    assert ids(stage["language_id"](spark, docs, SF)) == {i for i, _, _ in rows} - {103, 104}
    assert ids(stage["line_dedup"](spark, docs, SF)) == {i for i, _, _ in rows}
    assert {i for i, _, _ in rows} - ids(stage["simhash_near_dedup"](spark, docs, SF)) == {100, 101}
    assert {i for i, _, _ in rows} - ids(stage["benchmark_decontamination"](spark, docs, SF)) == {102}
    mixed = stage["source_mixing"](spark, docs, SF)
    assert mixed.agg(F.sum("taken")).first()[0] > 0


def test_stages_take_an_empty_table(spark):
    docs = made(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_language_stage_learns_alphabets_other_than_latin(spark):
    rng = random.Random(2)
    words = {"ru": ["привет", "дорога", "слово", "книга", "время", "город"], "el": ["λόγος", "θάλασσα", "δρόμος", "βιβλίο", "χρόνος", "πόλη"]}
    rows = [(n, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for n, lang in enumerate(["ru", "el"] * 30)]
    rows += [(100, None, "ru"), (101, "12 34 ?", "ru")]
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    assert {r.doc_id: r.lang for r in stage(spark, made(spark, rows), SF).collect()} == {n: lang for n, _, lang in rows[:60]}
    rows += [(n, " ".join(rng.choice(["the", "street", "word", "book", "time"]) for _ in range(40)), "en") for n in range(200, 230)]
    assert {r.doc_id: r.lang for r in stage(spark, made(spark, rows), SF).collect()} == {n: lang for n, _, lang in rows if n not in (100, 101)}


def test_mixing_keeps_equal_rows_single(spark):
    rows = [(1, "twelve words " * 6, "en", "s", 1)] * 4 + [(2, "a b", "en", "t", 1), (None, "c d", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixed(spark, docs, SF)
    got = [r for r in out.collect() if r.source == "s"]
    assert len(got) <= 4 and sum(r.taken for r in got) <= got[0].target + 6


def test_stages_keep_rows_without_ids(spark):
    rng = random.Random(3)
    text = [" ".join(f"w{rng.getrandbits(30)}" for _ in range(60)) for _ in range(3)]
    docs = made(spark, [(5, text[0], "en"), (9, text[1], "en"), (None, text[0], "en"), (None, text[1], "en"), (None, text[2], "en")])
    stage = dict(corpus_pipeline.STAGES)
    assert stage["simhash_near_dedup"](spark, docs, SF).count() == 5
    for name in ("line_dedup", "benchmark_decontamination"):
        assert stage[name](spark, docs, SF).count() == 5
