import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline


def test_stages_act_on_what_is_left(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    clean = [(i, text(60)) for i in range(20)]
    rows = clean + [(100, clean[3][1]), (101, clean[4][1] + " more"), (102, f"{text(30)} {item} {text(9)}"), (103, "12 34"), (104, None), (105, f"{text(20)} token=abcdef123456 {text(5)}"), (106, clean[3][1])]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_leaks", "secret_scan", "packing"]
    left = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{103, 104}, {100, 101, 106}, {102}, set()]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, gone):
        before = {r["doc_id"] for r in left.collect()}
        stage(spark, left, folder).write.parquet(f"{folder}/{name}")
        left = spark.read.parquet(f"{folder}/{name}")
        assert left.columns == docs.columns and before - {r["doc_id"] for r in left.collect()} == expected, name
    kept = {r["doc_id"]: r for r in left.collect()}
    assert "[SECRET]" in kept[105]["text"] and kept[105]["n_chars"] == len(kept[105]["text"])
    assert all(kept[i]["text"] == t for i, t in clean)
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(kept)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_documents_without_languages_stay(spark):
    rows = [(1, "some words", None), (2, "日本", None), (3, "12 34", None), (4, None, None), (5, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {1, 2, 5}


def test_rows_that_share_a_doc_id_go_only_with_their_words(spark):
    one, two = "one two three four five six seven", "quite other words stand in this very text"
    rows = [(1, one), (1, one.upper()), (1, two), (1, None), (2, two + " and more at its end"), (None, one), (None, one)]
    left = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in left) == sorted((str(i), (t or "").lower()) for i, t in [rows[0], rows[2], rows[3], rows[4], rows[5], rows[6]])
