"""Language detection: literal cases, missing languages, and edge cases of texts."""

from reelwright.operators import localize as L


def test_detects_and_leaves_blank_texts_null(spark):
    rows = [("the river and the hill", "en"), ("when they came home the dog was there", "en"), ("der Fluss und der Berg", "de"),
            ("als sie nach Hause kamen war der Hund da", "de"), ("ignored words", "xx"), (None, "en"), ("", "de"), ("anything", None)]
    model = L.train_language_model(spark.createDataFrame(rows, "text string, lang string"), ["en", "de", "fr"])
    assert sorted((r.language, len(r.weights)) for r in model.collect()) == [("de", 4096), ("en", 4096)]
    texts = ["The dog and the hill", "der Hund und der Berg", "", None, " \t\n", "the " * 20000, "DER"]
    found = L.detect_language(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), model, ["en", "de", "fr"], lang="t")
    assert found.columns == ["id", "t", "lang"]
    assert [r.lang for r in found.orderBy("id").collect()] == ["en", "de", None, None, None, "en", "de"]


def test_ties_and_empty_tables(spark):
    same = spark.createDataFrame([("uno dos", "b"), ("uno dos", "a")], "text string, lang string")
    model = L.train_language_model(same, ["b", "a"])
    docs = spark.createDataFrame([("dos",)], "t string")
    assert L.detect_language(docs, model, ["b", "a"], lang="t").collect()[0].lang == "a"
    nothing = L.train_language_model(same.where("false"), ["a"])
    assert L.detect_language(docs, nothing, ["a"], lang="t").collect()[0].lang is None
    assert L.detect_language(docs.where("false"), model, ["a"], lang="t").count() == 0
