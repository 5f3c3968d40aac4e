"""The pipeline's decontamination counts and cuts benchmark items of fewer words than a window."""

import corpus_pipeline


def test_short_items(spark, tmp_path):
    items = [(1, "One two three"), (2, "Über alles"), (3, "..."), (None, "no id here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["so one, TWO three and Über alles", "a one two three b", "one two", "well no id here", "..."]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.clean_of_benchmarks(spark, docs, str(tmp_path)).collect()}
    assert got == {1: ("a  b", 4), 2: ("one two", 7), 3: ("well ", 5), 4: ("...", 3)}
