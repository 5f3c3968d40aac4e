"""The near-duplicate stage against brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import similar


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """doc_ids that stay: the smallest of each component of pairs of Jaccard similarity >= 0.8."""
    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return sorted(i for i in up if up[i] == i)


def test_five_word_similarity(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = words(40), ["", None, "One two", "one  TWO", "one three", "a b c d e", "a b c d e f"]
    for size in (12, 30, 90, 400):
        for edits in range(6):
            base = words(size)
            for _ in range(6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
        # a chain: ends are apart, neighbours alike; and own words around a common passage
        chain = words(size)
        for _ in range(6):
            chain = chain[1:] + words(1)
            texts.append(" ".join(chain))
        texts += [" ".join(words(size) + passage) for _ in range(6)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_driver_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()) == kept(rows)


def test_edges(spark):
    """Nulls, repeated ids and rows, very long texts, clashing columns and the empty table."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, None), (3, "one two"), (3, "one two"), (4, long), (4, long + " more"), (None, "alone here"), (None, "alone here"), (5, "ONE two"), (6, "x y z w v u t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "key", "fp", "s", "h", "g", "u", "v", "c", "least", "row", "_row"):
        df = df.withColumn(name, F.lit("clash"))
    out = similar.similar_dedup(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "")[:10]) for r in out.collect()), key=str)
    assert [x for x in got if x[0] != 4] == sorted([(1, ""), (3, "one two"), (None, "alone here"), (6, "x y z w v ")], key=str) and sum(i == 4 for i, _ in got) == 1
    assert similar.similar_dedup(df.where("false")).count() == 0
    assert similar.similar_dedup(df.where("text is null")).count() == 1
