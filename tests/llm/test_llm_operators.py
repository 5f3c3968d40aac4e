"""The other operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, embeddings, gbdt, langid, mixing, pii, quality, simhash, tokens
from quern.llm.common import components, stored, table


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (10, 11), (11, 12), (12, 13), (13, 10), (7, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(-5, -9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 11: 10, 12: 10, 13: 10, -5: -9} | {101 + i: 100 for i in range(40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def window_hits(text, items):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    hit, own = [False] * len(words(low)), set()
    for i, t in items:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(8, len(w))
        for k in range(len(w) - size + 1) if size else ():
            for at in range(len(hit) - size + 1):
                if words(low)[at : at + size] == w[k : k + size]:
                    hit[at : at + size] = [True] * size
                    own |= {str(i)} if i is not None else set()
    return len(hit), sum(hit), sorted(own)


def test_decontamination(spark):
    items = [(1, "One two three four five six seven eight nine"), (20, "Über alles"), (3, None), (4, "..."), (20, "one more row of item twenty with nine words!"), (None, "no id here")]
    texts = ["so ONE, two three four five six seven eight nine! über alles", "one two three four five six seven", None, "", "no id here. No ID-here", "a one two three four five six seven eight b two three four five six seven eight nine"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = "word " * 40_000 + items[0][1] + " word" * 40_000
    seen = decontaminate.benchmark_hits(spark.createDataFrame([(0, long)], "doc_id long, text string"), bench).first()
    assert seen.n_words == 80_009 and list(seen["items"]) == ["1"] and [(x.s, x.e) for x in seen.spans] == [(40_000, 40_009)]
    for size in (1 << 20, 40):
        got = decontaminate.benchmark_hits(frame, bench, block_bytes=size).collect()
        for r in got:
            assert (r.n_words, sum(s["e"] - s["s"] for s in r.spans), list(r["items"])) == window_hits(texts[r.doc_id], items)
        assert len(got) == 7
    left = decontaminate.decontaminate(frame, bench)
    got = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == frame.columns and left.count() == 7
    assert got == {0: "so ! über alles", 1: texts[1], 2: None, 3: "", 4: texts[4], 5: "a  b "}
    assert decontaminate.benchmark_hits(frame, bench.where("item_id = 99")).where("size(items) > 0").count() == 0


def test_mixing(spark, docs):
    r = mixing.mix_sources(docs).toPandas()
    by = r.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert len(r) == docs.count() and abs(by.target.sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    assert ((by.taken - by.target).abs() <= 1).all() and (r.taken <= 3 * r["size"]).all()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, r[key].values))


def test_mixing_edges(spark):
    rows = [(1, None, None), (2, "", None), (3, "a b c", "x"), (3, "a b c", "x"), (None, "d e", "y"), (None, "d e", "y"), (5, "q " * 90, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    r = mixing.mix_sources(df).toPandas()
    total = {s: g.taken.sum() for s, g in r.fillna({"source": "null"}).groupby("source")}
    # weights: "" 1, "x" 2, "y" 3, null 1; x and y stop at three times their size
    assert total == {"": 70, "x": 18, "y": 12, "null": 0}
    assert mixing.mix_sources(df.where("doc_id = 99")).count() == 0
    assert mixing.mixed(stored(df)).columns == [*df.columns, "mix_size", "mix_taken", "mix_copies"]


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 1, 1000), (None, 1, 4)], "source string, n long, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got[None] == 12 and got["a"] == 30 and got["b"] == 30 and abs(got["c"] - 952) < 1e-9


def test_mass_is_moved_without_bias(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 9).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    r = mixing.mix_sources(df).toPandas()
    for _, g in r.groupby("source"):
        rate = g.target.iloc[0] / g.source_size.iloc[0]
        for _, own in g.groupby("size"):
            assert abs(own.taken.sum() / own["size"].sum() - rate) < 0.12
        assert (g.taken % g["size"] != 0).sum() <= 1


def test_language(spark, docs):
    marked = docs.withColumn("lang_pred", F.lit("clash")).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = langid.identify(marked, marked.where("not held"), keep=("doc_id", "lang", "held")).toPandas()
    held = got[got.held]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "x"), (5, "ein " * 200_000)], "doc_id long, text string")
    r = {x.doc_id: x for x in langid.identify(odd, docs).collect()}
    assert [r[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and r[4].lang_pred != "und" and r[5].lang_pred == "de"
    assert langid.identify(odd, docs.where("false")).where("lang_pred <> 'und' or score <> 0").count() == 0


def plain_grams(text):
    """Buckets of a text's n-grams, one by one: runs of what is no letter are one space, before and behind two."""
    import unicodedata

    kept = []
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        kept.append(c if kind in "LM" else " ")
    s = "  " + re.sub(" +", " ", "".join(kept)).removeprefix(" ")
    out = []
    for at in range(2, len(s)):
        h = 0
        for n, c in enumerate((s + "  ")[at : at + 3], 1):
            h = (h + ord(c)) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            out.append((n, h * 0x85EBCA77 % 2**32 >> 16))
    return [b for _, b in out]


def test_language_equals_plain_bayes(spark, docs):
    import math
    from collections import Counter

    training = docs.where("doc_id % 3 = 0").select("doc_id", "text", "lang").collect()
    counts, n = defaultdict(Counter), Counter()
    for r in training:
        counts[r.lang].update(plain_grams(r.text))
        n[r.lang] += 1
    asked = docs.where("doc_id % 3 = 1 and length(text) < 3000").select("doc_id", "text")
    got = {r.doc_id: r for r in langid.identify(asked, docs.where("doc_id % 3 = 0")).collect()}
    total = {x: sum(c.values()) for x, c in counts.items()}
    for r in asked.collect()[:40]:
        score = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * langid.BUCKETS)) for g in plain_grams(r.text)) for x in counts}
        best = max(sorted(score), key=score.get)
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - 1 / sum(math.exp(v - score[best]) for v in score.values())) < 1e-3


def test_many_languages_take_passes(spark, docs, monkeypatch):
    whole = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, docs).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, docs).collect()} == whole and len({x for x, _ in whole.values()}) == 4


def test_language_chunks_agree(spark, docs, monkeypatch):
    text = "Bonjour le monde, ça va bien aujourd'hui et demain."
    langs, model = langid.train(docs, "text", "lang")

    class Held:
        value = langid._block(model, langs)

    import pyarrow as pa

    low = [float("-inf")] * 3
    run = lambda: next(langid._predict(Held, langid.LENGTHS)(iter([pa.RecordBatch.from_pydict({"_text": [text, None, text + text], "lang_pred": ["und"] * 3, "_best": low, "_sum": low})]))).to_pylist()
    whole = run()
    assert whole[1]["lang_pred"] == "und" and whole[0]["lang_pred"] == "fr"
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert [x["lang_pred"] for x in run()] == [x["lang_pred"] for x in whole]


def plain_print(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(120).collect()]
    near = [(1000 + i, t + " tail") for i, t in base[:40]] + [(2000, None), (2001, ""), (2002, "One"), (2003, "one"), (2004, "a b c")]
    df = spark.createDataFrame(base + near, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    prints = {i: plain_print(t, 3) for i, t in base + near}
    want = plain_components(prints)
    got = {r.doc_id: r for r in simhash.near_groups(stored(df)).collect()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.simhash_dedup(stored(df.union(df.where("doc_id < 5"))))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def joined(nodes, pairs):
    """The smallest node that each one reaches."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in nodes}


def test_a_large_bucket_is_linked(spark):
    """Hundreds of prints around one, and chains, in few buckets."""
    ball = {0} | {1 << a | 1 << b for a in range(64) for b in range(a)}
    chain = {(1 << 63) | (2**k - 1) << 20 for k in range(30)}
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in ball | chain)
    got = {(r.u, r.v) for r in simhash.links(stored(spark.createDataFrame([(x,) for x in fps], "fp long")), 2).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert joined(fps, got) == joined(fps, want) and len(got) < len(want)


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_links_are_complete(spark, radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(-(2**63), 2**63, 30, dtype=np.int64)
    near = [int(c) ^ int(sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 4)).tolist()))) for c in centre for _ in range(6)]
    fps = sorted(set(near) | set(map(int, centre)))
    got = {(r.u, r.v) for r in simhash.links(stored(spark.createDataFrame([(x,) for x in fps], "fp long")), radius).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert {(min(p), max(p)) for p in got} <= want
    assert joined(fps, got) == joined(fps, want)
    assert simhash.links(spark.createDataFrame([], "fp long"), radius).count() == 0


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [None, "", " ", "  a  b ", "▁a ▁b", "<s>hi</s> <unk>", "x　y\n\nz\t", "\0", "ａ①", "word " * 3000, "a" * 5000, "trailing "]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000 + i, t) for i, t in enumerate(odd)] + [(9003, odd[3]), (None, "q"), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("p", F.lit("clash"))
    for head in (100_000, 50, 0):
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, path, head=head).collect()), key=str)
        assert got == sorted(((i, len((t or "").encode()), len(plain.encode(t or ""))) for i, t in rows), key=str)
    assert tokens.token_counts(df.where("false"), path).count() == 0


def test_models_that_do_not_add_up_are_refused(tmp_path):
    import public_tokenizers

    tokens.check_model(public_tokenizers.path("piece_bpe_32k.model"))
    text = lambda k, b: bytes([k << 3 | 2, len(b)]) + b
    number = lambda k, n: bytes([k << 3, n])
    plain = number(4, 0)
    for pieces, rules, fine in (([b"\xe2\x96\x81a"], plain, True), ([b"a\xe2\x96\x81b"], plain, False), ([b"a"], plain + text(2, b"map"), False), ([b"a"], b"", False), ([b"a"], plain + number(3, 0), False)):
        path = tmp_path / "x.model"
        path.write_bytes(b"".join(text(1, text(1, p)) for p in pieces) + text(3, rules))
        if fine:
            tokens.check_model(str(path))
        else:
            with pytest.raises(ValueError):
                tokens.check_model(str(path))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fine(kind, s):
        d = re.sub("[^0-9]", "", s)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15

    found = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fine(k, m[0])]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_patterns():
    import random

    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice(["@", ".", "1", "25", "255", "256", "000", "0255", "a", "b-", "+", "+1", " ", "(", ")", "-", "é", "%", "4111111111111111", "_"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_is_linear_on_junk():
    for junk in ("a" * 200_000, "0" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "+" + " " * 200_000):
        pii.base_spans(junk)


def test_pii_query(spark, docs):
    extra = [(7001, None), (7002, ""), (7003, "call +1 (826) 555-4081 190.137.223.204 now"), (7003, "call +1 (826) 555-4081 190.137.223.204 now")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("base", F.lit("clash"))
    for r, t in ((r, r.t) for r in pii.find_pii(df.withColumn("t", F.col("text")), keep=("doc_id", "t")).collect()):
        want = plain_spans(t or "")
        assert r["base"] == pii._written(want) and set(want) <= {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS]
    clean = pii.redact_pii(df)
    assert clean.columns == df.columns and clean.where("text rlike '[0-9]@[a-z]'").count() == 0
    same = clean.alias("a").join(df.alias("b"), "doc_id").where(F.col("a.text") == F.col("b.text")).count()
    assert same > 0.5 * df.count()
    assert pii.find_pii(df.where("false")).count() == 0


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = gbdt.fit(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == y[1500:].astype(bool)).mean() > 0.95


def test_quality(spark, data, docs):
    labels = table(spark, data, "labels")
    got = quality.classify(docs, labels, keep=("doc_id",)).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert len(got) >= docs.count() and clean.kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.3
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(8001, None), (8002, ""), (8003, "idiot moron stupid scum you loser"), (None, "a b")], "doc_id long, text string")).withColumn("_low", F.lit("clash"))
    r = {x.doc_id: x for x in quality.classify(odd, None).collect()}
    assert not r[8003].kept and 8001 in r and None in r
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.2
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth).astype(int) for a in (0.9, 0.8, 0.75)], 1)
    votes[rng.random(votes.shape) < 0.3] = 2
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.weigh(patterns, counts.astype(float), 0.3)[inverse.ravel()]
    assert ((post > 0.5) == truth).mean() > 0.88


def plain_links(rows):
    out, root = defaultdict(int), {}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(good)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (_, x, p), (_, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                out[a] += 1
                out[b] += 1
                s, t = find(a), find(b)
                root[max(s, t)] = min(s, t)
    groups = defaultdict(list)
    for a in range(len(good)):
        groups[find(a)].append(good[a][0])
    comp = {}
    for a in range(len(good)):
        comp[a] = min(groups[find(a)])
    return sorted([(good[a][0], out[a], comp[a], good[a][0] == comp[a]) for a in range(len(good))] + [(i, 0, i, True) for i, v, lab in rows if not any(v is w for _, w, _ in [(0, v, 0)] if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))])


@pytest.mark.parametrize("block", [2000, 7])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in np.float32(base[i % 40] + rng.standard_normal(16) * (0.02 * (i % 4)))], int(i % 40 % 3)) for i in range(200)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None), (304, rows[0][1], 0), (304, rows[0][1], 0), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [None] * 16, 0), (308, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("clash"))
    got = sorted(tuple(r) for r in embeddings.embedding_dedup(stored(df)).collect())
    assert got == plain_links(rows)
    assert embeddings.embedding_dedup(df.where("false")).count() == 0


def test_em_equals_plain_em():
    """``weigh`` against the same model written as loops over documents."""
    import math
    import random

    rng = random.Random(2)
    votes = [tuple(rng.choice((0, 1, 2)) for _ in range(3)) for _ in range(400)]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    rate, table = 0.2, [[[0.5, 0.1, 0.4]] * 3, [[0.1, 0.5, 0.4]] * 3]
    post = [0.0] * len(votes)
    for _ in range(100):
        new = []
        for v in votes:
            good, bad = (math.prod(table[c][k][x] for k, x in enumerate(v)) * p for c, p in ((0, 1 - rate), (1, rate)))
            new.append(bad / (good + bad))
        for c in (0, 1):
            table[c] = []
            for k in range(3):
                n = [1.0] * 3
                for v, p in zip(votes, new, strict=True):
                    n[v[k]] += p if c else 1 - p
                table[c].append([x / sum(n) for x in n])
        rate = min(max(sum(new) / len(new), 1e-3), 0.9)
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-6:
            break
        post = new
    got = dict(zip(map(tuple, patterns.tolist()), quality.weigh(patterns, counts.astype(float), 0.2), strict=True))
    assert all(abs(got[v] - p) < 1e-6 for v, p in zip(votes, new, strict=True))


def test_linear_scorer_equals_plain_steps():
    rng = np.random.default_rng(3)
    x = [np.sort(rng.choice(40, rng.integers(1, 9), False)) for _ in range(60)]
    y = rng.random(60)
    w, bias = quality.fit_linear(np.concatenate(x), np.array([len(a) for a in x]), y, rounds=15)
    v, b, g2, b2 = np.zeros(40), 0.0, np.full(40, 1e-8), 1e-8
    for _ in range(15):
        grad, total = np.zeros(40), 0.0
        for own, t in zip(x, y, strict=True):
            e = (1 / (1 + np.exp(-(v[own].sum() + b))) - t) / 60
            grad[own] += e
            total += e
        g2 += grad**2
        b2 += total**2
        for k in range(40):
            step = 0.3 / np.sqrt(g2[k])
            z = v[k] - step * grad[k]
            v[k] = np.sign(z) * max(abs(z) - step * 2e-4, 0)
        b -= 0.3 * total / np.sqrt(b2)
    assert np.allclose(w[:40], v, atol=1e-9) and not w[40:].any() and abs(bias - b) < 1e-9
    # what only one of many documents has stays at zero, so it may be left out
    many = [np.append(rng.choice(5, 2, False), 100 + i) for i in range(6000)]
    w, _ = quality.fit_linear(np.concatenate(many), np.full(6000, 3), (np.arange(6000) % 3 == 0).astype(float), rounds=5)
    assert not w[100:].any()


def test_labels_teach_the_lexicon(spark):
    """Stems that only labelled toxic documents hold reject others that hold them; the word list knows none of these."""
    import random

    rng = random.Random(4)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    bad = lambda: rng.choice(("zaxquo", "kevvix")) + rng.choice(syllables)
    rows = []
    for i in range(1200):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), bad())
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.where("doc_id % 3 <> 1").select("doc_id", F.lit(1).alias("quality"), "toxic")
    got = {r.doc_id: r.kept for r in quality.classify(df, labels).collect()}
    apart = [(i, t) for i, _, t in rows if i % 3 == 1]
    assert all(not got[i] for i, t in apart if t) or sum(not got[i] for i, t in apart if t) > 0.95 * sum(t for _, t in apart)
    assert sum(got[i] for i, t in apart if not t) > 0.98 * sum(not t for _, t in apart)
    assert not len(quality.learn_lexicon(df, labels.where("toxic = 0"), "text", "doc_id")) and not len(quality.learn_lexicon(df, None, "text", "doc_id"))


def plain_shape(text):
    words = text.split()
    n, lines = max(len(words), 1), [x for x in text.split("\n") if x.strip()]
    visible = max(sum(map(len, words)), 1)
    return {
        "n": float(len(words)), "top": max((words.count(w) for w in set(words)), default=0) / n, "distinct": (len(set(zip(words, words[1:], strict=False))) + 1) / n,
        "short": sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n, "marks": len(re.findall(r"[^\w\s]", text)) / visible, "upper": sum(map(str.isupper, words)) / n,
        "lines": 1 - len(set(lines)) / max(len(lines), 1), "long": visible / n,
    }


def test_shape_and_terms_equal_plain_ones(docs):
    import random

    rng = random.Random(8)
    odd = ["", " ", "A", "ǅ ǆ Ǆ x", "ÀÉ é_1 _ 9", "a\u3000b\x1fc\n\nd", "İstanbul ŞŞ", "😀 😀! (a)", "x" * 50_000, "A b\n" * 3000]
    odd += ["".join(rng.choice("aB é\n\t._1Ǆ|😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in odd + [r.text for r in docs.limit(40).collect()]:
        assert quality.shape(text) == pytest.approx(plain_shape(text)), text
        words = set(re.findall(r"\w+", text.lower()))
        own, stems = quality.terms(text)
        assert len(own) == len(words) and len(np.unique(stems)) == len({w[: quality.STEM] for w in words})
        assert all(np.isin(quality.terms(w)[0], own).all() for w in list(words)[:5])


def test_fold_equals_plain_rounding(spark):
    """The fold of a bucket against pivotal rounding written as a loop: pairs move mass until one has none or all."""
    import random

    rng = random.Random(6)
    for _ in range(12):
        items = [(i, i, float(rng.randint(1, 9)), 0, 0.0, rng.random(), i) for i in range(rng.randint(1, 20))]
        items = [(*x[:4], x[2] * rng.uniform(0.01, 0.99), *x[5:]) for x in items]
        done, rest = {}, list(items[0])
        for x in map(list, items[1:]):
            a, b = rest[4], x[4]
            grow, shrink = min(rest[2] - a, b), min(a, x[2] - b)
            if x[5] * (grow + shrink) < shrink:
                rest[4], x[4] = a + grow, b - grow
            else:
                rest[4], x[4] = a - shrink, b + shrink
            full = lambda z: abs(z[4]) < 1e-12 or abs(z[4] - z[2]) < 1e-12
            out, keep = (rest, x) if full(rest) else (x, rest)
            done[out[0]] = out[4]
            rest = keep
        kind = "array<struct<doc_id:long,h:long,size:double,whole:long,mass:double,u:double,row:long>>"
        got = spark.createDataFrame([(items,)], f"b {kind}").select(F.expr(mixing.fold("b")).alias("f")).first().f
        assert {d.doc_id: pytest.approx(d.mass, abs=1e-9) for d in got.done} == done
        assert got.rest.doc_id == rest[0] and abs(got.rest.mass - rest[4]) < 1e-9
        assert abs(sum(d.mass for d in got.done) + got.rest.mass - sum(x[4] for x in items)) < 1e-9
