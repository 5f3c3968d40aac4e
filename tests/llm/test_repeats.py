"""Suffix arrays, anchors, and both repeat removers against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import repeats, suffix, winnow
from quern.llm.substring_dedup import substring_dedup
from quern.llm.suffix_dedup import suffix_dedup


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(150):
        a = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 200))).astype(np.uint8)
        a = np.r_[a, a[: len(a) // 2], a] if trial % 3 == 0 else a
        b, depth = a.tobytes(), int(rng.integers(1, 40))
        sa = suffix.suffix_array(a, depth)
        assert [b[i : i + depth] for i in sa] == sorted(b[i : i + depth] for i in range(len(b)))
        got = suffix.common_prefixes(a, sa, depth)
        for x in range(1, len(sa)):
            p, q = b[sa[x - 1] :][:depth], b[sa[x] :][:depth]
            assert got[x] == next((m for m in range(min(len(p), len(q))) if p[m] != q[m]), min(len(p), len(q)))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcdef ") for _ in range(90))
    a = winnow.runs(winnow.byte_values(b"left side " + shared + b" right"), 40, 10)
    b = winnow.runs(winnow.byte_values(shared + b"x"), 40, 10)
    inner = lambda r, at: {(int(g)) for s, e, _, g, _ in zip(*r) if e >= at and s <= at + 50}
    assert inner(a, 10) & inner(b, 0)


def test_word_values_ignore_white_space():
    a, b = winnow.word_values("eine  rosé\tist\n".encode()), winnow.word_values("eine rosé ist".encode())
    assert (a == b).all() and len(a) == 3 and len(winnow.word_values(b" \n")) == 0


def brute(items, n):
    windows = Counter(w for x in items for w in (tuple(x[i : i + n]) for i in range(len(x) - n + 1)))
    out = []
    for x in items:
        hit = [False] * len(x)
        for i in range(len(x) - n + 1):
            if windows[tuple(x[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        out.append(hit)
    return out


def corpus(unit):
    rng = random.Random(7)
    word = (lambda: rng.choice("abcdefghij")) if unit == "bytes" else (lambda: rng.choice(["uno", "dos", "três", "vier", "fünf", "x"]))
    sep = "" if unit == "bytes" else " "
    make = lambda n: sep.join(word() for _ in range(n))
    shared = [make(60), make(45), make(120)]
    texts = [sep.join(x for x in (make(rng.randint(0, 50)), rng.choice(shared)[rng.randint(0, 30) :], make(rng.randint(0, 40)), rng.choice(shared), rng.choice(shared)) if x) for _ in range(60)]
    texts += [texts[0]] * 6 + [None, "", " ", "short", texts[3] + sep + texts[3]]
    return list(enumerate(texts)) + [(5, texts[5]), (None, "z" * 50)]


@pytest.mark.parametrize("unit", ["bytes", "words"])
@pytest.mark.parametrize("split", [800, 2])
def test_against_brute_force(spark, unit, split, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_CONTEXTS", split)
    rows = corpus(unit)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, row string, g int").repartition(3)
    docs = docs.sort("doc_id", "text")
    from quern.llm.common import stored

    docs = stored(docs)
    found = suffix_dedup(docs, length=40, gram=12) if unit == "bytes" else substring_dedup(docs, words=12, gram=5)
    items = [list((t or "").encode()) if unit == "bytes" else (t or "").encode().split() for _, t in rows]
    want = Counter()
    for (i, _), x, hit in zip(rows, items, brute(items, 40 if unit == "bytes" else 12), strict=True):
        left = [y for y, h in zip(x, hit, strict=True) if not h]
        runs = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        kept = bytes(left) if unit == "bytes" else b" ".join(left)
        want[i, len(x), sum(hit), runs, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect())
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(docs).count() == 0 and substring_dedup(docs).count() == 0


def test_long_texts_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(winnow, "PIECE", 64)
    v = winnow.byte_values(bytes(random.Random(2).choices(b"abc", k=500)))
    first, last, *_ = winnow.runs(v, 40, 10)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert sorted(covered.tolist()) == list(range(461))
