"""The forest over many leaves: recall against brute force, subtrees of large leaves, tight clusters."""

import numpy as np
import pytest

from quern.llm import embeddings
from quern.llm.common import stored


def clustered(n, dim, seed, near=0.98):
    """``n`` centres, and for each a partner at a cosine just above ``near``."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((n, dim)))
    r = unit(rng.standard_normal((n, dim)))
    r = unit(r - (r * a).sum(1, keepdims=True) * a)
    c = near + 0.001
    return np.float32(np.r_[a, c * a + (1 - c * c) ** 0.5 * r])


def plain(x, label):
    """(links of each vector, smallest fellow it reaches) by comparing all."""
    x = np.float64(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        low = np.minimum(comp, np.where(near, comp, len(x)).min(1))
        if (low == comp).all():
            return near.sum(1), comp
        comp = low


def run(spark, x, label, **parameters):
    rows = [(i, v.tolist(), int(b)) for i, (v, b) in enumerate(zip(x, label, strict=True))]
    df = stored(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(tuple(r) for r in embeddings.embedding_dedup(df, **parameters).collect())
    assert [g[0] for g in got] == list(range(len(x)))
    return np.array([g[1] for g in got]), np.array([g[2] for g in got])


@pytest.mark.parametrize(("dim", "sample"), [(64, 20_000), (16, 400)])
def test_recall(spark, dim, sample, monkeypatch):
    x = clustered(2500, dim, dim)
    label = np.arange(len(x)) % 2500 % 3
    want, _ = plain(x, label)
    deepest = []
    fit = embeddings.Tree.fit.__func__

    def seen(cls, *a):
        tree = fit(cls, *a)
        deepest.append(tree.depth)
        return tree

    monkeypatch.setattr(embeddings.Tree, "fit", classmethod(seen))
    got, _ = run(spark, x, label, leaf=20, sample=sample)
    # upper levels split nodes, and with the small sample leaves need subtrees
    assert max(deepest) >= 5 and (got <= want).all() and want.sum() > 4000
    assert got.sum() / want.sum() > 0.97


def test_large_leaves_are_split_again(spark):
    x = clustered(600, 16, 5)
    df = stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, v array<float>"))
    placed = embeddings._placements(df, 16, len(x), 2, 10, 0.025, 64, 400)
    sizes = [r["count"] for r in placed.groupBy("code").count().collect()]
    assert max(sizes) <= embeddings.LARGE * 10 and placed.select("cid").distinct().count() == len(x)


def test_tight_cluster(spark, monkeypatch):
    """No hyperplane parts a ball of near-equal vectors: it is compared in blocks, and every link counts once."""
    monkeypatch.setattr(embeddings, "BLOCK", 70)
    rng = np.random.default_rng(6)
    x = np.float32(np.r_[np.ones((300, 12)) + rng.standard_normal((300, 12)) * 0.004, rng.standard_normal((200, 12))])
    label = np.zeros(len(x), int)
    want, comp = plain(x, label)
    got, reached = run(spark, x, label, leaf=20, sample=200)
    assert (got == want).all() and (reached == comp).all() and want.max() >= 299
