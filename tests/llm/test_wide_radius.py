"""Every radius below 64 has an exact plan; others are refused."""

import numpy as np
import pytest

from quern.llm import simhash


def joined(nodes, pairs):
    """Each node's set of nodes that ``pairs`` connect it with."""
    group = {x: {x} for x in nodes}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return group


@pytest.mark.parametrize("radius", [0, 9, 10, 11, 24, 63])
def test_plan_covers_the_radius(radius):
    sample = np.random.default_rng(3).integers(-(2**63), 2**63, 200, np.int64)
    parts = simhash.plan(sample, radius, 200)
    assert sum(t + 1 for _, t in parts) == radius + 1
    masks = [m for m, _ in parts]
    assert sum(masks) < 2**64 and not any(a & b for i, a in enumerate(masks) for b in masks[:i])


def test_links_at_wide_radii(spark):
    rng = np.random.default_rng(4)
    prints = set()
    for base in rng.integers(0, 2**63, 20).tolist():
        prints |= {simhash.signed(base ^ sum(1 << int(b) for b in rng.choice(64, k, False))) for k in (0, 3, 8, 10, 11, 12)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for radius in (10, 11):
        expected = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(df, radius).collect()}
        assert expected and got <= expected and joined(prints, got) == joined(prints, expected)


@pytest.mark.parametrize("radius", [-1, 64])
def test_no_plan_is_an_error(radius):
    with pytest.raises(ValueError):
        simhash.plan(np.zeros(0, np.int64), radius, 0)
