"""Known rows meet the pool in a few Python tasks, whose differences are held piece by piece."""

import numpy as np

from cellmorph.operators import ml


def test_least_distances_hold_few_differences(monkeypatch):
    monkeypatch.setattr(ml, "ROWS", 4)
    monkeypatch.setattr(ml, "KNOWN_ROWS", 3)
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(11, 5)), rng.normal(size=(10, 5))
    assert np.array_equal(ml._least_distances(x, w), np.sqrt(((x[:, None] - w) ** 2).sum(2)).min(1))
    assert np.isinf(ml._least_distances(x, w[:0])).all()
