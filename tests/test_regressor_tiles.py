"""Nearest rows are picked without sorting a whole tile, equal values in their order."""

import numpy as np
import pytest

from strandloom.operators import regressors as R


@pytest.mark.parametrize("k", [1, 5, 40, 60])
def test_nearest_is_the_stable_sort(k, monkeypatch):
    square = np.random.default_rng(k).integers(0, 6, (30, 50)).astype(float)
    want = np.argsort(square, axis=1, kind="stable")[:, :k]
    if k < 50:
        monkeypatch.setattr(np, "argsort", None)
    assert np.array_equal(R.nearest(square, k), want)
