"""Rows with few entries add their pairs one by one; no matrix of all columns is made for them."""

import numpy as np
import pytest

from strandloom.operators import aggregates as A


@pytest.mark.parametrize("crossed", [None, 1])
@pytest.mark.parametrize("entries", [1, 3, 12])
def test_pairs_of_short_and_long_rows(spark, entries, crossed):
    rng = np.random.default_rng(entries)
    rows = [(k % 3, k, int(p), float(rng.normal())) for k in range(60) for p in rng.choice(20, size=(k + entries) % 13 if k % 2 else entries, replace=False)]
    want: dict = {}
    by_key: dict = {}
    for g, k, p, v in rows:
        by_key.setdefault((g, k), []).append((p, v))
    for (g, _), own in by_key.items():
        for i, x in own:
            for j, y in own:
                if i <= j and (crossed is None or i // 8 < crossed <= j // 8):
                    want[g, i, j] = want.get((g, i, j), 0) + np.array([1, x * y, x, y, x * x, y * y])
    got = A.pair_sums(spark.createDataFrame(rows, "g long, k long, p int, v double"), "g", "k", "p", "v", 8, crossed).collect()
    assert {(r.g, r.i, r.j) for r in got} == set(want)
    for r in got:
        assert np.allclose([r.n, r.s, r.x, r.y, r.xx, r.yy], want[r.g, r.i, r.j])


def test_short_rows_make_no_matrix(monkeypatch):
    """A row of four entries costs ten pairs, not the square of the columns."""
    own: dict = {}
    A._add_pairs(own, np.array([0, 0, 0, 0, 1, 1]), np.array([3, 1, 9, 1, 2, 2]), np.array([1.0, 2, 3, 4, 5, 6]), 8, None)
    assert set(own) == {(0, 0), (0, 1), (1, 1)}
    assert own[0, 0][0].sum() == 4 and own[0, 0][1][1, 1] == 16 and own[0, 0][1][2, 2] == 36 and own[0, 1][1][1, 1] == 12
