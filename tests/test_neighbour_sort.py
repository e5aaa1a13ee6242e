"""The neighbour search sorts the nearest few of a row, not its whole row of distances."""

import numpy as np
import pyarrow as pa

from strandloom.operators import joins as J


def brute(ids, x, k, radius):
    out = {}
    for i, key in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)
        out[key] = (sum(v for v, _ in others[:k]) / k, sum(v <= radius for v, _ in others))
    return out


def test_neighbours_on_a_grid_with_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (130, 3)).astype(float)  # many equal distances, many copies
    ids = list(range(130))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "key long, v array<double>")
    for radius in (1.0, 0.0, -1.0):
        for tile in (17, 8192):
            got = {r[0]: (r[1], r[2]) for r in J.neighbours(rows, "key", "v", 5, radius, tile=tile).collect()}
            want = brute(ids, x, 5, radius)
            assert all(abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1] for i in ids)


def test_whole_rows_are_not_sorted(spark, monkeypatch):
    sizes, found = [], []
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: (sizes.append(np.asarray(keys[0]).size), sort(keys, axis))[1])

    class Taken(Exception):
        pass

    def taken(self, fn, schema):
        found.append(fn)
        raise Taken

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", taken)
    try:
        J.neighbours(spark.createDataFrame([(1, [0.0])], "key long, v array<double>"), "key", "v", 5, 1.0)
    except Taken:
        pass
    n = 1000
    x = np.random.default_rng(1).normal(size=(n, 4))
    table = pa.table({"g": [0] * n, "k": np.arange(n), "v": x.tolist(), "a": [0] * n, "b": [0] * n, "first": [True] * n})
    out = found[0](table)
    assert out.num_rows == 5 * n and sum(sizes) < 10 * n
