"""Draws of n of n rows, turning points, p-values and balanced folds against numpy and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import bootstrap as B, resampling as R


def test_draws_sum_to_n_in_every_replicate(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_ROWS", 20)
    df = spark.createDataFrame([(i, float(i)) for i in range(500)], "key long, v double")
    one, two = ({r.key: r.draws for r in B.with_draws(d, "key", 40, 3).collect()} for d in (df, df.repartition(5)))
    assert one == two and len(one) == 500
    w = np.array([one[i] for i in range(500)])
    assert (w.sum(axis=0) == 500).all()
    # Weights of n of n draws: mean 1, variance 1 - 1/n, and Poisson-like frequencies.
    assert w.var() == pytest.approx(1, abs=0.06)
    for k in range(3):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)
    assert len({tuple(c) for c in w.T}) == 40


def test_shard_draws_of_odd_sizes():
    sizes = np.array([0, 5, 0, 1, 94])
    draws = np.stack([B.shard_draws(sizes, s, 2000, 1) for s in range(5)])
    assert (draws.sum(axis=0) == 100).all() and (draws[[0, 2]] == 0).all()
    assert draws.mean(axis=1) == pytest.approx(sizes, abs=0.4)


def test_interval_and_turning_point(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 400)
    y = -((x - 6) ** 2) + rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "key long, x double, y double")
    r = B.bootstrap_interval(df, "key", {"turn": B.turning_point("x", "y"), "mean": F.sum(F.col("w") * F.col("y")) / F.sum("w")}, 200).collect()
    turn, mean = ({c: v for c, v in z.asDict().items()} for z in sorted(r, key=lambda z: z.metric, reverse=True))
    c = np.polyfit(x, y, 2)
    assert turn["point"] == pytest.approx(-c[1] / 2 / c[0], abs=1e-6) and turn["lo"] < turn["point"] < turn["hi"] and turn["hi"] - turn["lo"] < 0.2
    assert mean["se"] == pytest.approx(y.std() / 20, rel=0.2) and mean["point"] == pytest.approx(y.mean())
    few = B.bootstrap_interval(df.limit(2), "key", {"mean": F.sum(F.col("w") * F.col("y")) / F.sum("w")}, 5).first()
    assert few.lo == few.hi == few.point and few.se is None


def test_transfer_interval_holds_its_point(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=300)
    rows = [(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(y, rng.normal(size=300)))]
    got = {r.metric: r for r in B.transfer_interval(spark.createDataFrame(rows, "key long, label double, prediction double"), "key", 100).collect()}
    p = np.array([r[2] for r in rows])
    assert got["r2"].point == pytest.approx(1 - ((y - p) ** 2).mean() / y.var()) and got["pearson"].point == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert all(r.lo < r.point < r.hi for r in got.values())


def test_p_values(spark):
    def exact(t, v):  # finite series for whole degrees of freedom
        a = math.atan(abs(t) / math.sqrt(v))
        s, term = 0.0, 1.0
        for i in range(v // 2):
            s += term * math.cos(a) ** (2 * i + v % 2)
            term *= (2 * i + 2) / (2 * i + 3) if v % 2 else (2 * i + 1) / (2 * i + 2)
        return 1 - (2 / math.pi * (a + math.sin(a) * s) if v % 2 else math.sin(a) * s)

    cases = [(t, v) for t in (0.0, 1e-6, 0.3, -1.0, 2.0, 5.0, 12.706204736, 40.0) for v in (1, 2, 3, 4, 10, 24, 99, 1000)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "i int, t double, v int")
    got = {r.i: r.p for r in df.select("i", B.t_test_p(F.col("t"), F.col("v")).alias("p")).collect()}
    for i, (t, v) in enumerate(cases):
        assert got[i] == pytest.approx(exact(t, v), abs=1e-9), (t, v)
    assert got[cases.index((2.0, 10))] == pytest.approx(0.07338803477074045, abs=1e-12)
    odd = spark.createDataFrame([(None, 3), (1.0, 0), (1.0, None)], "t double, v int")
    assert [r.p for r in odd.select(B.t_test_p(F.col("t"), F.col("v")).alias("p")).collect()] == [None, None, None]


def test_balanced_folds_differ_by_one_group_at_most(spark):
    rng = np.random.default_rng(5)
    sizes = [40, 31, 30, 9, 9, 9, 9] + rng.integers(1, 8, 60).tolist()
    rows = [(f"g{g}", i) for g, n in enumerate(sizes) for i in range(n)] + [(None, 1), (None, 2)]
    got = R.balanced_group_folds(spark.createDataFrame(rows, "g string, i int"), "g", 4).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.g, set()).add(r.fold)
    assert all(len(f) == 1 for f in of.values()) and None in of
    loads = [sum(r.fold == f for r in got) for f in range(4)]
    assert max(loads) - min(loads) <= max(sizes)
