"""Off-target search and three-dimensional neighbours against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import crowding as C, joins as J, offtarget as O
from strandloom.sources import files


def brute_off_targets(queries, sites):
    out = {}
    good = [s for s in sites if s and len(s) == 20 and set(s) <= set("ACGT")]
    for key, q in queries:
        if not (q and len(q) == 20 and set(q) <= set("ACGT")):
            out[key] = None
            continue
        mm = [(sum(a != b for a, b in zip(q, s)), q[8:] == s[8:]) for s in good]
        c = [sum(m == k for m, _ in mm) for k in range(5)]
        e = [sum(m == k and x for m, x in mm) for k in range(5)]
        others = [m for m, _ in mm if m > 0]
        row = [c[0]] + [v for k in range(1, 5) for v in (c[k], e[k])] + [c[1] + c[2] + c[3], min(others) if others else None, sum(c[k] / 4**k for k in range(1, 5)), int(c[0] > 1)]
        out[key] = row
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_off_targets_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rnd = random.Random(3)
    draw = lambda: "".join(rnd.choice("ACGT") for _ in range(20))

    def near(s, k):
        s = list(s)
        for i in rnd.sample(range(20), k):
            s[i] = rnd.choice([c for c in "ACGT" if c != s[i]])
        return "".join(s)

    bases = [draw() for _ in range(6)]
    sites = [near(b, k) for b in bases for k in (0, 0, 1, 1, 2, 3, 4, 5, 6, 7)] + ["N" * 20, "ACG", None, bases[0]]
    sites += [bases[1][:7] + c + bases[1][8:] for c in "ACGT"]  # outside the seed only
    queries = list(enumerate([*bases, *[near(b, k) for b in bases for k in (1, 3, 5, 6)], draw(), draw(), "A" * 20, None, "", "N" * 20, "acgt" * 5, bases[0]]))
    q = spark.createDataFrame(queries, "key long, s string")
    s = spark.createDataFrame([(x,) for x in sites], "s string")
    got = {r.key: (None if r[1] is None else list(r)[1:]) for r in O.off_targets(q, s).collect()}
    assert got == brute_off_targets(queries, sites)
    lone = {r.key: list(r)[1:] for r in O.off_targets(q.where("key = 0"), s.limit(0)).collect()}
    assert lone == {0: [0] * 10 + [None, 0.0, 0]}
    assert O.off_targets(q.limit(0), s).count() == 0


def test_hamming_pairs_come_once(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab") for _ in range(9)) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for within in (0, 2, 8):
        got = sorted(map(tuple, J.hamming_texts(df, df, "t", 9, within).collect()))
        want = sorted((a, b, m) for a in set(texts) for b in set(texts) if (m := sum(x != y for x, y in zip(a, b))) <= within)
        assert got == want


def test_crowding_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(size=(30, 3)) * 0.01 + 5, [[40.0, 0, 0]], [[1.0, 1, 1]] * 3])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i long, x double, y double, z double")
    got = {r.i: r for r in C.crowding(df, (3, 200), (0.5, 2.0)).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        others = np.sort(np.delete(d[i], i))
        want = [others[:3].mean(), others.mean(), (others <= 0.5).sum(), (others <= 2).sum(), np.linalg.norm(x[i] - x.mean(axis=0))]
        assert list(got[i])[1:] == pytest.approx(want)
    one = C.crowding(df.limit(1), (3,), (1.0,)).first()
    assert list(one)[1:] == [None, 0.0, 0.0]
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(4)], "i long, x double, y double, z double")
    assert all(list(r)[1:] == [0.0, 3.0, 0.0] for r in C.crowding(same, (2,), (1.0,)).collect())


def test_contacts_and_dependence(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(0, 5, (11, 11)).astype(float)
    m[3] = 0
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(11) for j in range(11) if m[i, j]], "i long, j long, v double")
    got = {r.i: list(r)[1:] for r in C.contact_block(df, 11, 2, 3).collect()}
    for i in range(11):
        sep = np.minimum((np.arange(11) - i) % 11, (i - np.arange(11)) % 11)
        short = m[i][sep <= 2].sum()
        left, right = (sum(m[i, (i + s * k) % 11] for k in range(1, 4)) for s in (-1, 1))
        total = m[i].sum()
        assert got[i] == pytest.approx([total, short, total - short, np.log2((short + 1) / (total - short + 1)), (right - left) / (right + left) if right + left else 0])
    dep = {r.i: r[1] for r in C.dependence({"x": (df.where("j > 4"), df)}, 11).collect()}
    a, b = m[:, 5:].sum(axis=1) / m[:, 5:].sum(), m.sum(axis=1) / m.sum()
    assert [dep[i] for i in range(11)] == pytest.approx(np.log2((b + 1e-9) / (a + 1e-9)).tolist())


def test_xyz_scan_and_places(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("1.0 2 3\n\n -4e0\t5 6 \n7 8 9\n")
    rows = sorted(map(tuple, C.read_xyz(spark, str(tmp_path / "m.xyz")).collect()))
    assert rows == [(0, 1.0, 2.0, 3.0), (1, -4.0, 5.0, 6.0), (2, 7.0, 8.0, 9.0)]
    bins = spark.createDataFrame([(0, 0.5), (1, 1.5)], "i long, v double")
    asked = spark.createDataFrame([("a", 1), ("b", 11), ("c", 25), ("d", None)], "key string, p int")
    got = sorted(map(tuple, C.by_place(asked, bins, "key", F.col("p"), 10, 2).select("key", "`eng.nucl.bin`", "v", "`eng.nucl.offset_in_bin`").collect()))
    assert got == [("a", 0, 0.5, 0.0), ("b", 1, 1.5, 0.0), ("c", 0, 0.5, 0.4), ("d", None, None, None)]


def test_no_row_of_a_tsv_is_dropped(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\n1\ta\nx\tb\n3\n")
    rows = sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t.tsv"), "n int, s string").collect()), key=str)
    assert rows == [(1, "a"), (3, None), (None, "b")]


def test_a_key_that_reads_like_the_header_is_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,\nid,v\nq,1\nid,2\n")
    assert sorted(map(tuple, files.read_titled_csv(spark, str(tmp_path / "a.csv"), "id string, v int", "id").collect())) == [("id", 2), ("q", 1)]


def test_rows_without_a_usable_vector_have_no_neighbour(spark):
    nan = float("nan")
    data = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(data, "k long, v array<double>")
    got = {r.k: (r.mean_near, r.within) for r in J.neighbours(df, "k", "v", 2, 1.5).collect()}
    assert got == {1: (1.0, 1), 2: (1.0, 1), **{k: (None, 0) for k in (3, 4, 5, 6, 7)}}
