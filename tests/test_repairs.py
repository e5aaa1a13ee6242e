"""Cases that once went wrong: empty cells, NULL ranks, unknown letters, hot groups, blocked products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import aggregates as A, joins as J, models as M, ordering as W
from strandloom.sources import files
from strandloom.sources.workspace import work_folder
from strandloom.streaming.resume import run_windowed_means


def test_titled_csv_keeps_rows_with_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title of the table,,\nid,name,v\na,x,1.0\nb,,3.0\n,lost key,4.0\nc,,\n")
    (tmp_path / "b.csv").write_text("id,name,v\nd,y,bad\n")
    (tmp_path / "c.csv").write_text("e,z,5\n")
    rows = files.read_titled_csv(spark, str(tmp_path), "id string, name string, v double", "id").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("a", "x", 1.0), ("b", None, 3.0), (None, "lost key", 4.0), ("c", None, None), ("d", "y", None), ("e", "z", 5.0)], key=str)
    one = work_folder(spark, "one-column")
    files.write_titled_csv(spark.createDataFrame([("p",), ("q",)], "id string"), one, "Only keys")
    assert sorted(r.id for r in files.read_titled_csv(spark, one, "id string", "id").collect()) == ["p", "q"]


def test_tsv_and_fasta(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# comment\n1\ta\n# more\n2\tb\n")
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t.tsv"), "`1)n` int, `2) name` string").collect())) == [(1, "a"), (2, "b")]
    assert files.clean_names(spark.createDataFrame([(1, "a")], "`1)n` int, `2) name` string")).columns == ["n", "name"]
    (tmp_path / "f.fa").write_text(">one first > record\nacg\nTT\n>two\n\n>three\nGG\n")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "f.fa")).collect())) == [("one", "ACGTT"), ("three", "GG"), ("two", "")]


@pytest.mark.parametrize("large", [1 << 18, 2])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_null_has_no_rank(spark, groups, large, monkeypatch):
    monkeypatch.setattr(W, "LARGE", large)
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 2.0), (4, "a", 2.0), (5, None, 7.0), (6, None, None)], "k int, g string, v double")
    ranks = {r.k: r.r for r in W.average_rank(df, "v", "r", groups).collect()}
    assert ranks == {1: 1.0, 2: None, 3: 2.5, 4: 2.5, 5: 1.0 if groups else 4.0, 6: None}


@pytest.mark.parametrize("large", [1 << 18, 3])
def test_exact_quantiles(spark, large, monkeypatch):
    monkeypatch.setattr(W, "LARGE", large)
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), np.round(rng.normal(size=900), 1))] + [(0, None), (9, 4.0)]
    found = W.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), "v", [0.0, 0.1, 0.5, 0.987, 1.0], ["g"]).collect()
    assert {r.g for r in found} == {0, 1, 2, 9}
    for r in found:
        assert r.quantiles == pytest.approx(np.quantile([v for g, v in rows if g == r.g and v is not None], [0, 0.1, 0.5, 0.987, 1]))


@pytest.mark.parametrize("large", [1 << 18, 4])
def test_rank_correlation_by_group(spark, large, monkeypatch):
    monkeypatch.setattr(W, "LARGE", large)
    rng = np.random.default_rng(6)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(rng.integers(0, 4, 500), np.round(rng.normal(size=500), 1), np.round(rng.normal(size=500), 1))] + [(9, 1.0, 2.0), (9, 1.0, 3.0), (5, None, 1.0), (None, 1.0, 2.0), (None, 2.0, 1.0)]
    found = {r.g: (r.n, r.rho) for r in A.spearman_by(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    assert set(found) == {0, 1, 2, 3, 9, None} and found[9] == (2, 0.0) and found[None] == (2, pytest.approx(-1.0))

    def ranks(v):
        return [(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v]

    for g in range(4):
        x, y = zip(*[(a, b) for k, a, b in rows if k == g])
        assert found[g] == (len(x), pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1]))


def test_duplex_of_other_letters_is_null(spark):
    texts = spark.createDataFrame([("ACGT",), ("acgt",), ("ANNA",), ("A",), ("",), (None,)], "s string")
    rows = texts.select(S.duplex(F.col("s")).alias("x")).select("x.*").collect()
    # ACGT: steps AC, CG, GT and two A-T ends.
    for r in rows[:2]:
        assert r.dh == pytest.approx(-8.4 - 10.6 - 8.4 + 2 * 2.3) and r.ds == pytest.approx(-22.4 - 27.2 - 22.4 + 2 * 4.1)
        assert r.dg37 == pytest.approx(-1.44 - 2.17 - 1.44 + 2 * 1.03)
    assert all(v is None for r in rows[2:] for v in r)


def test_pair_sums_over_blocks_and_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 7))
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = [(i % 2, i, p, None if np.isnan(x[i, p]) else float(x[i, p])) for i in range(40) for p in range(7)]
    found = A.pair_sums(spark.createDataFrame(rows, "g int, k int, p int, v double"), "g", "k", "p", "v", columns=3).collect()
    assert len(found) == 2 * 28
    for r in found:
        a, b = x[r.g :: 2, r.i], x[r.g :: 2, r.j]
        both = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[both], b[both]
        assert [r.n, r.s, r.x, r.y, r.xx, r.yy] == pytest.approx([len(a), a @ b, a.sum(), b.sum(), a @ a, b @ b])


def test_neighbours_over_tiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(60)] + [(99, 7, x[0].tolist())], "k int, g int, v array<double>")
    for group in (None, "g"):
        found = {r.k: r for r in J.neighbours(df, "k", "v", 3, 1.5, group, tile=9).collect()}
        assert set(found) == set(range(60)) | {99}
        if group:
            assert (found[99].mean_near, found[99].within) == (None, 0)
        for i in range(60):
            others = [j for j in range(60) if j != i and (group is None or j % 2 == i % 2)]
            d = np.sort([np.linalg.norm(x[i] - x[j]) for j in others] + ([np.linalg.norm(x[i] - x[0])] if group is None else []))
            assert found[i].mean_near == pytest.approx(d[:3].mean(), abs=1e-7) and found[i].within == (d <= 1.5).sum()


def test_every_occurrence_is_kept(spark):
    sites = spark.createDataFrame([("x", "-", 3), ("x", "+", 9), ("y", "+", 1)], "t string, strand string, pos int")
    queries = spark.createDataFrame([("x",), ("z",)], "t string")
    rows = sorted(map(tuple, J.occurrences(queries, sites, "t").select("t", "copies", "strand", "pos", "first").collect()), key=str)
    assert rows == sorted([("x", 2, "+", 9, True), ("x", 2, "-", 3, False), ("z", 0, None, None, None)], key=str)


def test_permutation_moves_the_values_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, float(a), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "key long, fold int, label double, features array<double>")
    fitted = M.estimator("tree").fit(M._vectors(df.where("fold = 0")))
    drops = {r.column: r["drop"] for r in M.permutation_importance(df.where("fold = 1"), fitted, [0, 1]).collect()}
    assert drops[0] > 0.7 and abs(drops[1]) < 0.2


def test_late_rows_are_dropped_from_closed_windows(spark):
    source = work_folder(spark, "late-source")
    schema = "ts timestamp, k string, v double"
    rows = lambda *x: spark.createDataFrame(list(x), "s string, k string, v double").select(F.to_timestamp("s").alias("ts"), "k", "v").coalesce(1)
    rows(("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 3.0), ("2024-01-03 01:00:00", "a", 5.0)).write.mode("append").parquet(source)
    state = work_folder(spark, "late-state")
    first = run_windowed_means(spark, source, schema, "ts", "k", "v", state=state)
    assert sorted((str(r.start), r["mean"], r.n) for r in first.collect()) == [("2024-01-01 00:00:00", 2.0, 2)]
    rows(("2024-01-01 03:00:00", "a", 100.0), ("2024-01-06 00:00:00", "a", 7.0)).write.mode("append").parquet(source)
    second = run_windowed_means(spark, source, schema, "ts", "k", "v", state=state)
    assert sorted((str(r.start), r["mean"], r.n) for r in second.collect()) == [("2024-01-01 00:00:00", 2.0, 2), ("2024-01-03 00:00:00", 5.0, 1)]


def test_dialects_of_column_names(spark):
    from strandloom.operators import cleaning as C

    names = ["p18dimer.Hbond.stackingraw", "p3BasePair.x", "p7pentamer.x", "p21.gc", "P4_one", "p0a", "p5", "p5-", "gc10", "p99999999999x", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: (r.u and tuple(r.u), r.p) for r in rows.select("i", C.parse_unit_column(F.col("n")).alias("u"), C.column_position(F.col("n")).alias("p")).collect()}
    assert [got[i] for i in range(len(names))] == [
        ((18, "dimer", "Hbond.stackingraw", 2), 18), ((3, "basepair", "x", 1), 3), (None, 7), (None, None), (None, 4), (None, None), (None, 5), (None, None), (None, None), (None, None), (None, None)]
