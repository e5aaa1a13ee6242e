"""Operators on small literal frames, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import aggregates as A, cleaning as C, families, joins as J, ordering as W, profiles as P, resampling as R
from strandloom.sources import files
from strandloom.sources.workspace import work_folder


def test_reverse_complement_is_an_involution(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("acgtAAC",)], "s string")
    assert [r[0] for r in df.select(S.revcomp(S.revcomp(F.col("s")))).collect()] == ["ACGTN", "", "acgtAAC"]
    assert df.select(S.revcomp(F.col("s"))).first()[0] == "NACGT"


def test_circular_slice_and_distance(spark):
    df = spark.createDataFrame([("ABCDEFGHIJKL", 11, 4, "KLAB"), ("ABCDEFGHIJKL", -1, 3, "KLA"), ("ABCDEFGHIJKL", 5, 0, ""), ("ABC", 2, 7, "BCABCAB")], "s string, p int, n int, x string")
    assert all(r[0] == r[1] for r in df.select(S.slice_circular(F.col("s"), F.col("p"), F.col("n")), "x").collect())
    d = spark.createDataFrame([(1, 11, 2, 2), (11, 1, 2, -2), (3, 9, 6, 6)], "a int, b int, d int, o int")
    assert all(r[0] == r[1] and r[2] == r[3] for r in d.select(S.circular_distance(F.col("a"), F.col("b"), 12), "d", S.signed_offset(F.col("a"), F.col("b"), 12), "o").collect())


def test_motifs_overlap(spark):
    df = spark.createDataFrame([("AAAA",), ("GATCGATC",), ("",)], "s string")
    assert [r[0] for r in df.select(S.find_all(F.col("s"), "AA")).collect()] == [[1, 2, 3], [], []]
    sites = S.motif_sites(spark.createDataFrame([(1, "AACCTTTGGA")], "k int, s string"), "k", "s", 3, "GG").collect()
    assert {(r.strand, r.place, r.target) for r in sites} == {("+", 5, "TTT"), ("-", 5, "AAA")}


def brute_nearest(p, targets, circle=None):
    every = [t + k for t in targets for k in ((-circle, 0, circle) if circle else (0,))]
    return (min((p - t for t in every if t <= p), default=None), min((t - p for t in every if t >= p), default=None))


@pytest.mark.parametrize("circle", [None, 500])
def test_nearest_on_line(spark, circle):
    rnd = random.Random(1)
    targets, points = rnd.sample(range(500), 9), [(i, rnd.randrange(500)) for i in range(80)]
    out = J.nearest_on_line(spark.createDataFrame(points, "k long, p long"), spark.createDataFrame([(t,) for t in targets], "p long"), "k", "p", circle, size=32).collect()
    assert {r.k: (r.before, r.after) for r in out} == {k: brute_nearest(p, targets, circle) for k, p in points}


def test_interval_containment(spark):
    rnd = random.Random(2)
    spans = [(i, a, a + rnd.randrange(60)) for i, a in enumerate(rnd.choices(range(300), k=40))]
    points = [(i, rnd.randrange(320)) for i in range(100)]
    found = J.interval_containment(spark.createDataFrame(points, "k int, p int"), spark.createDataFrame(spans, "i int, lo int, hi int"), "p", "lo", "hi", 16)
    assert sorted((r.k, r.i) for r in found.collect()) == sorted((k, i) for k, p in points for i, a, b in spans if a <= p <= b)
    best = {r.k: r.i for r in J.first_containing(found, "k", "lo", "i").collect()}
    assert best == {k: max(((a, -i) for i, a, b in spans if a <= p <= b))[1] * -1 for k, p in points if any(a <= p <= b for _, a, b in spans)}


def test_hamming_texts(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("AC", k=10)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = J.hamming_texts(df.limit(20), df, "s", 10, 3).collect()
    every = {(a, b, sum(x != y for x, y in zip(a, b))) for a in texts[:20] for b in texts}
    assert len(out) == len(set(out)) and {tuple(r) for r in out} == {x for x in every if x[2] <= 3}


def test_moving_means(spark):
    values = [float(i * i % 17) for i in range(1, 61)]
    df = spark.createDataFrame(list(enumerate(values, 1)), "p int, v double")
    clipped = {r.p: r.m for r in W.clipped_mean(df, "p", "v", 3, 2, "m", block=8).collect()}
    circular = {r.p: r.m for r in W.circular_mean(df, "p", "v", 3, 2, 60, "m", block=8).collect()}
    for p in range(1, 61):
        near = values[max(p - 4, 0) : p + 2]
        assert clipped[p] == pytest.approx(sum(near) / len(near))
        turned = [values[(p - 1 + k) % 60] for k in range(-3, 3)]
        assert circular[p] == pytest.approx(sum(turned) / 6)


def test_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 2.0, 9.0])], "k int, v double")
    assert {r.k: r.r for r in W.average_rank(df, "v", "r").collect()} == {0: 1.0, 1: 3.0, 2: 3.0, 3: 5.0, 4: 3.0, 5: 6.0}
    run = {r.k: r.c for r in W.with_running_sum(df, "v", F.col("v"), "c", ties=["k"]).collect()}
    assert run == {0: 1.0, 1: 3.0, 2: 5.0, 4: 7.0, 3: 10.0, 5: 19.0}
    const = spark.createDataFrame([(1, 5.0, float(i)) for i in range(5)], "g int, x double, y double")
    assert A.spearman_by(const, ["g"], "x", "y").first().rho == 0.0


def test_profile_nulls(spark):
    rows = [("a", p, None if p == 3 else float(p)) for p in range(1, 21)] + [("b", p, None) for p in range(1, 21)] + [("c", p, 2.0) for p in range(1, 21)]
    df = spark.createDataFrame(rows, "id string, pos int, v double")
    out = {(r.id, r.region): r for r in P.regional_summary(df, {"start": (1, 5), "end": (16, 20)}).collect()}
    assert out["a", "start"].mean == pytest.approx(3.0) and out["a", "start"].slope == pytest.approx(1.0)
    assert out["b", "start"].mean is None and out["b", "start"].slope == 0.0 and out["c", "end"].sd == 0.0
    assert P.hotspot(df, 20).where("id = 'c'").first().peak_pos == 1


def test_folds_cover_and_permutations_keep(spark):
    df = spark.createDataFrame([(i, i % 7, float(i)) for i in range(103)], "k int, g int, v double")
    sizes = sorted(r["count"] for r in R.exact_folds(df, "k", 5, 1).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    grouped = R.grouped_folds(df, "g", 3, 1)
    assert grouped.groupBy("g").agg(F.count_distinct("fold").alias("d")).where("d > 1").count() == 0
    assert sorted(r[0] for r in grouped.groupBy("fold").agg(F.count_distinct("g")).select("count(DISTINCT g)").collect()) == [2, 2, 3]
    mixed = R.permuted(df, "k", ["g", "v"], 4).collect()
    assert sorted(r.v for r in mixed) == sorted(float(i) for i in range(103)) and all(r.g == int(r.v) % 7 for r in mixed)
    assert any(r.k != int(r.v) for r in mixed)


def test_train_statistics_never_see_the_held_out_fold(spark):
    df = spark.createDataFrame([(0, 0, 1000.0), (1, 1, 1.0), (2, 1, 3.0), (3, 0, None)], "k int, fold int, v double")
    rows = R.tidy(df, ["k", "fold"], ["v"])
    out = {r.k: r for r in R.apply_train_statistics(rows, R.train_statistics(rows, "fold", 2), "fold").collect()}
    assert out[3].filled == 2.0 and out[0].scaled == pytest.approx(998.0) and out[1].mean == 1000.0


def test_cleaning(spark):
    df = spark.createDataFrame([("lacZb0344_12_Cas9", "1.5", None), ("nothing", "x", None), (None, None, None)], "id string, v string, e string")
    parsed = [r[0] for r in df.select(C.parse_identifier(F.col("id"))).collect()]
    assert parsed[0].gene == "lacZ" and parsed[0].locus == "b0344" and parsed[0].offset == 12 and parsed[1] is None and parsed[2] is None
    assert [r.v for r in C.coerce_numeric(df, ["v"]).collect()] == [1.5, None, None]
    assert C.drop_empty_columns(df).columns == ["id", "v"]
    with pytest.raises(ValueError):
        C.require_columns(df, ["missing"])
    column = spark.createDataFrame([("p18dimer.Hbond.stackingraw",), ("V10.x",)], "c string").select(C.parse_property_column(F.col("c")).alias("p")).collect()
    assert (column[0].p.position, column[0].p.unit) == (18, "dimer") and column[1].p is None


def test_concentration_and_quadratic(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(4)], "k int, w double")
    r = A.concentration(df, "k", "w").first()
    assert r.effective == pytest.approx(4.0) and r.gini == pytest.approx(0.0) and (r.n_50, r.n_90) == (2, 4)
    curve = spark.createDataFrame([(1, float(x), 2 + 3 * x - 0.5 * x * x) for x in range(9)], "g int, x double, y double")
    q = A.quadratic_fit(curve, ["g"], "x", "y").first()
    assert q.c == pytest.approx(-0.5) and q.b == pytest.approx(3.0) and q.turning_point == pytest.approx(3.0) and q.r2 == pytest.approx(1.0)


def test_roll_up_of_paired_arms(spark):
    cube = spark.createDataFrame([(s, f, a, v) for s in (0, 1) for f, (x, y) in enumerate([(0.1, 0.3), (0.2, 0.5), (0.3, 0.4)]) for a, v in (("base", x), ("plus", y + s))], "seed int, fold int, arm string, v double")
    out = {(r.seed, r.fold): r.delta for r in J.paired_deltas(cube, ["seed", "fold"], "arm", "v", "base").collect()}
    assert out[0, 0] == pytest.approx(0.2) and out[1, 2] == pytest.approx(1.1) and len(out) == 6


def test_files_round_trip(spark):
    df = spark.createDataFrame([(1, 'a,"b"', 1.5), (2, None, None)], "id long, t string, v double")
    path = work_folder(spark, "titled")
    files.write_titled_csv(df, path, "A title")
    assert sorted(files.read_titled_csv(spark, path, df.schema, "id").collect()) [0] == df.collect()[0]
    with pytest.raises(ValueError):
        files.check_block(spark.createDataFrame([(1, 2.0), (1, 3.0)], "`id` int, `eng.x` double"), "id")
    with pytest.raises(ValueError):
        files.check_block(spark.createDataFrame([(1, 2.0)], "id int, x double"), "id")
    assert files.read_if_any(spark, work_folder(spark, "none"), "a int").count() == 0


def test_families_report_failures(spark):
    rows = spark.createDataFrame([(1, "GATCCAGGACGT", "+", 5), (2, "ACGTACGTACGTAC", "-", 9)], "key long, s string, strand string, place long")
    families.REGISTRY["broken"] = lambda r: r.select("nowhere")
    try:
        out, status = families.build(rows, registry={"z_dosage": lambda r: families.dosage(r, 10_007)})
    finally:
        del families.REGISTRY["broken"]
    assert status["broken"].startswith("failed") and status["a_flank"] == "ok"
    got = {r.key: r for r in out.collect()}
    assert got[1]["eng.meth.gatc"] == 1 and got[1]["eng.meth.ccwgg"] == 1 and got[2]["eng.dose"] == pytest.approx(2 ** (-16 / 5003.5))
    assert not math.isnan(got[1]["eng.mech.tm"])
