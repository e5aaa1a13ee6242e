"""The sets that fold_verification checks are the top events of each whole fold."""

from strandloom.plans import load_queries, report_plans


def test_sets_come_from_all_events(spark, tmp_path, monkeypatch):
    load_queries()
    rows = [(i, 1000 + i, float(i)) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen, verify = [], report_plans.I.verify_folds

    def spy(df, selected, *rest):
        seen.extend(selected.collect())
        return verify(df, selected, *rest)

    monkeypatch.setattr(report_plans.I, "verify_folds", spy)
    found = report_plans.fold_verification(spark, str(tmp_path))
    assert {(r.fold, r.item) for r in seen} == {(i % 5, 1000 + i) for i in range(150, 200)}
    # Every user is in one fold and every set is complete; the sixth fold is empty.
    assert {r.check: r.failures for r in found.collect()} == {"key in one fold": 0, "no fold empty": 1, "sets complete": 0}
