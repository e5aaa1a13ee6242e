"""Brute-force checks of op1, op2 and op4 on small fixtures."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import embeddings, packing
from strandloom.llm.url_filter import candidate_keys, filter_captures


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_have_the_least_padding():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randrange(1, 9)
        lengths = sorted(rnd.sample(range(0, 40), n))
        counts = [rnd.randrange(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5, 12):
            bounds = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
            assert bounds == sorted(set(bounds)) and len(bounds) <= k and bounds[-1] == lengths[-1]
            least = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, n) - 1))
            assert padding(lengths, counts, bounds) == least
    assert packing.optimal_bounds(np.array([]), np.array([]), 4) == []


def test_pack_keeps_every_row_and_the_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 16)
    rnd = random.Random(2)
    data = [(i, " ".join(["w"] * rnd.randrange(0, 60)), 1) for i in range(300)] + [(None, None, 1), (5, "", 1), (7, "x " * 900, 1), (7, "x " * 900, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, bucket int")
    out = packing.pack(docs, buckets=4, budget=200).collect()
    assert len(out) == len(data)
    batches = {}
    for r in out:
        assert r.n_tokens <= r.padded_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    full = {}
    for (b, _), rs in batches.items():
        limit = max(1, 200 // max(rs[0].padded_tokens, 1))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= limit
        full.setdefault(b, []).append(len(rs) == limit)
    assert all(x.count(False) <= 1 for x in full.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_repeated_rows_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 16)
    docs = spark.createDataFrame([(1, "a b")] * 200, "doc_id long, text string")
    out = packing.pack(docs, budget=20).collect()
    assert sorted((r.batch, r.slot) for r in out) == [(i // 10, i % 10) for i in range(200)]


def test_long_lengths_have_their_own_bounds(spark):
    sizes = [10, 20_001, 20_002, 20_003, 1_000_000, 1_000_001]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n long").withColumn("text", F.lit("x"))
    out = packing.pack(docs, buckets=len(sizes), length=F.col("n")).collect()
    assert all(r.n_tokens == r.padded_tokens for r in out)


def brute_vectors(rows, threshold):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, dtype="f8")
            good[k] = x / np.linalg.norm(x)
    near = {k: {m for m in good if m != k and len(good[m]) == len(good[k]) and good[k] @ good[m] >= threshold} for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        low = min(ids) if ids else None
        out.append((i, len(near.get(k, ())), low, i is not None and i == low))
    return sorted(out, key=str)


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GROUP_ROWS", 40)
    monkeypatch.setattr(embeddings, "LEAST_ROWS", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), (centres[rng.integers(12)] + rng.normal(scale=0.18, size=16)).astype("f4").tolist()) for i in range(180)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (502, None), (503, []), (504, [0.0] * 16), (505, [float("nan")] * 16), (506, [None] * 16), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (None, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted([tuple(r) for r in embeddings.embedding_components(frame).collect()], key=str)
    assert got == brute_vectors(rows, 0.95)
    assert embeddings.embedding_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_of_several_lengths_over_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(embeddings, "GROUP_ROWS", 25)
    monkeypatch.setattr(embeddings, "LEAST_ROWS", 25)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(200 + i, (centre + rng.normal(scale=0.01, size=3)).tolist()) for i in range(10)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted([tuple(r) for r in embeddings.embedding_components(frame).collect()], key=str)
    assert got == brute_vectors([tuple(r) for r in frame.collect()], 0.95)
    assert [n for i, n, *_ in sorted(got) if i >= 200] == [9] * 10


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(9)
    u = rng.normal(size=(300, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, scale, e = embeddings.quantise(u)
    gap = np.abs(u @ u.T - scale**2 * (q.astype(float) @ q.T.astype(float)))
    assert (gap <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()


def test_url_filter_as_of(spark):
    d = dt.date
    entries = spark.createDataFrame(
        [("example.com", d(2024, 1, 1), "block"), ("example.com", d(2024, 2, 1), "allow"), ("Example.com", d(2024, 3, 1), "block"),
         ("a.example.com/x", d(2024, 1, 10), "block"), ("tie.org", d(2024, 1, 1), "allow"), ("tie.org", d(2024, 1, 1), "block"),
         (None, d(2024, 1, 1), "block"), ("late.org", None, "block"), ("Case.org./Adult/", d(2024, 1, 1), "block"), ("dots.org..", d(2024, 1, 1), "block")], "key string, since date, action string")
    captures = spark.createDataFrame(
        [(1, "http://EXAMPLE.com/", d(2023, 12, 31)), (2, "http://b.example.com:80/q", d(2024, 1, 1)), (3, "https://u@example.com?x", d(2024, 2, 1)),
         (4, "https://example.com/#f", d(2024, 5, 1)), (5, "http://a.example.com/x/y/?q=1", d(2024, 2, 10)), (6, "http://a.example.com/xy", d(2024, 2, 10)),
         (7, None, d(2024, 1, 5)), (8, "nonsense", d(2024, 1, 5)), (9, "http://tie.org", d(2024, 1, 5)), (10, "http://tie.org", None),
         (9, "http://tie.org", d(2024, 1, 5)), (11, "http://notexample.com/", d(2024, 1, 5)), (12, "http://case.org/Adult/x", d(2024, 1, 5)), (13, "http://CASE.org./adult", d(2024, 1, 5)),
         (14, "http://dots.org./" + "y/" * 3000, d(2024, 1, 5))], "page_id long, url string, fetched date").withColumn("rule", F.lit(1))
    out = sorted([(r.page_id, r.blocked, r.rule) for r in filter_captures(captures, entries).collect()])
    assert out == [(1, False, None), (2, True, "example.com"), (3, False, None), (4, True, "example.com"), (5, True, "a.example.com/x"), (6, False, None),
                   (7, False, None), (8, False, None), (9, True, "tie.org"), (9, True, "tie.org"), (10, False, None), (11, False, None),
                   (12, True, "case.org/Adult"), (13, False, None), (14, True, "dots.org")]
    assert filter_captures(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in filter_captures(captures, entries.limit(0)).collect())
    v6 = spark.createDataFrame([("[2001:DB8::1]", d(2024, 1, 1), "block"), ("u@Port.org:81/p", d(2024, 1, 1), "block"), ("[::ffff:1.2.3.4]/x/", d(2024, 1, 1), "block")], "key string, since date, action string")
    asked = ["http://[2001:db8::1]/", "https://u:p@[2001:DB8::1]:8080/a?b", "http://[2001:db8::2]/", "http://[2001:db8::1", "http://port.org:9/p/q", "http://a@b@port.org/p", "http://port.org/", "http://[::FFFF:1.2.3.4]:1/x", "http://2.3.4]/x"]
    hits = {r.page_id: r.rule for r in filter_captures(spark.createDataFrame([(i, u, d(2024, 1, 2)) for i, u in enumerate(asked)], "page_id long, url string, fetched date"), v6).collect()}
    assert [hits[i] for i in range(len(asked))] == ["[2001:db8::1]", "[2001:db8::1]", None, None, "port.org/p", "port.org/p", None, "[::ffff:1.2.3.4]/x", None]
    keys = spark.createDataFrame([("http://a.b.c/d/e",)], "u string").select(candidate_keys(F.col("u"))).first()[0]
    assert keys == ["a.b.c", "b.c", "c", "a.b.c/d", "a.b.c/d/e"]
