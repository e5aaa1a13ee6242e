"""The pipeline's near-duplicate stage against all pairs by brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
near_duplicates = pytest.importorskip("strandloom.llm.near_duplicates")

SCHEMA = "doc_id long, text string, lang string"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_force(rows):
    """Smallest id of each row's component, over all pairs."""
    sets, root = [shingle_set(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = {}
    for (k, _, _), r in zip(rows, root):
        low[r] = min(k, low.get(r, k))
    return [low[r] for r in root]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    header = " ".join(rnd.choices(words, k=30))  # boilerplate, in every third text
    rows, similar = [], []
    for k in range(150):
        body = rnd.choices(words, k=rnd.choice([60, 100, 200, 400]))
        text = [*header.split(), *body] if k % 3 == 0 else body
        rows.append((2 * k, " ".join(text), "en"))
        for m, changes in enumerate((1, 2, 4, 8)):
            edited = list(text)
            for at in rnd.sample(range(len(edited)), changes):
                edited[at] = rnd.choice(words)
            rows.append((1000 * (m + 1) + 2 * k + 1, " ".join(edited), "en"))
            similar.append(jaccard(shingle_set(rows[-1][1]), shingle_set(" ".join(text))))
    assert sum(0.8 <= s <= 0.95 for s in similar) > 100 and sum(0.6 < s < 0.8 for s in similar) > 50
    return rows + [(9001, None, "en"), (9002, "", "en"), (9003, "One two", "en"), (9004, "one  TWO", "en"), (9005, "one three", "en")]


def test_edited_copies_as_by_brute_force(spark, rows):
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), "")
    want = {low for low in brute_force(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize(("tile", "near", "rounds"), [(16, 44, (1, 1, 8)), (50, 0, (2,)), (4096, 64, (1,))])
def test_components_as_by_brute_force(spark, rows, monkeypatch, tile, near, rounds):
    monkeypatch.setattr(near_duplicates, "ALLOTMENTS", rounds)
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "NEAR", near)
    found = near_duplicates.near_duplicate_components(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(zip([r[0] for r in rows], brute_force(rows)))


def test_repeated_and_missing_ids(spark):
    a, b = " ".join(map(str, range(100))), " ".join(map(str, range(200, 300)))
    rows = [(3, a, "x"), (5, a + " more", "x"), (5, b, "x"), (5, b, "x"), (None, a, "x"), (None, "alone", "x"), (None, "alone", "x")]
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(3, a), (5, b), (-1, "alone")])


def sets_of(texts):
    values, begins = near_duplicates.shingle_sets(pa.array(texts, pa.string()))
    return [values[s:e] for s, e in zip(begins, begins[1:])]


def test_shingle_sets_have_the_right_similarity(rows):
    texts = [t for _, t, _ in rows]
    found = sets_of(texts)
    for i in range(0, len(texts) - 5, 5):
        for j in range(i, i + 5):
            a, b = shingle_set(texts[i]), shingle_set(texts[j])
            assert len(found[i]) == len(a) and len(np.intersect1d(found[i], found[j])) == len(a & b)


def test_parities_bound_the_difference():
    rnd = random.Random(2)
    for n in (1, 50, 64, 65, 300, 1100, 9000):
        a, other = sets_of([" ".join(str(rnd.random()) for _ in range(k)) for k in (n, n // 8)])
        b = np.union1d(a[: len(a) * 9 // 10], other)
        bound = near_duplicates.least_differences([near_duplicates.parities(x) for x in (a, b)], np.array([0, 1]), np.array([1, 0]))
        assert bound[0] == bound[1] <= len(np.setxor1d(a, b))


def chance_of_a_bit(shared, a, b):
    """That one bit differs between sets of shared + a and shared + b shingles."""
    chances = [[math.comb(k, x) / 2**k for x in range(k + 1)] for k in (shared, a, b)]
    over = lambda x, own, size: sum(p for y, p in enumerate(own) if 2 * (x + y) > size)
    out = 0.0
    for x, p in enumerate(chances[0]):
        one, two = over(x, chances[1], shared + a), over(x, chances[2], shared + b)
        out += p * (one * (1 - two) + two * (1 - one))
    return out


def test_radius_loses_less_than_one_pair_in_a_million_at_every_size():
    for shared in range(4, 121):
        for a in range(shared // 8 + 1):
            b = shared // 4 - a  # the most shingles apart at a similarity of 0.8
            p, bits = chance_of_a_bit(shared, a, b), 64 * near_duplicates.WORDS
            radius = near_duplicates.radius_of(np.array([shared + a, shared + b]))
            lost = sum(math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log(1 - p)) for k in range(radius + 1, bits + 1))
            assert lost < 1e-6, (shared, a, b, lost)


@pytest.mark.parametrize(("shared", "a", "b"), [(4, 0, 1), (8, 0, 2), (8, 1, 1), (12, 1, 2), (80, 10, 10), (800, 100, 100)])
def test_no_drawn_pair_at_the_threshold_is_lost(shared, a, b):
    rnd = np.random.default_rng(4)
    draw = lambda n: rnd.integers(0, 2**63, n, dtype=np.uint64)
    rows = []
    for _ in range(2000):
        common = draw(shared)
        rows += [np.concatenate([common, draw(a)]), np.concatenate([common, draw(b)])]
    fp = near_duplicates.fingerprints(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    radius = near_duplicates.radius_of(np.array([shared + a, shared + b]))
    assert (np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1) <= radius).all()


def test_short_texts_with_one_word_more(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(1500):
        text = " ".join(str(rnd.random()) for _ in range(8))
        rows += [(2 * k, text, "en"), (2 * k + 1, text + " more", "en")]
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 3000, 2))


def test_many_candidates_below_the_threshold(spark, monkeypatch):
    """A template that makes all texts candidates of one another, few of them links."""
    monkeypatch.setattr(near_duplicates, "ALLOTMENTS", (1, 2))
    rnd = random.Random(9)
    body = [str(rnd.random()) for _ in range(80)]
    rows = []
    for k in range(60):
        own = [str(rnd.random()) for _ in range(12)]
        rows.append((k, " ".join(body + own), "en"))
        if k % 6 == 0:
            rows.append((1000 + k, " ".join(body + own + ["tail"]), "en"))
    found = near_duplicates.near_duplicate_components(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(zip([r[0] for r in rows], brute_force(rows)))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pipeline.drop_near_duplicates(spark, empty, "").count() == 0
