"""Attention-based quality classifier: features, gradients, shards, held-out accuracy and defined cases."""

import random

import numpy as np
import pytest

from strandloom.llm import attention_quality as Q


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    bags = np.array([1, 4, 2, 3])
    x, label = rng.normal(size=(10, 7)), np.array([1.0, 0, 1, 0])
    p = Q.initial(7, 3)

    def loss(q):
        z = Q.forward(q, x, bags)["logit"]
        return np.mean(np.log1p(np.exp(-z)) + (1 - label) * z)

    g = Q.gradients(p, x, bags, label)
    for k in p:
        for i in list(np.ndindex(p[k].shape))[:40]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-7), k


def test_attention_is_a_share_of_each_bag():
    rng = np.random.default_rng(2)
    bags = np.array([3, 1, 5])
    f = Q.forward(Q.initial(4), rng.normal(size=(9, 4)), bags)
    assert np.add.reduceat(f["a"], f["starts"]) == pytest.approx([1, 1, 1])
    z = [sum(f["a"][i] * f["h"][i] for i in range(s, s + n)) for s, n in zip(f["starts"], bags)]
    assert f["z"] == pytest.approx(np.array(z))
    model = Q.AttentionModel(np.zeros(4), np.ones(4), Q.initial(4))
    score, top, best = model.score(rng.normal(size=(9, 4)), bags)
    assert (top < bags).all() and (best * bags >= 1 - 1e-9).all() and ((score > 0) & (score < 1)).all()


def test_passages_of_a_text_do_not_depend_on_its_neighbours():
    rng = random.Random(3)
    words = ["the", "Of", "a%%%", "|", "x1", "NAÏVE", "http://a.b", "....", "word,", "end."]
    texts = ["", " \n ", "one", "a a a\nb\nb\nb", *[" ".join(rng.choice(words) + rng.choice(["", "", "\n"]) for _ in range(rng.randrange(300))) for _ in range(30)], "w" * 5000]
    x, bags = Q.passages(texts, Q.Words())
    assert bags.tolist() == [max(1, -(-len(t.split()) // Q.PASSAGE_WORDS)) for t in texts]
    at = 0
    for t, n in zip(texts, bags):
        own, _ = Q.passages([t], Q.Words())
        assert own == pytest.approx(x[at : at + n])
        at += n
    assert np.isfinite(x).all() and not x[0].any()
    repeated = x[bags[:3].sum()]
    first = Q.N_WORD + Q.SHAPES
    # "a a a / b / b / b": repeats of the word before, words seen, pairs seen, lines seen, distinct words.
    assert repeated[first : first + 5] == pytest.approx([4 / 6, 4 / 6, 2 / 6, 2 / 6, 2 / 6])


def corpus(n=400, seed=4):
    """Good texts, and bad ones of which one passage alone is noise."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 400))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(words) + rng.choice(["%%%", "###"]) for _ in range(50)]
        rows.append((i, " ".join(text), i))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_defined_cases(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0), (902, " ", 0), (0, rows[0][1], 0), (None, "x y", 0)], "doc_id long, text string, score long")
    marked = spark.createDataFrame([*labels[:250], (3, None), (5, 7), (None, 1), (777, 1)], "doc_id long, quality int")
    model = Q.fit_attention(docs, marked, rounds=3)
    got = Q.score_attention(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].score >= 0.7) == bool(y) for i, y in labels[250:]]
    assert np.mean(held) > 0.95
    assert [by[901].score, by[902].score] == pytest.approx([by[900].score] * 2) and by[900].n_passages == 1
    again = {r.doc_id: r.score for r in Q.score_attention(docs.repartition(5).select("doc_id", "text"), Q.fit_attention(docs.repartition(7), marked, rounds=3)).collect()}
    assert [again[i] for i, _ in labels] == pytest.approx([by[i].score for i, _ in labels], abs=1e-6)
    kept = Q.score_attention(docs, model, keep=("doc_id", "score"), names=("s", "n", "t", "w"))
    assert kept.columns == ["doc_id", "score", "s", "n", "t", "w"] and kept.count() == len(got)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score_attention(docs, Q.fit_attention(docs, none)).collect()] == [0.5, 0.5]
    one = Q.fit_attention(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), rounds=1)
    assert all(r.score > 0.5 for r in Q.score_attention(docs, one).collect())
    assert Q.score_attention(docs.limit(0), one).count() == 0


def test_long_texts_are_fitted_on_spread_passages(spark):
    rows, labels = corpus(40)
    docs = spark.createDataFrame([(i, t * 30) for i, t, _ in rows], "doc_id long, text string")
    model = Q.fit_attention(docs, spark.createDataFrame(labels, "doc_id long, quality int"), fit_passages=8, rounds=1, steps=5)
    assert model.parameters is not None and Q.score_attention(docs, model).count() == 40
