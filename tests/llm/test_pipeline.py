"""The pipeline's stages against plain re-computations on a small corpus."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from strandloom.llm import langid, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_near_duplicates import brute_force  # noqa: E402
from test_scores import brute_features  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    syllables = {"en": ["tion", "the", "ing", "ous", "er"], "de": ["keit", "sch", "ung", "über", "ich"]}

    def text(lang, toxic):
        words = ["".join(rnd.choices(syllables[lang], k=3)) for _ in range(50)]
        for _ in range(5 if toxic else 0):
            words[rnd.randrange(50)] = rnd.choice(["vilest", "scumbag"])
        return " ".join(words)

    rows = [(i, text("en" if i % 2 else "de", i % 5 == 0), "en" if i % 2 else "de", "s", i, i % 3) for i in range(400)]
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, r[1], *r[2:]) for k, r in enumerate(clean[:40])]  # exact copies
    rows += [rows[1], (2000, None, "en", "s", 0, 1), (2001, "", "en", "s", 0, 1), (2002, "123 !", "de", "s", 0, 1), (None, text("en", False), "en", "s", 0, 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    counts = [docs.count()]
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, corpus)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        counts.append(kept.count())
    left = {r.doc_id for r in kept.collect()}
    toxic_left = {i for i in left if i is not None and i < 400 and i % 5 == 0}
    assert len(toxic_left) <= 2
    assert {i for i in range(400) if i % 5} <= left and not any(i is not None and 1000 <= i < 1040 for i in left)
    assert not left & {2000, 2001, 2002} and None in left
    assert kept.where("doc_id = 1").count() == 1


def test_every_stage_against_a_plain_recomputation(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    # Toxicity: the features word by word, the trees and the calibration one row at a time.
    labels = spark.read.parquet(f"{corpus}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text").join(labels, "doc_id"))
    bounds, values = list(model.calibration.boundaries), list(model.calibration.predictions)
    rows = docs.collect()
    kept = []
    for r in rows:
        x = brute_features(r.text or "", model.lexicon)
        margin = sum(w * t.predict(Vectors.dense(x)) for w, t in zip(model.trees.treeWeights, model.trees.trees))
        kept.append((r, float(np.interp(margin, bounds, values))))
    want = sorted((repr(tuple(r)) for r, score in kept if score < 0.5))
    stage = pipeline.drop_toxic(spark, docs, corpus).collect()
    assert sorted(repr(tuple(r)) for r in stage) == want
    # Language: every block compressed with every dictionary.
    left = spark.createDataFrame(stage, docs.schema)
    dictionaries = tuple(sorted(langid.language_dictionaries(left, F.lit(True)).items()))
    told = pipeline.drop_unknown_language(spark, left, corpus).collect()
    assert sorted(repr(tuple(r)) for r in told) == sorted(repr(tuple(r)) for r in stage if langid.classify(r.text, dictionaries)[2])
    # Near-duplicates: all pairs of whole shingle sets.
    left = [r for r in told if r.doc_id is not None]
    single = pipeline.drop_near_duplicates(spark, spark.createDataFrame(left, docs.schema), corpus).collect()
    low = brute_force([(r.doc_id, r.text, r.lang) for r in left])
    assert sorted(r.doc_id for r in single) == sorted(set(low))
    # Packing: no choice of as many bounds pads less.
    packed = pipeline.pack_documents(spark, spark.createDataFrame(single, docs.schema), corpus).collect()
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in single)
    sizes = {r.doc_id: len((r.text or "").split()) for r in single}
    assert all(r.n_tokens == sizes[r.doc_id] for r in packed)
    distinct = sorted(set(sizes.values()))
    assert len(distinct) <= 16 and all(r.padded_tokens == r.n_tokens for r in packed)


def test_run_packs_what_is_left(spark, corpus):
    out = pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "padded_tokens", "batch", "slot"]
    assert 300 <= out.count() <= 330


def test_empty_tables(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
