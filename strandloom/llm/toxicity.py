"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Learned from a bounded sample of labelled rows (``fit_rows``), whose toxic and other rows are each dealt into five
parts by the order of a hash: two give a lexicon (words and word stems with high odds in toxic texts), two others fit
``GBTClassifier`` on the dense features, the last fits ``IsotonicRegression`` on the trees' margin. No row is in two of
the three. Features of a whole text: lexicon densities, hits near a second-person word, capitals, punctuation and
obfuscation rates, length.

Defined cases: a null or empty text has all features zero and gets the score of such features; rows without a
label are not learned; with fewer than five labelled rows of a class, which cannot fill the parts, every score is the
share of toxic rows, and 0 without any labelled row; a word of any length counts whole; repeated rows repeat their result; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strandloom.llm.common import map_columns, materialise, ship_package, texts_of

#: Labelled rows that the model is fitted on, at most about so many.
FIT_ROWS = 20_000
#: Disjoint parts of those rows, and what is learned from each.
PARTS, LEXICON_PARTS, TREE_PARTS, CALIBRATION_PARTS = 5, (0, 1), (2, 3), (4,)
#: Entries of the lexicon, at most.
LEXICON_SIZE = 400
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: A lexicon entry's odds in toxic texts against others, and its least number of toxic texts.
MIN_ODDS, MIN_TEXTS = 20.0, 3
#: Words on either side of a hit in which a second-person word counts as near.
NEAR = 5

# Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinen deinem ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú usted ustedes vosotros vosotras tus ti contigo".split()
)
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})

FEATURES = ("lexicon_density", "lexicon_hits", "lexicon_distinct", "strongest_hit", "near_second_person", "second_person", "capital_rate", "shout_rate", "punctuation_rate", "exclamation_rate", "obfuscation_rate", "disguised_density", "log_words")

_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*._-]+[^\W\d_]|^[\d@$]+[^\W\d_]{2}")


def stems(core: str) -> list[str]:
    """Lexicon keys of a word: itself and its first letters."""
    return [f"={core}", *[core[:n] for n in STEM_LENGTHS if len(core) > n]]


def character_counts(word: str) -> tuple[int, int, int, int]:
    """Exclamation marks, characters that are neither letter nor digit, upper-case letters, letters."""
    return word.count("!"), sum(not c.isalnum() for c in word), sum(map(str.isupper, word)), sum(map(str.isalpha, word))


class Words(dict):
    """Memo: word -> (hit id or 0, flags and counts packed into one integer)."""

    LIMIT = 200_000
    #: Longer words are counted on their own, as their counts could exceed a packed field.
    LONGEST = 255

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        core = _EDGE.sub("", word).lower()
        hit = self._hit(core)
        mixed = bool(_MIXED.search(word))
        disguised = 0
        if not hit and mixed:
            hit = disguised = self._hit(_EDGE.sub("", word.lower().translate(DISGUISE)))
        exclamations, marks, upper, letters = character_counts(word)
        packed = hit | (core in SECOND_PERSON) << 16 | mixed << 17 | (disguised > 0) << 18 | (letters > 2 and upper == letters) << 19
        if len(word) <= self.LONGEST:
            packed |= exclamations << 20 | marks << 28 | upper << 36 | letters << 44
        self[word] = packed
        return packed

    def _hit(self, core: str) -> int:
        return next((i for s in stems(core) if (i := self.lexicon.get(s))), 0) if core else 0


def features(text: str, words: Words, weights: np.ndarray) -> list[float]:
    """Dense features of one whole text, in the order of FEATURES."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    p = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=n)
    hit = p & 0xFFFF
    where = np.flatnonzero(hit)
    second = (p >> 16 & 1).astype(bool)
    exclamations, marks, upper, letters = (int((p >> at & 255).sum()) for at in (20, 28, 36, 44))
    if max(map(len, tokens)) > words.LONGEST:
        long = [character_counts(w) for w in tokens if len(w) > words.LONGEST]
        exclamations, marks, upper, letters = (x + sum(c[k] for c in long) for k, x in enumerate((exclamations, marks, upper, letters)))
    near = 0
    if len(where) and second.any():
        at = np.flatnonzero(second)
        j = np.clip(np.searchsorted(at, where), 0, len(at) - 1)
        near = int((np.minimum(np.abs(at[j] - where), np.abs(at[np.maximum(j - 1, 0)] - where)) <= NEAR).sum())
    return [
        len(where) / n, float(len(where)), float(len(np.unique(hit[where]))), float(weights[hit].max()), near / n, second.sum() / n,
        upper / max(letters, 1), (p >> 19 & 1).sum() / n, marks / n, exclamations / n,
        (p >> 17 & 1).sum() / n, (p >> 18 & 1).sum() / n, math.log1p(n),
    ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
            keys = {k for w in set(text.split()) if (core := _EDGE.sub("", w).lower()) for k in stems(core)}
            counts[toxic].update(keys)
    if keys := list(counts[1].keys() | counts[0].keys()):
        yield pa.RecordBatch.from_pydict({"stem": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]})


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Stem -> log odds, from rows (text, toxic); at most LEXICON_SIZE entries."""
    ship_package(labelled.sparkSession)
    n = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    odds = ((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    found = (
        labelled.select("text", "toxic").mapInArrow(_stem_counts, "stem string, toxic long, clean long")
        .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= max(MIN_TEXTS, 0.01 * n.get(1, 0)))
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_ODDS)
        .orderBy((F.col("toxic") * F.log("odds")).desc(), "stem")
        .limit(LEXICON_SIZE)
        .collect()
    )
    return {r.stem: math.log(r.odds) for r in found}


def _featured(docs: DataFrame, lexicon: dict[str, float], text_col: str, keep: list[str], name: str) -> DataFrame:
    entries = sorted(lexicon)
    ids = {s: i for i, s in enumerate(entries, 1)}
    weights = np.array([0.0, *[lexicon[s] for s in entries]])

    task: dict[str, Words] = {}  # filled in the worker, so that a task's slices share one memo

    def run(texts: pa.Array) -> list[pa.Array]:
        words = task.setdefault("words", Words(ids))
        rows = [features(t, words, weights) for t in texts_of(texts)]
        return [pa.array(rows, pa.list_(pa.float64()))]

    return map_columns(docs, run, [T.StructField(name, T.ArrayType(T.DoubleType()))], [text_col], keep)


def fit_toxicity(labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 20, depth: int = 3) -> ToxicityModel:
    """Fit on rows (doc_id, text, toxic), of which about ``fit_rows`` at most are taken by a hash of doc_id."""
    usable = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    total = usable.select("toxic").count()
    if not total:
        return ToxicityModel({}, None, None, 0.0)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("toxicity")), F.lit(1_000_000))
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < math.ceil(1e6 * min(1.0, fit_rows / total)))
    # A bounded number of rows, about ``fit_rows``; written once, read by every step of the fit.
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "doc_id", "text"))
    sample = materialise(drawn.withColumn("part", F.pmod(place, F.lit(PARTS))).repartition("draw"), "toxicity-fit")
    classes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if min(classes.get(0, 0), classes.get(1, 0)) < PARTS:
        return ToxicityModel({}, None, None, classes.get(1, 0) / max(sum(classes.values()), 1))
    lexicon = learn_lexicon(sample.where(F.col("part").isin(*LEXICON_PARTS)))
    rows = materialise(
        _featured(sample, lexicon, "text", ["toxic", "part"], "features").withColumn("features", array_to_vector("features")),
        "toxicity-features",
    ).coalesce(4)
    learner = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False)
    fitted = learner.fit(rows.where(F.col("part").isin(*TREE_PARTS)))
    held = fitted.transform(rows.where(F.col("part").isin(*CALIBRATION_PARTS)))
    margins = held.select(vector_to_array("rawPrediction")[1].alias("margin"), F.col("toxic").cast("double").alias("toxic"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="margin").fit(margins)
    return ToxicityModel(lexicon, fitted, calibration)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), score_col: str = "score") -> DataFrame:
    """Append a calibrated score of every whole text; one pass, no shuffle."""
    if model.trees is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(score_col, F.lit(model.constant))
    held = [f"__keep{i}" for i in range(len(keep))]
    named = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{text_col}`").alias("__text"))
    marked = _featured(named, model.lexicon, "__text", held, "__features").withColumn("features", array_to_vector("__features"))
    margin = model.trees.transform(marked).withColumn("margin", vector_to_array("rawPrediction")[1])
    scored = model.calibration.transform(margin.select(*held, "margin"))
    return scored.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias(score_col))
