"""Brute-force checks of op5 and held-out checks of op6 and op9."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom.llm import ctw, langid, toxicity


def brute_kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1)


class BruteTree:
    """Context-tree weighting by the recursive definition, one node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.seen = depth, Counter()
        for t in texts:
            s = self.symbols(t)
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    self.seen[tuple(s[i - d : i]), s[i]] += 1
        self.children = {}
        self.after = {}
        for c, b in self.seen:
            self.children.setdefault(c[1:], set()).add(c) if c else None
            self.after.setdefault(c, set()).add(b)

    def symbols(self, text):
        return [255] * self.depth + list((text or "").encode()) + [255]

    def split(self, context, prefix):
        n = [0, 0]
        for b in self.after.get(context, ()):
            bits = f"{b:08b}"
            if bits.startswith(prefix):
                n[int(bits[len(prefix)])] += self.seen[context, b]
        return n

    def weighted(self, context, prefix):
        own = brute_kt(*self.split(context, prefix))
        if len(context) == self.depth:
            return own
        below = sum(self.weighted(c, prefix) for c in self.children.get(context, ()))
        return math.log(0.5) + np.logaddexp(own, below)

    def predict(self, before, prefix, d=0):
        context = tuple(before[len(before) - d :])
        n0, n1 = self.split(context, prefix)
        zero = (n0 + 0.5) / (n0 + n1 + 1)
        if d == self.depth:
            return zero
        stay = math.exp(math.log(0.5) + brute_kt(n0, n1) - self.weighted(context, prefix))
        return stay * zero + (1 - stay) * self.predict(before, prefix, d + 1)

    def score(self, text):
        s, total = self.symbols(text), 0.0
        for i in range(self.depth, len(s)):
            bits = f"{s[i]:08b}"
            for j in range(8):
                zero = self.predict(s[i - self.depth : i], bits[:j])
                total += math.log10(1 - zero if bits[j] == "1" else zero)
        return total


def brute_base(texts, learned, text):
    def tokens(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w] + [None]

    counts = Counter(w for t, use in zip(texts, learned) if use for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text)), len(tokens(text)), sum(counts[w] > 0 for w in tokens(text)), n


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 9000, 0.5), [1e6 + 0.5, 1e9, 1e12 + 0.5]])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize(("depth", "subtree", "heavy"), [(2, 10**6, 10**6), (2, 30, 20), (5, 60, 1), (5, 300, 50)])
def test_scores_match_brute_force(spark, depth, subtree, heavy):
    rnd = random.Random(5)
    texts = [None, "", "  ", "A b\u00e9\u00e8 a\u0301", "\U0001f600 \u4e2d"] + ["".join(rnd.choices("aab cdé\n", k=rnd.randrange(30))) for _ in range(14)]
    texts += [texts[6], "unseen zzz qqq", "q" * 40, "w" * 65 + " b"]
    learned = [i % 3 != 0 and i < 20 for i in range(len(texts))]
    schema = "doc_id long, text string, train boolean, row int, string long, words string, gain double"
    docs = spark.createDataFrame([(i, t, use, 0, 0, "clash", 0.0) for i, (t, use) in enumerate(zip(texts, learned))], schema)
    brute = BruteTree([t for t, use in zip(texts, learned) if use], depth)
    got = ctw.score_documents(docs, F.col("train"), depth=depth, subtree=subtree, heavy_strings=heavy, heavy_words=heavy).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        base, n_tokens, n_known, n = brute_base(texts, learned, text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(brute.score(text), abs=1e-7)
        assert r.bits_per_byte == pytest.approx(-brute.score(text) / math.log10(2) / (len((text or "").encode()) + 1), abs=1e-7)


def test_scores_without_training_or_rows(spark):
    docs = spark.createDataFrame([(0, "ab"), (None, None)], "doc_id long, text string")
    assert ctw.score_documents(docs.limit(0), F.lit(True)).count() == 0
    for flag in (F.lit(False), F.lit(None).cast("boolean")):
        rows = {r.doc_id: r for r in ctw.score_documents(docs, flag).collect()}
        assert rows[0].score == pytest.approx(24 * math.log10(0.5)) and rows[None].score == pytest.approx(8 * math.log10(0.5))
        assert [rows[0].train_tokens, rows[0].base_score, rows[0].n_known] == [0, 0.0, 0]


def test_language_identification(spark):
    rnd = random.Random(2)
    syllables = {"aa": ["tion", "the", "ing", "ous", "er"], "bb": ["keit", "sch", "ung", "über", "ich"], "cc": ["ción", "mente", "que", "ñar", "los"]}

    def text(lang):
        return " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(60))

    data = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    frame = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in data] + [(900, "plain", None, "x"), (901, "und text", "und", "x")], "doc_id long, text string, lang string, lang_pred string")
    found = langid.language_dictionaries(frame, F.col("doc_id") < 60)
    assert sorted(found) == ["aa", "bb", "cc"]
    out = {r.doc_id: r for r in langid.identify(frame, found).collect()}
    assert all(out[i].lang_pred == lang and out[i].accepted for i, _, lang in data)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "q"), (4, "q")], "doc_id long, text string")
    rows = langid.identify(odd, found).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "aa", "aa"] and not any(r.accepted for r in rows)
    assert langid.identify(frame.limit(0), found).count() == 0
    assert langid.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_toxicity_held_out(spark):
    rnd = random.Random(3)
    clean = [f"w{i}x" for i in range(200)]

    def text(toxic):
        words = rnd.choices(clean, k=40)
        for _ in range(4 if toxic else 0):
            words[rnd.randrange(40)] = rnd.choice(["vilest", "Scumbag", "V1lest!"])
        return " ".join(words)

    data = [(i, text(i % 4 == 0), int(i % 4 == 0), 0.5) for i in range(600)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int, score double")
    model = toxicity.fit_toxicity(frame.where("doc_id < 400"))
    out = toxicity.score_toxicity(frame.where("doc_id >= 400"), model, keep=("doc_id", "toxic")).collect()
    assert len(out) == 200 and sum((r.score >= 0.5) == bool(r.toxic) for r in out) >= 196
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.score_toxicity(frame.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, toxicity.fit_toxicity(frame.limit(0))).collect()} == {0.0}
    one = toxicity.fit_toxicity(frame.where("toxic = 1"))
    assert {r.score for r in toxicity.score_toxicity(odd, one).collect()} == {1.0}
    few = toxicity.fit_toxicity(frame.where("doc_id < 16"))
    assert {r.score for r in toxicity.score_toxicity(odd, few).collect()} == {0.25}


def test_toxicity_parts_are_disjoint_and_calibration_is_isotonic(spark):
    assert not set(toxicity.LEXICON_PARTS) & {*toxicity.TREE_PARTS, *toxicity.CALIBRATION_PARTS} and not set(toxicity.TREE_PARTS) & set(toxicity.CALIBRATION_PARTS)
    rnd = random.Random(6)
    data = [(i, " ".join(rnd.choices(["w%d" % k for k in range(50)] + ["foul"] * (15 if rnd.random() < (0.7 if i % 3 == 0 else 0.05) else 0), k=20)), int(i % 3 == 0)) for i in range(500)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame)
    # Pool adjacent violators over the model's own boundaries: rising, and the scores lie between them.
    bounds = list(model.calibration.predictions)
    assert bounds == sorted(bounds) and 0 <= bounds[0] and bounds[-1] <= 1
    # The lexicon by its definition, over the rows of its parts.
    order = spark.createDataFrame(data, "doc_id long, text string, toxic int").withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit("toxicity")), F.lit(1_000_000)))
    rows = sorted(order.collect(), key=lambda r: (r.draw, r.doc_id, r.text))
    held = [r for c in (0, 1) for k, r in enumerate([r for r in rows if r.toxic == c], 1) if k % toxicity.PARTS in toxicity.LEXICON_PARTS]
    n = Counter(r.toxic for r in held)
    counts = {c: Counter(s for r in held if r.toxic == c for s in {s for w in r.text.split() for s in toxicity.stems(w)}) for c in (0, 1)}
    odds = {s: (k + 0.5) / (n[1] + 1) / ((counts[0][s] + 0.5) / (n[0] + 1)) for s, k in counts[1].items()}
    want = {s: math.log(o) for s, o in odds.items() if o >= toxicity.MIN_ODDS and counts[1][s] >= max(toxicity.MIN_TEXTS, 0.01 * n[1])}
    assert model.lexicon == pytest.approx(want)


def brute_features(text, lexicon):
    """The features by their definitions, one word at a time."""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)

    def hit(core):
        return next((s for s in toxicity.stems(core) if s in lexicon), None) if core else None

    def bare(w):
        return re.sub(r"^\W+|\W+$", "", w)

    hits, disguised = [], 0
    mixed = [bool(toxicity._MIXED.search(w)) for w in tokens]
    for w, odd in zip(tokens, mixed):
        found = hit(bare(w).lower())
        if not found and odd:
            found = hit(bare(w.lower().translate(toxicity.DISGUISE)))
            disguised += bool(found)
        hits.append(found)
    second = [i for i, w in enumerate(tokens) if bare(w).lower() in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i, h in enumerate(hits) if h)
    n, found, joined = len(tokens), [h for h in hits if h], "".join(tokens)
    letters, upper = sum(c.isalpha() for c in joined), sum(c.isupper() for c in joined)
    shouts = sum(sum(map(str.isalpha, w)) > 2 and sum(map(str.isupper, w)) == sum(map(str.isalpha, w)) for w in tokens)
    return [
        len(found) / n, len(found), len(set(found)), max([lexicon[h] for h in found], default=0.0), near / n, len(second) / n, upper / max(letters, 1),
        shouts / n, sum(not c.isalnum() for c in joined) / n, joined.count("!") / n, sum(mixed) / n, disguised / n, math.log1p(n),
    ]


def test_toxicity_features_match_brute_force():
    rnd = random.Random(9)
    lexicon = {"=foul": 3.0, "vile": 2.5, "scumb": 4.0}
    entries = sorted(lexicon)
    words = toxicity.Words({s: i for i, s in enumerate(entries, 1)})
    weights = np.array([0.0, *[lexicon[s] for s in entries]])
    pool = ["foul", "Foul!", "vilest", "V1LE", "sc*mbag", "scumbag", "you", "Your,", "du", "word", "LOUD", "b3tter", "a!!", "...", "x" * 300 + "!" * 300, "A" * 400, "été"]
    for text in ["", " ", *[" ".join(rnd.choices(pool, k=rnd.randrange(1, 40))) for _ in range(200)]]:
        assert toxicity.features(text, words, weights) == pytest.approx(brute_features(text, lexicon))


def test_language_scores_match_single_compressions():
    rnd = random.Random(2)
    dictionaries = tuple(sorted((lang, " ".join("".join(rnd.choices(letters, k=4)) for _ in range(900)).encode()) for lang, letters in (("aa", "abcde"), ("bb", "fghij"))))
    for text in ["abba caba", "fghi jjij " * 700, "Abc, fgh. " * 40, "é" * 5000]:
        raw = text.lower().encode()
        sizes = {}
        for lang, held in dictionaries:
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=d, compression_params=langid._search())
            sizes[lang] = sum(len(c.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK))
        best = min(sizes, key=lambda k: (sizes[k], k))
        lang, score, accepted = langid.classify(text, dictionaries)
        gap = max(sizes.values()) - min(sizes.values())
        assert lang == best and score == pytest.approx(1 / (1 + math.exp(-gap / langid.TEMPERATURE)))
        assert accepted == (gap > 0 and gap >= langid.MIN_MARGIN * len(raw))


def test_language_passages_come_from_anywhere(spark):
    text = " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, text, "aa") for i in range(200)], "doc_id long, text string, lang string")
    held = langid.language_dictionaries(docs, F.lit(True))["aa"].decode().split("\n")[:-1]
    places = [text.index(p) for p in held]
    assert len(held) == langid.SAMPLE_TEXTS and all(len(p) == langid.PASSAGE for p in held)
    assert min(places) < len(text) / 10 and max(places) > len(text) * 9 / 10
