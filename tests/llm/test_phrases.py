"""Phrase collocations against counting by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import phrases as P


def brute(rows, least, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    held = {k: a for k, a in f.items() if a >= least}
    inside = {}
    for (lang, p), a in held.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                inside[key] = max(inside.get(key, 0), a)
    out = []
    for lang in n:
        found = []
        for (x, p), a in held.items():
            if x == lang and len(p) > 1 and 100 * inside.get((x, p), 0) < 100 * a:
                score, k = min((1000 * a * n[x] // (f[x, p[:k]] * f[x, p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[x, p[:k]], f[x, p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "é", "Ö", "x1", "In", "naïve", "\x1cz", "aa"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "de"), ("A b", None)]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\r\n", " , "]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None])))
    return rows + [("alpha beta gamma delta epsilon zeta", "fr")] * 9 + [("und ist der", "und")] * 8


@pytest.mark.parametrize("shard_words,most", [(1 << 21, 2000), (50, 2000), (50, 3)])
def test_equals_brute_force(spark, shard_words, most):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, x, "s") for i, (t, x) in enumerate(rows)], "number long, text string, lang string, words string").repartition(3)
    found = P.collocations(docs, least=4, most=most, shard_words=shard_words).drop("k").collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 4, most)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert P.collocations(docs).collect() == []


def test_extension_counts_and_both_intervals():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 4, 300), 0).astype(np.int32)
    back = text[::-1]
    counts = np.bincount(text, minlength=4)
    starts = P.starts_of(text, 4)
    shard = P.Shard(starts[1:], counts[1:], np.arange(1, 4, dtype=np.uint64), P.transform(text), P.transform(back), np.uint64(0))
    rows, rows_back = (sorted(range(len(t)), key=lambda i: [t[(i + k) % len(t)] for k in range(8)]) for t in (text, back))
    at = lambda t, i, m: tuple(int(t[(i + k) % len(t)]) for k in range(m))
    p = shard.single()
    for size in range(2, 6):
        p = shard.extend(p, size % 2 == 0)
        grams = Counter(at(text, i, size) for i in range(len(text) - size + 1))
        assert {tuple(w): n for w, n in zip(p.words.tolist(), p.n.tolist())} == {g: n for g, n in grams.items() if 0 not in g}
        for f, r, n, w in zip(p.forward, p.reverse, p.n, p.words.tolist()):
            assert all(at(text, i, size) == tuple(w) for i in rows[f : f + n])
            assert all(at(back, i, size) == tuple(w[::-1]) for i in rows_back[r : r + n])


def test_packed_cells():
    cells, n = np.array([9, 1, 9, 130, 64], dtype=np.uint64), np.array([1, 2, 3, 4, 5])
    found = [P.unpacked_cells(c, r, 10, 4) for r, c in P.packed_cells(cells, n, 10, 4)]
    assert sorted((int(c), int(k)) for x, y in found for c, k in zip(x, y)) == [(1, 2), (9, 4), (64, 5), (130, 4)]


def test_packed_phrases():
    size, phrase, count = P.unpacked_phrases(P.packed_phrases([2, 3, 2], [b"b c", b"a b c", b"a \xc3\xa9"], [5, 7, 100_000]))
    assert sorted(zip(size.tolist(), phrase, count.tolist())) == [(2, b"a \xc3\xa9", 100_000), (2, b"b c", 5), (3, b"a b c", 7)]


def test_blocks_end_where_pieces_end():
    raw = ("one two. " * 50 + "x" * 300 + " y. tail").encode()
    parts = list(P.blocks(raw, 40))
    assert b"".join(parts) == b"".join(P.blocks(raw)) and all(p.endswith(b"\n") for p in parts[:-1])
