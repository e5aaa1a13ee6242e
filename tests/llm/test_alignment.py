"""Cross-tokenizer alignment against whole-text encoding by the libraries and common offsets by set intersection."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandloom.llm import alignment as A
from strandloom.llm.queries import QUERIES

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(11)
    units = ["word", "Wort's", " ", "  ", "\n", "\t", " \n ", " ", "漢字", "é", "é", "123", "4,5", "...", "<s>", "</s>", "<unk>",
             "<|endoftext|>", "🙂🙂", "don't", "▁", "\x00", "\x1c", "=====", "a" * 40, " ", "naïve ", "it's 10% off, ", "ÿ", "\r\n"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    return [None, "", " ", "  x", "x  ", "x\n", *texts, "same words here", "same words here", "=" * 3000, "the cat " * 400]


def brute(texts):
    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = A._byte_of_letter()
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        ab = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            docs.append(None)
            continue

        def ends(x):
            at, out = 0, []
            for y in x:
                at += len(y)
                out.append(at)
            return out

        ea, eb = ends(ab), ends(bb)
        groups, i, j = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            i1, j1 = ea.index(c) + 1, eb.index(c) + 1
            groups.append((a[i:i1], b[j:j1]))
            i, j = i1, j1
        docs.append((a, b, groups))
    counts = Counter()
    for d in docs:
        if d:
            counts.update({(x, y) for g, h in d[2] for x in g for y in h})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g, h in d[2] for x in g for y in h]
        text = "|".join(",".join(map(str, g)) + ";" + ",".join(map(str, h)) for g, h in d[2])
        out.append((len(d[0]), len(d[1]), len(d[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [1 << 19, 40, 0])
def test_equals_brute_force(spark, heavy):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, row long, pairs string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in A.align_documents(docs, A_PATH, B_PATH, heavy_pairs=heavy).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(r[0] > 0 for r in got.values()) > 200 and any(r[0] == 0 for r in got.values())


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.align_documents(docs, A_PATH, B_PATH).collect() == []


def test_groups_of_any_ends():
    rng = random.Random(2)
    for _ in range(300):
        ends, counts, base, want = ([], []), ([], []), 0, []
        for _ in range(rng.randrange(1, 6)):  # texts one behind another
            n = rng.randrange(1, 40)
            both = [sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n)), n}) for _ in "ab"]
            want += [(len(ends[0]) + both[0].index(c) + 1, len(ends[1]) + both[1].index(c) + 1) for c in sorted(set(both[0]) & set(both[1]))]
            for x, own, total in zip(ends, both, counts):
                x += [base + e for e in own]
                total.append(len(x))
            base += n
        found = A.shared_groups(*map(np.array, ends), *map(np.array, counts))
        assert list(zip(*map(np.ndarray.tolist, found))) == want


def test_pairs_of_a_large_group(monkeypatch):
    texts = [t or "" for t in odd_texts()]
    plain = A.Aligner(A_PATH, B_PATH).documents(texts)
    monkeypatch.setattr(A, "LARGE_GROUP", 1)
    monkeypatch.setattr(A, "REMEMBERED", 10)
    small = A.Aligner(A_PATH, B_PATH)
    one = [small.documents([t]) for t in texts]
    for k, column in enumerate(plain):
        assert column.to_pylist() == [x[k][0].as_py() for x in one]


def test_digest_of_the_query(spark, tmp_path):
    texts = ["naïve 12,5 don't", "", None, "漢字 🙂🙂\x1c=====", "x" * 50 + "  y", "tab\tand\u0085line\u2028end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t, sp = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = A._byte_of_letter()
    want = {}
    for key, text in enumerate(texts):
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ab = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            want[key] = ""
            continue
        # Ids of a group joined by ",", A before "|" before B, groups by ";": a1,a2|b1;a3|b2,b3.
        at_a, at_b = np.cumsum([*map(len, ab)]).tolist(), np.cumsum([*map(len, bb)]).tolist()
        groups, low = [], 0
        for high in sorted(set(at_a) & set(at_b)):
            ids = [",".join(str(i) for i, end in zip(x, at) if low < end <= high) for x, at in ((a, at_a), (b, at_b))]
            groups.append("|".join(ids))
            low = high
        want[key] = hashlib.sha256(";".join(groups).encode()).hexdigest()
    assert {r.doc_id: r.groups_sha256 for r in QUERIES["op12_alignment"](spark, str(tmp_path)).collect()} == want
    assert sum(map(bool, want.values())) >= 3
