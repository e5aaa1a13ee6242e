"""Brute-force checks of op3, op7, op8 and op10 on small fixtures."""

import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe, common, quality, simhash
from strandloom.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, encoder
from strandloom.llm.graph import connected_components
from strandloom.llm.token_files import library_encoder, read_token_files, token_folder, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello  World's café İ <|endoftext|> foo<|startoftext|>BAR <|ENDOFTEXT|>", "aaaa aaaaaaa bananana",
    "x\u0000​�你好 😀 é ΑΣ ΣΑΣ", "a\x1cb\x85c d", "Straße ÀÉÎ ²³ ½ 123 'S it'LL don't", "<|endoftext|>",
    "word " * 3000, "՘꟎ 𝔘𝔫𝔦 ﬁ Å ǅ", "Hello  World's café İ <|endoftext|> foo<|startoftext|>BAR <|ENDOFTEXT|>",
]


def rows(spark, texts):
    data = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "no id", "clash", 0)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int")


def random_texts(n, seed=7):
    rnd = random.Random(seed)
    pool = [chr(c) for c in [*range(0x20, 0x17F), 0x300, 0x301, 0x308, 0x3A3, 0x4E2D, 0x1F600, 0x1100, 0x1161, 0x85, 0xA0, 0x3000, 0x9, 0xA, 0x1D]]
    return ["".join(rnd.choices(pool, k=rnd.randrange(80))) for _ in range(n)]


def syllable_texts(n, seed=3):
    """Texts of made-up words, so that a rank has many occurrences, also overlapping ones."""
    rnd = random.Random(seed)
    parts = ["th", "in", "er", "on", "le", "aa", "a", "oi", "ch", "ss", "é", "ou", "St", "--", "'s", "7", ","]
    return [" ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("held", [1 << 10, 64 << 20])
@pytest.mark.parametrize("make", [encoder, library_encoder])
def test_ids_equal_the_library(make, held, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_BYTES", held)
    monkeypatch.setattr(common, "SLICE_BYTES", 1 << 14)
    texts = [t for t in TEXTS if t] + random_texts(1500) + syllable_texts(300)
    lib = Tokenizer.from_file(PATH)
    expected = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    batch = pa.RecordBatch.from_pydict({"at": list(range(len(texts))), "text": texts})
    found, at = [], []
    for (kept,), ids, begins in bpe.encode_batches(iter([batch]), "text", ["at"], make(PATH).encode_chunks):
        found += [ids[s:e].tolist() for s, e in zip(begins, begins[1:])]
        at += kept.to_pylist()
    assert at == list(range(len(texts)))
    assert found == expected


@pytest.mark.parametrize("many", [1, 10**9])
def test_pair_index_merges_at_once_as_one_by_one(many, monkeypatch):
    monkeypatch.setattr(bpe, "MANY", many)
    words = sorted({w for t in syllable_texts(200) for w in re.findall("[a-zé]+", t)})
    lib = Tokenizer.from_file(PATH)
    ids, begins = encoder(PATH).bpe.encode(pa.array(words))
    assert [ids[s:e].tolist() for s, e in zip(begins, begins[1:])] == [e.ids for e in lib.encode_batch(words, add_special_tokens=False)]


def test_encode_decode_frame(spark):
    docs = rows(spark, TEXTS)
    lib = Tokenizer.from_file(PATH)
    out = bpe_decode(bpe_encode(docs, PATH), PATH).collect()
    assert len(out) == len(TEXTS) + 1
    by_id = {r.doc_id: r for r in out}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert by_id[i].ids == ids
        assert by_id[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe_encode(docs.limit(0), PATH).count() == 0


def test_repeated_ids_and_long_texts(spark):
    texts = ["one two", "one two", "three", None, "x" * 200_000, "y z " * 50_000]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, "one two")] * 2, "doc_id long, text string")
    lib = Tokenizer.from_file(PATH)
    expected = sorted((lib.encode(t or "", add_special_tokens=False).ids for t in [*texts, "one two", "one two"]), key=repr)
    found = bpe_round_trip(docs, PATH).collect()
    assert sorted((r.ids for r in found), key=repr) == expected
    assert all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in found)
    folder = token_folder(docs)
    out = read_token_files(write_token_files(docs, folder, PATH, part_bytes=1 << 18), folder).collect()
    assert len(out) == 8 and sum(r.doc_id is None for r in out) == 2
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None, None] + [7] * 6
    crc = sorted(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*ids, 2])) for ids in expected)
    assert sorted(r.ids_crc32 for r in out) == crc


def test_token_files_round_trip(spark):
    docs = rows(spark, TEXTS)
    lib = Tokenizer.from_file(PATH)
    for width in (2, 4):
        folder = token_folder(docs)
        out = read_token_files(write_token_files(docs, folder, PATH, width=width, part_bytes=4096), folder, width=width).collect()
        at = 0
        for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id)):
            text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
            ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
            data = b"".join(x.to_bytes(4, "little") for x in ids)
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(data))
            at += len(ids)
    empty = docs.limit(0)
    folder = token_folder(empty)
    assert read_token_files(write_token_files(empty, folder, PATH), folder).count() == 0


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    low = {i: i for i in fps}
    while True:
        new = {i: min(low[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if new == low:
            return low
        low = new


def test_simhash_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "É", "delta", "eps"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randrange(0, 6))) for _ in range(120)] + [None, "", "one two", "One\ttwo"]
    docs = spark.createDataFrame([(i + 5, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    fps = {i + 5: brute_fingerprint(t) for i, t in enumerate(texts)}
    expected = brute_components(fps)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (fps[i], expected[i]) for i in fps}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(expected.values())
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 100 + i) for i in range(50)] + [(7000, 7000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in [*range(101, 150), 1000]}


def brute_repeats(words):
    from collections import Counter

    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(8)})


def test_quality_statistics_and_order():
    rnd = random.Random(5)
    for n in (0, 1, 7, 8, 9, 40, 300):
        words = [b"w%d" % rnd.randrange(2) for _ in range(n)]
        assert quality.repeated_words(words) == brute_repeats(words)
    view = quality.TextView("a # line\na # line\n\n \t\na # line\r\né\vx")
    assert (view.n_words, view.word_chars, view.n_symbols, view.n_dup_lines, view.n_lines) == (11, 20, 3, 1, 4)
    rules = {"never": lambda v: False, "always": lambda v: True}
    assert quality.cascade_order(quality.rule_costs(["a", "b"], rules))[0] == "always"
    assert quality.cascade_order(quality.rule_costs([], rules)) == ["always", "never"]
    assert quality.cascade_order({"dear": (9, 9.0), "cheap": (2, 0.1), "none": (0, 0.0)}) == ["cheap", "dear", "none"]


def test_quality_rules_behind_a_rejection_cost_nothing():
    rules = quality.production_rules()
    order = ["too_few_words", *[n for n in rules if n != "too_few_words"]]
    view = quality.TextView("few words\n" * 3)
    assert quality.first_failure(view, [(n, rules[n]) for n in order]) == "too_few_words"
    assert set(vars(view)) == {"text", "raw", "words", "n_words"}
    for text in ("", "the " * 40, "a # b\n" * 30, " ".join(f"Word{i} says" for i in range(30)), "x" * 100_000):
        verdicts = {quality.first_failure(quality.TextView(text), [(n, rules[n]) for n in o]) is None for o in (order, order[::-1])}
        assert len(verdicts) == 1


def test_quality_cascade_rows(spark):
    good = " ".join(f"Word{i} says" for i in range(30))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, good, 0), (3, good, 0), (4, "the " * 40, 0)], "doc_id long, text string, kept int")
    order = quality.order_rules(docs)
    out = {r.doc_id: r for r in quality.quality_cascade(docs, order).collect()}
    assert [out[i].kept for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert out[4].n_repeat_words == 40 and out[4].base_failed and out[1].failed_rule is not None
    assert quality.quality_cascade(docs.limit(0), order).count() == 0
    assert sorted(quality.order_rules(docs.limit(0))) == sorted(order)
    short = quality.quality_cascade(docs, order, stats=False)
    assert short.columns == ["doc_id", "kept", "failed_rule"] and sum(r.kept for r in short.collect()) == 2
