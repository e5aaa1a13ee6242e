"""Texts of a large Arrow batch are coded in parts of bounded size, and combined counts are the same."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandloom.llm import ctw


def test_a_large_batch_is_coded_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 5000, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], names=["text", "train"])
    assert batch.nbytes > 3 << 20
    sizes, code = [], ctw.code

    def noted(found, depth):
        sizes.append(pc.sum(pc.binary_length(found)).as_py())
        return code(found, depth)

    monkeypatch.setattr(ctw, "code", noted)
    monkeypatch.setattr(ctw, "FLUSH", 20_000)
    parts = list(ctw._gather(iter([batch]), 5))
    assert max(sizes) <= 1 << 20 and sum(sizes) == sum(map(len, texts)) and len(parts) > 1
    words, strings = Counter(), Counter()
    for part in parts:
        for string, word, n in zip(*(c.to_pylist() for c in part.columns)):
            (words if string is None else strings)[word if string is None else string] += n
    assert words == Counter(w for t in texts for w in t.split())
    assert sum(strings.values()) == sum(len(t) + 1 for t in texts)
