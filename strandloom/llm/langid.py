"""Language identification by compression with per-language raw-content dictionaries.

Passages of a bounded sample of labelled texts, SAMPLE_TEXTS a language, make a zstandard raw-content dictionary; a
passage starts at a place drawn by a hash, anywhere in its text, and has PASSAGE characters. A text is lower-cased, cut
into blocks of ``block`` bytes and every block is compressed with each dictionary on its own, so that matches come
from the dictionary rather than from the text itself; the language with the fewest bytes wins. A text is rejected
when the second language needs hardly more bytes: fewer than ``min_margin`` of the text's bytes.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; ties go to the language
that sorts first and are rejected; rows with a null or ``und`` label are not learned; without any learned language
all texts are ``und``; repeated rows repeat their result; an empty table gives an empty result; other columns pass
through unread where asked for.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strandloom.llm.common import map_columns

#: Labelled texts taken for one language, by order of a hash of their key and text, and characters taken of each.
SAMPLE_TEXTS, PASSAGE = 96, 768
BLOCK = 1_024
#: Bytes by which the scores' softmax is scaled.
TEMPERATURE = 4.0
MIN_MARGIN = 0.0005

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def language_dictionaries(labelled: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict[str, bytes]:
    """Language -> raw dictionary, from a passage of each of at most SAMPLE_TEXTS usable rows a language."""
    order = F.xxhash64(F.col(f"`{key_col}`"), F.col(f"`{text_col}`"))
    by = Window.partitionBy("lang").orderBy("order", "text")
    start = F.pmod(F.xxhash64("order"), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1) + 1
    sample = (
        labelled.where(usable)
        .select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), order.alias("order"))
        .where("lang IS NOT NULL AND lang <> 'und' AND text IS NOT NULL")
        .where(F.col("text").rlike(r"\p{L}"))
        .withColumn("n", F.row_number().over(by))
        .where(F.col("n") <= SAMPLE_TEXTS)
        .select("lang", "n", F.lower(F.substring("text", start.cast("int"), F.lit(PASSAGE))).alias("text"))
    )
    found: dict[str, bytes] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.n)):
        found[r.lang] = found.get(r.lang, b"") + r.text.encode("utf-8", "surrogatepass") + b"\n"
    return found


def _search() -> zstandard.ZstdCompressionParameters:
    """A thorough match search over the whole dictionary, short matches included."""
    return zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=16, search_log=6, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_dict_id=False,
    )


@functools.lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=_search())
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=_search())))
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
    """(language, score, accepted) of one whole text."""
    if text is None or not dictionaries or not any(map(str.isalpha, text)):
        return "und", 0.0, False
    raw = text.lower().encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = sorted((sum([len(c.compress(b)) for b in blocks]), lang) for lang, c in _compressors(dictionaries))
    best = sizes[0][0]
    score = 1.0 / sum(math.exp((best - s) / TEMPERATURE) for s, _ in sizes)
    margin = sizes[1][0] - best if len(sizes) > 1 else len(raw)
    return sizes[0][1], score, margin > 0 and margin >= min_margin * len(raw)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """Append predicted language, score and acceptance of every whole text; one pass, no shuffle."""
    # Bounded by languages * SAMPLE_TEXTS * PASSAGE characters.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(texts: pa.Array) -> list[pa.Array]:
        found = [classify(t, shared.value) for t in texts.to_pylist()]
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, FIELDS)]
    return map_columns(docs, run, fields, [text_col], list(keep))
