"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm.alignment import align_documents
from strandloom.llm.attention_quality import fit_attention, score_attention
from strandloom.llm.bpe import bpe_round_trip
from strandloom.llm.common import fold_of
from strandloom.llm.ctw import score_documents
from strandloom.llm.embeddings import embedding_components
from strandloom.llm.langid import identify, language_dictionaries
from strandloom.llm.packing import pack
from strandloom.llm.phrases import collocations
from strandloom.llm.quality import order_rules, quality_cascade
from strandloom.llm.simhash import simhash_components
from strandloom.llm.token_files import read_token_files, token_folder, write_token_files
from strandloom.llm.toxicity import fit_toxicity, score_toxicity
from strandloom.llm.url_filter import filter_captures, host_of, path_of

#: Vocabulary files of the token queries; the library's operators take any path.
VOCABULARY, BYTE_VOCABULARY, PIECE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), _vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
line_counts AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
grams AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY rid),
s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
    (length(t) - length(replace(t, '...' || chr(10), ''))) // 4 + (length(t) - length(replace(t, '…' || chr(10), ''))) // 2 AS n_ellipsis,
    len(regexp_extract_all(t, '(?m)^[ \t]*(?:- |\* |•)')) AS n_bullets
  FROM d LEFT JOIN line_counts USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
    OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR 5 * lettered < 3 * n_words
    OR 2 * n_ellipsis > n_lines OR 10 * n_bullets > 9 * n_lines) AS kept
FROM s
"""


@_register("op7_quality_cascade", QUALITY_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cascade(docs, order_rules(docs)).drop("failed_rule")


@_register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = token_folder(docs)
    # The vocabulary's 49,408 ids fit into two bytes; the digests are of four-byte ids all the same.
    return read_token_files(write_token_files(docs, folder, _vocabulary(), width=2), folder, width=2)


@_register("op9_langid")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = language_dictionaries(docs, fold_of(F.col("doc_id")) != 0)
    return identify(docs, dictionaries).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "accepted"
    )


@_register("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id")) != 0).select("doc_id", "toxic")
    model = fit_toxicity(docs.select("doc_id", "text").join(labels, "doc_id"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_register("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts ON parts.x = v.vec_id LEFT JOIN degree ON degree.x = v.vec_id
"""


@_register("op2_embedding_dedup", EMBEDDINGS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


# The tables hold neither fetch dates nor a list, so both are derived from the captures themselves: the date from
# page_id, the entries from the hosts and first path segments by md5.
URL_SQL = r"""
WITH c AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1)), '\.+$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
names AS (
  SELECT host AS key FROM c WHERE host <> ''
  UNION SELECT host || '/' || split_part(path, '/', 2) FROM c WHERE host <> '' AND split_part(path, '/', 2) <> ''),
hashed AS (
  SELECT key, CAST('0x' || substr(md5(key || '#' || n), 1, 6) AS BIGINT) AS h FROM names, (VALUES (0), (1), (2), (3)) t(n)),
entries AS (
  SELECT key, CAST(DATE '2023-12-01' + CAST(h % 400 AS INTEGER) AS DATE) AS since, CASE WHEN h % 3 = 0 THEN 'allow' ELSE 'block' END AS action
  FROM hashed WHERE h % 5 < 2),
dated AS (SELECT key, since, max(action) AS action FROM entries GROUP BY key, since),
spans AS (SELECT key, since, action, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM dated),
asked AS (
  SELECT DISTINCT page_id, url, fetched, key FROM (
    SELECT page_id, url, fetched, unnest(list_transform(range(1, CASE WHEN host[1] = '[' THEN 2 ELSE len(string_split(host, '.')) + 1 END), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS key
    FROM c WHERE host <> ''
    UNION ALL
    SELECT page_id, url, fetched, unnest(list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/')))
    FROM c WHERE host <> '')),
best AS (
  SELECT page_id, url, fetched, max({'n': length(key), 'key': key, 'since': since}) AS b
  FROM asked JOIN spans USING (key)
  WHERE action = 'block' AND since <= fetched AND (until IS NULL OR fetched < until) GROUP BY ALL)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, b IS NOT NULL AS blocked, b.key AS rule, CAST(b.since AS VARCHAR) AS listed_since
FROM c LEFT JOIN best USING (page_id, url, fetched)
"""


@_register("op4_url_filter", URL_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    host, part = host_of(F.col("url")), F.split_part(path_of(F.col("url")), F.lit("/"), F.lit(2))
    names = (
        pages.where(host != "")
        .select(F.explode(F.array(host, F.when(part != "", F.concat_ws("/", host, part)))).alias("key"))
        .where("key IS NOT NULL").distinct()
    )
    h = F.conv(F.substring(F.md5(F.concat_ws("#", "key", "n")), 1, 6), 16, 10).cast("long")
    entries = (
        names.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("h", h).where("h % 5 < 2")
        .select(
            "key", F.date_add(F.lit("2023-12-01").cast("date"), F.pmod("h", F.lit(400)).cast("int")).alias("since"),
            F.when(F.col("h") % 3 == 0, "allow").otherwise("block").alias("action"),
        )
    )
    # Dates as text, so that the two engines' results compare by value.
    found = filter_captures(captures, entries)
    return found.withColumn("fetched", F.col("fetched").cast("string")).withColumn("listed_since", F.col("listed_since").cast("string"))


@_register("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = score_documents(docs, fold_of(F.col("doc_id")) != 1)
    return found.select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, w[i : i + m - 1] AS g
  FROM w, LATERAL (SELECT unnest(range(1, 6)) AS m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
f AS (SELECT lang, g, count(*)::HUGEINT AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
longer AS (
  SELECT DISTINCT lang, g[s : s + m - 1] AS g, a
  FROM f, LATERAL (SELECT unnest(range(2, len(g))) AS m), LATERAL (SELECT unnest(range(1, len(g) - m + 2)) AS s)),
alone AS (SELECT * FROM f WHERE len(g) > 1 AND NOT EXISTS (SELECT 1 FROM longer l WHERE l.lang = f.lang AND l.g = f.g AND 100 * l.a >= 100 * f.a)),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM alone),
scored AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score
  FROM cuts c JOIN totals USING (lang) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM worst)
WHERE rank <= 2000
"""


@_register("op11_phrases", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents")).drop("k")


@_register("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"), _vocabulary(BYTE_VOCABULARY), _vocabulary(PIECE_MODEL), marks=("|", ";"))


@_register("op13_attention_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", "quality")
    return score_attention(docs, fit_attention(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_passages", "top_passage", "top_weight",
    )
