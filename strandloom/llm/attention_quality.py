"""Quality classifier: gated attention over passages, learned from labels of whole documents (multiple-instance learning).

A text is a bag of passages of PASSAGE_WORDS words. A passage is described by rates of letters, marks and shapes of its words
and by how much of it repeats earlier words, word pairs and lines of its document. An encoder (one layer) represents each
passage; gated attention (Ilse et al., 2018) gives each a weight, a = softmax(w (tanh(V h) * sigmoid(U h))); the document's
score is the logistic of the weighted sum of representations. Encoder, gates and output are learned together.

Fitting takes at most about ``fit_rows`` labelled rows, drawn by a hash, and of a text longer than ``fit_passages`` passages as
many of them, evenly spread. The rows are dealt into SHARDS fixed shards; in each round a task a shard takes Adam steps
from the common parameters, and the round's parameters are their mean. The driver sees parameters only. Scoring
reads every passage of every text in one pass, without a shuffle.

Defined cases: a null, empty or blank text is one passage without words; rows whose label is null or not 0 or 1 are not
learned; without a learned row every score is 0.5; with one class only the model learns that class; repeated rows repeat
their result; an empty table gives an empty result; other columns pass through unread where asked for.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import map_columns, materialise, ship_package, texts_of

PASSAGE_WORDS = 64
#: Labelled rows that the model is fitted on, about, and passages of one of their texts, at most.
FIT_ROWS, FIT_PASSAGES = 20_000, 256
#: Shards of the labelled rows, rounds of averaging, and steps of one shard in a round.
SHARDS, ROUNDS, STEPS, BATCH = 8, 5, 160, 64
#: Sizes of the representation, of the gates, and buckets of word shapes.
HIDDEN, GATES, SHAPES = 24, 12, 24
RATE, DECAY = 0.01, 1e-4

_SYMBOL = re.compile(r"[#*$%&|<>]")
_RUN = re.compile(r"(.)\1{3}")
_PLACE = re.compile(r"://|@|www\.")
_CLASSES = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+"))
N_WORD = 16
#: Features of a passage: means over its words, shape rates, four repetition rates, share of distinct words, line ends, words, document words.
N_FEATURES = N_WORD + SHAPES + 8


def shape(word: str) -> str:
    """Letters as a (A where the first is upper case), digits as 0, other characters as they are, runs as one."""
    letters = _CLASSES[0].sub(lambda m: "A" if m[0][0].isupper() else "a", word[:64])
    return _CLASSES[2].sub(r"\1", _CLASSES[1].sub("0", letters))


@functools.lru_cache(maxsize=100_000)
def bucket(shaped: str) -> int:
    return zlib.crc32(shaped.encode("utf-8", "surrogatepass")) % SHAPES


def describe(word: str) -> tuple[list[float], int]:
    """Numbers of one word, and the bucket of its shape."""
    n = len(word)
    last = word[-1]
    mark = last in ".!?,;:"
    if n <= 64 and (word[:-1] if mark and n > 1 else word).isalpha():
        # Letters alone, perhaps with a mark behind them: the same numbers by fewer steps.
        letters = n - mark
        upper = 0 if word.islower() else sum(map(str.isupper, word))
        return [
            min(n, 40) / 8, letters / n, 0.0, upper / n, 0.0, mark / n, float(not word.isascii()), float(word[0].isupper()), float(upper == letters > 1),
            float(last in ".!?"), float(last in ",;:"), 0.0, 0.0, float(n > 20), float(bool(_RUN.search(word))), float("www." in word),
        ], bucket(("A" if word[0].isupper() else "a") + last * mark)
    letters, digits, upper, symbols = sum(map(str.isalpha, word)), sum(map(str.isdigit, word)), sum(map(str.isupper, word)), len(_SYMBOL.findall(word))
    other = n - letters - digits - symbols
    return [
        min(n, 40) / 8, letters / n, digits / n, upper / n, symbols / n, other / n, float(not word.isascii()), float(word[0].isupper()),
        float(upper == letters > 1), float(word[-1] in ".!?"), float(word[-1] in ",;:"), float(letters + digits == 0), float(letters > 0 < symbols),
        float(n > 20), float(bool(_RUN.search(word))), float(bool(_PLACE.search(word))),
    ], bucket(shape(word))


class Words:
    """Descriptions of the words that a task has met."""

    LIMIT = 200_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[list[float]] = []
        self.buckets: list[int] = []
        self.matrix = np.zeros((0, N_WORD))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Places of the words in ``table``."""
        for w in dict.fromkeys(words):
            if w not in self.at:
                row, bucket = describe(w)
                self.at[w] = len(self.rows)
                self.rows.append(row)
                self.buckets.append(bucket)
        return np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.matrix) < len(self.rows):
            self.matrix = np.concatenate([self.matrix, np.array(self.rows[len(self.matrix) :])])
        return self.matrix, np.array(self.buckets, dtype=np.int64)


def _seen_before(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same owner has the same value at a smaller place."""
    out = np.ones(len(value), dtype=bool)
    out[np.unique(owner * (int(value.max(initial=0)) + 1) + value, return_index=True)[1]] = False
    return out


def passages(texts: Sequence[str], memo: Words) -> tuple[np.ndarray, np.ndarray]:
    """(one row of features a passage, passages of each text)."""
    if len(memo.at) > memo.LIMIT:
        memo.clear()
    words: list[str] = []
    line_words: list[int] = []
    line_seen: list[bool] = []
    sizes = []
    for text in texts:
        before, seen = len(words), set()
        for line in text.split("\n"):
            own = line.split()
            if own:
                line_words.append(len(own))
                line_seen.append(line in seen)
                seen.add(line)
                words += own
        sizes.append(len(words) - before)
    n = np.array(sizes, dtype=np.int64)
    bags = np.maximum(-(-n // PASSAGE_WORDS), 1)
    out = np.zeros((int(bags.sum()), N_FEATURES))
    first = np.cumsum(bags) - bags
    if not words:
        return out, bags
    number = memo.numbers(words)
    matrix, buckets = memo.table()
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    passage = first[doc] + place // PASSAGE_WORDS
    filled = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    rows = passage[filled]
    count = np.diff(np.append(filled, len(words))).astype(float)
    out[rows, :N_WORD] = np.add.reduceat(matrix[number], filled, axis=0) / count[:, None]
    shapes = np.bincount(passage * SHAPES + buckets[number], minlength=len(out) * SHAPES).reshape(-1, SHAPES)
    out[rows, N_WORD : N_WORD + SHAPES] = shapes[rows] / count[:, None]
    previous = np.where(place > 0, np.concatenate([[0], number[:-1]]), -1)
    _, pair = np.unique(previous * np.int64(len(matrix)) + number, return_inverse=True)
    lines = np.array(line_words)
    flags = np.stack([
        previous == number, _seen_before(doc, number), _seen_before(doc, pair), np.repeat(np.array(line_seen), lines), ~_seen_before(passage, number),
    ], axis=1)
    out[rows, N_WORD + SHAPES : N_WORD + SHAPES + 5] = np.add.reduceat(flags.astype(float), filled, axis=0) / count[:, None]
    ends = np.bincount(passage[np.cumsum(lines) - 1], minlength=len(out))
    out[rows, -3] = ends[rows] / count
    out[rows, -2] = count / PASSAGE_WORDS
    out[:, -1] = np.repeat(np.log1p(n), bags) / 4
    return out, bags


def initial(width: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda i, o: rng.normal(0, 1 / math.sqrt(i), (i, o))
    return {"W": draw(width, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)}


def forward(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    """Representations, attention and logits of bags of passages, one bag after another."""
    starts, owner = np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (v * u) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a /= np.add.reduceat(a, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"owner": owner, "starts": starts, "h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the bags."""
    f = forward(p, x, bags)
    owner, a, h, v, u = (f[k] for k in ("owner", "a", "h", "v", "u"))
    g = (1 / (1 + np.exp(-f["logit"])) - label) / len(bags)
    to_z = g[:, None] * p["c"]
    along = (h * to_z[owner]).sum(axis=1)
    to_e = a * (along - np.add.reduceat(a * along, f["starts"])[owner])
    to_v, to_u = to_e[:, None] * p["w"] * u * (1 - v * v), to_e[:, None] * p["w"] * v * u * (1 - u)
    to_h = (a[:, None] * to_z[owner] + to_v @ p["V"].T + to_u @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ to_h, "b": to_h.sum(axis=0), "V": h.T @ to_v, "U": h.T @ to_u, "w": (v * u).T @ to_e, "c": f["z"].T @ g, "d": np.array([g.sum()])}


def improve(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, label: np.ndarray, steps: int, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Adam steps on drawn batches of bags, from the parameters ``p``."""
    rng, starts = np.random.default_rng(seed), np.cumsum(bags) - bags
    p = {k: v.copy() for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        chosen = rng.permutation(len(bags))[:BATCH]
        n = bags[chosen]
        at = np.arange(int(n.sum())) + np.repeat(starts[chosen] - (np.cumsum(n) - n), n)
        for k, g in gradients(p, x[at], n, label[chosen]).items():
            g = g + DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return p


@dataclass
class AttentionModel:
    """Parameters after scaling of the features; ``parameters`` is None where nothing was learned."""

    centre: np.ndarray
    spread: np.ndarray
    parameters: dict[str, np.ndarray] | None

    def score(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, passage with the highest weight, its weight) of every bag."""
        f = forward(self.parameters, (x - self.centre) / self.spread, bags)
        best = np.maximum.reduceat(f["a"], f["starts"])
        top = np.lexsort((np.arange(len(x)), -f["a"], f["owner"]))[f["starts"]] - f["starts"]
        return 1 / (1 + np.exp(-f["logit"])), top, best


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def fit_attention(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_rows: int = FIT_ROWS, fit_passages: int = FIT_PASSAGES, rounds: int = ROUNDS, steps: int = STEPS,
) -> AttentionModel:
    """Fit on the texts of ``docs`` that ``labels(id, label)`` marks."""
    spark = docs.sparkSession
    ship_package(spark)
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    total = usable.count()
    whole = 1 << 62
    draw = F.pmod(F.xxhash64("id", F.lit("attention")), F.lit(whole))
    marked = usable.where(draw < F.lit(min(whole, whole * fit_rows // max(total, 1))))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = named.join(F.broadcast(marked), "id")  # about fit_rows labels at most
    task: dict[str, Words] = {}

    def bag(texts: pa.Array) -> list[pa.Array]:
        out = []
        for text in texts_of(texts):
            x, n = passages([text], task.setdefault("words", Words()))
            if n[0] > fit_passages:
                x = x[np.linspace(0, n[0] - 1, fit_passages).astype(int)]
            out.append(x.ravel())
        return [pa.array(out, pa.list_(pa.float64()))]

    made = map_columns(rows, bag, [T.StructField("x", T.ArrayType(T.DoubleType()))], ["text"], ["id", "label"])
    order = F.xxhash64("id", "x")
    bags = materialise(made.withColumn("order", order).withColumn("shard", F.pmod("order", F.lit(SHARDS)).cast("int")), "bags")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, N_FEATURES))
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
            sums += np.stack([np.full(N_FEATURES, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"j": list(range(N_FEATURES)), "n": sums[0], "s": sums[1], "q": sums[2]})

    parts = bags.select("x").mapInArrow(moments, "j long, n double, s double, q double").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    found = np.array([(r.n, r.s, r.q) for r in parts.orderBy("j").collect()]).reshape(-1, 3)  # one row a feature
    if not len(found) or not found[0, 0]:
        return AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), None)
    centre = found[:, 1] / found[:, 0]
    spread = np.sqrt(np.maximum(found[:, 2] / found[:, 0] - centre**2, 0))
    spread[spread < 1e-6] = 1.0
    current = initial(N_FEATURES)
    for r in range(rounds):
        like, rate = current, RATE * (1.0 if r < rounds - 1 else 0.3)

        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by([("order", "ascending"), ("label", "ascending")])
            x = table.column("x").combine_chunks()
            sizes = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // N_FEATURES
            scaled = (x.flatten().to_numpy().reshape(-1, N_FEATURES) - centre) / spread
            label = table.column("label").to_numpy().astype(float)
            better = improve(like, scaled, sizes, label, steps, rate, table.column("shard")[0].as_py() + 1000 * r)
            flat = _flat(better)
            return pa.table({"j": np.arange(len(flat)), "v": flat, "n": np.full(len(flat), float(len(sizes)))})

        # One number a parameter, whatever the rows.
        mean = bags.groupBy("shard").applyInArrow(learn, "j long, v double, n double").groupBy("j").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).orderBy("j").toArrow()
        current = _shaped(mean.column("v").to_numpy(), current)
    return AttentionModel(centre, spread, current)


def score_attention(
    docs: DataFrame, model: AttentionModel, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
    names: Sequence[str] = ("score", "n_passages", "top_passage", "top_weight"),
) -> DataFrame:
    """Append the score of every whole text, its passages, and the first passage with the highest weight (from 0) with it."""
    kinds = (T.DoubleType(), T.LongType(), T.LongType(), T.DoubleType())
    task: dict[str, Words] = {}  # filled in the worker, so that a task's slices share one memo

    def run(texts: pa.Array) -> list[pa.Array]:
        x, bags = passages(texts_of(texts), task.setdefault("words", Words()))
        if model.parameters is None:
            score, top, best = np.full(len(bags), 0.5), np.zeros(len(bags), dtype=np.int64), 1 / bags
        else:
            score, top, best = model.score(x, bags) if len(bags) else (np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0))
        return [pa.array(score), pa.array(bags), pa.array(top), pa.array(best)]

    return map_columns(docs, run, [T.StructField(n, k) for n, k in zip(names, kinds)], [text_col], list(keep))
