"""Boosted regression trees by second-order histograms (ML-08, ML-09, ML-10, ML-16), and exact path attribution (ML-25).

A column's values are cut at exact quantiles into at most ``bins`` bins; the rows' bin codes are written once, a byte a column.
A level of all trees under construction costs one aggregation of (member, column, node, bin) sums of gradients and
weights: tasks add them up over their rows, one row a member and column is shuffled, and the task that has a column's sums
finds its best cut, so the driver sees one row a node. Members, which are pairs of a held-out fold and a seed, grow together, so
five folds of five seeds need no more jobs than one. Members are taken in groups whose sums fit into HELD_BYTES.

The rows' predictions so far are written every ``refresh`` trees; the trees since then are applied again where they are
needed, so a job reads codes, labels and predictions and never a long lineage. Dropout boosting changes the weights of earlier
trees, so there the rows' leaves are written instead, a byte a tree.

Where the training rows of a member fit into INSIDE_BYTES, one task a member grows all its trees from the same draws and the same
cuts, and a fit is one job instead of one a level: a job's start would cost more than its sums.

NULL and NaN have a bin of their own, sent to the side that gains more. Objectives: squared error, and Huber's loss, whose
gradient is cut at ``delta``. With ``drop`` above 0 earlier trees are dropped at random while a tree is grown and both are
scaled back (dropout boosting). Draws of rows are hashes of the key, of columns and trees seeded numpy draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators.ordering import quantile_cuts
from strandloom.sources.workspace import stored

#: Bytes of gradient sums that a task holds, about; rows taken at once.
HELD_BYTES, SLICE_ROWS = 256 << 20, 8192
#: Bytes that a member's training rows take up to which one task grows its trees; partitions that members are dealt into at least.
INSIDE_BYTES, DEALT = 320 << 20, 64


@dataclass
class Trees:
    """Trees as arrays of the same shape, one row a tree: node i has the children 2 i + 1 and 2 i + 2, a leaf the column -1.

    A row goes left where its value is at most ``threshold`` (in bin codes: ``code``), or is missing and ``missing_left``.
    """

    column: np.ndarray
    code: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, n: int, depth: int) -> Trees:
        size = (n, (1 << depth + 1) - 1)
        whole, real = np.full(size, -1, dtype=np.int32), np.zeros(size)
        return cls(whole, np.zeros(size, dtype=np.int32), real.copy(), np.zeros(size, dtype=bool), real.copy(), real.copy(), real.copy())

    @property
    def node_type(self) -> np.dtype:
        """The least type that holds every node."""
        return np.min_scalar_type(self.column.shape[1])

    def below(self, codes: np.ndarray, t: int, node: np.ndarray) -> np.ndarray:
        """Next node of tree ``t`` for every row of bin codes (0: missing); a leaf stays."""
        c = self.column[t, node]
        own = codes[np.arange(len(codes)), np.maximum(c, 0)]
        left = np.where(own == 0, self.missing_left[t, node], own <= self.code[t, node])
        return np.where(c < 0, node, 2 * node + 2 - left)

    def leaves(self, codes: np.ndarray, t: int) -> np.ndarray:
        """Leaf of tree ``t`` for every row of bin codes (0: missing)."""
        node = np.zeros(len(codes), dtype=np.int64)
        for _ in range(int(math.log2(self.column.shape[1] + 1)) - 1):
            node = self.below(codes, t, node)
        return node


@dataclass
class Member:
    """One model: fitted outside ``fold`` (None: on all rows) with ``seed``, over ``columns``."""

    fold: int | None
    seed: int
    columns: np.ndarray
    base: float
    trees: Trees
    scale: np.ndarray
    rng: np.random.Generator
    grown: int = 0
    dropped: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def margins(self, codes: np.ndarray, since: int, without: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(codes))
        gone = set() if without is None else set(without.tolist())
        for t in range(since, self.grown):
            if t not in gone:
                out += self.scale[t] * self.trees.value[t, self.trees.leaves(codes, t)]
        return out

    def drawn(self, t: int, column_share: float, drop: float) -> np.ndarray:
        """Columns that tree ``t`` may cut; draws the trees dropped meanwhile."""
        k = max(1, round(column_share * len(self.columns))) if len(self.columns) else 0
        taken = np.sort(self.rng.choice(self.columns, size=k, replace=False))
        self.dropped = np.flatnonzero(self.rng.random(t) < drop) if drop else self.dropped
        return taken

    def put(self, t: int, node: int, cut: tuple[int, float, int, bool, float, float], cuts: list[np.ndarray], rate: float, l2: float) -> bool:
        """Writes a node from its best cut (column, gain, bin, missing left) and its sums g and h; whether it is cut."""
        pos, gain, at, left, g, h = cut
        tree = self.trees
        if h <= 0:
            return False
        tree.cover[t, node], tree.value[t, node] = h, -rate * g / (h + l2)
        if gain <= 0:
            return False
        tree.column[t, node], tree.code[t, node], tree.missing_left[t, node], tree.gain[t, node] = pos, at, left, gain
        tree.threshold[t, node] = cuts[pos][at - 1] if at <= len(cuts[pos]) else np.inf
        return True

    def closed(self, t: int) -> None:
        """Tree ``t`` is grown; in dropout boosting it and those dropped share their sum."""
        self.grown = t + 1
        if len(self.dropped):
            k = len(self.dropped)
            self.scale[t], self.scale[self.dropped] = 1 / (k + 1), self.scale[self.dropped] * k / (k + 1)
            self.dropped = self.dropped[:0]


@dataclass
class Boosted:
    """Fitted members and the cuts between the bins of each column."""

    cuts: list[np.ndarray]
    members: list[Member]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1 of a matrix of values, 0 where a value is missing."""
        out = np.zeros(x.shape, dtype=np.uint8)
        for j, cut in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cut, x[:, j], side="left") + 1)
        return out

    def gains(self, kind: str = "average") -> np.ndarray:
        """Gain of each column over all members (ML-26): average of its cuts, or their total, as shares of the sum."""
        total, used = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for m in self.members:
            inner = m.trees.column[: m.grown] >= 0
            np.add.at(total, m.trees.column[: m.grown][inner], m.trees.gain[: m.grown][inner])
            np.add.at(used, m.trees.column[: m.grown][inner], 1)
        found = total / np.maximum(used, 1) if kind == "average" else total
        return found / found.sum() if found.sum() > 0 else found


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; NULL and rows of another length are NaN throughout."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out, ends = np.full((len(lengths), width), np.nan), np.cumsum(lengths)
    for i in np.flatnonzero(lengths == width):
        out[i] = flat[ends[i] - width : ends[i]]
    return out


def bin_cuts(df: DataFrame, bins: int = 64) -> list[np.ndarray]:
    """Ascending cuts of every column of ``features``: the exact quantiles between equal shares of its values."""
    width = df.select(F.max(F.size("features"))).first()[0] or 0
    tidy = df.select(F.posexplode("features").alias("pos", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found: list[list[float]] = [[] for _ in range(width)]
    # At most ``bins`` rows a column.
    for r in quantile_cuts(tidy, "v", bins, ["pos"]).collect():
        found[r.pos].append(r.cut)
    return [np.array(sorted(f)) for f in found]


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in 0..1 of the rows' hashes and a seed (the finaliser of SplitMix64)."""
    x = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) / 2.0**64


def best_cuts(sums: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, bin, missing goes left, weight to the left) of each node's best cut of one column.

    ``sums`` is (2, nodes, bins + 1): gradients and weights, missing values first; gain is -inf where no cut leaves both
    sides ``least`` weight.
    """
    g, h = sums
    G, H = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    score = lambda a, b: a * a / (b + l2)
    out = None
    for left in (False, True):
        gl, hl = np.cumsum(g[:, 1:], axis=1)[:, :-1], np.cumsum(h[:, 1:], axis=1)[:, :-1]
        if left:
            gl, hl = gl + g[:, :1], hl + h[:, :1]
        ok = (hl >= least) & (H - hl >= least) & (hl > 0) & (H - hl > 0)
        gain = np.where(ok, 0.5 * (score(gl, np.maximum(hl, 1e-300)) + score(G - gl, np.maximum(H - hl, 1e-300)) - score(G, np.maximum(H, 1e-300))), -np.inf)
        gain = gain.astype(np.float32).astype(np.float64)  # sums come in any order: equal cuts must tie
        at = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(g), dtype=np.int64)
        rows = np.arange(len(g))
        top = gain[rows, at] if gain.shape[1] else np.full(len(g), -np.inf)
        new = (top, at + 1, np.full(len(g), left))
        out = new if out is None else tuple(np.where(new[0] > out[0], a, b) for a, b in zip(new, out))
    return out


def fit_boosted(
    df: DataFrame, folds: Sequence[int | None] = (None,), seeds: Sequence[int] = (0,), trees: int = 400, depth: int = 4, rate: float = 0.05,
    row_share: float = 0.8, column_share: float = 0.8, l2: float = 1.0, least: float = 1.0, bins: int = 64, objective: str = "squared",
    delta: float = 1.0, drop: float = 0.0, columns: Mapping[tuple[int | None, int], Sequence[int]] | None = None, refresh: int = 25,
) -> Boosted:
    """Members for every fold and seed from rows (key, fold, label, features array<double>).

    A member never sees rows of its fold, whose values enter the bins' cuts only. ``columns`` may restrict a member.
    """
    if not 2 <= bins <= 254 or objective not in ("squared", "huber"):
        raise ValueError("bins from 2 to 254; objective squared or huber")
    model = Boosted(bin_cuts(df, bins), [])
    width = len(model.cuts)
    size = max((len(c) for c in model.cuts), default=0) + 2
    cuts = model

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = cuts.codes(matrix(batch.column("features"), width))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("label"), batch.column("h"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["fold", "label", "h", "codes"])

    named = df.where("label IS NOT NULL AND features IS NOT NULL").select(
        F.coalesce(F.col("fold").cast("long"), F.lit(-1)).alias("fold"), F.col("label").cast("double").alias("label"), F.xxhash64("key").alias("h"), "features"
    )
    rows = stored(named.mapInArrow(coded, "fold long, label double, h long, codes binary"), "boosting-codes")
    means = {r.fold: (r.n, r.s) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()}  # one row a fold
    for f in folds:
        n, s = (sum(v[i] for k, v in means.items() if k != f) for i in (0, 1))
        for seed in seeds:
            chosen = np.arange(width) if columns is None else np.array(sorted(columns[f, seed]), dtype=np.int64)
            rng = np.random.default_rng([seed, 0 if f is None else f + 1])
            model.members.append(Member(f, seed, chosen, s / n if n else 0.0, Trees.empty(trees, depth), np.ones(trees), rng))
    # Codes as they come, in order and by column; sixteen numbers; leaves where trees are dropped.
    row_bytes = 3 * width + 128 + (trees * Trees.empty(0, depth).node_type.itemsize if drop else 0)
    if max((sum(v[0] for k, v in means.items() if k != f) for f in folds), default=0) * row_bytes <= INSIDE_BYTES:
        _grow_inside(rows, model.members, model.cuts, trees, depth, rate, row_share, column_share, l2, least, objective, delta, drop)
        return model
    held = max(1, HELD_BYTES // max(width * (1 << depth - 1) * size * 16, 1))
    for at in range(0, len(model.members), held):
        _grow(rows, model.members[at : at + held], model.cuts, trees, depth, rate, row_share, column_share, l2, least, objective, delta, drop, refresh)
    return model


def _grow_inside(rows: DataFrame, members: list[Member], cuts, trees, depth, rate, row_share, column_share, l2, least, objective, delta, drop) -> None:
    """Grows all trees of a member in the task that holds its training rows."""
    if not members:
        return
    width, bins = len(cuts), max((len(c) for c in cuts), default=0) + 2
    parts = ("column", "code", "threshold", "missing_left", "value", "cover", "gain")

    def grow(group: pa.Table) -> pa.Table:
        which = group.column("member")[0].as_py()
        m = members[which]
        h, label = (group.column(c).to_numpy() for c in ("h", "label"))
        order = np.lexsort((label, h))  # sums do not depend on how rows were dealt
        h, label = h[order], label[order]
        flat, at = np.empty((len(order), width), dtype=np.uint8), 0
        for chunk in group.column("codes").chunks:
            flat[at : at + len(chunk)] = np.frombuffer(b"".join(chunk.to_pylist()), dtype=np.uint8).reshape(len(chunk), width)
            at += len(chunk)
        codes = np.ascontiguousarray(flat[order].T)
        del flat
        margin, tree = np.full(len(label), m.base), m.trees
        kept = np.empty((trees, len(label)), dtype=tree.node_type) if drop else None
        for t in range(trees):
            taken = m.drawn(t, column_share, drop)
            k = len(m.dropped)
            gone = sum((m.scale[d] * tree.value[d, kept[d]] for d in m.dropped.tolist()), np.zeros(len(label))) if k else 0.0
            margin = margin - gone
            g = margin - label
            g = np.clip(g, -delta, delta) if objective == "huber" else g
            node, drawn = np.zeros(len(label), dtype=np.int64), _uniform(h, m.seed * 1_000_003 + t) < row_share
            for level in range(depth + 1):
                first, nodes = (1 << level) - 1, 1 << level
                active = np.flatnonzero((node >= first) & drawn)
                place, weights = node[active] - first, g[active]
                if level == depth:
                    sums = np.stack([np.bincount(place, weights=weights, minlength=nodes), np.bincount(place, minlength=nodes)])
                    for i in range(nodes):
                        m.put(t, first + i, (-1, -np.inf, 0, False, *sums[:, i].tolist()), cuts, rate, l2)
                    break
                if not len(taken):
                    break
                total, whole = np.empty((2, len(taken), nodes, bins)), len(active) == len(label)
                for i, j in enumerate(taken.tolist()):
                    at = place * bins + (codes[j] if whole else codes[j, active])
                    total[0, i] = np.bincount(at, weights=weights, minlength=nodes * bins).reshape(nodes, bins)
                    total[1, i] = np.bincount(at, minlength=nodes * bins).reshape(nodes, bins)
                gain, at, left = (a.reshape(len(taken), nodes) for a in best_cuts(total.reshape(2, -1, bins), l2, least))
                own, grew = total.sum(axis=3), False
                for i, b in enumerate(gain.argmax(axis=0).tolist()):  # of equal gains the first column
                    grew |= m.put(t, first + i, (int(taken[b]), float(gain[b, i]), int(at[b, i]), bool(left[b, i]), *own[:, b, i].tolist()), cuts, rate, l2)
                if not grew:
                    break
                node = tree.below(codes.T, t, node)
            m.closed(t)
            margin = margin + (gone * (k / (k + 1)) if k else 0.0) + m.scale[t] * tree.value[t, node]
            if drop:
                kept[t] = node
        found = {c: getattr(tree, c) for c in parts} | {"scale": m.scale}
        return pa.table({"member": pa.array([which] * len(found), pa.int32()), "part": list(found), "data": pa.array([a.tobytes() for a in found.values()], pa.binary())})

    held = F.array(*[F.struct(F.lit(i).alias("member"), F.lit(m.fold).cast("long").alias("held")) for i, m in enumerate(members)])
    seen = F.filter(held, lambda m: m["held"].isNull() | (m["held"] != F.col("fold")))
    dealt = rows.select(F.explode(seen["member"]).alias("member"), "label", "h", "codes").repartition(max(DEALT, len(members)), "member")
    for r in dealt.groupBy("member").applyInArrow(grow, "member int, part string, data binary").collect():  # trees, whatever the rows
        m = members[r.member]
        old = m.scale if r.part == "scale" else getattr(m.trees, r.part)
        old[:] = np.frombuffer(r.data, dtype=old.dtype).reshape(old.shape)
    for m in members:
        m.grown = trees


def _margins(batch: pa.RecordBatch, codes: np.ndarray, members: Sequence[Member], since: int) -> np.ndarray:
    """One row a member: what it predicts so far, without the trees dropped at the moment."""
    if since and "leaves" in batch.schema.names:
        leaves, out = _leaves(batch, members), []
        for k, m in enumerate(members):
            weight = m.scale[:since].copy()
            weight[m.dropped[m.dropped < since]] = 0.0
            values = weight[:, None] * m.trees.value[:since]
            out.append(m.base + values[np.arange(since), leaves[:, k]].sum(axis=1) + m.margins(codes, since, m.dropped))
        return np.stack(out)
    known = np.frombuffer(b"".join(batch.column("margins").to_pylist()), dtype="<f8").reshape(len(codes), -1).T if since else np.array([[m.base] for m in members]) + np.zeros(len(codes))
    return np.stack([k + m.margins(codes, since, m.dropped) for k, m in zip(known, members)])


def _leaves(batch: pa.RecordBatch, members: Sequence[Member]) -> np.ndarray:
    """Rows by members by trees: the leaves written so far."""
    return np.frombuffer(b"".join(batch.column("leaves").to_pylist()), dtype=members[0].trees.node_type).reshape(batch.num_rows, len(members), -1)


def _grow(rows: DataFrame, members: list[Member], cuts, trees, depth, rate, row_share, column_share, l2, least, objective, delta, drop, refresh) -> None:
    width, since, table = len(cuts), 0, rows
    bins = max((len(c) for c in cuts), default=0) + 2
    for t in range(trees):
        taken = [m.drawn(t, column_share, drop) for m in members]
        for level in range(depth + 1):
            first, nodes = (1 << level) - 1, 1 << level
            begun, last = since, level == depth

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = [np.zeros((2, len(c), nodes, bins)) if not last else np.zeros((2, 1, nodes, 1)) for c in taken]
                for whole in batches:
                    for s in range(0, whole.num_rows, SLICE_ROWS):
                        batch = whole.slice(s, SLICE_ROWS)
                        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
                        label, fold, h = (batch.column(c).to_numpy() for c in ("label", "fold", "h"))
                        for m, c, own, margin in zip(members, taken, held, _margins(batch, codes, members, begun)):
                            node = m.trees.leaves(codes, t) - first
                            active = np.flatnonzero((node >= 0) & (fold != (m.fold if m.fold is not None else -2)) & (_uniform(h, m.seed * 1_000_003 + t) < row_share))
                            g = margin[active] - label[active]
                            g = np.clip(g, -delta, delta) if objective == "huber" else g
                            place = node[active]
                            if last:
                                own[0, 0, :, 0] += np.bincount(place, weights=g, minlength=nodes)
                                own[1, 0, :, 0] += np.bincount(place, minlength=nodes)
                                continue
                            for i, j in enumerate(c.tolist()):
                                at = place * bins + codes[active, j]
                                own[0, i] += np.bincount(at, weights=g, minlength=nodes * bins).reshape(nodes, bins)
                                own[1, i] += np.bincount(at, minlength=nodes * bins).reshape(nodes, bins)
                parts = [(k, int(j), own[:, i].tobytes()) for k, (c, own) in enumerate(zip(taken, held)) for i, j in enumerate([-1] if last else c.tolist())]
                yield pa.RecordBatch.from_pydict({"member": pa.array([p[0] for p in parts], pa.int32()), "pos": pa.array([p[1] for p in parts], pa.int32()), "sums": pa.array([p[2] for p in parts], pa.binary())})

            def cut(group: pa.Table) -> pa.Table:
                total = sum(np.frombuffer(b, dtype="<f8").reshape(2, nodes, -1) for b in group.column("sums").to_pylist())
                g, h = total.sum(axis=2)
                gain, at, left = (np.full(nodes, -np.inf), np.zeros(nodes), np.zeros(nodes, dtype=bool)) if last else best_cuts(total, l2, least)
                same = {c: pa.array([group.column(c)[0].as_py()] * nodes, pa.int32()) for c in ("member", "pos")}
                return pa.table(same | {"node": pa.array(np.arange(nodes), pa.int32()), "gain": gain, "bin": pa.array(at, pa.int32()), "left": left, "g": g, "h": h})

            found = table.mapInArrow(sums, "member int, pos int, sums binary").groupBy("member", "pos").applyInArrow(cut, "member int, pos int, node int, gain double, bin int, left boolean, g double, h double")
            # One row a member and node; of equal gains the first column.
            best = found.groupBy("member", "node").agg(F.max_by(F.struct("pos", "gain", "bin", "left", "g", "h"), F.struct("gain", -F.col("pos"))).alias("b")).select("member", "node", "b.*").collect()
            grew = False
            for r in best:
                grew |= members[r.member].put(t, first + r.node, (r.pos, r.gain, r.bin, r.left, r.g, r.h), cuts, rate, l2)
            if not grew:
                break
        for m in members:
            m.closed(t)
        if (t + 1) % refresh == 0 and t + 1 < trees:
            begun, grown, kept = since, t + 1, "leaves" if drop else "margins"

            def refreshed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
                    if drop:
                        new = np.stack([np.stack([m.trees.leaves(codes, i) for i in range(begun, grown)], axis=1) for m in members], axis=1).astype(members[0].trees.node_type)
                        known = np.concatenate([_leaves(batch, members), new], axis=2) if begun else new
                    else:
                        known = np.ascontiguousarray(_margins(batch, codes, members, begun).T)
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fold", "label", "h", "codes")] + [pa.array([x.tobytes() for x in known], pa.binary())], names=["fold", "label", "h", "codes", kept])

            table, since = stored(table.mapInArrow(refreshed, f"fold long, label double, h long, codes binary, {kept} binary"), "boosting-margins"), t + 1


def boosted_predictions(df: DataFrame, model: Boosted) -> DataFrame:
    """(key, fold, label, seed, prediction): every row by the members that did not see its fold (ML-10, ML-12)."""
    width = len(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(s, SLICE_ROWS)
                codes = model.codes(matrix(batch.column("features"), width))
                fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
                for m in model.members:
                    at = np.arange(len(codes)) if m.fold is None else np.flatnonzero(fold == m.fold)
                    if len(at):
                        taken = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [taken.column("key"), taken.column("fold"), taken.column("label"), pa.array(np.full(len(at), m.seed), pa.int64()), pa.array(m.base + m.margins(codes[at], 0))],
                            names=["key", "fold", "label", "seed", "prediction"],
                        )

    named = df.select(F.col("key"), F.col("fold").cast("long").alias("fold"), F.col("label").cast("double").alias("label"), "features")
    kind = dict(df.dtypes)["key"]
    return named.mapInArrow(run, f"key {kind}, fold long, label double, seed long, prediction double")


def top_columns(model: Boosted, top: int) -> dict[tuple[int | None, int], list[int]]:
    """Each member's ``top`` columns by falling average gain, the first of ties (ML-08)."""
    out = {}
    for m in model.members:
        own = Boosted(model.cuts, [m]).gains()
        out[m.fold, m.seed] = sorted(range(len(own)), key=lambda j: (-own[j], j))[:top]
    return out


def champion(df: DataFrame, folds: Sequence[int], seeds: Sequence[int], top: int = 300, trees: int = 400, **settings) -> tuple[Boosted, DataFrame]:
    """(model, out-of-fold predictions): columns ranked by gain outside each fold, then fitted again on the first ``top`` (ML-08..12)."""
    ranked = fit_boosted(df, folds, seeds, trees, **settings)
    model = fit_boosted(df, folds, seeds, trees, columns=top_columns(ranked, top), **settings)
    return model, boosted_predictions(df, model)
