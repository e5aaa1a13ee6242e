"""Feature families of a target and its flanks (FF-A, FF-D1, FF-F, FF-G, FF-I), as column expressions over whole tables.

Rows are (key, target, pam, upstream, downstream) in letters, read along the strand: the upstream text ends where the
target begins, so its windows are suffixes and the downstream text's are prefixes. Lookup tables and scales are small
dictionaries, at most 256 entries each, and parameters; a step that a table lacks is NULL and left out of means.
A NULL text gives NULL columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions import sequence as S
from strandloom.operators.aggregates import interaction
from strandloom.operators.joins import first_containing, interval_containment, nearest_on_line

Table = Mapping[str, float]


def end_window(upstream: Column, width: int) -> Column:
    """The letters next to the target."""
    return F.right(upstream, F.lit(width))


def start_window(downstream: Column, width: int) -> Column:
    """The letters next to the motif behind the target."""
    return F.substring(downstream, 1, width)


def profile(text: Column, table: Table) -> Column:
    """The table's value of every step along a text, NULL where it has none."""
    values = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
    return F.transform(S.kmers(F.upper(text), len(next(iter(table)))), lambda k: F.try_element_at(values, k))


def stats_of(values: Column) -> Column:
    """Struct of mean and population spread of an array without its NULLs in one pass, NULL where nothing is left."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, v: Column) -> Column:
        n, off = acc["n"] + 1, v - acc["mean"]
        mean = acc["mean"] + off / n
        moved = F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + off * (v - mean)).alias("m2"))
        return F.when(v.isNull(), acc).otherwise(moved)

    def done(acc: Column) -> Column:
        held = acc["n"] > 0
        return F.struct(F.when(held, acc["mean"]).alias("mean"), F.when(held, F.sqrt(acc["m2"] / acc["n"])).alias("sd"))

    return F.aggregate(values, zero, step, done)


def mean_of(values: Column) -> Column:
    """Mean of an array without its NULLs."""
    return stats_of(values)["mean"]


def spread_of(values: Column) -> Column:
    """Population standard deviation of an array without its NULLs."""
    return stats_of(values)["sd"]


def run_share(text: Column) -> Column:
    """Longest run of one letter as a share of the length, NULL for an empty text."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, c: Column) -> Column:
        run = F.when(acc["last"] == c, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    longest = F.aggregate(F.split(text, ""), start, step, lambda acc: acc["best"])
    return F.when(F.length(text) > 0, longest / F.length(text))


def _sides(width: int) -> dict[str, Column]:
    return {f"up{width}": end_window(F.col("upstream"), width), f"dn{width}": start_window(F.col("downstream"), width)}


def flank_block(rows: DataFrame, tables: Mapping[str, Table], series: Sequence[str], before: int = 10, after: int = 15, widths: Sequence[int] = (50, 250, 500, 1000)) -> DataFrame:
    """One-hot letters and table values at ``before`` places up, the motif's first and ``after`` down, window means and spreads of ``series``, composition (FF-A)."""
    whole = F.concat(end_window(F.col("upstream"), before), F.col("target"), F.col("pam"), F.col("downstream"))
    head = F.least(F.length("upstream"), F.lit(before))
    marked = rows.withColumn("__s", whole).withColumn("__t", head + F.length("target"))
    places = {f"u{i}": head - i + 1 for i in range(before, 0, -1)} | {"pamN": F.col("__t") + 1} | {f"d{i}": F.col("__t") + F.length("pam") + i for i in range(1, after + 1)}
    inside = lambda at: F.when(at >= 1, at)
    out: list[Column] = []
    for label, at in places.items():
        letter = F.coalesce(F.substr("__s", inside(at), F.lit(1)), F.lit("N"))
        out += [F.when(F.col("__s").isNotNull(), (letter == b).cast("int")).alias(f"eng.flank.seq.{label}.{b}") for b in "ACGT"]
    for name, table in tables.items():
        span = len(next(iter(table)))
        if span > 2:
            continue
        values = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
        out += [F.try_element_at(values, F.substr("__s", inside(at), F.lit(span))).alias(f"eng.flank.qct.{name}.{label}") for label, at in places.items()]
    for w in widths:
        for side, text in _sides(w).items():
            composition = {"gc": S.letter_share(text, "GC"), "purine": S.letter_share(text, "AG"), "maxrun": run_share(text)}
            out += [c.alias(f"eng.flank.comp.{side}.{n}") for n, c in composition.items()]
            for name in series:
                out += [f(profile(text, tables[name])).alias(f"eng.flank.win.{side}.{name}.{n}") for n, f in (("mean", mean_of), ("sd", spread_of))]
    return marked.select("key", *out)


def mechanics_block(rows: DataFrame, thirds: Mapping[str, tuple[int, int]], seed_start: int = 11, window: int = 5, flanks: Sequence[int] = (25, 100)) -> DataFrame:
    """Duplex energies of the target, its parts, the windows along target and motif, and the flanks (FF-D1, WN-14)."""
    t = F.col("target")
    part = lambda low, high: F.substring(t, low, high - low + 1)
    seed, distal = S.duplex(F.substr(t, F.lit(seed_start)))["dg37"], S.duplex(part(1, seed_start - 1))["dg37"]
    span = F.concat(t, F.coalesce("pam", F.lit("")))
    sliding = F.transform(S.kmers(span, window), lambda w: S.duplex(w)["dg37"])
    steps = profile(span, {k: v[2] for step, *v in S.STEPS for k in (step, step.translate(str.maketrans("ACGT", "TGCA"))[::-1])})
    out = [S.duplex(t)[c].alias(f"eng.mech.proto.{n}") for n, c in (("dH", "dh"), ("dS", "ds"), ("dG37", "dg37"), ("tm", "tm"))]
    for name, (low, high) in thirds.items():
        out += [S.duplex(part(low, high))["tm"].alias(f"eng.mech.tm.{name}"), S.duplex(part(low, high))["dg37"].alias(f"eng.mech.dG.{name}")]
    out += [seed.alias("eng.mech.dG.seed"), distal.alias("eng.mech.dG.distal"), (seed - distal).alias("eng.mech.dG.seed_minus_distal")]
    last = F.size("__w")
    out += [F.array_min("__w").alias("eng.mech.slide.min"), F.array_max("__w").alias("eng.mech.slide.max"), mean_of(F.col("__w")).alias("eng.mech.slide.mean"), spread_of(F.col("__w")).alias("eng.mech.slide.sd")]
    # Counted back from the motif; the first of equal windows.
    out += [(last - F.array_position("__w", f("__w"))).alias(f"eng.mech.slide.{n}_from_pam") for n, f in (("weakest", F.array_max), ("strongest", F.array_min))]
    out += [mean_of(F.col("__k")).alias("eng.mech.stack.mean"), F.array_min("__k").alias("eng.mech.stack.min"), spread_of(F.col("__k")).alias("eng.mech.stack.sd")]
    for w in flanks:
        for side, text in _sides(w).items():
            energy = S.duplex(text)["dg37"]
            out += [energy.alias(f"eng.mech.flank.{side}.dG37"), (energy / F.length(text)).alias(f"eng.mech.flank.{side}.dG_per_bp")]
    return rows.withColumn("__w", sliding).withColumn("__k", steps).select("key", *out)


def methylation_block(rows: DataFrame, motifs: Mapping[str, Sequence[str]], seed_start: int = 11, flank: int = 20, cut: int = 17, beside: int = 5) -> DataFrame:
    """Overlaps of each motif's sites with target, seed, distal part, motif and its flank, counts, nearest to the cut (FF-F, SC-12)."""
    up, pam = end_window(F.coalesce("upstream", F.lit("")), flank), F.coalesce("pam", F.lit(""))
    marked = rows.withColumn("__s", F.concat(up, F.col("target"), pam, start_window(F.coalesce("downstream", F.lit("")), flank))).withColumn("__a", F.length(up))
    first, last = F.col("__a"), F.col("__a") + F.length("target")
    out: list[Column] = []
    for name, words in motifs.items():
        k = len(words[0])
        # 0-based starts of all sites.
        sites = F.transform(F.concat(*[S.find_all(F.col("__s"), w) for w in words]), lambda p: p - 1)

        def overlaps(low: Column, high: Column, sites: Column = sites, k: int = k) -> Column:
            return F.exists(sites, lambda s: (s < high) & (s + k > low)).cast("int")

        regions = {
            "in_protospacer": (first, last), "in_seed": (first + seed_start - 1, last), "in_distal": (first, first + seed_start - 1),
            "in_pam": (last, last + F.length(pam)), "in_pam_flank": (last, last + F.length(pam) + beside),
        }
        out += [overlaps(low, high).alias(f"eng.meth.{name}.{region}") for region, (low, high) in regions.items()]
        inside = F.size(F.filter(sites, lambda s: (s >= first) & (s < last)))
        nearest = F.coalesce(_nearest(sites, k / 2.0, first + cut), F.length("__s").cast("double"))
        out += [F.size(sites).alias(f"eng.meth.{name}.n_in_window"), inside.alias(f"eng.meth.{name}.n_in_protospacer"), nearest.alias(f"eng.meth.{name}.nearest_to_cut")]
    block = marked.select("key", *out)
    return block.withColumn("eng.meth.any_in_seed", F.greatest(*[F.col(f"`eng.meth.{n}.in_seed`") for n in motifs], F.lit(0)))


def _nearest(sites: Column, half: float, place: Column) -> Column:
    return F.array_min(F.transform(sites, lambda s: F.abs(s + half - place)))


def symmetric(scale: Table) -> dict[str, float]:
    """Mean of every step's value and that of its reverse complement."""
    turn = str.maketrans("ACGT", "TGCA")
    return {k: (v + scale[k.translate(turn)[::-1]]) / 2 for k, v in scale.items()}


def shape_block(rows: DataFrame, scales: Mapping[str, Table], bend: tuple[str, str], widths: Sequence[int] = (20, 50, 100, 200), turn: float = 10.5) -> DataFrame:
    """Mean and spread of every scale over each window of the flanks, and the coherent bend of the difference of two (FF-I, WN-16)."""
    out: list[Column] = []
    net = {k: scales[bend[0]][k] - scales[bend[1]][k] for k in scales[bend[0]]}
    for w in widths:
        for side, text in _sides(w).items():
            usable = F.upper(text).rlike("^[ACGT]{2,}$")
            for name, scale in sorted(scales.items()):
                out += [F.when(usable, f(profile(text, scale))).alias(f"eng.shape.{name}.{side}.{n}") for n, f in (("mean", mean_of), ("sd", spread_of))]
            bends = profile(text, net)
            x, y = (_phased(bends, f, turn) for f in (F.cos, F.sin))
            out.append(F.when(usable, F.hypot(x, y) / F.size(bends)).alias(f"eng.shape.curv.{side}"))
    return rows.select("key", *out)


def _phased(values: Column, wave, turn: float) -> Column:
    parts = F.transform(values, lambda v, i: v * wave(F.lit(6.283185307179586) * i / turn))
    return F.aggregate(F.filter(parts, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def transcription_block(rows: DataFrame, starts: DataFrame, genes: DataFrame, expression: DataFrame, n: int, origin: int, terminus: int, farthest: int = 5000, width: int = 4096) -> DataFrame:
    """Nearest start site by strand, host gene, strands against gene and fork, expression, and interactions (FF-G, JN-11, JN-12, JN-02, SC-24).

    Rows are (key, place, strand, gene), start sites (tss, strand), genes (left, right, strand), expression (gene,
    level, ...) one row a gene. Of several genes that hold a place the one that starts last is its host, of equal starts the shortest, of equal genes the lesser strand.
    """
    out = rows.select("key", "place", "strand", "gene")
    for label, held in (("any", starts), ("plus", starts.where("strand = '+'")), ("minus", starts.where("strand = '-'"))):
        near = nearest_on_line(rows.where("place IS NOT NULL").select("key", F.col("place").alias("tss")), held, "key", "tss", n)
        out = out.join(near.select("key", F.least("before", "after", F.lit(farthest)).alias(f"eng.tx.tss.{label}")), "key", "left")
    spans = genes.select(F.col("left").alias("__l"), F.col("right").alias("__r"), F.col("strand").alias("__g"))
    asked = rows.select("place").where("place IS NOT NULL").distinct()
    hosts = first_containing(interval_containment(asked, spans.distinct(), "place", "__l", "__r", width), "place", "__l", "__r", "__g").select("place", "__l", "__r", "__g")
    length, share = F.col("__r") - F.col("__l") + 1, (F.col("place") - F.col("__l")) / (F.col("__r") - F.col("__l") + 1)
    forward = F.when(S.before_terminus(F.col("place"), origin, terminus, n), F.lit("+")).otherwise("-")
    measured = [c for c in expression.columns if c != "gene"]
    joined = out.join(hosts, "place", "left").join(expression, "gene", "left")
    block = joined.select(
        "key", *[f"`eng.tx.tss.{x}`" for x in ("any", "plus", "minus")],
        F.when(F.col("__g") == "+", share).otherwise(1 - share).alias("eng.tx.gene.rel_position"), length.alias("eng.tx.gene.length"),
        (F.col("strand") != F.col("__g")).cast("double").alias("eng.tx.gene.template_strand"), (F.col("__g") == forward).cast("double").alias("eng.tx.repl.codirectional"),
        (F.col("strand") == forward).cast("double").alias("eng.tx.repl.leading_strand"), *[F.col(c).alias(f"eng.tx.expr.{c}") for c in measured],
    ).withColumn("__tpl", F.col("`eng.tx.gene.template_strand`")).withColumn("__cod", F.col("`eng.tx.repl.codirectional`")).withColumn("__e", F.col(f"`eng.tx.expr.{measured[0]}`"))
    for other, name in (("__tpl", "expr_x_template"), ("__cod", "expr_x_codirectional")):
        block = interaction(block, "__e", other, f"eng.tx.ix.{name}", centre=0.5)
    mean = block.agg(F.avg("__e").alias("__m"))
    block = block.join(F.broadcast(mean)).withColumn("eng.tx.ix.expr_over_tss", (F.col("__e") - F.col("__m")) / (1 + F.col("`eng.tx.tss.any`")))  # one row
    lead = F.col("`eng.tx.repl.leading_strand`")
    return block.withColumn("eng.tx.ix.template_x_leading", (F.col("__tpl") - 0.5) * (lead - 0.5)).drop("__tpl", "__cod", "__e", "__m")


def registry(tables: Mapping[str, Table], series: Sequence[str], thirds: Mapping[str, tuple[int, int]], motifs: Mapping[str, Sequence[str]], scales: Mapping[str, Table], bend: tuple[str, str], widths: Sequence[int]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The whole flank families as builders of rows (key, upstream, target, pam, downstream), for ``families.build`` (FF-0)."""
    return {
        "a_flank": lambda rows: flank_block(rows, tables, series, widths=widths),
        "d_mechanics": lambda rows: mechanics_block(rows, thirds),
        "f_methylation": lambda rows: methylation_block(rows, motifs),
        "i_shape": lambda rows: shape_block(rows, scales, bend, widths),
    }
