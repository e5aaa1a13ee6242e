"""Feature families (FF-*, UD-01, UD-02): named builders from rows to a block (key, eng.*), run one by one.

A builder takes rows (key, s, strand, place) and gives a block; ``build`` reports those that fail and goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from strandloom.functions import sequence as S
from strandloom.operators.joins import bin_lookup, flag_members
from strandloom.operators.ordering import longest_run, with_running_sum

Builder = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Builder] = {}


def family(name: str) -> Callable[[Builder], Builder]:
    def add(fn: Builder) -> Builder:
        REGISTRY[name] = fn
        return fn

    return add


@family("a_flank")
def flank(rows: DataFrame) -> DataFrame:
    """Composition of nested windows at the start of the text, longest run included (FF-A)."""
    s, out = F.col("s"), []
    for w in (5, 10, 20):
        cut = F.substring(s, 1, w)
        out += [S.letter_share(cut, "GC").alias(f"eng.flank.gc{w}"), S.letter_share(cut, "AG").alias(f"eng.flank.purine{w}")]
    run = longest_run(rows, "key", "s").select("key", F.col("share").alias("eng.flank.run"))
    return rows.select("key", *out).join(run, "key", "left")


@family("d_mechanics")
def mechanics(rows: DataFrame) -> DataFrame:
    """Duplex energies of the whole text, of its halves, and the least stable window of five (FF-D1, WN-14)."""
    s = F.col("s")
    half = (F.length(s) / 2).cast("int")
    first, second = F.substr(s, F.lit(1), half), F.substr(s, half + 1, F.length(s))
    windows = F.transform(S.kmers(s, 5), lambda w: S.duplex(w)["dg37"])
    return rows.select(
        "key", S.duplex(s)["tm"].alias("eng.mech.tm"), S.duplex(s)["dg37"].alias("eng.mech.dg"), (S.duplex(first)["dg37"] - S.duplex(second)["dg37"]).alias("eng.mech.halves"),
        F.array_max(windows).alias("eng.mech.weakest"),
    )


@family("f_methylation")
def methylation(rows: DataFrame) -> DataFrame:
    """Counts of two motifs and the distance of the nearest to the middle (FF-F)."""
    s = F.col("s")
    sites = F.concat(S.find_all(s, "GATC"), S.find_all(s, "CCAGG"), S.find_all(s, "CCTGG"))
    near = F.array_min(F.transform(sites, lambda p: F.abs(p - F.length(s) / 2)))
    return rows.select("key", F.size(S.find_all(s, "GATC")).alias("eng.meth.gatc"), S.count_overlapping(s, "CC[AT]GG").alias("eng.meth.ccwgg"), near.alias("eng.meth.nearest"))


@family("i_shape")
def shape(rows: DataFrame) -> DataFrame:
    """Mean enthalpy step of the windows and its bend at the helical phase (FF-I, WN-16)."""
    h, _, _ = S.step_maps()
    steps = F.transform(S.kmers(F.col("s"), 2), lambda k: F.coalesce(F.try_element_at(h, k), F.lit(0.0)))
    turn = lambda f: F.aggregate(F.transform(steps, lambda v, i: v * f(F.lit(6.283185307179586) * (i + 1) / 10.5)), F.lit(0.0), lambda a, v: a + v)
    n = F.size(steps)
    return rows.select("key", F.try_divide(F.aggregate(steps, F.lit(0.0), lambda a, v: a + v), n).alias("eng.shape.mean"), F.try_divide(F.hypot(turn(F.cos), turn(F.sin)), n).alias("eng.shape.bend"))


@family("z_mapgc")
def mappability(rows: DataFrame) -> DataFrame:
    """Share of canonical 12-mers that occur once in all texts (FF-Z3)."""
    k = rows.select("key", F.explode(S.kmers(F.col("s"), 12)).alias("k")).select("key", S.canonical(F.col("k")).alias("c"))
    once = k.groupBy("c").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count("*").alias("u"))
    total = k.groupBy("key").agg(F.count("*").alias("w"))
    return rows.select("key").join(total, "key", "left").join(once, "key", "left").select("key", F.coalesce(F.try_divide(F.coalesce("u", F.lit(0)), "w"), F.lit(0.0)).alias("eng.map.unique"))


def dosage(rows: DataFrame, n: int, origin: int = 1) -> DataFrame:
    """2 to the minus twice the distance from the origin, as a share of half the circle of ``n`` (FF-Z1)."""
    return rows.select("key", F.pow(F.lit(2.0), -2 * S.circular_distance(F.col("place"), F.lit(origin), n) / F.lit(n / 2)).alias("eng.dose"))


def circular_window_means(asked: DataFrame, track: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """(keys, w, m): mean of a dense track (pos, value) over ``w`` positions around ``place`` on a circle of ``n``, from rows (keys, place, w).

    Running sums give a window's mean from two look-ups by position, so wide windows cost no more than narrow ones.
    """
    sums = with_running_sum(track.select("pos", "value"), "pos", F.col("value"), "cum").select("pos", "cum")
    total = sums.agg(F.max_by("cum", "pos").alias("all"))
    low = F.col("place") - F.floor(F.col("w") / 2) - 1
    ends = asked.select(*keys, "w", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), low.alias("at")), F.struct(F.lit(1).alias("sign"), (low + F.col("w")).alias("at")))).alias("e"))
    # Position 0 has sum 0; a place outside 1..n is a turn away.
    ends = ends.select(*keys, "w", "e.sign", F.pmod("e.at", F.lit(n)).alias("pos"), F.floor(F.col("e.at") / n).alias("turn"))
    value = F.col("sign") * (F.coalesce("cum", F.lit(0.0)) + F.col("turn") * F.col("all"))
    return ends.join(sums, "pos", "left").join(F.broadcast(total)).groupBy(*keys, "w").agg((F.sum(value) / F.max("w")).alias("m"))  # one row


def torsion_gradient(rows: DataFrame, track: DataFrame, widths: Sequence[int], n: int) -> DataFrame:
    """Mean of the track behind each place less that before it, in the direction of the strand, by width (FF-D2).

    The windows are centred half a width to either side; rows are (key, strand, place), NULL where there is no place.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(side).alias("side"), F.lit(side * (w // 2)).alias("move")) for w in widths for side in (1, -1)]))
    asked = rows.where("place IS NOT NULL").select("key", "place", sides.alias("x")).select("key", (F.pmod(F.col("place") + F.col("x.move") - 1, F.lit(n)) + 1).alias("place"), "x.w", "x.side")
    means = circular_window_means(asked, track, n, ["key", "side"])
    gradient = means.groupBy("key").agg(*[F.sum(F.when(F.col("w") == w, F.col("side") * F.col("m"))).alias(f"g{w}") for w in widths])
    sign = F.when(F.col("strand") == "+", 1).otherwise(-1)
    return rows.join(gradient, "key", "left").select("key", *[(sign * F.col(f"g{w}")).alias(f"eng.track.gradient{w}") for w in widths])


def circular_kmers(bases: DataFrame, k: int, n: int) -> DataFrame:
    """(pos, kmer) of the ``k`` letters from each position of a circle of ``n``, from rows (pos, base) of 1-based positions."""
    sent = bases.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "pos", "base").select((F.pmod(F.col("pos") - F.col("i") - 1, F.lit(n)) + 1).alias("pos"), "i", "base")
    letters = F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda x: x["base"])
    return sent.groupBy("pos").agg(F.array_join(letters, "").alias("kmer"))


def mapgc_block(rows: DataFrame, bases: DataFrame, k: int, widths: Sequence[int], n: int) -> DataFrame:
    """Share of k-mers that occur once on either strand, and of G and C, around each place, by width (FF-Z3)."""
    kmers = circular_kmers(bases, k, n).withColumn("c", S.canonical(F.col("kmer")))
    once = kmers.groupBy("c").agg(F.count("*").alias("times"))
    unique = kmers.join(once, "c").select("pos", (F.col("times") == 1).cast("double").alias("value"))
    gc = bases.select("pos", F.col("base").isin("G", "C").cast("double").alias("value"))
    asked = rows.where("place IS NOT NULL").select("key", "place", F.explode(F.array(*[F.lit(w) for w in widths])).alias("w"))
    out = rows.select("key")
    for name, track in (("unique", unique), ("gc", gc)):
        means = circular_window_means(asked, track, n, ["key"])
        out = out.join(means.groupBy("key").agg(*[F.max(F.when(F.col("w") == w, F.col("m"))).alias(f"eng.map.{name}{w}") for w in widths]), "key", "left")
    return out


def track_block(rows: DataFrame, tracks: DataFrame, roles: Sequence[str], widths: Sequence[int], n: int) -> DataFrame:
    """Mean of every track around each place on a circle of n, by width, and log ratios to the widest (FF-D2).

    Running sums of a track give a window's mean from two look-ups by position, so wide windows cost no more than narrow.
    """
    long = None
    for role in roles:
        part = with_running_sum(tracks.where(F.col("role") == role), "pos", F.col("value"), "cum").select("role", "pos", "cum")
        long = part if long is None else long.unionByName(part)
    total = long.groupBy("role").agg(F.max_by("cum", "pos").alias("all"))
    asked = rows.select("key", "place").withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles]))).withColumn("w", F.explode(F.array(*[F.lit(w) for w in widths])))
    ends = asked.select("key", "role", "w", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (F.col("place") - F.floor(F.col("w") / 2) - 1).alias("at")), F.struct(F.lit(1).alias("sign"), (F.col("place") - F.floor(F.col("w") / 2) - 1 + F.col("w")).alias("at")))).alias("e"))
    # Position 0 has sum 0; a place outside 1..n is a turn away.
    ends = ends.select("key", "role", "w", "e.sign", F.pmod("e.at", F.lit(n)).alias("pos"), F.floor(F.col("e.at") / n).alias("turn"))
    sums = ends.join(long, ["role", "pos"], "left").join(F.broadcast(total), "role")  # a row a role
    value = F.col("sign") * (F.coalesce("cum", F.lit(0.0)) + F.col("turn") * F.col("all"))
    means = sums.groupBy("key", "role", "w").agg((F.sum(value) / F.max("w")).alias("m"))
    wide = means.groupBy("key").agg(*[F.max(F.when((F.col("role") == r) & (F.col("w") == w), F.col("m"))).alias(f"eng.track.{r}{w}") for r in roles for w in widths])
    ratios = [S.log_ratio(F.col(f"`eng.track.{r}{w}`"), F.col(f"`eng.track.{r}{max(widths)}`")).alias(f"eng.track.{r}{w}.ratio") for r in roles for w in widths if w != max(widths)]
    return wide.select("*", *ratios)


def neighbourhood_block(rows: DataFrame, bins: DataFrame, contacts: DataFrame, width: int, n_bins: int, near: int) -> DataFrame:
    """Per-bin columns looked up by place, with the near and far sums of a contact map (i, j, v) (FF-E, JN-18)."""
    d = F.least(F.pmod(F.col("i") - F.col("j"), F.lit(n_bins)), F.pmod(F.col("j") - F.col("i"), F.lit(n_bins)))
    split = contacts.groupBy(F.col("i").alias("bin")).agg(
        F.sum(F.when(d <= near, F.col("v")).otherwise(0.0)).alias("eng.contact.near"), F.sum(F.when(d > near, F.col("v")).otherwise(0.0)).alias("eng.contact.far")
    )
    return bin_lookup(rows.select("key", "place"), "place", width, bins.join(split, "bin", "left"), n_bins).drop("place", "bin")


def membership_block(rows: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """1 for keys of the member table, 0 for all others (FF-K)."""
    return flag_members(rows.select("key"), "key", members).select("key", F.col("member").cast("int").alias(f"eng.{name}"))


def build(rows: DataFrame, names: Sequence[str] | None = None, registry: Mapping[str, Builder] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All blocks joined to the rows' keys and a status for each family (FF-0); a failing family is left out.

    ``registry`` holds further builders, or others of the same names, for instance ``flank_families.registry``.
    """
    builders = REGISTRY | dict(registry or {})
    out, status = rows.select("key"), {}
    for name in names or sorted(builders):
        try:
            block = builders[name](rows)
            if odd := [c for c in block.columns if c != "key" and not c.startswith("eng.")]:
                raise ValueError(f"columns without eng.: {odd}")
            out, status[name] = out.join(block, "key", "left"), "ok"
        except Exception as e:  # one family's failure is its own
            status[name] = f"failed: {e}"
    return out, status
