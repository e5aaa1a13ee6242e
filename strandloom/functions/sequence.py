"""Scalar functions on letter sequences and circular positions (SC-*), all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def revcomp(c: Column, letters: str = "ACGTNacgtn", complement: str = "TGCANtgcan") -> Column:
    """Reverse complement, case and unknown letters kept (SC-01)."""
    return F.reverse(F.translate(c, letters, complement))


def slice_circular(text: Column, start: Column, length: Column) -> Column:
    """``length`` letters from a 1-based position of a circular text; the empty text for length 0 (SC-02)."""
    n = F.length(text)
    turns = F.repeat(text, (F.floor((length + n) / n) + 1).cast("int"))
    return F.when(length > 0, F.substr(turns, (F.pmod(start - 1, n) + 1).cast("int"), length.cast("int"))).otherwise(F.lit(""))


def circular_distance(a: Column, b: Column, n: int) -> Column:
    """Shorter way round between two positions (SC-03)."""
    d = F.pmod(F.abs(a - b), F.lit(n))
    return F.least(d, n - d)


def signed_offset(a: Column, b: Column, n: int) -> Column:
    """Offset from b to a, the shorter way, in (-n/2, n/2] (SC-03)."""
    d = F.pmod(a - b, F.lit(n))
    return F.when(d * 2 > n, d - n).otherwise(d)


def find_all(text: Column, motif: str) -> Column:
    """1-based places of all occurrences, overlapping ones included (SC-04, SC-12)."""
    k = len(motif)
    return F.when(
        F.length(text) >= k, F.filter(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)) == motif)
    ).otherwise(F.array().cast("array<int>"))


def count_overlapping(text: Column, pattern: str) -> Column:
    """Number of overlapping matches of a regular expression (SC-12)."""
    return F.regexp_count(text, F.lit(f"(?=({pattern}))"))


def kmers(text: Column, k: int) -> Column:
    """All k-letter windows in order (SC-08)."""
    return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column, letters: str = "ACGT", complement: str = "TGCA") -> Column:
    """The lesser of a k-mer and its reverse complement (SC-22)."""
    return F.least(kmer, revcomp(kmer, letters, complement))


def letter_share(text: Column, letters: str) -> Column:
    """Share of the letters in a text, NULL for an empty one (SC-11)."""
    n = F.length(text)
    return F.try_divide((n - F.length(F.translate(text, letters, ""))).cast("double"), n.cast("double"))


def entropy(shares: Sequence[Column]) -> Column:
    """Shannon entropy in bits, shares floored at 1e-9 (SC-16)."""
    out = F.lit(0.0)
    for s in shares:
        p = F.greatest(s, F.lit(1e-9))
        out = out - p * F.log2(p)
    return out


def log_ratio(a: Column, b: Column, pseudo: float = 1e-4) -> Column:
    """log2 of a ratio with pseudo-counts (SC-14)."""
    return F.log2((a + pseudo) / (b + pseudo))


def context(text: Column, left: Column, right: Column, strand: Column, flank: int) -> Column:
    """Struct of upstream, target and downstream, read along the strand, on a circular text (SC-06)."""
    up, mid, down = slice_circular(text, left - flank, F.lit(flank)), slice_circular(text, left, right - left + 1), slice_circular(text, right + 1, F.lit(flank))
    plus = F.struct(up.alias("upstream"), mid.alias("target"), down.alias("downstream"))
    minus = F.struct(revcomp(down).alias("upstream"), revcomp(mid).alias("target"), revcomp(up).alias("downstream"))
    return F.when(strand == "+", plus).otherwise(minus)


def cut_site(left: Column, right: Column, strand: Column) -> Column:
    """Three letters inside the end that faces the motif (SC-21)."""
    return F.when(strand == "+", right - 3).otherwise(left + 3)


def before_terminus(position: Column, origin: int, terminus: int, n: int) -> Column:
    """True on the half of the circle that runs from the origin to the terminus (SC-07)."""
    return F.pmod(position - origin, F.lit(n)) < (terminus - origin) % n


def relative_place(position: Column, low: Column, high: Column, strand: Column) -> Column:
    """Place in an interval as a share of it, turned on the minus strand (SC-23)."""
    share = (position - low) / (high - low + 1)
    return F.when(strand == "+", share).otherwise(1 - share)


def motif_sites(df: DataFrame, key: str, text: str, target: int, motif: str) -> DataFrame:
    """(key, strand, place, target) of every ``target``-long word just before the motif, on both strands (SC-05)."""
    m = len(motif)
    s, back = F.col(text), revcomp(F.lit(motif))

    def starts(want: Column, offset: int) -> Column:
        last = F.length(s) - target - m + 1
        return F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda i: F.substr(s, i + offset, F.lit(m)) == want)).otherwise(F.array().cast("array<int>"))

    plus = F.transform(starts(F.lit(motif), target), lambda i: F.struct(F.lit("+").alias("strand"), i.alias("place"), F.substr(s, i, F.lit(target)).alias("target")))
    minus = F.transform(starts(back, 0), lambda i: F.struct(F.lit("-").alias("strand"), (i + m).alias("place"), revcomp(F.substr(s, i + m, F.lit(target))).alias("target")))
    return df.select(key, F.inline(F.concat(plus, minus)))


# Nearest-neighbour duplex steps (SantaLucia 1998): enthalpy in kcal/mol, entropy in cal/(mol K), free energy at 37 degrees.
STEPS = [
    ("AA", -7.9, -22.2, -1.00), ("AT", -7.2, -20.4, -0.88), ("TA", -7.2, -21.3, -0.58), ("CA", -8.5, -22.7, -1.45), ("GT", -8.4, -22.4, -1.44),
    ("CT", -7.8, -21.0, -1.28), ("GA", -8.2, -22.2, -1.30), ("CG", -10.6, -27.2, -2.17), ("GC", -9.8, -24.4, -2.24), ("GG", -8.0, -19.9, -1.84),
]
# Initiation by a terminal G-C or A-T pair, in the same order.
ENDS = {"GC": (0.1, -2.8, 0.98), "AT": (2.3, 4.1, 1.03)}


def step_maps() -> tuple[Column, Column, Column]:
    """Dinucleotide -> enthalpy, entropy and free energy, reverse complements included."""
    turn = str.maketrans("ACGT", "TGCA")
    full = {k: values for step, *values in STEPS for k in (step, step.translate(turn)[::-1])}
    return tuple(F.create_map(*[F.lit(x) for k, v in full.items() for x in (k, v[i])]) for i in range(3))


def duplex(text: Column, concentration: float = 5e-7) -> Column:
    """Struct of dh, ds, dg37 and tm of a duplex by nearest neighbours, case ignored (SC-13).

    All NULL for a text with another letter than A, C, G, T or with fewer than two.
    """
    letters = F.upper(text)
    steps = kmers(letters, 2)
    first, last = F.substring(letters, 1, 1), F.right(letters, F.lit(1))

    def total(i: int, values: Column) -> Column:
        end = lambda c: F.when(c.isin("G", "C"), ENDS["GC"][i]).otherwise(ENDS["AT"][i])
        inner = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.try_element_at(values, x))
        return F.when(letters.rlike("^[ACGT]{2,}$"), inner + end(first) + end(last))

    dh, ds, dg = (total(i, m) for i, m in enumerate(step_maps()))
    tm = F.try_divide(1000 * dh, ds + 1.987 * F.log(F.lit(concentration / 4))) - 273.15
    return F.struct(dh.alias("dh"), ds.alias("ds"), dg.alias("dg37"), tm.alias("tm"))


def decode(values: Column, codes: Mapping[str, str], unknown: str = "N") -> Column:
    """Letters of an array of codes, ``unknown`` for a NULL code (SC-10); check the codes first by ``unknown_codes``."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.array_join(F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v.cast("string")), F.lit(unknown))), "")


def unknown_codes(df: DataFrame, column: str, codes: Mapping[str, str]) -> DataFrame:
    """(code, rows) of the codes outside the table, of which a decoding should have none (SC-10)."""
    code = F.col(column).cast("string")
    return df.where(code.isNotNull() & ~code.isin(*codes)).groupBy(code.alias("code")).agg(F.count("*").alias("rows"))


def is_sequence(text: Column, length: int | None = None) -> Column:
    """True for a text of A, C, G, T only, of that length where one is given; false for NULL (PRJ-11)."""
    return F.coalesce(text.rlike("^[ACGT]{%s}$" % (length if length else "1,")), F.lit(False))


def has_unknown(text: Column, letter: str = "N") -> Column:
    """True where the text holds the letter for an unknown base; false for NULL (PRJ-11)."""
    return F.coalesce(F.contains(text, F.lit(letter)), F.lit(False))
