"""Decoy peptides: reversed in place, or shuffled by a hash, with fixed residues kept where they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospark.functions import let
from ribospark.functions.digest import Cleavage, cleavage_sites


def fixed_positions(seq: Column, cleavage: Cleavage | None = None, residues: str = "", keep_nterm: bool = True, keep_cterm: bool = True) -> Column:
    """Positions that a decoy keeps: those after cleavage sites, the termini, and any of ``residues``.

    The enzyme counts without exceptions, and marks the residue that follows a site.
    """
    n = F.length(seq)
    parts = [F.array().cast("array<int>")]
    if cleavage:
        parts.append(F.filter(cleavage_sites(seq, Cleavage(cleavage.enzyme, None)), lambda i: i < n))
    if keep_nterm:
        parts.append(F.array(F.lit(0)))
    if keep_cterm:
        parts.append(F.array(n - 1))
    if residues:
        parts.append(F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c.isin(*residues), i)), lambda i: i.isNotNull()))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _rearranged(seq: Column, fixed: Column, order) -> Column:
    """``seq`` with its free residues put in another order; the n-th free place takes the n-th of the ordered ones."""

    def placed(letters: Column, at: Column, moved: Column) -> Column:
        def rank(i: Column) -> Column:
            return i - F.size(F.filter(at, lambda f: f < i))

        return F.array_join(F.transform(letters, lambda c, i: F.when(F.array_contains(at, i), c).otherwise(F.get(moved, rank(i)))), "")

    def rebuilt(letters: Column, at: Column) -> Column:
        free = F.filter(letters, lambda c, i: ~F.array_contains(at, i))
        return let(order(free), lambda moved: placed(letters, at, moved))

    made = let(F.split(seq, ""), lambda letters: let(fixed, lambda at: rebuilt(letters, at)))
    return F.when(F.length(seq) > 0, made).otherwise(seq)


def reverse(seq: Column, fixed: Column) -> Column:
    return _rearranged(seq, fixed, F.reverse)


def shuffle(seq: Column, fixed: Column, seed: Column | int, attempt: Column | int = 0) -> Column:
    """Free residues ordered by a hash of (sequence, seed, attempt, place): the same on every run and cluster."""
    seed, attempt = (x if isinstance(x, Column) else F.lit(x) for x in (seed, attempt))

    def order(free: Column) -> Column:
        ranked = F.transform(free, lambda c, i: F.struct(F.xxhash64(seq, seed, attempt, i).alias("h"), i.alias("i"), c.alias("c")))
        return F.transform(F.array_sort(ranked), lambda s: s["c"])

    return _rearranged(seq, fixed, order)


def w2f_variants(seq: Column) -> Column:
    """All sequences with a non-empty set of W read as F; the mask over the W's counts up."""
    sites = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c == "W", i)), lambda i: i.isNotNull())
    return let(F.split(seq, ""), lambda letters: let(sites, lambda s: _w2f(letters, s)))


def _w2f(letters: Column, sites: Column) -> Column:
    n = F.size(sites)
    masks = F.when(n > 0, F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 1)).otherwise(F.array().cast("array<int>"))

    def apply(mask):
        return F.array_join(
            F.transform(
                letters,
                lambda c, i: F.when(
                    (c == "W") & (F.call_function("getbit", mask, F.greatest(F.array_position(sites, i).cast("int") - 1, F.lit(0))) == 1), "F"
                ).otherwise(c),
            ),
            "",
        )

    return F.transform(masks, apply)


def sec_truncations(seq: Column, starts: Column | bool = False) -> Column:
    """The peptide up to each U, and the same without a leading M if it starts the protein."""
    starts = starts if isinstance(starts, Column) else F.lit(starts)
    sites = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c == "U", i)), lambda i: i.isNotNull())
    whole = F.transform(sites, lambda i: F.substring(seq, F.lit(1), i))
    clipped = F.transform(F.filter(whole, lambda p: p.startswith("M")), lambda p: F.substring(p, 2, 1_000_000_000))
    return F.concat(whole, F.when(starts, clipped).otherwise(F.array().cast("array<string>")))
