"""Column functions on DNA and protein sequences. Positions are 0-based, intervals half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospark.functions import fixed

_IUPAC = ("ACGTUNRYSWKMBDHV", "TGCAANYRSWMKVHDB")
_FROM = _IUPAC[0] + _IUPAC[0].lower()
_TO = _IUPAC[1] + _IUPAC[1].lower()


def reverse_complement(seq: Column) -> Column:
    """Reverse complement with all IUPAC letters, case kept."""
    return F.translate(F.reverse(seq), _FROM, _TO)


def slice_of(seq: Column, start: Column | int, end: Column | int) -> Column:
    """seq[start:end]; empty where end <= start."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.substring(seq, start + 1, F.greatest(end - start, F.lit(0)))


def stranded(seq: Column, strand: Column) -> Column:
    """A genomic stretch as it reads on its strand (-1: reverse complement)."""
    return F.when(strand == -1, reverse_complement(seq)).otherwise(seq)


def codon_array(seq: Column, start: Column | int = 0) -> Column:
    """The whole codons of a sequence from ``start``; a partial one at the end is dropped."""
    start = start if isinstance(start, Column) else F.lit(start)
    # one pass of the matcher; cutting by position would scan from the front for every codon
    return F.regexp_extract_all(F.substring(seq, start + 1, F.length(seq)), F.lit("(?s).{3}"), F.lit(0))


def translate_dna(seq: Column, start: Column | int = 0, table: str = "Standard") -> Column:
    """Protein of a sequence: `*` for a stop, `X` for a codon with an ambiguous base.

    Each codon gets a mark behind it, so that the three letters before a mark are always a codon, and the codons are
    replaced one kind after the other: as many searches of the string as there are codons, all of them compiled.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    bases = F.substring(F.upper(seq), start + 1, F.floor((F.length(seq) - start) / 3).cast("int") * 3)
    marked = F.regexp_replace(bases, "(?s)(.{3})", "$1,")
    for codon, residue in fixed.codons(table).items():
        marked = F.replace(marked, F.lit(f"{codon},"), F.lit(residue))
    return F.regexp_replace(marked, "(?s).{3},", "X")


def until_stop(protein: Column) -> Column:
    return F.substring_index(protein, "*", 1)


def sites_of(seq: Column, word: str) -> Column:
    """Starts of the non-overlapping matches of a literal alternation whose words are equally long, from the left."""
    size = len(word.split("|")[0])
    parts = F.split(seq, word)
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-size)) + size + F.length(p))),
    )
    return ends


def start_codon_sites(seq: Column, starts: tuple[str, ...] = ("ATG",)) -> Column:
    """Positions of the start codons, in any frame, non-overlapping from the left."""
    return sites_of(seq, "|".join(starts))


def stop_sites(protein: Column) -> Column:
    """Positions of `*`."""
    return F.filter(
        F.transform(F.split(protein, ""), lambda c, i: F.when(c == "*", i)), lambda i: i.isNotNull()
    )


def in_frame_stop(seq: Column, start: Column | int = 0) -> Column:
    """Position of the first of TAA, TAG, TGA in the frame of ``start``; -1 if there is none."""
    start = start if isinstance(start, Column) else F.lit(start)
    hit = F.array_min(
        F.filter(
            F.transform(codon_array(seq, start), lambda c, i: F.when(c.isin("TAA", "TAG", "TGA"), i)), lambda i: i.isNotNull()
        )
    )
    return F.coalesce(start + hit * 3, F.lit(-1))


def first_orf(seq: Column) -> Column:
    """(start, end) of the first ATG and its first in-frame stop; end is the last whole codon's if there is no stop."""
    start = F.instr(seq, "ATG") - 1
    stop = in_frame_stop(seq, start)
    end = F.when(stop >= 0, stop).otherwise(start + F.floor((F.length(seq) - start) / 3) * 3)
    return F.when(start >= 0, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def query_index(locations: Column, position: Column) -> Column:
    """Index in a spliced sequence of a reference position, given its matched locations; -1 outside of them.

    A location is struct<q_start, q_end, ref_start, ref_end>.
    """
    own = F.filter(locations, lambda m: (m["ref_start"] <= position) & (position < m["ref_end"]))
    return F.coalesce(F.get(F.transform(own, lambda m: m["q_start"] + position - m["ref_start"]), F.lit(0)), F.lit(-1))


def slice_locations(locations: Column, start: Column, end: Column) -> Column:
    """Matched locations of seq[start:end], with queries counted from ``start``."""
    own = F.filter(locations, lambda m: (m["q_start"] < end) & (m["q_end"] > start))
    return F.transform(
        own,
        lambda m: F.struct(
            (F.greatest(m["q_start"], start) - start).alias("q_start"),
            (F.least(m["q_end"], end) - start).alias("q_end"),
            (m["ref_start"] + F.greatest(start - m["q_start"], F.lit(0))).alias("ref_start"),
            (m["ref_end"] - F.greatest(m["q_end"] - end, F.lit(0))).alias("ref_end"),
        ),
    )


def merge_locations(locations: Column) -> Column:
    """Matched locations in order with those that touch both in the query and in the reference joined."""
    kind = "array<struct<q_start:int,q_end:int,ref_start:int,ref_end:int>>"

    def step(acc, m):
        last = F.try_element_at(acc, F.lit(-1))
        touches = last.isNotNull() & (last["q_end"] == m["q_start"]) & (last["ref_end"] == m["ref_start"])
        joined = F.struct(
            last["q_start"].alias("q_start"), m["q_end"].alias("q_end"), last["ref_start"].alias("ref_start"), m["ref_end"].alias("ref_end")
        )
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(F.array_sort(locations).cast(kind), F.array().cast(kind), step)
