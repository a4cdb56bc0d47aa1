"""Enzymatic digestion, masses and peptide validity, in Catalyst expressions; whole pools are digested by Arrow batches.

All cleavage patterns consume exactly one residue, so putting a mark after every match and splitting at the marks gives
the fragments. An exception folds into the rule as a negative lookahead, because a rule and an exception that end at the
same residue also start at it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.functions import fixed, let

_MARK = "|"


@dataclass(frozen=True)
class Cleavage:
    """Digestion parameters. The exception `auto` is that of the enzyme, if it has one."""

    enzyme: str = "trypsin"
    exception: str | None = "auto"
    miscleavage: int = 2
    min_mw: float = 500.0
    min_length: int = 7
    max_length: int = 25

    def exception_pattern(self) -> str | None:
        if self.exception == "auto":
            return fixed.EXCEPTIONS.get(f"{self.enzyme}_exception")
        return fixed.EXCEPTIONS.get(self.exception, self.exception) if self.exception else None

    def pattern(self) -> str:
        rule, exception = fixed.ENZYMES[self.enzyme], self.exception_pattern()
        return f"(?!(?:{exception}))(?:{rule})" if exception else f"(?:{rule})"


def fragments(protein: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """Fragments between cleavage sites; the last is empty where the last residue is a site."""
    marked = F.regexp_replace(protein, F.lit(cleavage.pattern()), F.lit(f"$0\\{_MARK}"))
    return F.split(marked, r"\|", -1)


def cleavage_sites(protein: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """Positions of the cleavage sites: the ends of all fragments but the last."""
    sizes = let(fragments(protein, cleavage), lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length))
    return F.aggregate(
        sizes,
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)),
    )


def cleave_and_stop_sites(protein: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """Cleavage sites, and both sides of every `*` within the protein; sorted, each once."""
    from ribospark.functions.sequence import stop_sites

    stops = stop_sites(protein)
    before = F.filter(stops, lambda i: i > 0)
    after = F.filter(F.transform(stops, lambda i: i + 1), lambda i: i < F.length(protein))
    return F.array_sort(F.array_distinct(F.concat(cleavage_sites(protein, cleavage), before, after)))


def first_cleave_or_stop_site(protein: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """The least of ``cleave_and_stop_sites``; -1 if there is none."""
    return F.coalesce(F.array_min(cleave_and_stop_sites(protein, cleavage)), F.lit(-1))


def mass(peptide: Column) -> Column:
    """Average molecular weight; null if a letter has no mass. Letters are counted by what is left without them."""
    n = F.length(peptide)
    total = F.lit(0.0)
    for letter, m in fixed.MASSES.items():
        total = total + (n - F.length(F.replace(peptide, F.lit(letter), F.lit("")))) * m
    known = ~peptide.rlike(f"[^{''.join(fixed.MASSES)}]")
    return F.when(peptide == "", F.lit(0.0)).when(known, total - (n - 1) * fixed.WATER)


def _windows(parts: Column, misses: int, starts_clipped: Column) -> Column:
    """All joins of 1 to ``misses`` + 1 neighbouring fragments, and those from the start without a leading M."""
    n = F.size(parts)

    def from_fragment(part, i):
        counts = F.sequence(F.lit(1), F.least(F.lit(misses + 1), n - i))
        return F.transform(counts, lambda k: F.array_join(F.slice(parts, i + 1, k), ""))

    every = F.flatten(F.transform(parts, from_fragment))
    first = F.transform(F.sequence(F.lit(1), F.least(F.lit(misses + 1), n)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ""))
    clipped = F.transform(F.filter(first, lambda p: p.startswith("M")), lambda p: F.substring(p, 2, 1_000_000_000))
    return F.concat(every, F.when(starts_clipped, clipped).otherwise(F.array().cast("array<string>")))


def is_sized(peptide: Column, cleavage: Cleavage) -> Column:
    return F.length(peptide).between(cleavage.min_length, cleavage.max_length)


#: Mass of the lightest residue: a peptide of n residues has at least n times this, and water.
_LIGHTEST = min(fixed.MASSES.values()) - fixed.WATER


def _heavy(peptide: Column, least: float, inclusive: bool) -> Column:
    """Whether a peptide reaches the least mass and all its letters have one. Most are long enough to need no sum."""
    known = ~peptide.rlike(f"[^{''.join(fixed.MASSES)}]")
    m = mass(peptide)
    return known & ((F.length(peptide) * _LIGHTEST + fixed.WATER > least + 0.01) | ((m >= least) if inclusive else (m > least)))


def is_valid_digest(peptide: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """Digestion keeps what has the size, no X, and more than the least mass."""
    return is_sized(peptide, cleavage) & _heavy(peptide, cleavage.min_mw, False)


def is_valid_variant(peptide: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """Callers keep what has the size, no X, and at least the least mass."""
    return is_sized(peptide, cleavage) & _heavy(peptide, cleavage.min_mw, True)


def digest(protein: Column, cleavage: Cleavage = Cleavage(), cds_start_nf: Column | bool = False) -> Column:
    """Array of the valid peptides of a protein, repeats kept; its size is tested before its mass is summed."""
    nf = cds_start_nf if isinstance(cds_start_nf, Column) else F.lit(cds_start_nf)
    windows = let(fragments(protein, cleavage), lambda parts: _windows(parts, cleavage.miscleavage, ~nf))
    return F.filter(windows, lambda p: is_valid_digest(p, cleavage))


def miscleavages(peptide: Column, cleavage: Cleavage = Cleavage()) -> Column:
    """Cleavage sites inside a peptide."""
    parts = fragments(peptide, cleavage)
    return F.size(parts) - 1 - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


class Digester:
    """The valid peptides of one protein after another, as ``digest`` has them."""

    def __init__(self, cleavage: Cleavage):
        self.cleavage = cleavage
        self.site = re.compile(cleavage.pattern())
        self.unknown = re.compile(f"[^{''.join(fixed.MASSES)}]")
        #: Peptides of so many residues are heavy enough whatever they are.
        self.enough = (cleavage.min_mw + 0.01 - fixed.WATER) / _LIGHTEST

    def _is_valid(self, peptide: str) -> bool:
        return not self.unknown.search(peptide) and (
            len(peptide) > self.enough or sum(map(fixed.MASSES.__getitem__, peptide)) - (len(peptide) - 1) * fixed.WATER > self.cleavage.min_mw
        )

    def peptides(self, protein: str, nf: bool = False) -> list[str]:
        low, high, misses = self.cleavage.min_length, self.cleavage.max_length, self.cleavage.miscleavage
        ends = [0, *(m.end() for m in self.site.finditer(protein)), len(protein)]
        found = [protein[a:b] for i, a in enumerate(ends) for b in ends[i + 1 : i + misses + 2] if low <= b - a <= high]
        if protein.startswith("M") and not nf:
            found += [protein[1:b] for b in ends[1 : misses + 2] if low < b <= high + 1]
        return list(filter(self._is_valid, found))


def digest_rows(proteins: DataFrame, cleavage: Cleavage = Cleavage(), seq: str = "seq", keep: Sequence[str] = (), nf: str | None = None, distinct: bool = False) -> DataFrame:
    """(keep…, pep): the peptides of every protein, one a row, with the columns ``keep`` of its row. Null proteins give none.

    The same as exploding ``digest``, by Arrow batches: lambdas over arrays aren't compiled, and digesting whole proteomes
    takes several times as long with them. With ``distinct`` a protein gives a row once, and without ``keep`` a thousand do.
    """
    columns = [*keep, seq, *([nf] if nf else [])]
    schema = ", ".join([*(f"`{c}` {proteins.schema[c].dataType.simpleString()}" for c in keep), "pep string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = Digester(cleavage)
        # few proteins at a time, so that a worker holds the peptides of no more
        for batch in (b.slice(at, 1_000) for b in batches for at in range(0, b.num_rows, 1_000)):
            texts = batch.column(len(keep)).to_pylist()
            incomplete = batch.column(len(keep) + 1).to_pylist() if nf else [False] * len(texts)
            at, found = [], []
            for i, (text, part) in enumerate(zip(texts, incomplete, strict=True)):
                if text:
                    own = digester.peptides(text, bool(part))
                    own = dict.fromkeys(own) if distinct else own
                    found += own
                    at += [i] * len(own)
            if distinct and not keep:
                found = list(dict.fromkeys(found))
            rows = pa.array(at[: len(found)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(keep))), pa.array(found, pa.string())], [*keep, "pep"])

    return proteins.select(*columns).mapInArrow(run, schema)


def canonical_pool(proteins: DataFrame, cleavage: Cleavage = Cleavage(), seq: str = "seq") -> DataFrame:
    """(seq): the distinct canonical peptides of a proteome, each also with L for I.

    A leading X is stripped and the protein ends at its first `*`. With a boolean column ``cds_start_nf`` the clipped
    peptides of incomplete proteins are left out. Null proteins and an empty proteome give no peptides. The distinct
    aggregates on the map side first, so one peptide in many proteins costs one row per task.
    """
    protein = F.substring_index(F.regexp_replace(seq, "^X+", ""), "*", 1)
    nf = "cds_start_nf" if "cds_start_nf" in proteins.columns else None
    peptides = digest_rows(proteins.withColumn("__protein", protein), cleavage, "__protein", nf=nf, distinct=True)
    both = F.when(F.col("pep").contains("I"), F.array("pep", F.translate("pep", "I", "L"))).otherwise(F.array("pep"))
    return peptides.select(F.explode(both).alias("seq")).distinct()
