"""Interval predicates and coordinate arithmetic as columns; intervals are 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether a holds all of b."""
    return (a_start <= b_start) & (b_end <= a_end)


def holds(start: Column, end: Column, position: Column) -> Column:
    return (start <= position) & (position < end)


def intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """struct<start, end>, null where a and b don't overlap."""
    return F.when(
        overlaps(a_start, a_end, b_start, b_end),
        F.struct(F.greatest(a_start, b_start).alias("start"), F.least(a_end, b_end).alias("end")),
    )


def strand_level(strand: Column) -> Column:
    """Rank of a strand in the order of locations: none, 0, -1, +1."""
    return F.when(strand.isNull(), 0).when(strand == 0, 1).when(strand == -1, 2).otherwise(3)


def genomic_to_gene(position: Column, start: Column, end: Column, strand: Column) -> Column:
    """Position in a gene, counted along its strand; null outside the gene."""
    inside = F.when(strand == -1, end - 1 - position).otherwise(position - start)
    return F.when(holds(start, end, position), inside)


def gene_to_genomic(position: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == -1, end - 1 - position).otherwise(start + position)


def range_gene_to_genomic(a: Column, b: Column, start: Column, end: Column, strand: Column) -> Column:
    """Interval [a, b) of gene coordinates as struct<start, end> on the genome; both ends swap on the - strand."""
    return F.when(strand == -1, F.struct((end - b).alias("start"), (end - a).alias("end"))).otherwise(
        F.struct((start + a).alias("start"), (start + b).alias("end"))
    )


def range_genomic_to_gene(a: Column, b: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == -1, F.struct((end - b).alias("start"), (end - a).alias("end"))).otherwise(
        F.struct((a - start).alias("start"), (b - start).alias("end"))
    )


def codon_range(start: Column, end: Column, frame: Column) -> Column:
    """Amino acids touched by a DNA interval in a reading frame: struct<start, end>, rounded outwards."""
    return F.struct(
        F.floor((start - frame) / 3).cast("int").alias("start"), F.ceil((end - frame) / 3).cast("int").alias("end")
    )
