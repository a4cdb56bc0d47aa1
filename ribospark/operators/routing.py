"""Variants on their way to the caller: from gene to transcript coordinates, and into the kind of work they belong to.

Each record meets its transcript by id; everything else is arithmetic over the transcript's exon array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribospark.functions import fixed, intervals
from ribospark.functions.sequence import slice_of
from ribospark.operators import reference as ref


def frames_shifted(start: Column, end: Column, alt: Column, kind: Column, donor_start: Column, donor_end: Column) -> Column:
    """(reference length − alternative length) mod 3; 0 for a fusion."""
    donor = donor_end - donor_start
    alt_len = F.when(kind == "Insertion", donor + 1).when(kind == "Substitution", donor).when(kind == "Deletion", 1).otherwise(F.length(alt))
    return F.when(kind == "Fusion", 0).otherwise(F.pmod(end - start - alt_len, F.lit(3)))


def is_frameshifting(start: Column, end: Column, alt: Column, kind: Column, donor_start: Column, donor_end: Column) -> Column:
    return (kind == "Fusion") | (frames_shifted(start, end, alt, kind, donor_start, donor_end) != 0)


def predicates(df: DataFrame) -> DataFrame:
    """Boolean columns of what a variant is."""
    ref_n, alt_n, kind = F.length("ref"), F.length("alt"), F.col("type")
    small = kind.isin(*fixed.SMALL_TYPES)
    return df.withColumns(
        {
            "is_snv": small & (ref_n == 1) & (alt_n == 1),
            "is_indel": small & (ref_n != alt_n),
            "is_insertion": (kind == "Insertion") | (small & (ref_n == 1) & (alt_n > 1)),
            "is_deletion": (kind == "Deletion") | (small & (ref_n > 1) & (alt_n == 1)),
            "is_fusion": kind == "Fusion",
            "is_circ_rna": kind == "circRNA",
            "is_alternative_splicing": kind.isin(*fixed.SPLICING_TYPES),
            "is_merged_mnv": F.coalesce(F.map_contains_key("attrs", F.lit("MERGED_MNV")), F.lit(False)),
            "has_transcript": F.coalesce(F.map_contains_key("attrs", F.lit("TRANSCRIPT_ID")), F.lit(False)),
        }
    )


def dedup(variants: DataFrame) -> DataFrame:
    """One record per (transcript, location, alleles, type and donor): the same variant from several files is one."""
    donor = [F.col("attrs")[k].alias(f"__{k}") for k in ("START", "END", "DONOR_START", "DONOR_END", "ACCEPTER_TRANSCRIPT_ID", "ACCEPTER_POSITION")]
    keyed = variants.select("*", *donor)
    keys = ["tx_id", "gene_id", "start", "end", "ref", "alt", "type", *(c for c in keyed.columns if c.startswith("__"))]
    return keyed.dropDuplicates(keys).select(*variants.columns)


def order(kind: str = "start") -> list[Column]:
    """Order of variants: place, strand, end, then alternative and type."""
    return [F.col(kind), F.col("end"), F.col("alt"), F.col("type")]


def locate(variants: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """Variants with ``tx_start, tx_end`` (null ends are intronic), ``bucket`` and their transcript's columns.

    bucket is fusion, transcriptional, intronic, spanning (one end in an exon, the other in an intron: unusable) or
    outside. Donor breakpoints of fusions snap to the end of the exon before, and keep the intron in between as
    ``left_insert``; the accepter is looked up likewise.
    """
    g = genes.select(F.col("gene_id").alias("g_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("strand").alias("g_strand"))
    t = transcripts.select(F.col("tx_id").alias("t_id"), F.col("exons"), F.col("strand").alias("t_strand"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    joined = variants.join(t, F.col("tx_id") == F.col("t_id")).join(g, F.col("gene_id") == F.col("g_id"))

    def genomic(p: Column) -> Column:
        return intervals.gene_to_genomic(p, F.col("g_start"), F.col("g_end"), F.col("g_strand"))

    def gene(p: Column) -> Column:
        return intervals.genomic_to_gene(p, F.col("g_start"), F.col("g_end"), F.col("g_strand"))

    def on_transcript(p: Column) -> Column:
        return ref.genomic_to_transcript(genomic(p), F.col("exons"), F.col("t_strand"))

    fusion = F.col("type") == "Fusion"
    before = genomic(F.col("start") - 1)
    exonic = ref.genomic_to_transcript(before, F.col("exons"), F.col("t_strand")).isNotNull()
    snapped = gene(ref.upstream_exon_end(before, F.col("exons"), F.col("t_strand"))) + 1
    kept = [c for c in joined.columns if c not in ("start", "end")]
    moved = joined.withColumn("at", F.when(fusion & ~exonic, snapped)).select(
        *kept,
        F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("start"), F.col("start").alias("end"))).alias("left_insert"),
        F.coalesce("at", "start").alias("start"),
        F.coalesce(F.col("at") + 1, F.col("end")).alias("end"),
    )
    a = on_transcript(F.col("start") - F.when(fusion, 1).otherwise(0))
    b = on_transcript(F.col("end") - 1)
    placed = moved.withColumns({"a": a, "b": b})
    inside = intervals.overlaps(
        F.least(genomic(F.col("start")), genomic(F.col("end") - 1)), F.greatest(genomic(F.col("start")), genomic(F.col("end") - 1)) + 1,
        F.col("t_start"), F.col("t_end"),
    )
    bucket = (
        F.when(fusion & F.col("a").isNotNull(), "fusion")
        .when(fusion, "outside")
        .when(F.col("a").isNotNull() & F.col("b").isNotNull(), "transcriptional")
        .when(F.col("a").isNotNull() | F.col("b").isNotNull(), "spanning")
        .when(inside, "intronic")
        .otherwise("outside")
    )
    deletion = F.col("type") == "Deletion"
    return placed.withColumns(
        {
            "bucket": bucket,
            "tx_start": F.when(fusion, F.col("a") + 1).when(deletion, F.col("a") - 1).otherwise(F.col("a")),
            "tx_end": F.when(fusion, F.col("a") + 2).otherwise(F.col("b") + 1),
        }
    ).drop("a", "b", "g_id", "t_id", "g_start", "g_end", "g_strand", "t_start", "t_end", "exons", "t_strand")


def accepter(fusions: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """Fusions with ``acc_tx, acc_gene, acc_tx_pos`` and ``right_insert``: the accepter's breakpoint snapped to the next exon."""
    attrs = F.col("attrs")
    named = fusions.withColumns(
        {
            "acc_tx": attrs["ACCEPTER_TRANSCRIPT_ID"],
            "acc_gene": attrs["ACCEPTER_GENE_ID"],
            "acc_pos": attrs["ACCEPTER_POSITION"].cast("int"),
        }
    )
    g = genes.select(F.col("gene_id").alias("g_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("strand").alias("g_strand"))
    t = transcripts.select(F.col("tx_id").alias("t_id"), "exons", F.col("strand").alias("t_strand"))
    joined = named.join(g, F.col("acc_gene") == F.col("g_id")).join(t, F.col("acc_tx") == F.col("t_id"))
    at = intervals.gene_to_genomic(F.col("acc_pos"), F.col("g_start"), F.col("g_end"), F.col("g_strand"))
    here = ref.genomic_to_transcript(at, F.col("exons"), F.col("t_strand"))
    down = ref.downstream_exon_start(at, F.col("exons"), F.col("t_strand"))
    down_gene = intervals.genomic_to_gene(down, F.col("g_start"), F.col("g_end"), F.col("g_strand"))
    return joined.withColumns(
        {
            "right_insert": F.when(here.isNull(), F.struct(F.col("acc_pos").alias("start"), down_gene.alias("end"))),
            "acc_tx_pos": F.coalesce(here, ref.genomic_to_transcript(down, F.col("exons"), F.col("t_strand"))),
        }
    ).drop("g_id", "t_id", "g_start", "g_end", "g_strand", "exons", "t_strand").where("acc_tx_pos is not null")


def on_gene(variants: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """Variants on transcripts (tx_id, start, end, ref, alt, type, id, …) with their start, end and ref on the gene.

    A deletion written with the base after it ends at the last base deleted. ``status`` is ok, unknown transcript, or
    spans an intron where the interval on the gene is longer and the variant is no deletion; a deletion's ref is then
    the one its id names.
    """
    g = genes.select(F.col("gene_id").alias("g_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("strand").alias("g_strand"))
    t = transcripts.select(F.col("tx_id").alias("t_id"), F.col("gene_id").alias("t_gene"), "exons", F.col("strand").alias("t_strand"))
    rows = variants.join(t, F.col("tx_id") == F.col("t_id"), "left").join(g, F.col("t_gene") == F.col("g_id"), "left")
    deletion = (F.col("type") == "INDEL") & (F.length("ref") > F.length("alt"))
    after = deletion & (F.length("alt") == 1) & (F.substring("ref", -1, 1) == F.col("alt")) & (F.substring("ref", 1, 1) != F.col("alt"))

    def gene(index: Column) -> Column:
        at = ref.transcript_to_genomic(index, F.col("exons"), F.col("t_strand"))
        return intervals.genomic_to_gene(at, F.col("g_start"), F.col("g_end"), F.col("g_strand"))

    placed = rows.withColumns({"__a": gene(F.col("start")), "__b": F.when(after, gene(F.col("end") - 2) + 2).otherwise(gene(F.col("end") - 1) + 1)})
    longer = F.col("__b") - F.col("__a") != F.col("end") - F.col("start")
    status = F.when(F.col("t_id").isNull(), "unknown transcript").when(longer & ~deletion, "spans an intron").otherwise("ok")
    named = F.when(longer & deletion, F.get(F.split("id", "-"), F.lit(2))).otherwise(F.col("ref"))
    kept = [c for c in variants.columns if c not in ("start", "end", "ref", "gene_id")]
    return placed.select(F.col("t_gene").alias("gene_id"), F.col("__a").alias("start"), F.col("__b").alias("end"), named.alias("ref"), *kept, status.alias("status"))


def strictly_within(variants: DataFrame, segments: DataFrame, inclusive: bool = False) -> DataFrame:
    """Variants inside some segment (gene_id, seg_start, seg_end): strictly, or including its ends."""
    s = segments.select(F.col("gene_id").alias("seg_gene"), "seg_start", "seg_end")
    inside = (
        (F.col("seg_start") <= F.col("start")) & (F.col("end") <= F.col("seg_end"))
        if inclusive
        else (F.col("seg_start") < F.col("start")) & (F.col("end") < F.col("seg_end"))
    )
    return variants.join(s, (F.col("gene_id") == F.col("seg_gene")) & inside, "left_semi")


def adjacent_mnvs(variants: DataFrame, k: int = 2, start: str = "start", end: str = "end", unit: str = "tx_id") -> DataFrame:
    """Merged variants of 2 to ``k`` neighbours of one class (SNV with editing sites, INDEL with INDEL), of one unit.

    Each next one starts where the first ends, for a third one too. The id counts its position from 0.
    """
    klass = F.when(F.col("type").isin("SNV", "RNAEditingSite"), "SNV").when(F.col("type") == "INDEL", "INDEL")
    small = variants.select(F.col(unit).alias("u"), F.col(start).alias("s"), F.col(end).alias("e"), "ref", "alt", "id", klass.alias("k")).where("k is not null")
    chains = small.select("u", "k", "s", F.col("e").alias("e0"), F.col("e"), "ref", "alt", F.array("id").alias("ids"), F.struct("s", "e", "alt", "id").alias("last"))
    out = None
    for _ in range(1, k):
        n = small.select(F.col("u").alias("u2"), F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("ref").alias("r2"), F.col("alt").alias("a2"), F.col("id").alias("i2"))
        nxt = chains.join(n, (F.col("u") == F.col("u2")) & (F.col("k") == F.col("k2")) & (F.col("e0") == F.col("s2")))
        after = F.struct(F.col("s2").alias("s"), F.col("e2").alias("e"), F.col("a2").alias("alt"), F.col("i2").alias("id"))
        chains = nxt.where(after > F.col("last")).select(
            "u", "k", "s", "e0", F.col("e2").alias("e"), F.concat("ref", "r2").alias("ref"), F.concat("alt", "a2").alias("alt"), F.concat("ids", F.array("i2")).alias("ids"), after.alias("last")
        )
        out = chains if out is None else out.unionByName(chains)
    if out is None:
        out = chains.limit(0)
    return out.select(
        F.col("u").alias(unit), F.col("s").alias(start), F.col("e").alias(end), "ref", "alt", F.lit("MNV").alias("type"),
        F.concat_ws("-", F.lit("MNV"), F.col("s").cast("string"), "ref", "alt").alias("id"), "ids",
    )


def hypermutated(variants: DataFrame, distance: int = 6, unit: str = "tx_id", start: str = "start", end: str = "end") -> DataFrame:
    """(unit, n_regions, largest): chains of variants less than ``distance`` apart, and the size of the largest.

    A skew hint: the work on a unit grows exponentially with it, not with the number of variants.
    """
    w = Window.partitionBy(unit).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) - reach >= distance), 1).otherwise(0)
    chained = variants.select(unit, start, end, fresh.alias("fresh")).withColumn("region", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = chained.groupBy(unit, "region").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(unit).agg(F.count(F.lit(1)).alias("n_regions"), F.max("n").alias("largest"))


def noncanonical_only(variants: DataFrame) -> DataFrame:
    """Variants of the transcripts that have a fusion or a splicing variant."""
    some = variants.where(F.col("type").isin("Fusion", *fixed.SPLICING_TYPES)).select("tx_id").distinct()
    return variants.join(some, "tx_id", "left_semi")


def end_inclusion(seq: Column) -> list[Column]:
    """start, end, ref and alt of a variant written with the base after it instead of the one before."""
    base = slice_of(seq, F.col("end"), F.col("end") + 1)
    return [
        (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"),
        F.concat(F.substring("ref", 2, 1_000_000_000), base).alias("ref"), F.concat(F.substring("alt", 2, 1_000_000_000), base).alias("alt"),
    ]
