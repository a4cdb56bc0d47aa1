"""Outputs of variant callers as DataFrames, one function per format. Columns keep the callers' own coordinates.

Each takes paths, or a DataFrame of lines (``text.read_lines``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribospark.sources.text import read_lines


def _rows(spark: SparkSession, path, comment: str | None = "#") -> DataFrame:
    """(pos, f): the tab-separated fields of every line that isn't blank or a comment."""
    lines = read_lines(spark, path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), "pos")
    keep = F.trim("value") != ""
    if comment:
        keep = keep & ~F.col("value").startswith(comment)
    return lines.where(keep).select("pos", F.split("value", "\t").alias("f"))


def _positional(rows: DataFrame, names: Sequence[str], kinds: dict[str, str] | None = None) -> DataFrame:
    kinds = kinds or {}

    def column(i: int, n: str) -> Column:
        v = F.get("f", F.lit(i))
        return (v.try_cast(kinds[n]) if n in kinds else v).alias(n)

    return rows.select("pos", *(column(i, n) for i, n in enumerate(names)))


def _present(c: str) -> Column:
    return F.when(~F.col(c).isin("-", ""), F.col(c))


def _pair(c: str) -> Column:
    """`a/b` as two elements; the second of a single one is empty."""
    parts = F.split(c, "/")
    return F.when(F.size(parts) == 1, F.array(F.get(parts, F.lit(0)), F.lit(""))).otherwise(F.slice(parts, 1, 2))


VEP = ("uploaded_variation", "location", "allele", "gene", "feature", "feature_type", "consequences", "cdna_position",
       "cds_position", "protein_position", "amino_acids", "codons", "existing_variation", "extra")


def vep_tsv(spark: SparkSession, path) -> DataFrame:
    """VEP's default output: consequences as an array, amino acids and codons as pairs, no phase sets."""
    rows = _positional(_rows(spark, path), VEP)
    return rows.withColumns(
        {
            "consequences": F.split("consequences", ","),
            "amino_acids": _pair("amino_acids"),
            "codons": _pair("codons"),
            "sample": F.lit(None).cast("string"),
            "phase_sets": F.array().cast("array<string>"),
        }
    )


def vep_vcf(spark: SparkSession, path: str, samples: Sequence[str] | None = None) -> DataFrame:
    """VEP's VCF output: one row per consequence and sample that carries the allele, with phase sets of phased genotypes.

    A requested sample that the header lacks is an error. Without samples in the file there is one row with sample null.
    """
    text = read_lines(spark, path)
    header = text.where(F.col("value").startswith("#CHROM")).first()
    meta = text.where(F.col("value").startswith("##INFO=<ID=CSQ")).first()
    names = header.value.strip().split("\t")[9:] if header else []
    for s in samples or ():
        if s not in names:
            raise ValueError(f"sample {s!r} isn't in the header of {path}")
    csq = meta.value.split("Format: ")[1].split('"')[0].split("|") if meta else []
    wanted = [n for n in names if not samples or n in samples]
    rows = _rows(spark, path).select("pos", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("chrom", "vcf_pos", "id", "ref", "alts", "qual", "filter", "info", "format"))), "f")
    gt_at = F.array_position(F.split("format", ":"), F.lit("GT")).cast("int") - 1
    carriers = [
        F.struct(F.lit(n).alias("sample"), F.get(F.split(F.get("f", F.lit(9 + names.index(n))), ":"), gt_at).alias("gt")) for n in wanted
    ]
    carriers = carriers or [F.struct(F.lit(None).cast("string").alias("sample"), F.lit(None).cast("string").alias("gt"))]
    entries = F.split(F.regexp_extract("info", r"(?:\A|;)CSQ=([^;]*)", 1), ",")
    start = F.col("vcf_pos").cast("int")
    span = F.length("ref")

    def allele_place(ref: Column, alt: Column) -> tuple[Column, Column]:
        """VEP's location and allele of a VCF allele: what both share at the front is left out."""
        shared = (F.length(ref) != F.length(alt)) & (F.substring(ref, 1, 1) == F.substring(alt, 1, 1))
        a = F.when(shared, F.substring(alt, 2, 1_000_000)).otherwise(alt)
        lo = F.when(shared & (span > 1), start + 1).otherwise(start)
        hi = F.when(shared & (span == 1), start + 1).otherwise(start + span - 1)
        loc = F.when(lo == hi, F.concat_ws(":", "chrom", lo.cast("string"))).otherwise(
            F.concat(F.col("chrom"), F.lit(":"), lo.cast("string"), F.lit("-"), hi.cast("string"))
        )
        return loc, F.when(a == "", "-").otherwise(a)

    per = rows.select("pos", "chrom", "vcf_pos", "id", "ref", F.posexplode(F.split("alts", ",")).alias("n", "alt"), "info", F.explode(F.array(*carriers)).alias("s"), entries.alias("csq"))
    has = F.col("s.gt").isNull() | F.array_contains(F.split("s.gt", r"[|/]"), (F.col("n") + 1).cast("string"))
    loc, allele = allele_place(F.col("ref"), F.col("alt"))
    per = per.where(has).withColumns({"location": loc, "allele": allele}).withColumn("e", F.explode("csq")).withColumn("c", F.split("e", r"\|"))

    def of(name: str) -> Column:
        return F.get("c", F.lit(csq.index(name))) if name in csq else F.lit(None).cast("string")

    phased = F.split("s.gt", r"\|")
    number = F.dense_rank().over(Window.partitionBy("s.sample").orderBy("pos")) * 2
    sets = F.array(
        F.when(F.get(phased, F.lit(0)) == (F.col("n") + 1).cast("string"), F.concat(F.lit("PS"), (number - 1).cast("string"))),
        F.when(F.get(phased, F.lit(1)) == (F.col("n") + 1).cast("string"), F.concat(F.lit("PS"), number.cast("string"))),
    )
    out = per.where(of("Allele") == F.col("allele")).select(
        "pos",
        F.col("id").alias("uploaded_variation"),
        "location",
        "allele",
        of("Gene").alias("gene"),
        of("Feature").alias("feature"),
        of("Feature_type").alias("feature_type"),
        F.split(of("Consequence"), "&").alias("consequences"),
        of("cDNA_position").alias("cdna_position"),
        of("CDS_position").alias("cds_position"),
        of("Protein_position").alias("protein_position"),
        of("Amino_acids").alias("amino_acids"),
        of("Codons").alias("codons"),
        of("Existing_variation").alias("existing_variation"),
        F.lit(None).cast("string").alias("extra"),
        F.col("s.sample").alias("sample"),
        F.when(F.col("s.gt").contains("|"), F.filter(sets, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("phase_sets"),
    )
    return out.withColumns({"amino_acids": _pair("amino_acids"), "codons": _pair("codons")})


REDITOOLS = ("region", "position", "reference", "strand", "coverage_q", "mean_quality", "base_count", "all_subs", "frequency",
             "g_coverage_q", "g_mean_quality", "g_base_count", "g_all_subs", "g_frequency")


def reditools(spark: SparkSession, path, transcript_column: int = 17) -> DataFrame:
    """REDItools tables with annotation: base counts as an array, substitutions as pairs, transcripts as (tx_id, feature)."""
    rows = _rows(spark, path, None).where(F.get("f", F.lit(0)) != "Region")
    kinds = {"position": "int", "strand": "int", "coverage_q": "int", "mean_quality": "double", "frequency": "double", "g_coverage_q": "int"}
    out = _positional(rows.select("pos", "f"), REDITOOLS, kinds)
    tx = F.regexp_replace(F.get("f", F.lit(transcript_column - 1)), r"[,&$]+\z", "")
    texts = rows.select("pos", tx.alias("tx"))
    pairs = F.transform(
        F.filter(F.split("tx", r"[,&$]"), lambda t: t.contains("-")),
        lambda t: F.struct(F.regexp_extract(t, r"\A(.*)-([^-]*)\z", 1).alias("tx_id"), F.regexp_extract(t, r"\A(.*)-([^-]*)\z", 2).alias("feature")),
    )
    return out.join(texts.select("pos", pairs.alias("transcripts")), "pos").withColumns(
        {
            "base_count": F.from_json("base_count", "array<int>"),
            "all_subs": F.transform(F.filter(F.split("all_subs", " "), lambda s: F.length(s) == 2), lambda s: F.struct(F.substring(s, 1, 1).alias("ref"), F.substring(s, 2, 1).alias("alt"))),
        }
    )


def _named(spark: SparkSession, path, wanted: dict[str, tuple[str, str]], marked: bool = True) -> DataFrame:
    """Columns by the names of the header line; one that the file lacks is null. ``wanted`` maps output to (name, type)."""
    first = read_lines(spark, path).where(F.trim("value") != "")
    head = (first.where(F.col("value").startswith("#") & ~F.col("value").startswith("##")) if marked else first).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head.value.strip("\r\n").lstrip("#").split("\t")
    rows = _rows(spark, path)
    if not marked:
        rows = rows.where(F.get("f", F.lit(0)) != names[0])

    def column(name: str, kind: str) -> Column:
        v = F.get("f", F.lit(names.index(name))) if name in names else F.lit(None).cast("string")
        return v if kind == "string" else v.try_cast(kind)

    return rows.select("pos", *(column(n, k).alias(c) for c, (n, k) in wanted.items()))


def _breakpoint(c: str, end: int) -> Column:
    return F.get(F.split(c, ":"), F.lit(end))


def star_fusion(spark: SparkSession, path) -> DataFrame:
    """STAR-Fusion predictions, with or without est_J and est_S. Genes are the ids after the last `^`."""
    wanted = {
        "fusion_name": ("FusionName", "string"), "junction_read_count": ("JunctionReadCount", "int"), "spanning_frag_count": ("SpanningFragCount", "int"),
        "est_j": ("est_J", "double"), "est_s": ("est_S", "double"), "splice_type": ("SpliceType", "string"), "left_gene": ("LeftGene", "string"),
        "left_breakpoint": ("LeftBreakpoint", "string"), "right_gene": ("RightGene", "string"), "right_breakpoint": ("RightBreakpoint", "string"),
        "ffpm": ("FFPM", "double"), "annots": ("annots", "string"),
    }
    rows = _named(spark, path, wanted)
    return rows.withColumns({g: F.substring_index(g, "^", -1) for g in ("left_gene", "right_gene")})


def fusion_catcher(spark: SparkSession, path) -> DataFrame:
    names = ("five_end_gene_symbol", "three_end_gene_symbol", "fusion_description", "counts_of_common_mapping_reads", "spanning_pairs",
             "spanning_unique_reads", "longest_anchor_found", "fusion_finding_method", "left_breakpoint", "right_breakpoint", "left_gene",
             "right_gene", "five_end_exon_id", "three_end_exon_id", "fusion_sequence", "predicted_effect")
    kinds = {n: "int" for n in ("counts_of_common_mapping_reads", "spanning_pairs", "spanning_unique_reads", "longest_anchor_found")}
    return _positional(_rows(spark, path).where(~F.get("f", F.lit(0)).startswith("Gene_1_symbol")), names, kinds)


ARRIBA_CONFIDENCE = ("low", "medium", "high")


def arriba(spark: SparkSession, path) -> DataFrame:
    """Arriba fusions; confidence also as its ordinal, strands as numbers (annotated, in the fusion)."""
    names = ("gene1", "gene2", "strand1", "strand2", "left_breakpoint", "right_breakpoint", "site1", "site2", "type", "split_reads1",
             "split_reads2", "discordant_mates", "coverage1", "coverage2", "confidence", "reading_frame", "tags",
             "retained_protein_domains", "closest_genomic_breakpoint1", "closest_genomic_breakpoint2", "left_gene", "right_gene",
             "transcript_id1", "transcript_id2", "direction1", "direction2", "filters", "fusion_transcript", "peptide_sequence",
             "read_identifiers")
    kinds = {n: "int" for n in ("split_reads1", "split_reads2", "discordant_mates", "coverage1", "coverage2")}
    rank = F.array_position(F.array(*(F.lit(c) for c in ARRIBA_CONFIDENCE)), F.col("confidence")) - 1

    def number(s: Column) -> Column:
        return F.when(s == "+", 1).when(s == "-", -1)

    strands = {f"transcript_strand{i}": number(F.get(F.split(f"strand{i}", "/"), F.lit(1))) for i in (1, 2)}
    return _positional(_rows(spark, path), names, kinds).withColumns({"confidence_rank": rank, **strands})


_RMATS_EXONS = {
    "SE": {"exon_start": "exonStart_0base", "exon_end": "exonEnd", "upstream_exon_start": "upstreamES", "upstream_exon_end": "upstreamEE", "downstream_exon_start": "downstreamES", "downstream_exon_end": "downstreamEE"},
    "A5SS": {"long_exon_start": "longExonStart_0base", "long_exon_end": "longExonEnd", "short_exon_start": "shortES", "short_exon_end": "shortEE", "flanking_exon_start": "flankingES", "flanking_exon_end": "flankingEE"},
    "MXE": {"first_exon_start": "1stExonStart_0base", "first_exon_end": "1stExonEnd", "second_exon_start": "2ndExonStart_0base", "second_exon_end": "2ndExonEnd", "upstream_exon_start": "upstreamES", "upstream_exon_end": "upstreamEE", "downstream_exon_start": "downstreamES", "downstream_exon_end": "downstreamEE"},
    "RI": {"retained_intron_exon_start": "riExonStart_0base", "retained_intron_exon_end": "riExonEnd", "upstream_exon_start": "upstreamES", "upstream_exon_end": "upstreamEE", "downstream_exon_start": "downstreamES", "downstream_exon_end": "downstreamEE"},
}
_RMATS_EXONS["A3SS"] = _RMATS_EXONS["A5SS"]
RMATS_EVENTS = ("SE", "A5SS", "A3SS", "MXE", "RI")


def rmats(spark: SparkSession, path, event: str) -> DataFrame:
    """rMATS tables of one event type: quotes off, counts as arrays, NA as null. Coordinates are 0-based, half-open."""
    if event not in RMATS_EVENTS:
        raise ValueError(f"event must be one of {RMATS_EVENTS}")
    wanted = {"gene_id": ("GeneID", "string"), "gene_symbol": ("geneSymbol", "string"), "chrom": ("chr", "string")}
    wanted |= {c: (n, "int") for c, n in _RMATS_EXONS[event].items()}
    counts = ("IJC_SAMPLE_1", "SJC_SAMPLE_1", "IJC_SAMPLE_2", "SJC_SAMPLE_2")
    wanted |= {n.lower(): (n, "string") for n in counts}
    wanted |= {"inc_form_len": ("IncFormLen", "int"), "skip_form_len": ("SkipFormLen", "int"), "pvalue": ("PValue", "double"), "fdr": ("FDR", "double")}
    rows = _named(spark, path, wanted, marked=False)
    numbers = {n.lower(): F.transform(F.filter(F.split(n.lower(), ","), lambda x: x != ""), lambda x: x.try_cast("int")) for n in counts}
    return rows.withColumns({c: F.trim(F.translate(c, '"', "")) for c in ("gene_id", "gene_symbol")} | numbers).withColumn("event", F.lit(event))


def circexplorer(spark: SparkSession, path, version: int = 2) -> DataFrame:
    """CIRCexplorer 2 or 3 known circles; the scores of version 3 are null for version 2. 0-based, half-open."""
    names = ["chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "exon_count", "exon_sizes", "exon_offsets",
             "read_number", "circ_type", "gene_name", "isoform_name", "exon_index", "flank_intron", "fpb_circ", "fpb_linear", "circ_score"]
    kinds = {n: "int" for n in ("start", "end", "thick_start", "thick_end", "exon_count", "read_number")}
    kinds |= {n: "double" for n in ("score", "fpb_circ", "fpb_linear", "circ_score")}
    out = _positional(_rows(spark, path), names, kinds)
    lists = {n: F.transform(F.filter(F.split(n, ","), lambda x: x != ""), lambda x: x.try_cast("int")) for n in ("exon_sizes", "exon_offsets")}
    out = out.withColumns(lists)
    return out if version == 3 else out.withColumns({n: F.lit(None).cast("double") for n in ("fpb_circ", "fpb_linear", "circ_score")})
