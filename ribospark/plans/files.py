"""Queries of the readers and writers of files, with SQL. Lines are made of the driver's tables and go through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribospark.functions import labels
from ribospark.functions import sequence as sq
from ribospark.operators import pool, reference, routing
from ribospark.plans.genomics import _base, _gene, _lines, _named, _on_genes, _W, world
from ribospark.plans.peptides import _LABELLED, labelled
from ribospark.session import table
from ribospark.sources import callers, gvf, sinks, text

_HEX, _AMINO = "0123456789abcdef", "ACDEFGHIKLMNPQRS"


# --- sequences and annotation ------------------------------------------------------------------------------------------


def genome_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Contigs written as wrapped FASTA records and read again."""
    genome = world(_base(spark, d)).genome
    records = genome.select(sinks.fasta_record(F.concat("seqname", F.lit(" a contig|x")), F.col("seq")).alias("value"))
    return text.genome(spark, records)


def _proteins(spark: SparkSession, d: str, header: Column) -> DataFrame:
    seq = F.translate(F.md5("transcript_id"), _HEX, _AMINO)
    return table(spark, d, "transcripts").select("transcript_id", "gene_id").distinct().select(sinks.fasta_record(header, seq, 20).alias("value"))


def proteome_gencode(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat_ws("|", F.concat(F.lit("P"), "transcript_id"), "transcript_id", "gene_id", F.lit("-"), F.lit("x"))
    return text.proteome(spark, _proteins(spark, d, header), "GENCODE")


def proteome_ensembl(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("P"), "transcript_id", F.lit(" pep chromosome:x:1 gene:"), "gene_id", F.lit(" transcript:"), "transcript_id", F.lit(" gene_biotype:x"))
    return text.proteome(spark, _proteins(spark, d, header), "ENSEMBL")


def header_styles(spark: SparkSession, d: str) -> DataFrame:
    """The vote on the style of a proteome, for either kind."""
    gencode = text.fasta(spark, _proteins(spark, d, F.concat_ws("|", "transcript_id", "transcript_id", "gene_id")))
    ensembl = text.fasta(spark, _proteins(spark, d, F.concat(F.lit("P pep x gene:"), "gene_id", F.lit(" transcript:"), "transcript_id")))
    return spark.createDataFrame([("a", text.header_style(gencode)), ("b", text.header_style(ensembl))], "kind string, style string")


def _annotation(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an annotation of the made genome: genes, transcripts, exons and CDS."""
    ref = world(_base(spark, d))
    none = F.lit(None).cast("string")
    shared = [F.col("chrom").alias("seqname"), F.lit("made").alias("source")]

    def rows(df: DataFrame, feature: str, start: Column, end: Column, frame: Column, *ids: Column) -> DataFrame:
        names = ("gene_id", "transcript_id", "protein_id", "gene_name", "gene_type", "gene_biotype", "is_protein_coding")
        values = dict(zip(names, [*ids, *[none] * 7], strict=False))
        return df.select(
            F.col("pos"), *shared, F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), F.col("strand"), frame.alias("frame"),
            *(values[n].alias(n) for n in names), F.array(F.lit("basic"), F.lit(feature)).alias("tags"),
        )

    no = F.lit(None).cast("int")
    t, ids = ref.transcripts, [F.col("gene_id"), F.col("tx_id"), none, F.col("gene_name"), F.col("biotype")]
    parts = [rows(ref.genes, "gene", F.col("start"), F.col("end"), no, F.col("gene_id"), none, none, F.col("gene_name"), F.lit("protein_coding")), rows(t, "transcript", F.col("start"), F.col("end"), no, *ids)]
    for column, feature in (("exons", "exon"), ("cds", "CDS"), ("utr", "UTR")):
        each = t.select("*", F.explode(column).alias("e"))
        parts.append(rows(each, feature, F.col("e.start"), F.col("e.end"), F.col("e.frame") if feature == "CDS" else no, *ids))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return text.gtf(spark, sinks.gtf_lines(out))


def _spans(c: str) -> Column:
    return F.array_join(F.transform(c, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",").alias(c)


def gtf_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcript models of annotation lines that were written and read again."""
    t = reference.transcripts_of(_annotation(spark, d))
    return t.select("tx_id", "gene_id", "chrom", "strand", "start", "end", "biotype", _spans("exons"), F.aggregate("cds", F.lit(0), lambda a, e: a + e["end"] - e["start"] + e["frame"]).alias("coded"), F.size("utr").alias("n_utr"))


def gtf_genes(spark: SparkSession, d: str) -> DataFrame:
    return reference.genes_of(_annotation(spark, d)).select("gene_id", "gene_name", "biotype", "chrom", "start", "end", "strand")


def exons_of_genes(spark: SparkSession, d: str) -> DataFrame:
    return reference.exons_of_gene(world(_base(spark, d)).transcripts).select("gene_id", _spans("exons"))


def unversioned_genes(spark: SparkSession, d: str) -> DataFrame:
    """One gene per id without version, of the record tables' genes."""
    return reference.unversioned(table(spark, d, "genes").select("gene_id").distinct())


def novel_orf_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts whose ORFs are novel: noncoding, of no excluded biotype, of 60 bases or more."""
    return reference.novel_orf_transcripts(world(_base(spark, d)), min_length=60).select("tx_id")


def expression_table(spark: SparkSession, d: str) -> DataFrame:
    """Expression lines with a header, columns by name; what isn't a number is null."""
    o = table(spark, d, "orders")
    value = F.when(F.col("o_orderkey") % 10 == 0, "NA").otherwise(F.floor("o_totalprice").cast("string"))
    lines = _lines(spark, o, [_named("T", "o_orderkey"), F.lit("x"), value]).withColumn("pos", F.monotonically_increasing_id() + 1)
    head = spark.createDataFrame([("tx\tother\tTPM", 0)], "value string, pos bigint")
    return text.expression(spark, head.unionByName(lines), "tx", "TPM")


def name_list(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.when(F.col("p_size") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t"))).alias("value"))
    return text.name_list(spark, lines.withColumn("value", F.regexp_replace("value", r"\t", "")))


# --- caller outputs ----------------------------------------------------------------------------------------------------


def scan_vep(spark: SparkSession, d: str) -> DataFrame:
    """The delivered VEP lines, well-formed or not, as the reader has them."""
    lines = table(spark, d, "raw_lines").where("tool = 'vep' and line is not null").select(F.col("line").alias("value"), F.col("line_id").alias("pos"))
    rows = callers.vep_tsv(spark, lines)
    return rows.select("pos", "location", "allele", "gene", "feature", F.array_join("consequences", "&").alias("consequences"), F.get("amino_acids", F.lit(0)).alias("aa_ref"), F.get("amino_acids", F.lit(1)).alias("aa_alt"), "existing_variation", "extra")


def scan_vep_vcf(spark: SparkSession, d: str) -> DataFrame:
    """VCF lines with two samples: one row for each sample that carries an allele, phase sets of phased genotypes."""
    e = table(spark, d, "events")
    deletion = F.col("event_id") % 3 == 0
    gt = F.when(F.col("event_id") % 2 == 0, "0|1").otherwise("1/1")
    allele = F.when(deletion, "-").otherwise("T")
    csq = F.concat(F.lit("DP=3;CSQ="), allele, F.lit("|missense_variant&intron_variant|G1|T1,"), F.lit("zzz|x|G2|T2"))
    fields = [F.lit("chr1"), F.floor("value") + 1, _named("V", "event_id"), F.when(deletion, "AC").otherwise("A"), F.when(deletion, "A").otherwise("T"), F.lit("."), F.lit("."), csq, F.lit("GT:DP"), F.concat(gt, F.lit(":4")), F.lit("0/0:2")]
    head = ['##INFO=<ID=CSQ,Description="x Format: Allele|Consequence|Gene|Feature">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2"])]
    rows = callers.vep_vcf(spark, sinks.with_head(_lines(spark, e, fields), head))
    return rows.select("uploaded_variation", "location", "allele", "gene", "feature", F.array_join("consequences", ",").alias("consequences"), "sample", F.size("phase_sets").alias("n_sets"))


def scan_star_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "star_fusion")
    head = ["#FusionName", "JunctionReadCount", "SpanningFragCount", "est_J", "est_S", "LeftGene", "LeftBreakpoint", "RightGene", "RightBreakpoint", "FFPM", "annots"]
    names = ["fusion_name", "junction_read_count", "spanning_frag_count", "est_j", "est_s", "left_gene", "left_breakpoint", "right_gene", "right_breakpoint", "ffpm", F.lit("x")]
    return callers.star_fusion(spark, _lines(spark, s, names, head)).drop("pos", "annots")


def scan_rmats_mxe(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "rmats_mxe")
    exons = list(callers._RMATS_EXONS["MXE"].items())
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in ("gene_id", "gene_symbol")]
    counts = [F.translate(c, "\t\r\n", "") for c in ("sjc_sample_1", "sjc_sample_2")]
    fields = ["record_id", *quoted, "chrom", "strand", *(c for c, _ in exons), F.lit("1,2"), counts[0], F.lit(""), counts[1], "inc_form_len", "skip_form_len", "pvalue", "fdr"]
    head = ["ID", "GeneID", "geneSymbol", "chr", "strand", *(n for _, n in exons), "IJC_SAMPLE_1", "SJC_SAMPLE_1", "IJC_SAMPLE_2", "SJC_SAMPLE_2", "IncFormLen", "SkipFormLen", "PValue", "FDR"]
    rows = callers.rmats(spark, _lines(spark, m, fields, head), "MXE")
    return rows.select("gene_id", "gene_symbol", "chrom", *(c for c, _ in exons), F.size("ijc_sample_1").alias("n_ijc"), F.size("ijc_sample_2").alias("n_none"), "inc_form_len", "skip_form_len", "pvalue", "fdr")


_CIRC = ["chrom", "circ_start", "circ_end", "circ_name", "bed_score", "strand", "thick_start", "thick_end", "item_rgb", "exon_count", "exon_sizes", "exon_offsets", "read_number", "circ_type",
         "gene_name", "isoform_name", "exon_index", "flank_intron", "fpb_circ", "fpb_linear", "circ_score"]


def scan_circexplorer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "circ_known")
    rows = callers.circexplorer(spark, _lines(spark, c, _CIRC), 3)
    sizes = [F.aggregate(n, F.lit(0), lambda a, x: a + x).alias(n) for n in ("exon_sizes", "exon_offsets")]
    return rows.select("chrom", "start", "end", "strand", "exon_count", *sizes, "read_number", "circ_type", "fpb_circ", "fpb_linear", "circ_score")


# --- variant files and peptide tables ----------------------------------------------------------------------------------


def gvf_extract(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a variant file that belong to the transcripts of orders above the mean price."""
    e = table(spark, d, "events")
    info = F.concat(F.lit("TRANSCRIPT_ID=T"), F.col("user_id").cast("string"), F.lit(";GENE_SYMBOL=N"))
    lines = sinks.with_head(_lines(spark, e, [F.lit("G"), F.col("event_id"), F.lit("x"), F.lit("A"), F.lit("C"), F.lit("."), F.lit("."), info]), ["##source=x"])
    o = table(spark, d, "orders")
    wanted = o.where(F.col("o_totalprice") > o.agg(F.avg("o_totalprice")).scalar()).select(_named("T", "o_orderkey").alias("tx_id"))
    return gvf.extract(spark, lines, wanted)


def _table_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "peptide_table")

    def clean(c: str) -> Column:
        v = F.regexp_replace(F.col(c).cast("string"), r"\A\s+|\s+\z", "")
        return F.when(v.isNull() | (v == ""), ".").otherwise(v)

    columns = ("peptide_seq", "pep_header", "subsequence", "seg_start", "seg_end", "feature_type", "feature_id", "ref_start", "ref_end", "start_offset", "end_offset", "variant_id")
    rows = p.select(*(clean(c).alias(n) for c, n in zip(columns, gvf.TABLE, strict=True)), "row_id")
    return sinks.peptide_table_lines(rows.select(*gvf.TABLE)).withColumn("pos", F.monotonically_increasing_id())


def peptide_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a peptide table written and read again; `.` is null."""
    return gvf.peptide_table(spark, _table_lines(spark, d)).drop("pos")


def peptide_table_merged(spark: SparkSession, d: str) -> DataFrame:
    """A table merged with itself, without the peptides that have a row on the reference alone."""
    t = gvf.peptide_table(spark, _table_lines(spark, d))
    return gvf.merge_tables([t, t], t.where("variant is null and ref_start is not null").select(F.col("sequence").alias("seq")))


def peptide_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The segments of each label of each peptide, and the table that they make again."""
    t = gvf.peptide_table(spark, _table_lines(spark, d))
    back = gvf.table_rows(gvf.annotations(t))
    return back.groupBy("sequence", "header").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


def peptide_table_fasta(spark: SparkSession, d: str) -> DataFrame:
    return gvf.table_fasta(gvf.peptide_table(spark, _table_lines(spark, d)))


def peptide_table_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Place of each row in the table sorted by first occurrence, header and start."""
    p = table(spark, d, "peptide_table")
    rows = p.select(F.col("row_id").alias("pos"), F.col("peptide_seq").alias("sequence"), F.col("pep_header").alias("header"), F.col("seg_start").alias("start"))
    first = gvf.sorted_table(rows)
    w = Window.partitionBy("sequence").orderBy("header", "start", "pos")
    return first.withColumn("n", F.row_number().over(w)).select("pos", "n")


# --- variants and pools ------------------------------------------------------------------------------------------------


def variant_predicates(spark: SparkSession, d: str) -> DataFrame:
    v = routing.predicates(_on_genes(spark, d, _base(spark, d)))
    return v.groupBy("type").agg(*(F.sum(F.col(c).cast("int")).alias(c) for c in ("is_snv", "is_indel", "is_insertion", "is_deletion", "is_fusion", "is_alternative_splicing", "has_transcript")))


def noncanonical_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of the transcripts that have a splicing variant."""
    return routing.noncanonical_only(_on_genes(spark, d, _base(spark, d))).select("event_id", "tx_id")


def distinct_variants(spark: SparkSession, d: str) -> DataFrame:
    v = routing.dedup(_on_genes(spark, d, _base(spark, d)))
    return v.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"))


def variants_on_genes(spark: SparkSession, d: str) -> DataFrame:
    """Variants on transcripts put back on their genes; one over an intron is told apart."""
    base = _base(spark, d)
    ref = world(base)
    n = reference.transcript_length(F.col("exons"))
    rows = ref.transcripts.where("tx_id like 'T%'").select("tx_id", F.floor(n / 2).cast("int").alias("start"), n.alias("n")).where("start + 2 <= n")
    v = rows.select("tx_id", "start", (F.col("start") + 2).alias("end"), F.lit("AC").alias("ref"), F.lit("GT").alias("alt"), F.lit("MNV").alias("type"), F.lit("MNV-1-AC-GT").alias("id"))
    out = routing.on_gene(v, ref.transcripts, ref.genes)
    return out.select("tx_id", "gene_id", "start", "end", "status")


def variants_within(spark: SparkSession, d: str) -> DataFrame:
    """Variants strictly inside the middle half of their gene."""
    base = _base(spark, d)
    half = base.select(_gene().alias("gene_id"), F.floor(F.col("size") / 4).cast("int").alias("seg_start"), F.floor(F.col("size") * 3 / 4).cast("int").alias("seg_end"))
    return routing.strictly_within(_on_genes(spark, d, base), half).select("event_id")


def spliced_locations(spark: SparkSession, d: str) -> DataFrame:
    """A cut of a spliced sequence: the exons' places in it, cut, joined where they touch, and a base looked up."""
    base = _base(spark, d)
    own = reference.exon_table(world(base).transcripts.where("tx_id like 'T%' and strand = 1")).select("tx_id", F.struct(F.col("cum_start").alias("q_start"), F.col("cum_end").alias("q_end"), F.col("start").alias("ref_start"), F.col("end").alias("ref_end")).alias("m"))
    t = own.groupBy("tx_id").agg(F.array_sort(F.collect_list("m")).alias("m"), F.max("m.q_end").alias("n"))
    cut = t.withColumn("c", sq.slice_locations(F.col("m"), F.lit(3), F.col("n") - 2))
    shown = sq.merge_locations(F.col("c"))
    at = sq.query_index(F.col("c"), F.get("m", F.lit(0))["ref_start"] + 5)
    return cut.select("tx_id", F.size(shown).alias("n"), at.alias("at"), F.aggregate(shown, F.lit(0), lambda a, x: a + x["q_end"] - x["q_start"]).alias("bases"))


def numbered_labels(spark: SparkSession, d: str) -> DataFrame:
    """The use of each label within its transcript, numbered by peptide."""
    rows = labelled(spark, d).select("seq", F.explode(labels.entries(F.col("header"))).alias("label"))
    return pool.numbered_labels(rows.withColumn("tx_id", F.substring_index("label", "|", 1))).select("seq", "entry")


def built_entries(spark: SparkSession, d: str) -> DataFrame:
    """Header entries put together and taken apart."""
    p = table(spark, d, "part")
    entry = labels.build_entry(_named("T", "p_partkey"), F.array(F.concat(F.lit("SNV-"), F.col("p_size").cast("string"))), F.when(F.col("p_size") % 2 == 0, "ORF3"), None, F.col("p_size"))
    parsed = labels.parse_entry(entry)
    return p.select("p_partkey", entry.alias("entry"), parsed["backbone"].alias("backbone"), parsed["idx"].alias("idx"), labels.without_index(entry).alias("bare"))


QUERIES = {
    f.__name__: f
    for f in (
        genome_fasta, proteome_gencode, proteome_ensembl, header_styles, gtf_transcripts, gtf_genes, exons_of_genes, unversioned_genes, novel_orf_transcripts, expression_table, name_list, scan_vep, scan_vep_vcf,
        scan_star_fusion, scan_rmats_mxe, scan_circexplorer, gvf_extract, peptide_table, peptide_table_merged, peptide_annotations, peptide_table_fasta, peptide_table_sorted, variant_predicates,
        noncanonical_variants, distinct_variants, variants_on_genes, variants_within, spliced_locations, numbered_labels, built_entries,
    )
}

_P_SEQ = f"translate(md5(transcript_id), '{_HEX}', '{_AMINO}')"
_PT = """t AS (SELECT {0} FROM peptide_table)""".format(
    ", ".join(
        f"""{'TRY_CAST(' if n in gvf._NUMBERS else ''}nullif(nullif(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g'), ''), '.'){' AS INT)' if n in gvf._NUMBERS else ''} AS "{n}\""""
        for c, n in zip(("peptide_seq", "pep_header", "subsequence", "seg_start", "seg_end", "feature_type", "feature_id", "ref_start", "ref_end", "start_offset", "end_offset", "variant_id"), gvf.TABLE, strict=True)
    )
)
_V = f"""{_W}, z AS (SELECT event_id, o, strand, len, p AS a, p + CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS b, CASE event_type WHEN 'purchase' THEN 'Deletion' WHEN 'signup' THEN 'INDEL' ELSE 'SNV' END AS type FROM ev)"""

SQL = {
    "genome_fasta": f"WITH {_W} SELECT 'C' || o AS seqname, seq FROM q",
    "proteome_gencode": f"SELECT 'P' || transcript_id AS protein_id, transcript_id, gene_id, {_P_SEQ} AS seq FROM (SELECT DISTINCT transcript_id, gene_id FROM transcripts)",
    "proteome_ensembl": f"SELECT 'P' || split_part(transcript_id, '.', 1) AS protein_id, split_part(transcript_id, '.', 1) AS transcript_id, split_part(gene_id, '.', 1) AS gene_id, {_P_SEQ} AS seq FROM (SELECT DISTINCT transcript_id, gene_id FROM transcripts)",
    "header_styles": "SELECT * FROM (VALUES ('a', 'GENCODE'), ('b', 'ENSEMBL')) v(kind, style)",
    "gtf_transcripts": f"""WITH {_W}, cd AS (SELECT o, min(s) + 7 AS lo, max(t) - 4 AS hi FROM k GROUP BY o
        ), cp AS (SELECT k.o, sum(CASE WHEN least(t, hi) > greatest(s, lo) THEN least(t, hi) - greatest(s, lo) + k.o % 3 ELSE 0 END) AS coded, sum(CASE WHEN s < least(t, lo) THEN 1 ELSE 0 END + CASE WHEN greatest(s, hi) < t THEN 1 ELSE 0 END) AS n_utr FROM k JOIN cd USING (o) GROUP BY k.o)
        SELECT tx AS tx_id, any_value(gene) AS gene_id, 'C' || o AS chrom, any_value(w.strand) AS strand, 0 AS start, any_value(stop) AS "end", CASE WHEN kind = 'T' AND o % 3 > 0 THEN 'protein_coding' ELSE 'lncRNA' END AS biotype,
          string_agg(s || '-' || t, ',' ORDER BY s) AS exons, CAST(CASE WHEN kind = 'T' THEN any_value(coded) ELSE 0 END AS INT) AS coded, CAST(CASE WHEN kind = 'T' THEN any_value(n_utr) ELSE 0 END AS INT) AS n_utr
        FROM tx JOIN w USING (o) JOIN (SELECT o, gene FROM q0) USING (o) JOIN cp USING (o) GROUP BY tx, o, kind""",
    "gtf_genes": f"WITH {_W} SELECT gene AS gene_id, 'N' || o AS gene_name, 'protein_coding' AS biotype, 'C' || o AS chrom, 0 AS start, len AS \"end\", strand FROM q0",
    "exons_of_genes": f"WITH {_W} SELECT gene AS gene_id, string_agg(s || '-' || t, ',' ORDER BY s) AS exons FROM k JOIN (SELECT o, gene FROM q0) USING (o) GROUP BY gene",
    "unversioned_genes": """SELECT split_part(gene_id, '.', 1) AS unversioned, arg_min(gene_id, CASE WHEN contains(gene_id, '_PAR_Y') THEN '1' ELSE '0' END || gene_id) AS gene_id FROM genes GROUP BY 1""",
    "novel_orf_transcripts": f"WITH {_W} SELECT tx AS tx_id FROM tx WHERE kind = 'U' OR o % 3 = 0 GROUP BY tx HAVING sum(t - s) >= 60",
    "expression_table": "SELECT 'T' || o_orderkey AS tx_id, CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice) END AS quant FROM orders",
    "name_list": "SELECT trim(p_name) AS name FROM part WHERE p_size % 5 <> 0",
    "scan_vep": """WITH l AS (SELECT line_id AS pos, string_split(regexp_replace(line, '\\r$', ''), chr(9)) AS f FROM raw_lines WHERE tool = 'vep' AND line IS NOT NULL AND NOT starts_with(line, '#') AND trim(regexp_replace(line, '\\r$', '')) <> ''
        ), a AS (SELECT *, string_split(f[11], '/') AS aa FROM l)
        SELECT pos, f[2] AS location, f[3] AS allele, f[4] AS gene, f[5] AS feature, replace(f[7], ',', '&') AS consequences, aa[1] AS aa_ref, CASE WHEN len(aa) = 1 THEN '' ELSE aa[2] END AS aa_alt, f[13] AS existing_variation, f[14] AS extra FROM a""",
    "scan_vep_vcf": """SELECT 'V' || event_id AS uploaded_variation, 'chr1:' || CAST(CASE WHEN event_id % 3 = 0 THEN floor(value) + 2 ELSE floor(value) + 1 END AS BIGINT) AS location, CASE WHEN event_id % 3 = 0 THEN '-' ELSE 'T' END AS allele,
        'G1' AS gene, 'T1' AS feature, 'missense_variant,intron_variant' AS consequences, 's1' AS sample, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_sets FROM events""",
    "scan_star_fusion": "SELECT coalesce(fusion_name, '') AS fusion_name, junction_read_count, spanning_frag_count, est_j, est_s, CAST(NULL AS VARCHAR) AS splice_type, split_part(coalesce(left_gene, ''), '^', -1) AS left_gene, coalesce(left_breakpoint, '') AS left_breakpoint, "
    "split_part(coalesce(right_gene, ''), '^', -1) AS right_gene, coalesce(right_breakpoint, '') AS right_breakpoint, ffpm FROM star_fusion",
    "scan_rmats_mxe": f"""SELECT trim(gene_id) AS gene_id, trim(gene_symbol) AS gene_symbol, chrom, {", ".join(callers._RMATS_EXONS["MXE"])}, 2 AS n_ijc, 0 AS n_none, inc_form_len, skip_form_len, pvalue, fdr FROM rmats_mxe""",
    "scan_circexplorer": """WITH c AS (SELECT *, [TRY_CAST(x AS INT) FOR x IN string_split(coalesce(exon_sizes, ''), ',') IF x <> ''] AS a, [TRY_CAST(x AS INT) FOR x IN string_split(coalesce(exon_offsets, ''), ',') IF x <> ''] AS b FROM circ_known)
        SELECT coalesce(chrom, '') AS chrom, circ_start AS start, circ_end AS "end", coalesce(strand, '') AS strand, exon_count, CAST(coalesce(list_sum(a), 0) AS INT) AS exon_sizes, CAST(coalesce(list_sum(b), 0) AS INT) AS exon_offsets, read_number, coalesce(circ_type, '') AS circ_type, fpb_circ, fpb_linear, circ_score FROM c""",
    "gvf_extract": """SELECT '##source=x' AS value UNION ALL SELECT 'G' || chr(9) || event_id || chr(9) || 'x' || chr(9) || 'A' || chr(9) || 'C' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'TRANSCRIPT_ID=T' || user_id || ';GENE_SYMBOL=N'
        FROM events WHERE user_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))""",
    "peptide_table": f"WITH {_PT} SELECT * FROM t",
    "peptide_table_merged": f"WITH {_PT} SELECT DISTINCT * FROM t WHERE sequence IS NULL OR sequence NOT IN (SELECT sequence FROM t WHERE variant IS NULL AND ref_start IS NOT NULL AND sequence IS NOT NULL)",
    "peptide_annotations": f"""WITH {_PT} SELECT sequence, header, count(*) AS n, min(start) AS first, max("end") AS last FROM t GROUP BY ALL""",
    "peptide_table_fasta": f"WITH {_PT} SELECT sequence AS seq, coalesce(string_agg(DISTINCT header, ' ' ORDER BY header), '') AS header FROM t GROUP BY sequence",
    "peptide_table_sorted": "SELECT row_id AS pos, CAST(row_number() OVER (PARTITION BY peptide_seq ORDER BY pep_header NULLS FIRST, seg_start NULLS FIRST, row_id) AS INT) AS n FROM peptide_table",
    "variant_predicates": f"""WITH {_V} SELECT type, CASE WHEN type = 'Deletion' THEN 0 ELSE count(*) END AS is_snv, 0 AS is_indel, 0 AS is_insertion, CASE WHEN type = 'Deletion' THEN count(*) ELSE 0 END AS is_deletion, 0 AS is_fusion,
        CASE WHEN type = 'Deletion' THEN count(*) ELSE 0 END AS is_alternative_splicing, 0 AS has_transcript FROM z GROUP BY type""",
    "noncanonical_variants": f"WITH {_V} SELECT event_id, 'T' || o AS tx_id FROM z WHERE o IN (SELECT o FROM z WHERE type = 'Deletion')",
    "distinct_variants": f"WITH {_V} SELECT 'T' || o AS tx_id, count(*) AS n FROM (SELECT DISTINCT o, a, b, type FROM z) GROUP BY o",
    "variants_on_genes": f"""WITH {_W}, m AS (SELECT o, CAST(sum(t - s) AS INT) AS n FROM k GROUP BY o), v2 AS (SELECT o, n // 2 AS a FROM m WHERE n // 2 + 2 <= n
        ), g AS (SELECT v2.o, v2.a, (SELECT CASE WHEN strand = 1 THEN s + a - c0 ELSE t - 1 - (a - c0) END FROM k WHERE k.o = v2.o AND c0 <= a AND a < c1) AS x, (SELECT CASE WHEN strand = 1 THEN s + a + 1 - c0 ELSE t - 1 - (a + 1 - c0) END FROM k WHERE k.o = v2.o AND c0 <= a + 1 AND a + 1 < c1) AS y FROM v2
        ), h AS (SELECT g.o, CASE WHEN strand = 1 THEN x ELSE len - 1 - x END AS ga, CASE WHEN strand = 1 THEN y ELSE len - 1 - y END AS gb FROM g JOIN w USING (o))
        SELECT 'T' || o AS tx_id, gene AS gene_id, ga AS start, gb + 1 AS "end", CASE WHEN gb - ga <> 1 THEN 'spans an intron' ELSE 'ok' END AS status FROM h JOIN (SELECT o, gene FROM q0) USING (o)""",
    "variants_within": f"WITH {_V} SELECT event_id FROM z WHERE len // 4 < a AND b < len * 3 // 4",
    "spliced_locations": f"""WITH {_W}, m AS (SELECT o, s, c0, c1, sum(t - s) OVER (PARTITION BY o) AS n FROM k WHERE strand = 1), c AS (SELECT *, greatest(c0, 3) - 3 AS a, least(c1, n - 2) - 3 AS b, s + greatest(3 - c0, 0) AS r FROM m WHERE c0 < n - 2 AND c1 > 3
        ), f AS (SELECT o, min(s) + 5 AS x FROM m GROUP BY o)
        SELECT 'T' || m.o AS tx_id, CAST(coalesce(any_value(u.n), 0) AS INT) AS n, CAST(coalesce(max(u.at), -1) AS INT) AS at, CAST(coalesce(any_value(u.bases), 0) AS INT) AS bases
        FROM (SELECT DISTINCT o FROM m) m LEFT JOIN (SELECT c.o, count(*) AS n, sum(b - a) AS bases, max(CASE WHEN r <= x AND x < r + b - a THEN a + x - r END) AS at FROM c JOIN f USING (o) GROUP BY c.o) u USING (o) GROUP BY m.o""",
    "numbered_labels": f"WITH {_LABELLED} SELECT seq, 'TX' || lang || '|SNV-' || source || '|' || row_number() OVER (PARTITION BY lang, source ORDER BY seq) AS entry FROM l",
    "encode_headers": f"""WITH {_LABELLED}, h AS (SELECT seq, sha256(string_agg('TX' || lang || '|SNV-' || source, ' ' ORDER BY 'TX' || lang || '|SNV-' || source)) AS x FROM l GROUP BY seq)
        SELECT seq, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-4' || substr(x, 14, 3) || '-8' || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS header FROM h""",
    "built_entries": """SELECT p_partkey, 'T' || p_partkey || '|SNV-' || p_size || CASE WHEN p_size % 2 = 0 THEN '|ORF3' ELSE '' END || '|' || p_size AS entry, 'T' || p_partkey AS backbone, p_size AS idx,
        'T' || p_partkey || '|SNV-' || p_size || CASE WHEN p_size % 2 = 0 THEN '|ORF3' ELSE '' END AS bare FROM part""",
}
