"""Queries of the peptide and coordinate operators over the driver's tables, with SQL.

The tables hold no genomics, so each query derives its input from whole tables: a protein is the letters of a document
that are amino acids, its DNA a letter-by-letter translation, a transcript an order whose exons are its line items laid
end to end with gaps, and a variant an event at the place of its value. The SQL derives the same.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribospark.functions import decoy as decoys
from ribospark.functions import digest as dg
from ribospark.functions import fixed, intervals, labels
from ribospark.functions import sequence as sq
from ribospark.functions.digest import Cleavage
from ribospark.operators import call, pool, reference, routing
from ribospark.operators.pool import SourceOrder
from ribospark.session import spread, table
from ribospark.sources import gvf

_AMINO = "ACDEFGHIKLMNPQRSTVWY"
_BASES = "ACGT" * 5
GAP = 10


# --- inputs ------------------------------------------------------------------------------------------------------------


def proteins(spark: SparkSession, d: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.regexp_replace(letters, f"[^{_AMINO}]", "").alias("seq"))


def dna(spark: SparkSession, d: str) -> DataFrame:
    return proteins(spark, d).select("doc_id", F.translate("seq", _AMINO, _BASES).alias("seq"))


def exon_rows(spark: SparkSession, d: str) -> DataFrame:
    """(tx_id, strand, start, end): line items of an order side by side, each as long as its quantity, with gaps between."""
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    w = Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").withColumn("start", F.coalesce(F.sum(size + GAP).over(w), F.lit(0)).cast("int"))
    return rows.select(F.col("l_orderkey").alias("tx_id"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"), "start", (F.col("start") + size).alias("end"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    rows = exon_rows(spark, d).groupBy("tx_id", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return rows.withColumn("gene_id", F.col("tx_id"))


def variant_events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, tx_id, pos, kind): an event as a variant at the floor of its value."""
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("tx_id"), F.floor("value").cast("int").alias("pos"), "event_type")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(seq, header): digested peptides of documents, each labelled by the document's language and source."""
    rows = dg.digest_rows(proteins(spark, d).withColumn("tx", _tx()), keep=["tx"], distinct=True)
    return rows.groupBy(F.col("pep").alias("seq")).agg(F.array_join(F.array_sort(F.collect_set("tx")), " ").alias("header"))


def _tx() -> Column:
    return F.concat(F.lit("TX"), F.coalesce(F.upper("lang"), F.lit("NA")), F.lit("|SNV-"), F.coalesce("source", F.lit("none")))


_LANGS = ("EN", "DE", "FR", "ES", "NA")
_SOURCES = ("court_site", "law_reports", "mirror_b", "none", "registry_feed", "scan_archive")


def label_sources(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Sources of the labels, and genes of the transcripts."""
    pairs = [(f"G{lang}", f"SNV-{s}", s) for lang in _LANGS for s in _SOURCES]
    return (
        spark.createDataFrame(pairs, "gene_id string, label string, source string"),
        spark.createDataFrame([(f"TX{x}", f"G{x}") for x in _LANGS], "tx_id string, gene_id string"),
    )


# --- sequences ---------------------------------------------------------------------------------------------------------


def _digest(cleavage: Cleavage):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return dg.digest_rows(proteins(spark, d), cleavage, keep=["doc_id"], distinct=True).distinct()

    return query


def canonical_pool(spark: SparkSession, d: str) -> DataFrame:
    return dg.canonical_pool(proteins(spark, d), Cleavage(exception=None))


def peptide_mass(spark: SparkSession, d: str) -> DataFrame:
    peptides = canonical_pool(spark, d)
    return peptides.select("seq", F.round(dg.mass(F.col("seq")), 4).alias("mass"), F.length("seq").alias("size"))


def cleave_and_stop_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites with every W of the protein taken as a stop."""
    rows = proteins(spark, d).select("doc_id", F.translate("seq", "W", "*").alias("seq"))
    return rows.select("doc_id", F.explode(dg.cleave_and_stop_sites(F.col("seq"), Cleavage(exception=None))).alias("site"))


def miscleavage_count(spark: SparkSession, d: str) -> DataFrame:
    peptides = canonical_pool(spark, d)
    return peptides.select(dg.miscleavages(F.col("seq"), Cleavage(exception=None)).alias("misc")).groupBy("misc").agg(F.count(F.lit(1)).alias("n"))


def translate_three_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d).select("doc_id", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("frame"), "seq")
    return rows.select("doc_id", "frame", F.md5(sq.translate_dna(F.col("seq"), F.col("frame"))).alias("protein_md5"))


def translate_mitochondrial(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("doc_id", F.md5(sq.translate_dna(F.col("seq"), 0, "SGC1")).alias("protein_md5"))


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("doc_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("rc_md5"))


def start_codon_sites(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("doc_id", F.posexplode(sq.start_codon_sites(F.col("seq"))).alias("n", "site")).select("doc_id", F.col("n") + 1, "site").toDF("doc_id", "orf_number", "site")


def first_orf(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("doc_id", sq.first_orf(F.col("seq")).alias("o")).where("o is not null").select("doc_id", F.col("o.start").alias("orf_start"), F.col("o.end").alias("orf_end"))


def decoy_reverse(spark: SparkSession, d: str) -> DataFrame:
    peptides = canonical_pool(spark, d)
    kept = decoys.fixed_positions(F.col("seq"), Cleavage())
    return peptides.select("seq", decoys.reverse(F.col("seq"), kept).alias("decoy"))


def decoy_shuffle(spark: SparkSession, d: str) -> DataFrame:
    made = pool.decoy(canonical_pool(spark, d).withColumn("header", F.col("seq")), "shuffle", Cleavage(), attempts=3, seed=7)
    return made.where("is_decoy")


def w2f_subsets(spark: SparkSession, d: str) -> DataFrame:
    return canonical_pool(spark, d).where(F.col("seq").contains("W")).select("seq", F.explode(decoys.w2f_variants(F.col("seq"))).alias("variant"))


# --- coordinates -------------------------------------------------------------------------------------------------------


def exon_cumulative(spark: SparkSession, d: str) -> DataFrame:
    out = reference.exon_table(transcripts(spark, d))
    return out.select("tx_id", "n5", "start", "end", "cum_start", "cum_end")


def transcript_length(spark: SparkSession, d: str) -> DataFrame:
    return transcripts(spark, d).select("tx_id", reference.transcript_length(F.col("exons")).alias("size"))


def _located(spark: SparkSession, d: str) -> DataFrame:
    return variant_events(spark, d).join(transcripts(spark, d), "tx_id")


def genomic_to_transcript(spark: SparkSession, d: str) -> DataFrame:
    rows = _located(spark, d)
    return rows.select("event_id", reference.genomic_to_transcript(F.col("pos"), F.col("exons"), F.col("strand")).alias("tx_pos"))


def transcript_to_genomic(spark: SparkSession, d: str) -> DataFrame:
    rows = _located(spark, d)
    return rows.select("event_id", reference.transcript_to_genomic(F.col("pos"), F.col("exons"), F.col("strand")).alias("genomic"))


def nearest_exons(spark: SparkSession, d: str) -> DataFrame:
    """Last base of the exon before each variant and first base of the one after it, along the strand."""
    rows = _located(spark, d)
    return rows.select(
        "event_id",
        reference.upstream_exon_end(F.col("pos"), F.col("exons"), F.col("strand")).alias("upstream"),
        reference.downstream_exon_start(F.col("pos"), F.col("exons"), F.col("strand")).alias("downstream"),
    )


def route_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of 1 to 5 bases by whether their ends lie in exons of their transcript."""
    kinds = F.create_map(*(F.lit(x) for pair in zip(("view", "signup", "click", "error", "purchase"), range(1, 6), strict=True) for x in pair))
    rows = _located(spark, d).withColumn("last", F.col("pos") + kinds[F.col("event_type")] - 1)
    a, b = (reference.genomic_to_transcript(F.col(c), F.col("exons"), F.col("strand")) for c in ("pos", "last"))
    bucket = F.when(a.isNotNull() & b.isNotNull(), "transcriptional").when(a.isNotNull() | b.isNotNull(), "spanning").otherwise("intronic")
    return rows.select("event_id", bucket.alias("bucket"))


def known_junctions(spark: SparkSession, d: str) -> DataFrame:
    rows = transcripts(spark, d).select("tx_id", F.explode(reference.junctions(F.col("exons"))).alias("j"))
    return rows.select("tx_id", F.col("j.start").alias("donor"), F.col("j.end").alias("accepter"))


def novel_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of successive variants of a transcript, taken as junctions that it doesn't have."""
    w = Window.partitionBy("tx_id").orderBy("pos", "event_id")
    pairs = variant_events(spark, d).withColumn("next", F.lead("pos").over(w)).where("next > pos")
    rows = pairs.join(transcripts(spark, d), "tx_id")
    return rows.where(~reference.has_junction(F.col("exons"), F.col("pos"), F.col("next"))).select("event_id", "tx_id", "pos", "next")


def exon_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Exons that a window of 20 bases from a variant touches, holds, and by how much."""
    v = variant_events(spark, d).withColumn("stop", F.col("pos") + 20)
    rows = v.join(exon_rows(spark, d), "tx_id").where(intervals.overlaps(F.col("pos"), F.col("stop"), F.col("start"), F.col("end")))
    shared = intervals.intersection(F.col("pos"), F.col("stop"), F.col("start"), F.col("end"))
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_exons"),
        F.sum(intervals.contains(F.col("pos"), F.col("stop"), F.col("start"), F.col("end")).cast("int")).alias("n_inside"),
        F.sum(shared["end"] - shared["start"]).alias("shared"),
    )


def _small_variants(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "SNV").when(F.col("event_type") == "error", "RNAEditingSite").when(F.col("event_type") == "signup", "INDEL").otherwise("Deletion")
    size = F.when(kind == "INDEL", 2).otherwise(1)
    base = F.substring(F.lit("ACGT"), F.pmod(F.col("pos"), F.lit(4)).cast("int") + 1, F.lit(1))
    return variant_events(spark, d).select(
        "event_id", "tx_id", F.col("pos").alias("start"), (F.col("pos") + size).alias("end"), base.alias("ref"), base.alias("alt"), kind.alias("type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id")
    )


def adjacent_mnv(spark: SparkSession, d: str) -> DataFrame:
    out = routing.adjacent_mnvs(_small_variants(spark, d), 2)
    return out.select("tx_id", "start", "end", "id", F.array_join("ids", "+").alias("ids"))


def hypermutated_regions(spark: SparkSession, d: str) -> DataFrame:
    return routing.hypermutated(_small_variants(spark, d))


def frame_shift_class(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "Fusion").when(F.col("p_size") % 4 == 1, "Insertion").when(F.col("p_size") % 4 == 2, "Deletion").otherwise("INDEL")
    rows = part.select("p_partkey", kind.alias("kind"), F.lit(0).alias("start"), F.length("p_name").alias("end"), F.col("p_brand").alias("alt"), F.lit(0).alias("ds"), F.length("p_type").alias("de"))
    return rows.select("p_partkey", routing.frames_shifted(*(F.col(c) for c in ("start", "end", "alt", "kind", "ds", "de"))).cast("int").alias("shift"))


def gvf_info(spark: SparkSession, d: str) -> DataFrame:
    """An INFO field made of a part's columns, parsed and written again."""
    part = table(spark, d, "part")
    info = F.concat(F.lit("TRANSCRIPT_ID="), "p_brand", F.lit(";START="), F.col("p_size").cast("string"), F.lit(';GENE_SYMBOL="'), "p_type", F.lit('"'))
    rows = part.select("p_partkey", gvf.parse_info(info).alias("attrs"))
    return rows.select("p_partkey", F.col("attrs")["START"].alias("start_0"), F.col("attrs")["GENE_SYMBOL"].alias("symbol"), gvf.info_text(F.col("attrs"), gvf.ATTR_ORDER).alias("written"))


# --- pools -------------------------------------------------------------------------------------------------------------


def merge_pools(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of English documents merged with those of the others; the German ones' are denied."""
    own = proteins(spark, d).withColumn("lang", F.coalesce(F.lower("lang"), F.lit("na")))
    rows = dg.digest_rows(own, Cleavage(exception=None), keep=["lang"], distinct=True).withColumnRenamed("pep", "seq").distinct()
    deny = rows.where("lang = 'de'").select("seq")

    def part(cond: str) -> DataFrame:
        return rows.where(cond).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("header"))

    return pool.merge([part("lang = 'en'"), part("lang not in ('en', 'de')")], deny)


def source_split(spark: SparkSession, d: str) -> DataFrame:
    source, genes = label_sources(spark)
    order = SourceOrder(["law_reports", "court_site"], [s for s in _SOURCES if s not in ("law_reports", "court_site")])
    return pool.split(labelled(spark, d), source, genes, order).groupBy("database").agg(F.count(F.lit(1)).alias("n"))


def summary_by_source(spark: SparkSession, d: str) -> DataFrame:
    source, genes = label_sources(spark)
    return pool.summarize(labelled(spark, d), source, genes, SourceOrder(sorted(_SOURCES)), Cleavage())


def filter_by_expression(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose transcript reaches a level; levels are the mean length of the language's texts."""
    levels = proteins(spark, d).groupBy(F.concat(F.lit("TX"), F.coalesce(F.upper("lang"), F.lit("NA"))).alias("tx_id")).agg(F.avg(F.length("seq")).alias("quant"))
    mid = levels.select(F.avg("quant")).first()[0]
    coding = spark.createDataFrame([("TXEN",)], "tx_id string")
    return pool.filter_pool(labelled(spark, d), levels, mid, coding, keep_all_coding=True)


def encode_headers(spark: SparkSession, d: str) -> DataFrame:
    return pool.encode(labelled(spark, d))[0]


def header_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of headers taken apart: kind, backbone, variants and index."""
    rows = labelled(spark, d).select("seq", F.posexplode(labels.entries(F.col("header"))).alias("at", "entry")).withColumn("p", labels.parse_entry(F.col("entry")))
    return rows.groupBy("p.kind", "p.backbone", F.array_join(F.transform("p.variants", lambda v: v["id"]), ",").alias("variants")).agg(F.count(F.lit(1)).alias("n"))


# --- calling -----------------------------------------------------------------------------------------------------------


def _reference(spark: SparkSession, d: str) -> reference.Reference:
    """One gene and one coding transcript of one exon per customer, on a contig of its own; the sequence spells the name."""
    word = F.regexp_replace(F.upper("c_name"), "[^A-Z0-9]", "")
    key = F.col("c_custkey")
    bases = F.translate(F.md5(F.concat(word, key.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    more = reduce(F.concat, [F.translate(F.md5(F.concat(F.lit(str(i)), word)), "0123456789abcdef", "AGCTAGCTCAGTTGCA") for i in range(5)])
    c = table(spark, d, "customer").select(F.concat(F.lit("T"), key.cast("string")).alias("tx_id"), F.concat(F.lit("ATG"), bases, more, F.lit("TAA")).alias("seq"))
    n = F.length("seq")
    base = c.select(
        "tx_id", F.concat(F.lit("G"), "tx_id").alias("gene_id"), F.lit(None).cast("string").alias("protein_id"), F.col("tx_id").alias("gene_name"), F.lit("protein_coding").alias("biotype"),
        F.concat(F.lit("C"), "tx_id").alias("chrom"), F.lit(0).alias("start"), n.alias("end"), F.lit(1).alias("strand"),
        F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))).alias("exons"), F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), F.lit(0).alias("frame"))).alias("cds"),
        F.array().cast("array<struct<start:int,end:int>>").alias("utr"), F.array().cast("array<struct<start:int,end:int>>").alias("sec"), F.array().cast("array<string>").alias("tags"),
        F.lit(True).alias("is_coding"), F.lit(0).alias("pos"), "seq",
    )
    genes = base.select("gene_id", "gene_name", "biotype", "chrom", "start", "end", "strand", "pos")
    return reference.Reference(genes, base.drop("seq"), base.select(F.col("chrom").alias("seqname"), "seq"))


def call_variant(spark: SparkSession, d: str) -> DataFrame:
    """Variant peptides: an event is a substitution at the floor of its value on one of its user's ten transcripts.

    With the reference's default cap: peptides of more than 7 variants, and 2 for each missed cleavage, are left out.
    ``call_small`` has none.
    """
    ref = _reference(spark, d)
    seqs = ref.genome.select(F.substring("seqname", 2, 100).alias("t"), "seq")
    own = F.col("tx_id") * 10 + F.col("event_id") % 10
    v = variant_events(spark, d).select(F.concat(F.lit("T"), own.cast("string")).alias("tx_id"), "pos").distinct()
    placed = v.join(seqs, F.col("tx_id") == F.col("t")).where((F.col("pos") >= 3) & (F.col("pos") < F.length("seq") - 3))
    base = F.substring("seq", F.col("pos") + 1, F.lit(1))
    alt = F.translate(base, "ACGT", "GTAC")
    name = labels.variant_id(F.lit("SNV"), F.col("pos"), base, alt)
    none = F.create_map().cast("map<string,string>")
    variants = placed.select(F.concat(F.lit("G"), "tx_id").alias("gene_id"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), base.alias("ref"), alt.alias("alt"), F.lit("SNV").alias("type"), name.alias("id"), "tx_id", none.alias("attrs"))
    return call.call_variant(ref, variants, None, call.Rules(exception="auto", max_variants=7), None, adjacent=0).select("tx_id", "seq", "label")


QUERIES = {
    "canonical_pool": canonical_pool,
    "digest_trypsin": _digest(Cleavage(exception=None)),
    "digest_trypsin_exception": _digest(Cleavage()),
    "digest_lysc": _digest(Cleavage("lysc", None)),
    "digest_arg_c": _digest(Cleavage("arg-c", None, miscleavage=1)),
    "digest_asp_n": _digest(Cleavage("asp-n", None)),
    "digest_proteinase_k": _digest(Cleavage("proteinase k", None)),
    "peptide_mass": peptide_mass,
    "cleave_and_stop_sites": cleave_and_stop_sites,
    "miscleavage_count": miscleavage_count,
    "translate_three_frames": translate_three_frames,
    "translate_mitochondrial": translate_mitochondrial,
    "reverse_complement": reverse_complement,
    "start_codon_sites": start_codon_sites,
    "first_orf": first_orf,
    "decoy_reverse": decoy_reverse,
    "decoy_shuffle": decoy_shuffle,
    "w2f_subsets": w2f_subsets,
    "exon_cumulative": exon_cumulative,
    "transcript_length": transcript_length,
    "genomic_to_transcript": genomic_to_transcript,
    "transcript_to_genomic": transcript_to_genomic,
    "nearest_exons": nearest_exons,
    "route_variants": route_variants,
    "known_junctions": known_junctions,
    "novel_junctions": novel_junctions,
    "exon_overlap": exon_overlap,
    "adjacent_mnv": adjacent_mnv,
    "hypermutated_regions": hypermutated_regions,
    "frame_shift_class": frame_shift_class,
    "gvf_info": gvf_info,
    "merge_pools": merge_pools,
    "source_split": source_split,
    "summary_by_source": summary_by_source,
    "filter_by_expression": filter_by_expression,
    "header_entries": header_entries,
    "encode_headers": encode_headers,
    "call_variant": call_variant,
}

# --- SQL ---------------------------------------------------------------------------------------------------------------

_P = f"""p AS (
  SELECT doc_id, lang, source, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{_AMINO}]', '', 'g') AS seq
  FROM documents WHERE text IS NOT NULL
)"""
_N = f"n AS (SELECT doc_id, translate(seq, '{_AMINO}', '{_BASES}') AS seq FROM p)"
_C = """c AS (
  SELECT doc_id, i, substr(seq, i, 1) AS c, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) ELSE '' END AS b, substr(seq, i + 1, 1) AS a
  FROM p, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i)
)"""
_TRYPSIN = "((c IN ('K', 'R') AND a NOT IN ('P', '')) OR (c = 'K' AND b = 'W' AND a = 'P') OR (c = 'R' AND b = 'M' AND a = 'P'))"
_EXCEPTION = "((c = 'K' AND b IN ('C', 'D') AND a = 'D') OR (c = 'K' AND b = 'C' AND a IN ('H', 'Y')) OR (c = 'R' AND b = 'C' AND a = 'K') OR (c = 'R' AND b = 'R' AND a IN ('H', 'R')))"


def _mass(x: str) -> str:
    terms = " + ".join(f"(length({x}) - length(replace({x}, '{k}', ''))) * {v}" for k, v in fixed.MASSES.items() if k in _AMINO)
    return f"({terms} - (length({x}) - 1) * {fixed.WATER})"


def _peptides(site: str, misses: int = 2, name: str = "d", source: str = _P, ends: str = "true") -> str:
    """CTEs up to ``d(doc_id, pep)``: the valid peptides of ``source``, p(doc_id, seq); of those that end where their sequence does, where ``ends`` says so."""
    return f"""{source}, {_C}, s AS (
  SELECT doc_id, 0 AS pos FROM p UNION ALL SELECT doc_id, i FROM c WHERE {site} UNION ALL SELECT doc_id, length(seq) FROM p WHERE {ends}
), r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s
), w AS (SELECT x.doc_id, x.pos AS lo, y.pos AS hi FROM r x JOIN r y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k + 1 AND x.k + {misses + 1} WHERE y.pos - x.pos BETWEEN 7 AND 26
), q AS (SELECT doc_id, lo, substr(seq, lo + 1, hi - lo) AS pep FROM w JOIN p USING (doc_id)
), u AS (SELECT doc_id, pep FROM q UNION ALL SELECT doc_id, substr(pep, 2) FROM q WHERE lo = 0 AND pep LIKE 'M%'
), {name} AS (SELECT doc_id, pep FROM u WHERE length(pep) BETWEEN 7 AND 25 AND {_mass('pep')} > 500)"""


_POOL = f"{_peptides(_TRYPSIN)}, k AS (SELECT DISTINCT unnest([pep, translate(pep, 'I', 'L')]) AS seq FROM d)"
_E = f"""x AS (
  SELECT l_orderkey AS tx_id, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS strand, CAST(l_quantity AS INT) AS size,
    CAST(coalesce(sum(CAST(l_quantity AS INT) + {GAP}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
      l_tax, l_returnflag, l_linestatus, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS lo
  FROM lineitem
), e AS (
  SELECT tx_id, strand, lo AS s, lo + size AS t,
    row_number() OVER o AS n5, CAST(sum(size) OVER o AS INT) - size AS c0, CAST(sum(size) OVER o AS INT) AS c1
  FROM x WINDOW o AS (PARTITION BY tx_id ORDER BY lo * strand)
), v AS (SELECT event_id, user_id AS tx_id, CAST(floor(value) AS INT) AS pos, event_type FROM events WHERE user_id IN (SELECT tx_id FROM x))"""
_AT = "CASE WHEN strand = 1 THEN c0 + {p} - s ELSE c0 + t - 1 - {p} END"


def _exonic(p: str) -> str:
    return f"(SELECT {_AT.format(p=p)} FROM e WHERE e.tx_id = v.tx_id AND s <= {p} AND {p} < t)"


def _codon_sql(table_name: str) -> str:
    pairs = fixed.codons(table_name)
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _translation(frame: str, table_name: str = "Standard") -> str:
    n = f"CAST(floor((length(seq) - {frame}) / 3) AS BIGINT)"
    return (
        f"md5(coalesce((SELECT string_agg(t.m[substr(seq, CAST({frame} + 3 * i + 1 AS BIGINT), 3)], '' ORDER BY i) "
        f"FROM (SELECT {_codon_sql(table_name)} AS m) t, (SELECT unnest(range(0, greatest({n}, 0))) AS i)), ''))"
    )


_LABELLED = f"""{_peptides(f'({_TRYPSIN} AND NOT {_EXCEPTION})')}, l AS (
  SELECT DISTINCT d.pep AS seq, coalesce(upper(p.lang), 'NA') AS lang, coalesce(p.source, 'none') AS source FROM d JOIN p USING (doc_id)
)"""
_ORDER = ["law_reports", "court_site", *(s for s in _SOURCES if s not in ("law_reports", "court_site"))]

_ALL_SOURCES = [*sorted(_SOURCES), fixed.SOURCE_NOVEL_ORF, fixed.SOURCE_SECT, fixed.SOURCE_CODON_REASSIGNMENT]
_COMBOS = ["-".join(c) for n in range(1, len(_ALL_SOURCES) + 1) for c in combinations(_ALL_SOURCES, n)]

SQL = {
    "summary_by_source": f"""WITH {_LABELLED}, b AS (SELECT seq, min(source) AS s FROM l GROUP BY seq), bc AS (
          SELECT b.seq, s, substr(b.seq, i, 1) AS c, CASE WHEN i > 1 THEN substr(b.seq, i - 1, 1) ELSE '' END AS b, substr(b.seq, i + 1, 1) AS a
          FROM b, LATERAL (SELECT unnest(range(1, length(b.seq) + 1)) AS i)
        ), m AS (SELECT seq, s AS sources, count(*) FILTER (WHERE {_TRYPSIN} AND NOT {_EXCEPTION}) AS misc FROM bc GROUP BY ALL
        ), j AS (SELECT sources, count(*) AS n_total, count(*) FILTER (WHERE misc = 0) AS n_0_misc, count(*) FILTER (WHERE misc = 1) AS n_1_misc, count(*) FILTER (WHERE misc = 2) AS n_2_misc FROM m GROUP BY sources)
        SELECT k.sources, coalesce(n_total, 0) AS n_total, coalesce(n_0_misc, 0) AS n_0_misc, coalesce(n_1_misc, 0) AS n_1_misc, coalesce(n_2_misc, 0) AS n_2_misc
        FROM (SELECT unnest({_COMBOS}) AS sources) k LEFT JOIN j USING (sources)""",
    "canonical_pool": f"WITH {_POOL} SELECT seq FROM k",
    "digest_trypsin": f"WITH {_peptides(_TRYPSIN)} SELECT DISTINCT doc_id, pep FROM d",
    "digest_trypsin_exception": f"WITH {_peptides(f'({_TRYPSIN} AND NOT {_EXCEPTION})')} SELECT DISTINCT doc_id, pep FROM d",
    "digest_lysc": f"""WITH {_peptides("c = 'K'")} SELECT DISTINCT doc_id, pep FROM d""",
    "digest_arg_c": f"""WITH {_peptides("c = 'R'", 1)} SELECT DISTINCT doc_id, pep FROM d""",
    "digest_asp_n": f"""WITH {_peptides("a = 'D'")} SELECT DISTINCT doc_id, pep FROM d""",
    "digest_proteinase_k": f"""WITH {_peptides("c IN ('A', 'E', 'F', 'I', 'L', 'T', 'V', 'W', 'Y')")} SELECT DISTINCT doc_id, pep FROM d""",
    "peptide_mass": f"WITH {_POOL} SELECT seq, round({_mass("seq")}, 4) AS mass, length(seq) AS size FROM k",
    "cleave_and_stop_sites": f"""WITH {_P.replace("AS seq", "AS seq0")}, p2 AS (SELECT doc_id, translate(seq0, 'W', '*') AS seq FROM p), {_C.replace("FROM p,", "FROM p2,")}
        SELECT DISTINCT doc_id, CAST(site AS INT) AS site FROM (
          SELECT doc_id, i AS site FROM c WHERE (c IN ('K', 'R') AND a NOT IN ('P', '')) OR (c = 'R' AND b = 'M' AND a = 'P')
          UNION ALL SELECT doc_id, i - 1 FROM c WHERE c = '*' AND i > 1 UNION ALL SELECT doc_id, i FROM c WHERE c = '*' AND a <> '')""",
    "miscleavage_count": f"""WITH {_POOL}, kc AS (
          SELECT seq, substr(seq, i, 1) AS c, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) ELSE '' END AS b, substr(seq, i + 1, 1) AS a
          FROM k, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i)
        ), m AS (SELECT seq, count(*) FILTER (WHERE {_TRYPSIN}) AS misc FROM kc GROUP BY seq)
        SELECT CAST(misc AS INT) AS misc, count(*) AS n FROM m GROUP BY 1""",
    "translate_three_frames": f"WITH {_P}, {_N} SELECT doc_id, CAST(frame AS INT) AS frame, {_translation('frame')} AS protein_md5 FROM n, (SELECT unnest([0, 1, 2]) AS frame)",
    "translate_mitochondrial": f"WITH {_P}, {_N} SELECT doc_id, {_translation('0', 'SGC1')} AS protein_md5 FROM n",
    "reverse_complement": f"WITH {_P}, {_N} SELECT doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc_md5 FROM n",
    "start_codon_sites": f"""WITH {_P}, {_N}, s AS (SELECT doc_id, i FROM n, LATERAL (SELECT unnest(range(0, length(seq))) AS i) WHERE substr(seq, i + 1, 3) = 'ATG')
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS orf_number, i AS site FROM s""",
    "first_orf": f"""WITH {_P}, {_N}, f AS (SELECT doc_id, seq, strpos(seq, 'ATG') - 1 AS o FROM n WHERE strpos(seq, 'ATG') > 0)
        SELECT doc_id, o AS orf_start, coalesce((SELECT min(o + 3 * i) FROM (SELECT unnest(range(0, (length(seq) - o) // 3)) AS i) WHERE substr(seq, o + 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA')),
          o + (length(seq) - o) // 3 * 3) AS orf_end FROM f""",
    "decoy_reverse": f"""WITH {_POOL}, kc AS (
          SELECT seq, i, substr(seq, i, 1) AS c, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) ELSE '' END AS b, substr(seq, i + 1, 1) AS a
          FROM k, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i)
        ), held AS (SELECT seq, i + 1 AS i FROM kc WHERE {_TRYPSIN} UNION SELECT seq, 1 FROM k UNION SELECT seq, length(seq) FROM k
        ), free AS (SELECT seq, i, c, row_number() OVER (PARTITION BY seq ORDER BY i) AS f, row_number() OVER (PARTITION BY seq ORDER BY i DESC) AS g FROM kc ANTI JOIN held USING (seq, i)
        ), put AS (SELECT x.seq, x.i, y.c FROM free x JOIN free y ON x.seq = y.seq AND x.f = y.g UNION ALL SELECT kc.seq, kc.i, kc.c FROM kc JOIN held USING (seq, i))
        SELECT seq, string_agg(c, '' ORDER BY i) AS decoy FROM put GROUP BY seq""",
    "w2f_subsets": f"""WITH {_POOL}, kw AS (SELECT seq, i, row_number() OVER (PARTITION BY seq ORDER BY i) AS j FROM k, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i) WHERE substr(seq, i, 1) = 'W'
        ), nw AS (SELECT seq, count(*) AS m FROM kw GROUP BY seq
        ), mk AS (SELECT seq, unnest(range(1, CAST(2 ** m AS BIGINT))) AS mask FROM nw
        ), ch AS (SELECT mk.seq, mask, i, CASE WHEN (mask >> CAST(j - 1 AS BIGINT)) & 1 = 1 THEN 'F' ELSE substr(mk.seq, i, 1) END AS c
          FROM (SELECT seq, mask, unnest(range(1, length(seq) + 1)) AS i FROM mk) mk LEFT JOIN kw USING (seq, i))
        SELECT seq, string_agg(c, '' ORDER BY i) AS variant FROM ch GROUP BY seq, mask""",
    "exon_cumulative": f"WITH {_E} SELECT tx_id, CAST(n5 AS INT) AS n5, s AS start, t AS \"end\", c0 AS cum_start, c1 AS cum_end FROM e",
    "transcript_length": f"WITH {_E} SELECT tx_id, CAST(sum(size) AS INT) AS size FROM x GROUP BY tx_id",
    "genomic_to_transcript": f"WITH {_E} SELECT event_id, {_exonic('v.pos')} AS tx_pos FROM v",
    "transcript_to_genomic": f"""WITH {_E} SELECT event_id, (SELECT CASE WHEN strand = 1 THEN s + v.pos - c0 ELSE t - 1 - (v.pos - c0) END FROM e
        WHERE e.tx_id = v.tx_id AND c0 <= v.pos AND v.pos < c1) AS genomic FROM v""",
    "nearest_exons": f"""WITH {_E} SELECT event_id,
        CASE WHEN any_value(strand) = 1 THEN max(t - 1) FILTER (WHERE t <= pos) ELSE min(s) FILTER (WHERE s >= pos) END AS upstream,
        CASE WHEN any_value(strand) = 1 THEN min(s) FILTER (WHERE s >= pos) ELSE max(t - 1) FILTER (WHERE t - 1 <= pos) END AS downstream
        FROM v JOIN e USING (tx_id) GROUP BY event_id""",
    "route_variants": f"""WITH {_E}, z AS (SELECT event_id, tx_id, pos, pos + CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS q FROM v
        ), b AS (SELECT event_id, bool_or(s <= pos AND pos < t) AS f, bool_or(s <= q AND q < t) AS g FROM z JOIN e USING (tx_id) GROUP BY event_id)
        SELECT event_id, CASE WHEN f AND g THEN 'transcriptional' WHEN f OR g THEN 'spanning' ELSE 'intronic' END AS bucket FROM b""",
    "known_junctions": f"WITH {_E} SELECT * FROM (SELECT tx_id, t AS donor, lead(s) OVER (PARTITION BY tx_id ORDER BY s) AS accepter FROM e) WHERE accepter IS NOT NULL",
    "novel_junctions": f"""WITH {_E}, j AS (SELECT tx_id, t AS donor, lead(s) OVER (PARTITION BY tx_id ORDER BY s) AS accepter FROM e
        ), n AS (SELECT event_id, user_id AS tx_id, CAST(floor(value) AS INT) AS pos, lead(CAST(floor(value) AS INT)) OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS INT), event_id) AS nxt FROM events)
        SELECT event_id, tx_id, pos, nxt AS next FROM n WHERE nxt > pos AND tx_id IN (SELECT tx_id FROM x) AND NOT EXISTS (SELECT 1 FROM j WHERE j.tx_id = n.tx_id AND donor = pos AND accepter = nxt)""",
    "exon_overlap": f"""WITH {_E} SELECT event_id, count(*) AS n_exons, count(*) FILTER (WHERE pos <= s AND t <= pos + 20) AS n_inside, CAST(sum(least(t, pos + 20) - greatest(s, pos)) AS BIGINT) AS shared
        FROM v JOIN e USING (tx_id) WHERE pos < t AND s < pos + 20 GROUP BY event_id""",
    "adjacent_mnv": """WITH z AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, user_id AS tx_id, CAST(floor(value) AS INT) AS s, CAST(floor(value) AS INT) + CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS e,
          substr('ACGT', CAST(floor(value) AS INT) % 4 + 1, 1) AS b, CASE WHEN event_type = 'signup' THEN 'INDEL' WHEN event_type <> 'purchase' THEN 'SNV' END AS k FROM events)
        SELECT f.tx_id, f.s AS start, g.e AS "end", 'MNV-' || f.s || '-' || f.b || g.b || '-' || f.b || g.b AS id, f.id || '+' || g.id AS ids
        FROM z f JOIN z g ON f.tx_id = g.tx_id AND f.k = g.k AND g.s = f.e""",
    "hypermutated_regions": """WITH z AS (SELECT user_id AS tx_id, CAST(floor(value) AS INT) AS s, CAST(floor(value) AS INT) + CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS e FROM events
        ), m AS (SELECT *, row_number() OVER o AS rn, max(e) OVER (PARTITION BY tx_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM z WINDOW o AS (PARTITION BY tx_id ORDER BY s, e)
        ), g AS (SELECT tx_id, sum(CASE WHEN r IS NULL OR s - r >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY tx_id ORDER BY rn) AS region FROM m
        ), c AS (SELECT tx_id, region, count(*) AS n FROM g GROUP BY ALL) SELECT tx_id, count(*) AS n_regions, max(n) AS largest FROM c GROUP BY tx_id""",
    "frame_shift_class": """SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN ((length(p_name) - length(p_type) - 1) % 3 + 3) % 3 WHEN 2 THEN ((length(p_name) - 1) % 3 + 3) % 3
        ELSE ((length(p_name) - length(p_brand)) % 3 + 3) % 3 END AS INT) AS shift FROM part""",
    "gvf_info": "SELECT p_partkey, CAST(p_size - 1 AS VARCHAR) AS start_0, p_type AS symbol, 'TRANSCRIPT_ID=' || p_brand || ';START=' || p_size || ';GENE_SYMBOL=' || p_type AS written FROM part",
    "merge_pools": f"""WITH {_peptides(_TRYPSIN)}, t AS (SELECT DISTINCT pep AS seq, coalesce(lower(p.lang), 'na') AS lang FROM d JOIN p USING (doc_id))
        SELECT seq, string_agg(lang, ' ' ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, lang) AS header FROM t WHERE seq NOT IN (SELECT seq FROM t WHERE lang = 'de') GROUP BY seq""",
    "source_split": f"""WITH {_LABELLED}, b AS (SELECT seq, arg_min(source, list_position({_ORDER}, source)) AS database FROM l GROUP BY seq)
        SELECT database, count(*) AS n FROM b GROUP BY database""",
    "header_entries": f"WITH {_LABELLED} SELECT 'base' AS kind, 'TX' || lang AS backbone, 'SNV-' || source AS variants, count(*) AS n FROM l GROUP BY ALL",
    "filter_by_expression": f"""WITH {_LABELLED}, g AS (SELECT coalesce(upper(lang), 'NA') AS lang, avg(length(seq)) AS quant FROM p GROUP BY 1)
        SELECT seq, string_agg('TX' || lang || '|SNV-' || source, ' ' ORDER BY 'TX' || lang || '|SNV-' || source) AS header FROM l JOIN g USING (lang)
        WHERE lang = 'EN' OR quant >= (SELECT avg(quant) FROM g) GROUP BY seq""",
}
