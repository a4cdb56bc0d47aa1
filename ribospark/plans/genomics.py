"""Queries of coordinates, conversion and calling over a genome made of the driver's tables, with SQL.

An order is a gene on a contig of its own. Its line items, laid end to end with gaps, are the exons of transcript `T`;
transcript `U` has the first and the last of three or more. The bases are those of hashes of the order's number. Caller
records are lines in the callers' own formats made of events and orders, and go through the readers of these formats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.functions import intervals, labels
from ribospark.operators import convert, reference, routing
from ribospark.operators.reference import Reference
from ribospark.plans.peptides import _E, GAP, _codon_sql, transcripts
from ribospark.session import checkpointed, table
from ribospark.sources import callers, gvf, sinks

_HEX, _DNA = "0123456789abcdef", "ACGT" * 4
_INTERVALS = "array<struct<start:int,end:int>>"


# --- the genome --------------------------------------------------------------------------------------------------------


def _base(spark: SparkSession, d: str) -> DataFrame:
    """(o, strand, exons, stop, size): an order's exons, their end, and the length of its contig."""
    rows = transcripts(spark, d).select(F.col("tx_id").alias("o"), "strand", "exons", F.element_at("exons", -1)["end"].alias("stop"))
    return checkpointed(rows.withColumn("size", F.col("stop") + GAP))


def _named(prefix: str, o: Column | str = "o") -> Column:
    o = F.col(o) if isinstance(o, str) else o
    return F.concat(F.lit(prefix), o.cast("string"))


def _gene(o: Column | str = "o") -> Column:
    o = F.col(o) if isinstance(o, str) else o
    return F.concat(_named("G", o), F.lit("."), (o % 3).cast("string"))


def _coding_parts() -> tuple[Column, Column]:
    """CDS and UTR: the exons but for 7 bases at the lower end and 4 at the upper one."""
    lo, hi = F.get("exons", F.lit(0))["start"] + 7, F.col("stop") - 4

    def inside(a: Column, b: Column, *more: Column) -> Column:
        cut = F.transform("exons", lambda e: F.struct(F.greatest(e["start"], a).alias("start"), F.least(e["end"], b).alias("end"), *more))
        return F.filter(cut, lambda e: e["start"] < e["end"])

    frame = (F.col("o") % 3).cast("int").alias("frame")
    return inside(lo, hi, frame), F.concat(inside(F.lit(0), lo), inside(hi, F.col("stop")))


def world(base: DataFrame) -> Reference:
    hashes = F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / 32).cast("int")), lambda k: F.md5(F.concat(_named(""), F.lit(":"), k.cast("string"))))
    text = F.array_join(hashes, "")
    genome = base.select(_named("C").alias("seqname"), F.substring(F.translate(text, _HEX, _DNA), F.lit(1), F.col("size")).alias("seq"))
    genes = base.select(
        _gene().alias("gene_id"), _named("N").alias("gene_name"), F.lit("protein_coding").alias("biotype"), _named("C").alias("chrom"), F.lit(0).alias("start"), F.col("size").alias("end"), "strand", F.col("o").alias("pos")
    )
    cds, utr = _coding_parts()
    none = F.array().cast(_INTERVALS)
    shared = [
        _gene().alias("gene_id"), F.lit(None).cast("string").alias("protein_id"), _named("N").alias("gene_name"), _named("C").alias("chrom"),
        F.lit(0).alias("start"), F.col("stop").alias("end"), "strand",
    ]
    rest = [none.alias("sec"), F.array().cast("array<string>").alias("tags")]
    noncoding = F.lit("lncRNA").alias("biotype")
    kind = F.when(F.col("o") % 3 > 0, "protein_coding").otherwise("lncRNA").alias("biotype")
    t = base.select(_named("T").alias("tx_id"), *shared, kind, "exons", cds.alias("cds"), F.array_sort(utr).alias("utr"), *rest, (F.col("o") % 3 > 0).alias("is_coding"), F.col("o").alias("pos"))
    ends = F.array(F.get("exons", F.lit(0)), F.element_at("exons", -1))
    u = base.where(F.size("exons") >= 3).select(
        _named("U").alias("tx_id"), *shared, noncoding, ends.alias("exons"), F.array().cast("array<struct<start:int,end:int,frame:int>>").alias("cds"), none.alias("utr"), *rest, F.lit(False).alias("is_coding"), F.col("o").alias("pos")
    )
    return Reference(genes, t.unionByName(u), genome)


def _events(spark: SparkSession, d: str, base: DataFrame) -> DataFrame:
    """(event_id, event_type, o, p, value, …): events at a base of the exons' range of their user's order."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("o"), F.floor("value").cast("int").alias("value"))
    return e.join(base, "o").withColumn("p", F.pmod(F.col("value"), F.col("stop")).cast("int"))


def _lines(spark: SparkSession, rows: DataFrame, fields: list[Column | str], head: list[str] | None = None) -> DataFrame:
    """(value): rows as tab-separated lines, after a header line."""
    text = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    lines = rows.select(F.concat_ws("\t", *(F.coalesce(f, F.lit("")) for f in text)).alias("value"))
    return lines if head is None else sinks.with_head(lines, ["\t".join(head)])


# --- sequences and coordinates -----------------------------------------------------------------------------------------


def gene_sequences(spark: SparkSession, d: str) -> DataFrame:
    return world(_base(spark, d)).gene_sequences()


def spliced_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return world(_base(spark, d)).transcript_sequences().select("tx_id", "tx_seq")


def coding_regions(spark: SparkSession, d: str) -> DataFrame:
    """ORF, coding bases and bases of either UTR of transcripts with a CDS."""
    ref = world(_base(spark, d))
    bases = {
        n: F.aggregate(f(F.col("cds"), F.col("utr"), F.col("strand")), F.lit(0), lambda a, u: a + u["end"] - u["start"]).alias(n)
        for n, f in (("five", reference.five_utr), ("three", reference.three_utr))
    }
    seqs = ref.transcript_sequences().where(F.size("cds") > 0).select("tx_id", "orf_start", "orf_end", bases["five"], bases["three"])
    return seqs.join(ref.cds_sequences(), "tx_id")


def translated_cds(spark: SparkSession, d: str) -> DataFrame:
    return world(_base(spark, d)).translated()


def gene_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """A base and an interval of the genome on the gene and back, and the codons that the interval touches."""
    e = _events(spark, d, _base(spark, d)).withColumns({"z": F.lit(0), "stop5": F.col("p") + 5})
    own = (F.col("z"), F.col("size"), F.col("strand"))
    at = intervals.genomic_to_gene(F.col("p"), *own)
    span = intervals.range_genomic_to_gene(F.col("p"), F.col("stop5"), *own)
    back = intervals.range_gene_to_genomic(span["start"], span["end"], *own)
    aa = intervals.codon_range(F.col("p"), F.col("stop5"), F.pmod("event_id", F.lit(3)))
    return e.select(
        "event_id", at.alias("gene_pos"), intervals.gene_to_genomic(at, *own).alias("genomic"), span["start"].alias("a"), span["end"].alias("b"),
        back["start"].alias("x"), back["end"].alias("y"), aa["start"].alias("aa_start"), aa["end"].alias("aa_end"),
    )


def _on_genes(spark: SparkSession, d: str, base: DataFrame) -> DataFrame:
    """Small variants and deletions on genes: an event of 1 to 3 bases at its place on the gene."""
    size = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).otherwise(1)
    kind = F.when(F.col("event_type") == "purchase", "Deletion").when(size == 2, "INDEL").otherwise("SNV")
    return _events(spark, d, base).select(
        "event_id", _gene().alias("gene_id"), F.col("p").alias("start"), (F.col("p") + size).alias("end"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), kind.alias("type"),
        _named("V", "event_id").alias("id"), _named("T").alias("tx_id"), F.create_map().cast("map<string,string>").alias("attrs"),
    )


def locate_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of genes on their transcripts, and the kind of work they belong to."""
    base = _base(spark, d)
    ref = world(base)
    return routing.locate(_on_genes(spark, d, base), ref.transcripts, ref.genes).select("event_id", "bucket", "tx_start", "tx_end")


def locate_fusions(spark: SparkSession, d: str) -> DataFrame:
    """Breakpoints of fusions snapped to exons: the donor's to the end before it, the accepter's to the start after it."""
    base = _base(spark, d)
    ref = world(base)
    on_gene = F.col("p") + 1
    attrs = F.create_map(F.lit("ACCEPTER_TRANSCRIPT_ID"), _named("T"), F.lit("ACCEPTER_GENE_ID"), _gene(), F.lit("ACCEPTER_POSITION"), F.floor(F.col("p") / 2).cast("string"))
    v = _events(spark, d, base).select(
        "event_id", _gene().alias("gene_id"), on_gene.alias("start"), (on_gene + 1).alias("end"), F.lit("A").alias("ref"), F.lit("<FUSION>").alias("alt"), F.lit("Fusion").alias("type"),
        _named("V", "event_id").alias("id"), _named("T").alias("tx_id"), attrs.alias("attrs"),
    )
    located = routing.locate(v, ref.transcripts, ref.genes).where("bucket = 'fusion'")
    out = routing.accepter(located, ref.transcripts, ref.genes)
    return out.select(
        "event_id", "start", "tx_start", F.col("left_insert.start").alias("left_start"), F.col("left_insert.end").alias("left_end"), "acc_tx_pos",
        F.col("right_insert.start").alias("right_start"), F.col("right_insert.end").alias("right_end"),
    )


# --- conversion --------------------------------------------------------------------------------------------------------

_VEP_SIZE = {"view": 1, "click": 2, "signup": 2, "error": 1, "purchase": 3}
_VEP_ALLELE = {"click": "-", "signup": "GA", "error": "ACG", "purchase": "TTA"}


def _vep_lines(spark: SparkSession, e: DataFrame) -> DataFrame:
    size = F.create_map(*(F.lit(x) for pair in _VEP_SIZE.items() for x in pair))[F.col("event_type")]
    letters = F.substring(F.lit("ACGT"), (F.col("event_id") % 4).cast("int") + 1, F.lit(1))
    allele = F.coalesce(F.create_map(*(F.lit(x) for pair in _VEP_ALLELE.items() for x in pair))[F.col("event_type")], letters)
    first, last = (F.col("p") + 1).cast("string"), (F.col("p") + size).cast("string")
    place = F.concat(_named("C"), F.lit(":"), first, F.when(size > 1, F.concat(F.lit("-"), last)).otherwise(""))
    gene = F.when(F.col("event_id") % 13 == 0, "missing").otherwise(_gene())
    feature = F.when(F.col("event_id") % 11 == 0, "missing").otherwise(_named("T"))
    dash = F.lit("-")
    fields = [F.col("event_id"), place, allele, gene, feature, F.lit("Transcript"), F.lit("missense_variant,splice_region_variant"), dash, dash, dash, F.lit("A/T"), F.lit("gCt/gTt"), dash, dash]
    return _lines(spark, e, fields)


def _vep(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    return convert.vep(callers.vep_tsv(spark, _vep_lines(spark, _events(spark, d, base))), world(base))


def convert_vep(spark: SparkSession, d: str) -> DataFrame:
    return _vep(spark, d).where("status = 'ok'").select("gene_id", "tx_id", "start", "end", "ref", "alt", "type", "id", F.col("attrs")["GENE_SYMBOL"].alias("symbol"))


def convert_vep_tally(spark: SparkSession, d: str) -> DataFrame:
    return convert.tally(_vep(spark, d))


def gvf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Converted records written as lines of a variant file, and read again."""
    ok = _vep(spark, d).where("status = 'ok'")
    lines = sinks.with_head(ok.select(gvf.variant_line().alias("value")), gvf.metadata_lines({"source": "x"}, ["TRANSCRIPT_ID", "GENE_SYMBOL", "GENOMIC_POSITION"]))
    back = gvf.variants(spark, lines)
    return back.select("gene_id", "tx_id", "start", "end", "ref", "alt", "type", "id", F.col("attrs")["GENE_SYMBOL"].alias("symbol"), F.col("attrs")["GENOMIC_POSITION"].alias("place"))


def gvf_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels alone of the records of a variant file."""
    return gvf.labels(spark, _vep(spark, d).where("status = 'ok'").select(gvf.variant_line().alias("value")))


def convert_reditools(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    n = [F.col("event_id") % k for k in (7, 11, 13, 17)]
    counts = F.concat(F.lit("["), F.concat_ws(", ", *(x.cast("string") for x in n)), F.lit("]"))
    subs = F.when(F.col("event_id") % 3 == 0, "AC").when(F.col("event_id") % 3 == 1, "AC AT").otherwise("-")
    covered = F.when(F.col("event_id") % 5 == 0, "-1").otherwise((F.col("event_id") % 23).cast("string"))
    names = F.concat(_named("T"), F.lit("-transcript&"), _named("U"), F.lit("-transcript$"), _named("T"), F.lit("-exon"))
    dash = F.lit("-")
    fields = [_named("C"), F.col("p") + 1, F.lit("A"), F.lit(1), F.lit(30), F.lit(35.5), counts, subs, F.lit(0.1), covered, dash, dash, dash, dash, F.lit("exon"), _gene(), names]
    lines = _lines(spark, _events(spark, d, base), fields, ["Region", "Position"])
    return convert.reditools(callers.reditools(spark, lines), world(base)).select("gene_id", "tx_id", "start", "end", "ref", "alt", "id")


def _pairs(spark: SparkSession, d: str, base: DataFrame) -> DataFrame:
    """Events with the next order as the other gene of a fusion."""
    other = base.select((F.col("o") - 1).alias("o"), F.col("stop").alias("r_stop"), F.col("strand").alias("r_strand"))
    return _events(spark, d, base).join(other, "o").withColumn("rp", F.pmod(F.col("value") * 3 + 1, F.col("r_stop")).cast("int"))


def _sign(strand: str) -> Column:
    return F.when(F.col(strand) == 1, "+").otherwise("-")


def _point(o: Column, at: str, strand: str) -> Column:
    return F.concat_ws(":", _named("C", o), (F.col(at) + 1).cast("string"), _sign(strand))


def _fusion(rows: DataFrame) -> DataFrame:
    attr = F.col("attrs")
    return rows.select("gene_id", "tx_id", "start", "ref", "id", attr["ACCEPTER_GENE_ID"].alias("acc_gene"), attr["ACCEPTER_TRANSCRIPT_ID"].alias("acc_tx"), attr["ACCEPTER_POSITION"].cast("int").alias("acc_pos"))


def convert_star_fusion(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    head = ["#FusionName", "JunctionReadCount", "SpanningFragCount", "est_J", "LeftGene", "LeftBreakpoint", "RightGene", "RightBreakpoint", "FFPM"]
    other = F.col("o") + 1
    genes = [F.concat(_named("N"), F.lit("^"), _gene()), F.concat(_named("N", other), F.lit("^"), _gene(other))]
    fields = [F.lit("x--y"), F.lit(3), F.lit(4), F.col("event_id") % 8, genes[0], _point(F.col("o"), "p", "strand"), genes[1], _point(other, "rp", "r_strand"), F.lit(0.5)]
    return _fusion(convert.star_fusion(callers.star_fusion(spark, _lines(spark, _pairs(spark, d, base), fields, head)), world(base), 3.0))


def convert_fusion_catcher(spark: SparkSession, d: str) -> DataFrame:
    """Genes without version; common mappings and unique reads are gates."""
    base = _base(spark, d)
    other, x = F.col("o") + 1, F.lit("x")
    fields = [x, x, x, F.col("event_id") % 2, F.lit(1), F.col("event_id") % 9, F.lit(20), x, _point(F.col("o"), "p", "strand"), _point(other, "rp", "r_strand"), _named("G"), _named("G", other), x, x, x, x]
    return _fusion(convert.fusion_catcher(callers.fusion_catcher(spark, _lines(spark, _pairs(spark, d, base), fields, ["Gene_1_symbol(5end_fusion_partner)"])), world(base)))


def convert_arriba(spark: SparkSession, d: str) -> DataFrame:
    """Reads, confidence, and strands that must be those of the genes."""
    base = _base(spark, d)
    other, x = F.col("o") + 1, F.lit(".")
    trust = F.when(F.col("event_type") == "view", "low").when(F.col("event_type") == "click", "medium").otherwise("high")
    wrong = F.when(F.col("event_id") % 5 == 0, F.translate(_sign("strand"), "+-", "-+")).otherwise(_sign("strand"))
    fields = [
        x, x, F.concat(x, F.lit("/"), wrong), F.concat(x, F.lit("/"), _sign("r_strand")), _point(F.col("o"), "p", "strand"), _point(other, "rp", "r_strand"), x, x, x, F.col("event_id") % 3, F.col("event_id") % 4,
        F.lit(1), F.lit(1), F.lit(1), trust, x, x, x, x, x, _gene(), _gene(other), *[x] * 8,
    ]
    return _fusion(convert.arriba(callers.arriba(spark, _lines(spark, _pairs(spark, d, base), fields, ["#gene1"])), world(base)))


def _circles(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """An order's circle: its second and third exons as far as it has them, or the intron before the second."""
    base = _base(spark, d) if base is None else base
    n = F.size("exons")
    intron = (F.col("o") % 4 == 3) & (n >= 2)
    exon = lambda i: F.get("exons", F.lit(i))
    pieces = F.when(intron, F.array(F.struct(exon(0)["end"].alias("start"), exon(1)["start"].alias("end")))).when(n == 1, F.slice("exons", 1, 1)).otherwise(F.slice("exons", 2, 2))
    off = F.when(F.col("o") % 5 == 0, 6).otherwise(0)
    rows = base.withColumns({"intron": intron, "pieces": F.transform(pieces, lambda e: F.struct((e["start"] + off).alias("start"), (e["end"] + off).alias("end")))})
    first, last = F.get("pieces", F.lit(0))["start"], F.element_at("pieces", -1)["end"]

    def joined(f) -> Column:
        return F.concat(F.array_join(F.transform("pieces", lambda e: f(e).cast("string")), ","), F.lit(","))

    x = F.lit("x")
    name = F.when(F.col("o") % 7 == 0, "missing").otherwise(_named("T"))
    fields = [
        _named("C"), first, last, x, F.lit(0), _sign("strand"), first, last, F.lit("0,0,0"), F.size("pieces"), joined(lambda e: e["end"] - e["start"]), joined(lambda e: e["start"] - first),
        F.col("o") % 3, F.when(F.col("intron"), "ciRNA").otherwise("circRNA"), _named("N"), name, x, x,
    ]
    return convert.circexplorer(callers.circexplorer(spark, _lines(spark, rows, fields)), world(base))


def _fragments(rows: DataFrame) -> DataFrame:
    pieces = F.array_join(F.transform("fragments", lambda f: F.concat(f["start"].cast("string"), F.lit("-"), f["end"].cast("string"), F.lit(":"), f["type"])), ",")
    return rows.select("gene_id", "tx_id", "id", "start", pieces.alias("fragments"), "genomic_location")


def convert_circles(spark: SparkSession, d: str) -> DataFrame:
    return _fragments(_circles(spark, d).where("status = 'ok'"))


def convert_circles_tally(spark: SparkSession, d: str) -> DataFrame:
    return convert.tally(_circles(spark, d))


def circle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Circles written as lines of a variant file, and read again."""
    return _fragments(gvf.circles(spark, _circles(spark, d).where("status = 'ok'").select(gvf.circle_line().alias("value"))))


_HEAD, _TAIL = ["ID", "GeneID", "geneSymbol", "chr", "strand"], ["ID", "IJC_SAMPLE_1", "SJC_SAMPLE_1", "IJC_SAMPLE_2", "SJC_SAMPLE_2", "IncFormLen", "SkipFormLen", "PValue", "FDR"]


def _rmats(event: str, least: int, exons: Callable[[], list[tuple[Column, Column]]]):
    """Conversion of one event for each order with so many exons; ``exons()`` are the event's columns in the file's order."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        base = _base(spark, d)
        rows = base.where(F.size("exons") >= least)
        if event == "A3SS":  # the shorter exon begins 2 bases in
            rows = rows.where(F.when(F.col("strand") == 1, _size(1)).otherwise(_size(0)) > 3)
        counts = [(F.col("o") % 3).cast("string"), F.lit("0,4"), F.lit(""), F.lit("2")]
        values = [F.col("o"), _gene(), _named("N"), _named("C"), _sign("strand"), *(x for pair in exons() for x in pair), F.col("o"), *counts, F.lit(100), F.lit(50), F.lit("NA"), F.lit(0.5)]
        head = [*_HEAD, *callers._RMATS_EXONS[event].values(), *_TAIL]
        lines = _lines(spark, rows, values, head)
        out = convert.rmats(callers.rmats(spark, lines, event), world(base), event)
        attr = F.col("attrs")
        return out.select(
            "gene_id", "tx_id", "start", "end", "ref", "alt", "id", attr["START"].cast("int").alias("first"), attr["END"].cast("int").alias("last"),
            attr["DONOR_START"].cast("int").alias("ds"), attr["DONOR_END"].cast("int").alias("de"),
        )

    return query


def _exon(i: int) -> tuple[Column, Column]:
    e = F.get("exons", F.lit(i))
    return e["start"], e["end"]


def _size(i: int) -> Column:
    return _exon(i)[1] - _exon(i)[0]


def _by_strand(plus: tuple[Column, Column], minus: tuple[Column, Column]) -> tuple[Column, Column]:
    return tuple(F.when(F.col("strand") == 1, a).otherwise(b) for a, b in zip(plus, minus, strict=True))


def _skipped() -> list:
    return [_exon(1), _exon(0), _exon(2)]


def _within_gap() -> list:
    return [(_exon(0)[1] + 3, _exon(0)[1] + 7), _exon(0), _exon(1)]


def _longer() -> list:
    return [_by_strand((_exon(0)[0], _exon(0)[1] + 4), (_exon(1)[0] - 4, _exon(1)[1])), _by_strand(_exon(0), _exon(1)), _by_strand(_exon(1), _exon(0))]


def _shorter() -> list:
    return [_by_strand(_exon(1), _exon(0)), _by_strand((_exon(1)[0] + 2, _exon(1)[1]), (_exon(0)[0], _exon(0)[1] - 2)), _by_strand(_exon(0), _exon(1))]


def _exchanged() -> list:
    return [_exon(1), (_exon(1)[1] + 3, _exon(1)[1] + 7), _exon(0), _exon(2)]


def _retained() -> list:
    return [(_exon(0)[0], _exon(1)[1]), _exon(0), _exon(1)]


QUERIES = {
    "gene_sequences": gene_sequences,
    "spliced_transcripts": spliced_transcripts,
    "coding_regions": coding_regions,
    "translated_cds": translated_cds,
    "gene_coordinates": gene_coordinates,
    "locate_variants": locate_variants,
    "locate_fusions": locate_fusions,
    "convert_vep": convert_vep,
    "convert_vep_tally": convert_vep_tally,
    "gvf_round_trip": gvf_round_trip,
    "gvf_labels": gvf_labels,
    "convert_reditools": convert_reditools,
    "convert_star_fusion": convert_star_fusion,
    "convert_fusion_catcher": convert_fusion_catcher,
    "convert_arriba": convert_arriba,
    "convert_circles": convert_circles,
    "convert_circles_tally": convert_circles_tally,
    "circle_round_trip": circle_round_trip,
    "convert_rmats_se": _rmats("SE", 3, _skipped),
    "convert_rmats_se_novel": _rmats("SE", 2, _within_gap),
    "convert_rmats_a5ss": _rmats("A5SS", 2, _longer),
    "convert_rmats_a3ss": _rmats("A3SS", 2, _shorter),
    "convert_rmats_mxe": _rmats("MXE", 3, _exchanged),
    "convert_rmats_ri": _rmats("RI", 2, _retained),
}

# --- SQL ---------------------------------------------------------------------------------------------------------------


def _rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


_W = f"""{_E}, k AS (SELECT tx_id AS o, strand, s, t, row_number() OVER (PARTITION BY tx_id ORDER BY s) AS i, c0, c1 FROM e
), w AS (SELECT o, any_value(strand) AS strand, CAST(max(t) AS INT) AS stop, CAST(max(t) + {GAP} AS INT) AS len, count(*) AS n FROM k GROUP BY o
), q0 AS (SELECT *, substr(translate(array_to_string([md5(o || ':' || h) FOR h IN range(0, (len - 1) // 32 + 1)], ''), '{_HEX}', '{_DNA}'), 1, len) AS seq, 'G' || o || '.' || o % 3 AS gene FROM w
), q AS (SELECT *, CASE WHEN strand = 1 THEN seq ELSE {_rc("seq")} END AS gseq FROM q0
), ev AS (SELECT event_id, event_type, user_id AS o, CAST(floor(value) AS INT) AS val, CAST(floor(value) AS INT) % stop AS p, w.* EXCLUDE (o) FROM events JOIN w ON user_id = w.o
), tx AS (SELECT 'T' || o AS tx, o, 'T' AS kind, s, t FROM k UNION ALL SELECT 'U' || o, o, 'U', s, t FROM k JOIN w USING (o) WHERE n >= 3 AND (i = 1 OR i = n)
), sp AS (SELECT tx, any_value(o) AS o, any_value(strand) AS strand, string_agg(substr(seq, s + 1, t - s), '' ORDER BY s) AS fwd FROM tx JOIN q USING (o) GROUP BY tx
), ts AS (SELECT tx, o, strand, CASE WHEN strand = 1 THEN fwd ELSE {_rc("fwd")} END AS seq FROM sp)"""
_CD = """, cd AS (SELECT o, any_value(strand) AS strand, min(s) + 7 AS lo, max(t) - 4 AS hi FROM k GROUP BY o
), cb AS (SELECT k.o, any_value(cd.strand) AS strand, CAST(sum(greatest(0, least(t, lo) - s)) AS INT) AS below, CAST(sum(greatest(0, t - greatest(s, hi))) AS INT) AS above,
  CAST(sum(greatest(0, least(t, hi) - greatest(s, lo))) AS INT) AS coded, CAST(sum(t - s) AS INT) AS total,
  string_agg(CASE WHEN least(t, hi) > greatest(s, lo) THEN substr(seq, CAST(greatest(s, lo) + 1 AS BIGINT), CAST(least(t, hi) - greatest(s, lo) AS BIGINT)) ELSE '' END, '' ORDER BY s) AS fwd
  FROM k JOIN cd USING (o) JOIN q USING (o) GROUP BY k.o
), cr AS (SELECT o, strand, CASE WHEN strand = 1 THEN below ELSE above END AS five, CASE WHEN strand = 1 THEN above ELSE below END AS three, total, fwd FROM cb WHERE coded > 0
), orf AS (SELECT o, strand, fwd, five, three, CAST(five + o % 3 AS INT) AS orf_start, CAST(total - three - (total - three - five - o % 3) % 3 AS INT) AS orf_end FROM cr)"""
_GENE_AT = "CASE WHEN strand = 1 THEN {p} ELSE len - 1 - ({p}) END"


def _gene_at(p: str) -> str:
    return _GENE_AT.format(p=p)


def _span(a: str, b: str) -> tuple[str, str]:
    """Gene interval of a genomic one."""
    return f"CASE WHEN strand = 1 THEN {a} ELSE len - ({b}) END", f"CASE WHEN strand = 1 THEN {b} ELSE len - ({a}) END"


def _idx(p: str, o: str = "z.o") -> str:
    """Index on T of a genomic base."""
    return f"(SELECT CASE WHEN strand = 1 THEN c0 + ({p}) - s ELSE c0 + t - 1 - ({p}) END FROM k WHERE k.o = {o} AND s <= ({p}) AND ({p}) < t)"


_SIZE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _VEP_SIZE.items()) + " END"
_ALLELE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VEP_ALLELE.items()) + " ELSE substr('ACGT', event_id % 4 + 1, 1) END"
_VEP = f"""{_W}, v1 AS (SELECT event_id, o, strand, len, stop, p AS lo, p + {_SIZE} AS hi, {_ALLELE} AS allele FROM ev
), v2 AS (SELECT v1.*, gseq, gene, {_span("lo", "hi")[0]} AS a, {_span("lo", "hi")[1]} AS b, CASE WHEN v1.strand = 1 THEN allele ELSE {_rc("allele")} END AS al, CASE WHEN v1.strand = 1 THEN 0 ELSE {GAP} END AS ta, CASE WHEN v1.strand = 1 THEN v1.stop ELSE v1.len END AS tb
  FROM (SELECT * FROM v1) v1 JOIN (SELECT o, gseq, gene FROM q) USING (o)
), v3 AS (SELECT *, substr(gseq, a + 1, 1) AS here, substr(gseq, a, 1) AS before FROM v2
), v4 AS (SELECT *, CASE WHEN allele = '-' THEN {{'start': a - 1, 'end': b, 'ref': substr(gseq, a, b - a + 1), 'alt': before}}
    WHEN b - a = 1 AND length(al) > 1 THEN CASE WHEN here = right(al, 1) THEN {{'start': a - 1, 'end': a, 'ref': before, 'alt': before || left(al, length(al) - 1)}}
      WHEN here = left(al, 1) THEN {{'start': a, 'end': b, 'ref': here, 'alt': al}} END
    WHEN b - a = 1 THEN {{'start': a, 'end': b, 'ref': here, 'alt': al}}
    WHEN b - a = 2 THEN {{'start': a, 'end': b - 1, 'ref': here, 'alt': here || al}}
    ELSE {{'start': a, 'end': b, 'ref': substr(gseq, a + 1, b - a), 'alt': al}} END AS v FROM v3
), v5 AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'unknown gene' WHEN event_id % 11 = 0 THEN 'unknown transcript' WHEN a <= ta THEN 'start site' WHEN b > tb THEN 'stop site' WHEN v IS NULL THEN 'allele' ELSE 'ok' END AS status,
    CASE WHEN length(v.ref) = 1 AND length(v.alt) = 1 THEN 'SNV' WHEN length(v.ref) = 1 THEN 'INDEL' ELSE 'MNV' END AS kind FROM v4
), ok AS (SELECT gene AS gene_id, 'T' || o AS tx_id, v.start AS start, v.end AS "end", v.ref AS ref, v.alt AS alt, kind AS type, kind || '-' || (v.start + 1) || '-' || v.ref || '-' || v.alt AS id, 'N' || o AS symbol,
    'C' || o || ':' || (lo + 1) || CASE WHEN hi - lo > 1 THEN '-' || hi ELSE '' END AS place FROM v5 WHERE status = 'ok')"""
_RES = f"""{_W}, r1 AS (SELECT event_id, o, strand, len, p, [event_id % 7, event_id % 11, event_id % 13, event_id % 17] AS n, unnest(CASE event_id % 3 WHEN 0 THEN ['C'] WHEN 1 THEN ['C', 'T'] ELSE [] END) AS alt FROM ev
    WHERE event_id % 5 = 0 OR event_id % 23 >= 10
), r2 AS (SELECT *, list_sum(n) AS total, CASE alt WHEN 'C' THEN n[2] ELSE n[4] END AS hits FROM r1
), r3 AS (SELECT r2.*, tx FROM r2 JOIN tx USING (o) WHERE total >= 10 AND hits >= 3 AND hits / total >= 0.1 AND s <= p AND p < t)
SELECT 'G' || o || '.' || o % 3 AS gene_id, tx AS tx_id, {_gene_at("p")} AS start, {_gene_at("p")} + 1 AS "end", 'A' AS ref, alt, 'RES-' || ({_gene_at("p")} + 1) || '-A-' || alt AS id FROM r3"""


def _fusion_sql(gate: str, shift: int) -> str:
    return f"""WITH {_W}, f1 AS (SELECT event_id, event_type, ev.o, ev.strand, ev.len, ev.p, r.strand AS rs, r.len AS rl, (ev.val * 3 + 1) % r.stop AS rp, ev.n AS ln, r.n AS rn FROM ev JOIN w r ON r.o = ev.o + 1 WHERE {gate}
    ), f2 AS (SELECT f1.*, seq, {_gene_at("p")} AS lpos, CASE WHEN rs = 1 THEN rp ELSE rl - 1 - rp END AS rpos FROM f1 JOIN (SELECT o, seq FROM q) USING (o)
    ), f3 AS (SELECT *, unnest(CASE WHEN ln >= 3 THEN ['T', 'U'] ELSE ['T'] END) AS lt FROM f2), f4 AS (SELECT *, unnest(CASE WHEN rn >= 3 THEN ['T', 'U'] ELSE ['T'] END) AS rt FROM f3)
    SELECT 'G' || o || '.' || o % 3 AS gene_id, lt || o AS tx_id, lpos + 1 AS start, CASE WHEN strand = 1 THEN substr(seq, p + 2 + {shift}, 1) ELSE translate(substr(seq, p + 2, 1), 'ACGT', 'TGCA') END AS ref,
      'FUSION-' || lt || o || ':' || (lpos + 1) || '-' || rt || (o + 1) || ':' || rpos AS id, 'G' || (o + 1) || '.' || (o + 1) % 3 AS acc_gene, rt || (o + 1) AS acc_tx, rpos AS acc_pos FROM f4"""


_ARRIBA = "event_id % 3 >= 1 AND event_id % 4 >= 1 AND event_type <> 'view' AND event_id % 5 <> 0"
_CIRC = f"""{_W}, z1 AS (SELECT o, any_value(w.strand) AS strand, any_value(len) AS len, any_value(n) AS n, o % 4 = 3 AND any_value(n) >= 2 AS intron, CASE WHEN o % 5 = 0 THEN 6 ELSE 0 END AS off,
    list({{'s': s, 't': t}} ORDER BY i) AS x FROM k JOIN w USING (o) GROUP BY o HAVING o % 3 >= 1
), z2 AS (SELECT *, CASE WHEN intron THEN [{{'s': x[1].t, 't': x[2].s}}] WHEN n = 1 THEN x[1:1] ELSE x[2:3] END AS y FROM z1
), z3 AS (SELECT *, y[1].s + off AS lo, y[len(y)].t + off AS hi, CASE WHEN o % 7 = 0 THEN 'unknown transcript' WHEN off = 0 THEN 'ok' WHEN intron THEN 'no intron' ELSE 'no exon' END AS status FROM (SELECT * RENAME (len AS size) FROM z2)
), z4 AS (SELECT o, strand, size, lo, hi, intron, unnest(y) AS f FROM z3 WHERE status = 'ok'
), z5 AS (SELECT *, CASE WHEN strand = 1 THEN f.s ELSE size - f.t END AS a, CASE WHEN strand = 1 THEN f.t ELSE size - f.s END AS b, CASE WHEN strand = 1 THEN lo ELSE size - hi END AS ga, CASE WHEN strand = 1 THEN hi ELSE size - lo END AS gb FROM z4
), cc AS (SELECT 'G' || o || '.' || o % 3 AS gene_id, 'T' || o AS tx_id, 'CIRC-T' || o || '-' || any_value(ga) || ':' || any_value(gb) AS id, any_value(ga) AS start,
    string_agg(a || '-' || b || ':' || CASE WHEN intron THEN 'intron' ELSE 'exon' END, ',' ORDER BY a) AS fragments, 'C' || o || ':' || any_value(lo) || ':' || any_value(hi) AS genomic_location FROM z5 GROUP BY o)"""
_INC = "o % 3 >= 1"


def _rmats_sql(rows: str, name: str, insertion: str | None = None) -> str:
    """``rows`` yields o, tx, kind, the genomic interval a, b of what is replaced (or the base before an insertion, along
    the strand, as a) and the donor's x, y; ``name`` is the event's id."""
    s, e = _span("a", "b")
    ds, de = _span("x", "y")
    ins = "kind = 'INS'"
    return f"""WITH {_W}, m AS (SELECT o, any_value(w.strand) AS strand, any_value(len) AS len, any_value(n) AS n, list({{'s': s, 't': t}} ORDER BY i) AS x FROM k JOIN w USING (o) GROUP BY o
    ), j AS (SELECT o, strand, len, n, x[1].s AS s1, x[1].t AS t1, x[2].s AS s2, x[2].t AS t2, x[3].s AS s3, x[3].t AS t3 FROM m WHERE n >= 2
    ), r AS ({rows}), g AS (SELECT r.*, CASE WHEN {ins} THEN {_gene_at("a")} ELSE {s} END AS start, CASE WHEN {ins} THEN {_gene_at("a")} + 1 ELSE {e} END AS stop, {ds} AS ds, {de} AS de, {name} AS id FROM r)
    SELECT gene AS gene_id, tx || o AS tx_id, g.start, g.stop AS "end", substr(gseq, g.start + 1, 1) AS ref, '<' || kind || '>' AS alt, id, CASE WHEN NOT {ins} THEN g.start END AS first, CASE WHEN NOT {ins} THEN g.stop END AS last, ds, de
    FROM g JOIN (SELECT o, gene, gseq FROM q) USING (o)"""


def _pick(plus: str, minus: str) -> str:
    return f"(CASE WHEN strand = 1 THEN {plus} ELSE {minus} END)"


def _g(p: str) -> str:
    return f"({_gene_at(p)})"


_SE_ID = "'SE_' || {0} || '-' || {1} || '-' || ({2} + 1) || '-' || ({3} + 1)".format
_SE_PARTS = lambda es, ee, uee, des: _SE_ID(_pick(_g(f"{uee} - 1"), _g(des)), _pick(_g(es), _g(f"{ee} - 1")), _pick(_g(f"{ee} - 1"), _g(es)), _pick(_g(des), _g(f"{uee} - 1")))
_MXE_ID = " || '-' || ".join(
    [f"({_pick(_g('t1 - 1'), _g('s3'))} + 1)", _pick(_g("s2"), _g("t2 - 1")), f"({_pick(_g('t2 - 1'), _g('s2'))} + 1)", _pick(_g("t2 + 3"), _g("t2 + 6")), f"({_pick(_g('t2 + 6'), _g('t2 + 3'))} + 1)", _pick(_g("s3"), _g("t1 - 1"))]
)
_J = "o, strand, len, s1, t1, s2, t2, s3, t3"

SQL = {
    "gene_sequences": f"WITH {_W} SELECT gene AS gene_id, gseq AS gene_seq FROM q",
    "spliced_transcripts": f"WITH {_W} SELECT tx AS tx_id, seq AS tx_seq FROM ts",
    "coding_regions": f"WITH {_W}{_CD} SELECT 'T' || o AS tx_id, orf_start, orf_end, five, three, CASE WHEN strand = 1 THEN fwd ELSE {_rc('fwd')} END AS cds_seq FROM orf",
    "translated_cds": f"""WITH {_W}{_CD}, c AS (SELECT tx, seq, orf_start, unnest(range(0, greatest((length(seq) - orf_start) // 3, 1))) AS i FROM orf JOIN ts ON tx = 'T' || orf.o)
        SELECT tx AS tx_id, split_part(string_agg(coalesce({_codon_sql("Standard")}[substr(seq, orf_start + 3 * i + 1, 3)], ''), '' ORDER BY i), '*', 1) AS protein FROM c GROUP BY tx""",
    "gene_coordinates": f"""WITH {_W} SELECT event_id, {_gene_at("p")} AS gene_pos, p AS genomic, {_span("p", "p + 5")[0]} AS a, {_span("p", "p + 5")[1]} AS b, p AS x, p + 5 AS y,
        CAST(floor((p - event_id % 3) / 3) AS INT) AS aa_start, CAST(ceil((p + 5 - event_id % 3) / 3) AS INT) AS aa_end FROM ev""",
    "locate_variants": f"""WITH {_W}, z AS (SELECT event_id, o, strand, len, stop, p AS a, p + CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS b, event_type = 'purchase' AS del FROM ev
        ), y AS (SELECT *, {_idx(_pick("a", "len - 1 - a"))} AS ia, {_idx(_pick("b - 1", "len - b"))} AS ib FROM z)
        SELECT event_id, CASE WHEN ia IS NOT NULL AND ib IS NOT NULL THEN 'transcriptional' WHEN ia IS NOT NULL OR ib IS NOT NULL THEN 'spanning' WHEN {_pick("a", "len - b")} < stop AND 0 < {_pick("b", "len - a")} THEN 'intronic' ELSE 'outside' END AS bucket,
          CASE WHEN del THEN ia - 1 ELSE ia END AS tx_start, ib + 1 AS tx_end FROM y""",
    "locate_fusions": f"""WITH {_W}, z AS (SELECT event_id, o, strand, len, p + 1 AS st, {_gene_at("p")} AS b, p // 2 AS ap, {_gene_at("p // 2")} AS ag FROM ev
        ), y AS (SELECT *, {_idx("b")} AS ib, {_idx("ag")} AS ia, CASE WHEN strand = 1 THEN (SELECT max(t - 1) FROM k WHERE k.o = z.o AND t <= b) ELSE (SELECT min(s) FROM k WHERE k.o = z.o AND s >= b) END AS up,
            CASE WHEN strand = 1 THEN (SELECT min(s) FROM k WHERE k.o = z.o AND s >= ag) ELSE (SELECT max(t - 1) FROM k WHERE k.o = z.o AND t - 1 <= ag) END AS dn FROM z
        ), x2 AS (SELECT *, {_gene_at("up")} + 1 AS snap, {_gene_at("dn")} AS dg FROM y), x3 AS (SELECT *, CASE WHEN ib IS NULL THEN snap ELSE st END AS pt FROM x2
        ), x4 AS (SELECT *, {_idx(_gene_at("pt - 1"), "x3.o")} AS ti, {_idx("dn", "x3.o")} AS di FROM x3)
        SELECT event_id, pt AS start, ti + 1 AS tx_start, CASE WHEN ib IS NULL THEN snap END AS left_start, CASE WHEN ib IS NULL THEN st END AS left_end, coalesce(ia, di) AS acc_tx_pos,
          CASE WHEN ia IS NULL THEN ap END AS right_start, CASE WHEN ia IS NULL THEN dg END AS right_end FROM x4 WHERE ti IS NOT NULL AND coalesce(ia, di) IS NOT NULL""",
    "convert_vep": f"WITH {_VEP} SELECT * EXCLUDE (place) FROM ok",
    "convert_vep_tally": f"WITH {_VEP} SELECT status, count(*) AS n FROM v5 GROUP BY status",
    "gvf_round_trip": f"WITH {_VEP} SELECT * REPLACE (CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) = 1 OR length(alt) = 1 THEN 'INDEL' ELSE 'MNV' END AS type) FROM ok",
    "gvf_labels": f"WITH {_VEP} SELECT gene_id, tx_id, id AS label FROM ok",
    "convert_reditools": f"WITH {_RES}",
    "convert_star_fusion": _fusion_sql("event_id % 8 >= 3", 1),
    "convert_fusion_catcher": _fusion_sql("event_id % 2 = 0 AND event_id % 9 >= 5", 0),
    "convert_arriba": _fusion_sql(_ARRIBA, 0),
    "convert_circles": f"WITH {_CIRC} SELECT * FROM cc",
    "convert_circles_tally": f"WITH {_CIRC} SELECT status, count(*) AS n FROM z3 GROUP BY status",
    "circle_round_trip": f"WITH {_CIRC} SELECT * REPLACE (replace(fragments, 'intron', 'exon') AS fragments) FROM cc",
    "convert_rmats_se": _rmats_sql(f"SELECT {_J}, 'T' AS tx, 'DEL' AS kind, s2 AS a, t2 AS b, NULL AS x, NULL AS y FROM j WHERE n > 3", _SE_PARTS("s2", "t2", "t1", "s3")),
    "convert_rmats_se_novel": _rmats_sql(
        f"SELECT {_J}, 'T' AS tx, 'INS' AS kind, {_pick('t1 - 1', 's2')} AS a, NULL AS b, t1 + 3 AS x, t1 + 7 AS y FROM j WHERE {_INC}", _SE_PARTS("(t1 + 3)", "(t1 + 7)", "t1", "s2")
    ),
    "convert_rmats_a5ss": _rmats_sql(
        f"SELECT {_J}, 'T' AS tx, 'INS' AS kind, {_pick('t1 - 1', 's2')} AS a, NULL AS b, {_pick('t1', 's2 - 4')} AS x, {_pick('t1 + 4', 's2')} AS y FROM j WHERE {_INC} AND (strand = 1 OR n >= 3)",
        f"'A5SS_' || ({_pick(_g('t1 + 3'), _g('s2 - 4'))} + 1) || '-' || ({_pick(_g('t1 - 1'), _g('s2'))} + 1) || '-' || {_pick(_g('s2'), _g('t1 - 1'))}",
    ),
    "convert_rmats_a3ss": _rmats_sql(
        f"SELECT {_J}, 'T' AS tx, 'DEL' AS kind, {_pick('s2', 't1 - 2')} AS a, {_pick('s2 + 2', 't1')} AS b, NULL AS x, NULL AS y FROM j WHERE {_pick('t2 - s2', 't1 - s1')} > 3",
        f"'A5SS_' || ({_pick(_g('t1 - 1'), _g('s2'))} + 1) || '-' || {_pick(_g('s2'), _g('t1 - 1'))} || '-' || {_pick(_g('s2 + 2'), _g('t1 - 3'))}",
    ),
    "convert_rmats_mxe": _rmats_sql(
        f"""SELECT {_J}, 'T' AS tx, 'SUB' AS kind, s2 AS a, t2 AS b, t2 + 3 AS x, t2 + 7 AS y FROM j WHERE n >= 3
        UNION ALL SELECT {_J}, 'U', 'INS', {_pick('t1 - 1', 's3')}, NULL, s2, t2 FROM j WHERE n = 3 AND {_INC}""",
        f"'MXE_' || {_MXE_ID}",
    ),
    "convert_rmats_ri": _rmats_sql(
        f"SELECT {_J}, 'T' AS tx, 'INS' AS kind, {_pick('t1 - 1', 's2')} AS a, NULL AS b, t1 AS x, s2 AS y FROM j WHERE {_INC}",
        f"'RI_' || {_span('t1', 's2')[0]} || '-' || {_span('t1', 's2')[1]}".replace("'RI_' || CASE", "'RI_' || (CASE").replace("END || '-' || CASE", "END) || '-' || (CASE") + ")",
    ),
}
