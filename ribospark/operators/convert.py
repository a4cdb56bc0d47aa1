"""Caller records to variants on genes: point mutations, editing sites, fusions, splicing events and circles.

Records meet genes and transcripts by id; alleles, coordinates and the decision trees are column expressions. A record
that can't be converted keeps its reason in ``status`` where the function says so, so that good and bad rows can be
counted and told apart in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.functions import intervals, labels
from ribospark.functions.sequence import reverse_complement, slice_of, stranded
from ribospark.operators import reference as ref
from ribospark.operators.reference import Reference
from ribospark.session import broadcast_if_small

_INDEX = "array<int>"


def _genes(reference: Reference) -> DataFrame:
    return reference.genes.select(
        F.col("gene_id").alias("g_id"), F.col("gene_name").alias("g_name"), F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("strand").alias("g_strand")
    )


def _bases(rows: DataFrame, reference: Reference, a: Column, b: Column, out: str, short: bool | None = True) -> DataFrame:
    """``rows`` with the bases [a, b) of their gene as it reads on its strand, cut out of the pieces of the genome."""
    span = intervals.range_gene_to_genomic(a, b, F.col("g_start"), F.col("g_end"), F.col("g_strand"))
    placed = rows.withColumns({"__lo": span["start"], "__hi": span["end"]})
    cut = ref.sliced(placed, reference.genome, "g_chrom", "__lo", "__hi", out, short)
    return cut.withColumn(out, stranded(F.col(out), F.col("g_strand"))).drop("__lo", "__hi")


def _to_gene(p: Column) -> Column:
    return intervals.genomic_to_gene(p, F.col("g_start"), F.col("g_end"), F.col("g_strand"))


def _attrs(**values: Column) -> Column:
    """A map of the values that aren't null."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """Gene interval [start, end) of two genomic bases, the first and the last, whatever the strand."""
    x, y = _to_gene(a), _to_gene(b)
    return F.least(x, y), F.greatest(x, y) + 1


def tally(records: DataFrame) -> DataFrame:
    """(status, n): how many records were converted, and why the others weren't."""
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def vep(records: DataFrame, reference: Reference, keep_quirks: bool = True) -> DataFrame:
    """VEP records as variants, with ``status`` ok, start site, stop site, unknown gene, unknown transcript or allele.

    Deletions get the base before them (or after, at the start of the transcript). With ``keep_quirks`` a deletion down to
    one base is named MNV, as existing variant files have it. A record meets the piece of the genome it lies in; those
    too long for one piece are converted apart.
    """
    span = F.split(F.get(F.split("location", ":"), F.lit(1)), "-")
    size = F.get(span, F.lit(1)).try_cast("int") - F.get(span, F.lit(0)).try_cast("int")
    is_long = F.coalesce(size > ref.REACH - 4, F.lit(False))
    return _vep(records.where(~is_long), reference, keep_quirks, True).unionByName(_vep(records.where(is_long), reference, keep_quirks, False))


def _vep(records: DataFrame, reference: Reference, keep_quirks: bool, short: bool) -> DataFrame:
    place = F.split("location", ":")
    span = F.split(F.get(place, F.lit(1)), "-")
    lo = F.get(span, F.lit(0)).try_cast("int")
    rows = records.withColumns({"lo": lo - 1, "hi": F.coalesce(F.get(span, F.lit(1)).try_cast("int"), lo)})
    t = reference.transcripts.select(F.col("tx_id").alias("t_id"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.array_contains("tags", "cds_start_NF").alias("t_nf"))
    joined = rows.join(_genes(reference), F.col("gene") == F.col("g_id"), "left").join(broadcast_if_small(t), F.col("feature") == F.col("t_id"), "left")
    start, end = _ordered(F.col("lo"), F.col("hi") - 1)
    tx_start, tx_end = _ordered(F.col("t_start"), F.col("t_end") - 1)
    placed = joined.withColumns({"a": start, "b": end, "ta": tx_start, "tb": tx_end})
    allele = F.when(F.col("g_strand") == -1, reverse_complement(F.col("allele"))).otherwise(F.col("allele"))
    placed = placed.withColumn("al", allele)
    # the record's bases with one more on either side, as far as the gene goes
    first, last = F.greatest(F.col("a") - 1, F.lit(0)), F.least(F.col("b") + 1, F.col("g_end") - F.col("g_start"))
    placed = _bases(placed, reference, first, last, "around", short)
    a, b, al = F.col("a"), F.col("b"), F.col("al")

    def gene_bases(x: Column, y: Column) -> Column:
        return slice_of(F.col("around"), x - first, y - first)

    n = F.length(al)
    here = gene_bases(a, a + 1)
    before = gene_bases(a - 1, a)

    def made(s: Column, e: Column, r: Column, x: Column) -> Column:
        return F.struct(s.alias("start"), e.alias("end"), r.alias("ref"), x.alias("alt"))

    at_start = a == F.col("ta")
    deletion = F.when(at_start, made(a, b + 1, gene_bases(a, b + 1), gene_bases(b, b + 1))).otherwise(made(a - 1, b, gene_bases(a - 1, b), before))
    insertion = (
        F.when(here == F.substring(al, -1, 1), made(a - 1, a, before, F.concat(before, F.substring(al, F.lit(1), n - 1))))
        .when(here == F.substring(al, 1, 1), made(a, b, here, al))
    )
    result = (
        F.when(F.col("allele") == "-", deletion)
        .when((b - a == 1) & (n > 1), insertion)
        .when(b - a == 1, made(a, b, here, al))
        .when(b - a == 2, made(a, b - 1, here, F.concat(here, al)))
        .otherwise(made(a, b, gene_bases(a, b), al))
    )
    out = placed.withColumn("v", result)
    status = (
        F.when(F.col("g_id").isNull(), "unknown gene")
        .when(F.col("t_id").isNull(), "unknown transcript")
        .when((a < F.col("ta")) | ((a == F.col("ta")) & ~F.col("t_nf")), "start site")
        .when(b > F.col("tb"), "stop site")
        .when(F.coalesce(F.length("v.ref"), F.lit(0)) == 0, "allele")
        .otherwise("ok")
    )
    r1, a1 = F.length("v.ref") == 1, F.length("v.alt") == 1
    either = r1 if keep_quirks else (r1 | a1)
    kind = F.when(r1 & a1, "SNV").when(either, "INDEL").otherwise("MNV")
    phases = F.array_join("phase_sets", ",") if "phase_sets" in records.columns else F.lit("")
    return out.select(
        F.col("gene").alias("gene_id"), "v.start", "v.end", "v.ref", "v.alt", kind.alias("type"),
        labels.variant_id(kind, F.col("v.start"), F.col("v.ref"), F.col("v.alt")).alias("id"), F.col("feature").alias("tx_id"),
        _attrs(TRANSCRIPT_ID=F.col("feature"), GENOMIC_POSITION=F.col("location"), GENE_SYMBOL=F.col("g_name"), PHASE_SETS=F.when(phases != "", phases)).alias("attrs"),
        *([F.col("sample")] if "sample" in records.columns else []), status.alias("status"),
    )


def valid_substitutions(min_coverage_alt: int = 3, min_frequency_alt: float = 0.1, min_coverage_rna: int = 10, min_coverage_dna: int = 10) -> Column:
    """Substitutions of an editing site that pass depth and frequency; a DNA coverage of -1 means it wasn't measured."""
    counts = F.col("base_count")
    total = F.aggregate(counts, F.lit(0), lambda x, n: x + n)
    deep = (total >= min_coverage_rna) & ((F.col("g_coverage_q") == -1) | F.coalesce(F.col("g_coverage_q") >= min_coverage_dna, F.lit(False)))

    def reads(s: Column) -> Column:
        return F.get(counts, F.instr(F.lit("ACGT"), s["alt"]) - 1)

    keep = F.filter("all_subs", lambda s: (reads(s) >= min_coverage_alt) & (reads(s) / total >= min_frequency_alt))
    return F.when(deep, keep).otherwise(F.array().cast("array<struct<ref:string,alt:string>>"))


def reditools(records: DataFrame, reference: Reference, **gates) -> DataFrame:
    """Editing sites as variants: one row per exonic transcript and substitution that passes."""
    tx = F.filter("transcripts", lambda t: t["feature"] == "transcript")
    rows = records.select("region", "position", F.explode(F.transform(tx, lambda t: t["tx_id"])).alias("tx_id"), valid_substitutions(**gates).alias("subs"))
    t = reference.transcripts.select("tx_id", "gene_id", "exons", "strand")
    joined = rows.join(broadcast_if_small(t), "tx_id").join(_genes(reference), F.col("gene_id") == F.col("g_id"))
    exonic = ref.genomic_to_transcript(F.col("position") - 1, F.col("exons"), F.col("strand")).isNotNull()
    at = _to_gene(F.col("position") - 1)
    placed = joined.where(exonic).select("*", at.alias("start"), F.explode("subs").alias("s"))
    return placed.select(
        "gene_id", "start", (F.col("start") + 1).alias("end"), F.col("s.ref").alias("ref"), F.col("s.alt").alias("alt"), F.lit("RNAEditingSite").alias("type"),
        labels.variant_id(F.lit("RES"), F.col("start"), F.col("s.ref"), F.col("s.alt")).alias("id"), "tx_id",
        _attrs(TRANSCRIPT_ID=F.col("tx_id"), GENOMIC_POSITION=F.concat_ws(":", "region", F.col("position").cast("string")), STRAND=F.col("g_strand")).alias("attrs"),
    )


def versioned_genes(records: DataFrame, reference: Reference, *columns: str) -> DataFrame:
    """Records whose gene ids without version are replaced by the annotation's; ids with a version stay."""
    names = broadcast_if_small(ref.unversioned(reference.genes))
    for c in columns:
        n = names.select(F.col("unversioned").alias("u"), F.col("gene_id").alias("full"))
        records = records.join(n, (F.col(c) == F.col("u")) & ~F.col(c).rlike(r"\.[0-9]+\z"), "left").withColumn(c, F.coalesce("full", c)).drop("u", "full")
    return records


def fusions(records: DataFrame, reference: Reference, ref_shift: int = 0) -> DataFrame:
    """Fusion records (left_gene, left_breakpoint, right_gene, right_breakpoint) as variants, one per pair of transcripts.

    Donor and accepter transcripts are those that hold the breakpoints, in exons or introns. Both lists belong to one
    record, so pairs are formed within a record only. ``ref_shift`` is 1 for the caller whose reference base is read one
    base later on the + strand.
    """
    base = records.select(
        "left_gene", "right_gene",
        F.get(F.split("left_breakpoint", ":"), F.lit(1)).cast("int").alias("left_at"), F.get(F.split("right_breakpoint", ":"), F.lit(1)).cast("int").alias("right_at"),
    ).withColumn("rid", F.monotonically_increasing_id())
    txs = reference.transcripts.select(F.col("tx_id").alias("tx"), F.col("gene_id").alias("tx_gene"), F.col("start").alias("tx_s"), F.col("end").alias("tx_e"))
    per_gene = broadcast_if_small(txs.groupBy("tx_gene").agg(F.array_sort(F.collect_list(F.struct("tx", "tx_s", "tx_e"))).alias("txs")))

    def side(rows: DataFrame, which: str) -> DataFrame:
        at = F.col(f"{which}_at") - 1
        g = _genes(reference)
        own = rows.join(broadcast_if_small(g), F.col(f"{which}_gene") == F.col("g_id")).join(per_gene, F.col("g_id") == F.col("tx_gene"), "left")
        holding = F.transform(F.filter("txs", lambda t: intervals.holds(t["tx_s"], t["tx_e"], at)), lambda t: t["tx"])
        return own.withColumns(
            {f"{which}_txs": holding, f"{which}_pos": _to_gene(at), f"{which}_name": F.col("g_name"), f"{which}_chrom": F.col("g_chrom"), f"{which}_strand": F.col("g_strand")}
        ).drop("g_id", "g_name", "g_chrom", "g_start", "g_end", "g_strand", "tx_gene", "txs")

    both = side(side(base, "left"), "right").where("left_pos is not null and right_pos is not null")
    plus = F.col("left_strand") != -1
    both = both.withColumn("__at", F.col("left_at") + F.when(plus, ref_shift).otherwise(0)).withColumn("__next", F.col("__at") + 1)
    both = ref.sliced(both, reference.genome, "left_chrom", "__at", "__next", "there", True)
    base_there = F.col("there")
    pairs = both.withColumn("r", F.when(plus, base_there).otherwise(reverse_complement(base_there))).select(
        "*", F.explode("left_txs").alias("donor"), (F.col("left_pos") + 1).alias("start")
    ).select("*", F.explode("right_txs").alias("acc"))

    def position(which: str) -> Column:
        p = F.col(f"{which}_at").cast("string")
        return F.concat_ws(":", f"{which}_chrom", p, p)

    name = F.concat(F.lit("FUSION-"), "donor", F.lit(":"), F.col("start").cast("string"), F.lit("-"), "acc", F.lit(":"), F.col("right_pos").cast("string"))
    return pairs.select(
        F.col("left_gene").alias("gene_id"), "start", (F.col("start") + 1).alias("end"), F.col("r").alias("ref"), F.lit("<FUSION>").alias("alt"), F.lit("Fusion").alias("type"), name.alias("id"), F.col("donor").alias("tx_id"),
        _attrs(
            TRANSCRIPT_ID=F.col("donor"), GENE_SYMBOL=F.col("left_name"), GENOMIC_POSITION=position("left"), ACCEPTER_GENE_ID=F.col("right_gene"), ACCEPTER_TRANSCRIPT_ID=F.col("acc"),
            ACCEPTER_SYMBOL=F.col("right_name"), ACCEPTER_POSITION=F.col("right_pos"), ACCEPTER_GENOMIC_POSITION=position("right"),
        ).alias("attrs"),
    )


def star_fusion(records: DataFrame, reference: Reference, min_est_j: float | None = None) -> DataFrame:
    kept = records if min_est_j is None else records.where(F.col("est_j") >= min_est_j)
    return fusions(kept, reference, ref_shift=1)


def fusion_catcher(records: DataFrame, reference: Reference, max_common_mapping: int = 0, min_spanning_unique: int = 5) -> DataFrame:
    kept = records.where((F.col("counts_of_common_mapping_reads") <= max_common_mapping) & (F.col("spanning_unique_reads") >= min_spanning_unique))
    return fusions(versioned_genes(kept, reference, "left_gene", "right_gene"), reference)


def arriba(records: DataFrame, reference: Reference, min_split_reads1: int = 1, min_split_reads2: int = 1, min_confidence: str = "medium") -> DataFrame:
    """Arriba fusions with enough evidence whose transcripts lie on the strands of their genes."""
    from ribospark.sources.callers import ARRIBA_CONFIDENCE

    kept = records.where(
        (F.col("split_reads1") >= min_split_reads1) & (F.col("split_reads2") >= min_split_reads2) & (F.col("confidence_rank") >= ARRIBA_CONFIDENCE.index(min_confidence))
    )
    for i, g in ((1, "left_gene"), (2, "right_gene")):
        strands = reference.genes.select(F.col("gene_id").alias("sg"), F.col("strand").alias("ss"))
        kept = kept.join(broadcast_if_small(strands), F.col(g) == F.col("sg")).where(F.col("ss") == F.col(f"transcript_strand{i}")).drop("sg", "ss")
    return fusions(kept, reference)


def circexplorer(records: DataFrame, reference: Reference, min_read_number: int = 1, min_fpb_circ: float | None = None, min_circ_score: float | None = None, intron_start: tuple[int, int] = (-2, 0), intron_end: tuple[int, int] = (-100, 5)) -> DataFrame:
    """Circles with ``status`` ok, unknown transcript, no exon or no intron.

    A fragment of a circRNA must be an exon of its transcript; one of a ciRNA must begin near the end of an exon, and end
    near the start of the next exon or before it.
    """
    kept = records.where(F.col("read_number") >= min_read_number)
    if min_fpb_circ:
        kept = kept.where(F.col("fpb_circ") >= min_fpb_circ)
    if min_circ_score:
        kept = kept.where(F.col("circ_score") >= min_circ_score)
    t = reference.transcripts.select("tx_id", "gene_id", "exons", F.col("strand").alias("t_strand"))
    joined = kept.withColumnsRenamed({"start": "c_start", "end": "c_end", "strand": "c_strand", "gene_name": "c_gene"}).join(
        broadcast_if_small(t), F.col("isoform_name") == F.col("tx_id"), "left"
    ).join(_genes(reference), F.col("gene_id") == F.col("g_id"), "left").drop("g_id")
    pieces = F.transform(
        F.arrays_zip("exon_offsets", "exon_sizes"),
        lambda x: F.struct((F.col("c_start") + x["exon_offsets"]).alias("s"), (F.col("c_start") + x["exon_offsets"] + x["exon_sizes"]).alias("e")),
    )
    minus = F.col("t_strand") == -1
    n = F.size("exons")

    def is_exon(p: Column) -> Column:
        return F.exists("exons", lambda e: (e["start"] == p["s"]) & (e["end"] == p["e"]))

    def is_intron(p: Column) -> Column:
        def after(i: Column, step: int) -> Column:
            return F.get("exons", i + step)

        def fits(i: Column) -> Column:
            x = F.get("exons", i)
            off = F.when(minus, -(p["e"] - x["start"])).otherwise(p["s"] - x["end"])
            nxt = F.when(minus, F.when(i > 0, after(i, -1))).otherwise(F.when(i < n - 1, after(i, 1)))
            gap = F.when(minus, -(p["s"] - nxt["end"])).otherwise(p["e"] - nxt["start"])
            beyond = F.when(minus, nxt["end"] <= p["s"]).otherwise(nxt["start"] >= p["e"])
            return off.between(*intron_start) & nxt.isNotNull() & (gap.between(*intron_end) | beyond)

        return F.exists(F.sequence(F.lit(0), n - 1), fits)

    circ = F.col("circ_type") == "circRNA"
    rows = joined.withColumn("pieces", pieces)
    good = F.when(circ, F.forall("pieces", is_exon)).otherwise(F.forall("pieces", is_intron))

    def on_gene(p: Column) -> Column:
        x, y = _to_gene(p["s"]), _to_gene(p["e"] - 1)
        return F.struct(F.least(x, y).alias("start"), (F.greatest(x, y) + 1).alias("end"), F.when(circ, "exon").otherwise("intron").alias("type"))

    lo, hi = _ordered(F.col("c_start"), F.col("c_end") - 1)
    name = F.concat(F.lit("CIRC-"), "tx_id", F.lit("-"), lo.cast("string"), F.lit(":"), hi.cast("string"))
    fragments = F.array_sort(F.transform("pieces", on_gene))
    introns = F.when(circ, F.array().cast(_INDEX)).otherwise(F.sequence(F.lit(0), F.size("pieces") - 1))
    status = F.when(F.col("tx_id").isNull(), "unknown transcript").when(good, "ok").when(circ, "no exon").otherwise("no intron")
    return rows.select(
        "gene_id", lo.alias("start"), name.alias("id"), "tx_id", F.col("g_name").alias("gene_name"),
        F.concat_ws(":", "chrom", F.col("c_start").cast("string"), F.col("c_end").cast("string")).alias("genomic_location"),
        fragments.alias("fragments"), introns.alias("introns"), status.alias("status"),
    )


# --- splicing events ---------------------------------------------------------------------------------------------------


def passes(counts1: str, counts2: str, least: int) -> Column:
    """Any replicate of sample 1 reaches the least count, and any of sample 2 where it has values."""
    one = F.exists(counts1, lambda x: F.coalesce(x >= least, F.lit(False)))
    two = F.exists(counts2, lambda x: F.coalesce(x >= least, F.lit(False)))
    return one & ((F.size(counts2) == 0) | two)


def _gene_models(reference: Reference) -> DataFrame:
    """Genes with transcripts and all known junctions."""
    t = reference.transcripts.select("gene_id", F.struct("tx_id", "exons", "start", "end").alias("t"), ref.junctions(F.col("exons")).alias("j"))
    models = t.groupBy(F.col("gene_id").alias("m_id")).agg(F.collect_list("t").alias("txs"), F.array_distinct(F.flatten(F.collect_list("j"))).alias("known"))
    return _genes(reference).join(models, F.col("g_id") == F.col("m_id")).drop("m_id")


def _junction(us: Column, ue: Column, ds: Column, de: Column, gate: Column, up_novel, down_novel) -> Column:
    u, d = (x if isinstance(x, Column) else F.lit(x) for x in (up_novel, down_novel))
    return F.struct(us.alias("us"), ue.alias("ue"), ds.alias("ds"), de.alias("de"), gate.alias("gate"), u.alias("un"), d.alias("dn"))


def _event_junctions(event: str, inc: Column, skip: Column) -> Column:
    c = F.col
    plus = c("g_strand") == 1
    if event == "SE":
        up, ex, down = (c("upstream_exon_start"), c("upstream_exon_end")), (c("exon_start"), c("exon_end")), (c("downstream_exon_start"), c("downstream_exon_end"))
        return F.array(_junction(*up, *down, skip, False, False), _junction(*up, *ex, inc, False, True), _junction(*ex, *down, inc, True, False))
    if event == "MXE":
        return F.array(
            _junction(c("first_exon_start"), c("first_exon_end"), c("downstream_exon_start"), c("downstream_exon_end"), inc, True, False),
            _junction(c("upstream_exon_start"), c("upstream_exon_end"), c("second_exon_start"), c("second_exon_end"), skip, False, True),
        )
    long, short, flank = ((c(f"{n}_exon_start"), c(f"{n}_exon_end")) for n in ("long", "short", "flanking"))
    # the alternative exon lies upstream of its flank for A5SS on +, and A3SS on -
    first = plus if event == "A5SS" else ~plus

    def pair(exon: tuple, gate: Column) -> Column:
        parts = [F.when(first, a).otherwise(b) for a, b in zip((*exon, *flank), (*flank, *exon), strict=True)]
        return _junction(*parts, gate, first, ~first)

    return F.array(pair(long, inc), pair(short, skip))


def _event_id(event: str) -> Column:
    """Identifier of an event, from gene positions along the strand. A3SS events carry the prefix of A5SS."""
    c = F.col
    plus = c("g_strand") == 1

    def g(p: Column) -> Column:
        return _to_gene(p)

    def pick(a: Column, b: Column) -> Column:
        return F.when(plus, a).otherwise(b)

    if event == "SE":
        uee, es, ee, des = g(c("upstream_exon_end") - 1), g(c("exon_start")), g(c("exon_end") - 1), g(c("downstream_exon_start"))
        parts = [pick(uee, des), pick(es, ee), pick(ee, es) + 1, pick(des, uee) + 1]
        return F.concat(F.lit("SE_"), F.concat_ws("-", *(p.cast("string") for p in parts)))
    if event == "MXE":
        uee, des = g(c("upstream_exon_end") - 1), g(c("downstream_exon_start"))
        fes, fee = g(c("first_exon_start")), g(c("first_exon_end") - 1)
        ses, see = g(c("second_exon_start")), g(c("second_exon_end") - 1)
        parts = [pick(uee, des) + 1, pick(fes, fee), pick(fee, fes) + 1, pick(ses, see), pick(see, ses) + 1, pick(des, uee)]
        return F.concat(F.lit("MXE_"), F.concat_ws("-", *(p.cast("string") for p in parts)))
    if event == "A5SS":
        parts = [
            pick(g(c("long_exon_end") - 1), g(c("long_exon_start"))) + 1,
            pick(g(c("short_exon_end") - 1), g(c("short_exon_start"))) + 1,
            pick(g(c("flanking_exon_start")), g(c("flanking_exon_end") - 1)),
        ]
    else:
        parts = [
            pick(g(c("flanking_exon_end") - 1), g(c("flanking_exon_start"))) + 1,
            pick(g(c("long_exon_start")), g(c("long_exon_end") - 1)),
            pick(g(c("short_exon_start")), g(c("short_exon_end") - 1)),
        ]
    return F.concat(F.lit("A5SS_"), F.concat_ws("-", *(p.cast("string") for p in parts)))


def _aligned(rows: DataFrame) -> DataFrame:
    """Rows of (junction j, transcript t) with the exon indices that the decision tree asks for; -1 for none."""
    e = F.col("t.exons")
    starts, ends = F.transform(e, lambda x: x["start"]), F.transform(e, lambda x: x["end"])

    def index(values: Column, at: str) -> Column:
        return F.array_position(values, F.col(at)).cast("int") - 1

    with_index = rows.withColumns({"ui": index(ends, "j.ue"), "di": index(starts, "j.ds"), "dei": index(ends, "j.de"), "n": F.size(e)})
    kept = with_index.where((~F.col("j.un") | (F.col("di") >= 0)) & (~F.col("j.dn") | (F.col("ui") >= 0)))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    ui, di, ue, ds = F.col("ui"), F.col("di"), F.col("j.ue"), F.col("j.ds")

    def inside(i: Column) -> Column:
        x = F.get(e, i)
        return F.when(ui >= 0, i > ui).otherwise(i < di) & (ue <= x["start"]) & (x["end"] <= ds)

    def containing(p: Column, allowed) -> Column:
        hit = F.filter(every, lambda i: allowed(i) & intervals.holds(F.get(e, i)["start"], F.get(e, i)["end"], p))
        return F.coalesce(F.get(hit, F.lit(0)), F.lit(-1))

    return kept.withColumns(
        {
            "inter": F.filter(every, inside),
            "up_span": containing(ue - 1, lambda i: (di == -1) | (i < di)),
            "down_span": containing(ds, lambda i: (ui == -1) | (i > ui)),
        }
    )


_BUILT = "struct<kind:string,s:int,e:int,ds:int,de:int>"


def _decisions() -> Column:
    """array of (kind, genomic first and last + 1, donor first and last + 1) that a junction makes of a transcript."""
    e, ui, di, n = F.col("t.exons"), F.col("ui"), F.col("di"), F.col("n")
    us, ue, ds, de = (F.col(f"j.{x}") for x in ("us", "ue", "ds", "de"))
    k = F.size("inter")
    first, last = F.get("inter", F.lit(0)), F.get("inter", k - 1)
    none = F.lit(None).cast("int")
    minus = F.col("g_strand") == -1

    def exon(i: Column, end: str) -> Column:
        return F.get(e, i)[end]

    def built(kind: str, s: Column, x: Column, a: Column = none, b: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), x.cast("int").alias("e"), a.cast("int").alias("ds"), b.cast("int").alias("de"))

    up, down = F.col("up_span"), F.col("down_span")
    up_del = built("Deletion", F.when(exon(up, "end") == ue, exon(first, "start")).otherwise(ue), F.when(k > 0, exon(last, "end")).otherwise(exon(up, "end")))
    down_del = built("Deletion", F.when(k > 0, exon(first, "start")).otherwise(exon(down, "start")), F.when(exon(down, "start") == ds, exon(last, "end")).otherwise(ds))
    up_sub = built("Substitution", exon(first, "start"), exon(last, "end"), F.when(first > 0, F.greatest(exon(first - 1, "end"), us)).otherwise(us), ue)
    down_sub = built("Substitution", exon(first, "start"), exon(last, "end"), ds, F.when(last < n - 1, F.least(exon(last + 1, "start"), de)).otherwise(de))
    # an insertion's place is the base before it along the strand; its donor is given as first and last + 1 on the genome
    up_ins = built("Insertion", F.when(minus, ds).otherwise(exon(di - 1, "end") - 1), none, F.greatest(exon(di - 1, "end"), us), ue)
    down_ins = built("Insertion", F.when(minus, exon(ui + 1, "start")).otherwise(ue - 1), none, ds, F.least(exon(ui + 1, "start"), de))
    up_case = F.when((ui == -1) | (k > 0), F.when(up >= 0, up_del).when(k > 0, up_sub).when(di > 0, up_ins))
    down_case = F.when((di == -1) | (k > 0), F.when(down >= 0, down_del).when(k > 0, down_sub).when(F.col("dei").between(0, n - 2), down_ins))
    after = F.when(minus, F.col("t.end") > ds + 1).otherwise(F.col("t.start") < ue)
    skipping = F.when(
        ~F.col("j.un") & ~F.col("j.dn") & after & F.when(minus, di != -1).otherwise(ui != -1),
        F.when(minus, F.when((ui == -1) | (k > 0), F.when(up >= 0, up_del).when(k > 0, up_sub))).otherwise(
            F.when((di == -1) | (k > 0), F.when(down >= 0, down_del).when(k > 0, down_sub))
        ),
    )
    return F.filter(F.array(F.when(F.col("j.un"), up_case), F.when(F.col("j.dn"), down_case), skipping), lambda v: v.isNotNull())


def rmats(records: DataFrame, reference: Reference, event: str, min_ijc: int = 1, min_sjc: int = 1) -> DataFrame:
    """rMATS events as variants of the transcripts they change, distinct. An event whose junctions are all known gives none."""
    models = broadcast_if_small(_gene_models(reference), 20_000)
    rows = records.drop("chrom").join(models, F.col("gene_id") == F.col("g_id"))
    inc, skip = passes("ijc_sample_1", "ijc_sample_2", min_ijc), passes("sjc_sample_1", "sjc_sample_2", min_sjc)
    if event == "RI":
        return _retained(rows.withColumns({"inc": inc, "skip": skip}), reference)
    with_j = rows.withColumns({"js": _event_junctions(event, inc, skip), "id": _event_id(event)})
    novel = F.exists("js", lambda j: ~F.exists("known", lambda k: (k["start"] == j["ue"]) & (k["end"] == j["ds"])))
    pairs = with_j.where(novel).select("gene_id", "id", "g_name", "g_chrom", "g_start", "g_end", "g_strand", "txs", F.explode("js").alias("j")).where("j.gate")
    aligned = _aligned(pairs.withColumn("t", F.explode("txs")).drop("txs"))
    made = aligned.select("gene_id", "id", "g_name", "g_chrom", "g_start", "g_end", "g_strand", "t.tx_id", F.explode(_decisions()).alias("v"))
    start, end = _ordered(F.col("v.s"), F.col("v.e") - 1)
    insertion = F.col("v.kind") == "Insertion"
    ds, de = _ordered(F.col("v.ds"), F.col("v.de") - 1)
    placed = made.select(
        "*", F.when(insertion, _to_gene(F.col("v.s"))).otherwise(start).alias("start"), F.when(insertion, _to_gene(F.col("v.s")) + 1).otherwise(end).alias("end"), ds.alias("ds"), de.alias("de")
    )
    placed = _bases(placed, reference, F.col("start"), F.col("start") + 1, "base")
    own = F.when(~insertion, F.col("start"))
    genomic = F.when(
        insertion, F.concat_ws(":", "g_chrom", (F.col("v.s") + 1).cast("string"), (F.col("v.s") + 2).cast("string"))
    ).otherwise(F.concat_ws(":", "g_chrom", (F.col("v.s") + 1).cast("string"), F.col("v.e").cast("string")))
    out = placed.select(
        "gene_id", "start", "end", F.col("base").alias("ref"),
        F.concat(F.lit("<"), F.upper(F.substring("v.kind", 1, 3)), F.lit(">")).alias("alt"), F.col("v.kind").alias("type"), "id", "tx_id",
        _attrs(
            TRANSCRIPT_ID=F.col("tx_id"), START=own, END=F.when(~insertion, F.col("end")), DONOR_START=F.col("ds"), DONOR_END=F.col("de"),
            DONOR_GENE_ID=F.when(F.col("ds").isNotNull(), F.col("gene_id")), GENE_SYMBOL=F.col("g_name"), GENOMIC_POSITION=genomic,
        ).alias("attrs"),
    )
    return out.dropDuplicates(["gene_id", "start", "end", "ref", "alt", "id", "tx_id"])


def _retained(rows: DataFrame, reference: Reference) -> DataFrame:
    """A retained intron is an insertion where no transcript retains it, and its loss a deletion where none splices it."""
    ue, ds = F.col("upstream_exon_end"), F.col("downstream_exon_start")
    spliced = F.filter("txs", lambda t: ref.has_junction(t["exons"], ue, ds))
    kept = F.filter("txs", lambda t: F.exists(t["exons"], lambda e: (e["start"] < ue) & (ds < e["end"] - 1)) & ~ref.has_junction(t["exons"], ue, ds))
    start, end = _ordered(ue, ds - 1)
    made = rows.withColumns({"spliced": spliced, "kept": kept, "a": start, "b": end})
    ins = F.when(F.col("inc") & (F.size("kept") == 0), F.transform("spliced", lambda t: F.struct(F.lit("Insertion").alias("kind"), t["tx_id"].alias("tx_id"))))
    dele = F.when(F.col("skip") & (F.size("spliced") == 0), F.transform("kept", lambda t: F.struct(F.lit("Deletion").alias("kind"), t["tx_id"].alias("tx_id"))))
    empty = F.array().cast("array<struct<kind:string,tx_id:string>>")
    each = made.select("*", F.explode(F.concat(F.coalesce(ins, empty), F.coalesce(dele, empty))).alias("v"))
    insertion = F.col("v.kind") == "Insertion"
    at = F.when(insertion, F.col("a") - 1).otherwise(F.col("a"))
    stop = F.when(insertion, F.col("a")).otherwise(F.col("b"))
    position = F.concat(F.col("g_chrom"), F.lit(":"), ue.cast("string"), F.lit("-"), ds.cast("string"))
    each = _bases(each, reference, at, at + 1, "base")
    return each.select(
        "gene_id", at.alias("start"), stop.alias("end"), F.col("base").alias("ref"), F.concat(F.lit("<"), F.upper(F.substring("v.kind", 1, 3)), F.lit(">")).alias("alt"),
        F.col("v.kind").alias("type"), F.concat(F.lit("RI_"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("id"), "v.tx_id",
        _attrs(
            TRANSCRIPT_ID=F.col("v.tx_id"), START=F.when(~insertion, F.col("a")), END=F.when(~insertion, F.col("b")), DONOR_START=F.when(insertion, F.col("a")), DONOR_END=F.when(insertion, F.col("b")),
            DONOR_GENE_ID=F.when(insertion, F.col("gene_id")), COORDINATE=F.when(insertion, F.lit("gene")), GENE_SYMBOL=F.col("g_name"), GENOMIC_POSITION=position,
        ).alias("attrs"),
    )


def sect_variants(transcripts: DataFrame) -> DataFrame:
    """(tx_id, start, id): one Sec termination per annotated site of ``Reference.transcript_sequences``."""
    return transcripts.select("tx_id", F.explode("sec_sites").alias("start")).select("tx_id", "start", F.concat(F.lit("SECT-"), (F.col("start") + 1).cast("string")).alias("id"))


def w2f_variants(peptides: DataFrame) -> DataFrame:
    """(seq, start, id): one reassignment per W of a peptide."""
    sites = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.when(c == "W", i)), lambda i: i.isNotNull())
    return peptides.select("seq", F.explode(sites).alias("start")).select("seq", "start", F.concat(F.lit("W2F-"), (F.col("start") + 1).cast("string")).alias("id"))
