"""Queries of the peptide callers over the genome of ``plans.genomics``, with SQL that enumerates every set of variants."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.functions import intervals, labels
from ribospark.operators import call, convert, reference
from ribospark.operators.call import Rules
from ribospark.plans.genomics import _CD, _W, _base, _circles, _gene, _HEAD, _lines, _named, _retained, _rc, _sign, _skipped, _TAIL, world
from ribospark.plans.peptides import _TRYPSIN, GAP, _codon_sql, _mass, _peptides
from ribospark.session import checkpointed
from ribospark.sources import callers

_RULES = Rules(exception=None)


def _coding(ref: reference.Reference) -> DataFrame:
    """(tx_id, tx_seq, orf_start, …) of the coding transcripts."""
    return replace(ref, transcripts=ref.transcripts.where("is_coding and size(cds) > 0")).transcript_sequences()


def _on_gene(index: Column, exon: Column, size: Column) -> Column:
    """Gene position of a transcript index within an exon struct (start, end, cum_start)."""
    step = index - exon["cum_start"]
    g = F.when(F.col("strand") == 1, exon["start"] + step).otherwise(exon["end"] - 1 - step)
    return intervals.genomic_to_gene(g, F.lit(0), size, F.col("strand"))


def _small_variants(ref: reference.Reference) -> DataFrame:
    """A substitution, an insertion of 2 bases or a deletion of 2 in the middle of each exon after the start codon."""
    n, i = F.size("exons"), F.col("i")
    forward = F.col("strand") == 1
    before = F.when(forward, F.slice("exons", F.lit(1), i)).otherwise(F.slice("exons", i + 2, n))
    placed = _coding(ref).select("tx_id", "gene_id", "strand", "tx_seq", "orf_start", "exons", (F.col("end") + GAP).alias("size"), F.posexplode("exons").alias("i", "x"))
    rows = placed.withColumns({"n5": F.when(forward, i + 1).otherwise(n - i), "e": F.struct("x.start", "x.end", reference.transcript_length(before).alias("cum_start"))})
    long = F.col("e.end") - F.col("e.start")
    m = F.col("e.cum_start") + F.floor(long / 2).cast("int")
    deletion = (F.col("n5") % 3 == 2) & (long >= 6)
    insertion = F.col("n5") % 3 == 1
    bases = F.substring("tx_seq", m + 1, F.when(deletion, 3).otherwise(1))
    alt = F.when(deletion, F.substring(bases, 1, 1)).when(insertion, F.concat(bases, F.lit("AG"))).otherwise(F.translate(bases, "ACGT", "GTAC"))
    kind = F.when(deletion | insertion, "INDEL").otherwise("SNV")
    placed = rows.where(m >= F.col("orf_start") + 3).select("gene_id", "tx_id", _on_gene(m, F.col("e"), F.col("size")).alias("start"), bases.alias("ref"), alt.alias("alt"), kind.alias("type"))
    return placed.select(
        "gene_id", "start", (F.col("start") + F.length("ref")).alias("end"), "ref", "alt", "type", labels.variant_id(F.col("type"), F.col("start"), F.col("ref"), F.col("alt")).alias("id"), "tx_id",
        F.create_map().cast("map<string,string>").alias("attrs"),
    )


def call_small(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of substitutions, insertions and deletions, up to seven on a transcript, without a cap."""
    ref = world(_base(spark, d))
    return call.call_variant(ref, checkpointed(_small_variants(ref)), rules=_RULES, adjacent=0, labelled=False).select("tx_id", "seq").distinct()


def call_splicing(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of retained introns and skipped exons of coding transcripts."""
    base = _base(spark, d)
    ref = world(base)

    def event(kind: str, exons, least: int) -> DataFrame:
        counts = [F.lit("5"), F.lit("5"), F.lit(""), F.lit("")]
        values = [F.col("o"), _gene(), _named("N"), _named("C"), _sign("strand"), *(x for pair in exons() for x in pair), F.col("o"), *counts, F.lit(100), F.lit(50), F.lit(0.5), F.lit(0.5)]
        lines = _lines(spark, base.where(F.size("exons") >= least), values, [*_HEAD, *callers._RMATS_EXONS[kind].values(), *_TAIL])
        return convert.rmats(callers.rmats(spark, lines, kind), ref, kind)

    variants = event("RI", _retained, 2).unionByName(event("SE", _skipped, 3))
    variants = variants.join(ref.transcripts.where("is_coding and size(cds) > 0").select("tx_id"), "tx_id", "left_semi")
    return call.call_variant(ref, checkpointed(variants), rules=_RULES, adjacent=0, labelled=False).select("tx_id", "seq").distinct()


def call_fusions(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of fusions of each coding transcript, after two thirds of it, with the next order's from a third on."""
    base = _base(spark, d)
    ref = world(base)
    exons = reference.exon_table(ref.transcripts.where("tx_id like 'T%'")).groupBy("tx_id").agg(F.collect_list(F.struct("start", "end", "cum_start", "cum_end")).alias("all"))
    t = ref.transcripts.where("tx_id like 'T%'").select("tx_id", "gene_id", "strand", F.col("pos").alias("o"), reference.transcript_length(F.col("exons")).alias("n"))
    placed = t.join(exons, "tx_id").join(base.select("o", "size"), "o")

    def at(index: Column, out: str) -> Column:
        e = F.get(F.filter("all", lambda x: (x["cum_start"] <= index) & (index < x["cum_end"])), F.lit(0))
        return _on_gene(index, e, F.col("size")).alias(out)

    acc = placed.select((F.col("o") - 1).alias("o"), F.col("tx_id").alias("acc_tx"), F.col("gene_id").alias("acc_gene"), at(F.floor(F.col("n") / 3).cast("int"), "acc_pos"))
    last = F.greatest(F.col("orf_start") + 5, F.floor(F.col("n") * 2 / 3).cast("int"))
    donors = placed.join(_coding(ref).select("tx_id", "orf_start"), "tx_id").where(last < F.col("n")).select("o", "tx_id", "gene_id", at(last, "last"))
    attrs = F.create_map(F.lit("ACCEPTER_TRANSCRIPT_ID"), "acc_tx", F.lit("ACCEPTER_GENE_ID"), "acc_gene", F.lit("ACCEPTER_POSITION"), F.col("acc_pos").cast("string"))
    start = F.col("last") + 1
    variants = donors.join(acc, "o").select(
        "gene_id", start.alias("start"), (start + 1).alias("end"), F.lit("A").alias("ref"), F.lit("<FUSION>").alias("alt"), F.lit("Fusion").alias("type"), F.concat_ws("-", F.lit("FUSION"), "tx_id", "acc_tx").alias("id"), "tx_id", attrs.alias("attrs")
    )
    return call.call_variant(ref, checkpointed(variants), rules=_RULES, adjacent=0, labelled=False).select("tx_id", "seq").distinct()


def call_circles(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of circles, read round and round."""
    base = _base(spark, d)
    ref = world(base)
    circles = checkpointed(_circles(spark, d, base).where("status = 'ok'"))
    none = spark.createDataFrame([], "gene_id string, start int, end int, ref string, alt string, type string, id string, tx_id string, attrs map<string,string>")
    return call.call_variant(ref, none, circles, _RULES, adjacent=0, labelled=False).select("unit", "seq").distinct()


def call_novel_orf(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of the ORFs of noncoding transcripts, each of the last ORF of its frame that gives it."""
    return call.call_novel_orf(world(_base(spark, d)), _RULES)[0]


def novel_orfs(spark: SparkSession, d: str) -> DataFrame:
    """The ORFs of noncoding transcripts: those that give a peptide, and those of 7 residues or more."""
    return call.call_novel_orf(world(_base(spark, d)), _RULES)[1]


def call_alt_translation(spark: SparkSession, d: str) -> DataFrame:
    """Peptides of coding transcripts with some W read as F."""
    return call.call_alt_translation(world(_base(spark, d)), Rules(exception=None, w2f=True))


QUERIES = {
    "call_small": call_small,
    "call_splicing": call_splicing,
    "call_fusions": call_fusions,
    "call_circles": call_circles,
    "call_novel_orf": call_novel_orf,
    "novel_orfs": novel_orfs,
    "call_alt_translation": call_alt_translation,
}

# --- SQL ---------------------------------------------------------------------------------------------------------------


def _read(seq: str, start: str) -> str:
    """The residues of a sequence from a start, read as M, to the first stop, and whether there is a stop."""
    n = f"greatest((length({seq}) - ({start})) // 3, 1)"
    codons = f"list_transform(range(1, {n}), lambda codon: coalesce(t.m[substr({seq}, CAST(({start}) + 3 * codon + 1 AS BIGINT), 3)], ''))"
    return f"'M' || array_to_string({codons}, '')"


_TABLE = f"(SELECT {_codon_sql('Standard')} AS m) t"


def _digested(proteins: str, ends: str = "true") -> str:
    """(pid, pep) of ``proteins`` (pid, seq)."""
    inner = _peptides(_TRYPSIN, source=f"p AS (SELECT pid AS doc_id, seq{', ended' if ends == 'ended' else ''} FROM {proteins})", ends=ends)
    return f"(WITH {inner} SELECT doc_id AS pid, pep FROM d)"


_PLAIN = f"""{_W}{_CD}, ct AS (SELECT orf.o, ts.tx, ts.seq, orf_start FROM orf JOIN ts ON ts.tx = 'T' || orf.o WHERE orf.o % 3 > 0
), pr AS (SELECT tx AS pid, split_part({_read("seq", "orf_start")}, '*', 1) AS seq FROM ct, {_TABLE}
), pp AS (SELECT DISTINCT pid AS tx, pep FROM {_digested("pr")})"""
_HAPLOTYPES = f"""hp AS (SELECT DISTINCT h.tx, split_part({_read("h.seq", "ct.orf_start")}, '*', 1) AS seq FROM hs h JOIN ct USING (tx), {_TABLE}
), hd AS (SELECT seq, row_number() OVER () AS pid FROM (SELECT DISTINCT seq FROM hp)
), he AS (SELECT DISTINCT hp.tx, pep FROM {_digested("hd")} JOIN hd USING (pid) JOIN hp USING (seq))
SELECT tx AS tx_id, pep AS seq FROM he ANTI JOIN pp USING (tx, pep)"""
_SMALL = f"""WITH RECURSIVE {_PLAIN}, va AS (SELECT 'T' || k.o AS tx, n5, k.t - k.s AS size, k.c0 + (k.t - k.s) // 2 AS m, orf_start, ct.seq FROM k JOIN e ON e.tx_id = k.o AND e.s = k.s JOIN ct ON ct.tx = 'T' || k.o
), vb AS (SELECT tx, m, CASE WHEN n5 % 3 = 2 AND size >= 6 THEN m + 3 ELSE m + 1 END AS stop, substr(seq, m + 1, 1) AS b, CASE WHEN n5 % 3 = 2 AND size >= 6 THEN 'D' WHEN n5 % 3 = 1 THEN 'I' ELSE 'S' END AS kind FROM va WHERE m >= orf_start + 3
), vc AS (SELECT tx, m, stop, CASE kind WHEN 'D' THEN b WHEN 'I' THEN b || 'AG' ELSE translate(b, 'ACGT', 'GTAC') END AS alt, row_number() OVER (PARTITION BY tx ORDER BY m) AS j, count(*) OVER (PARTITION BY tx) AS n FROM vb
), hap(tx, j, txt, pos, past) AS (
  SELECT DISTINCT tx, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM vc
  UNION ALL SELECT h.tx, v.j, CASE WHEN take THEN txt || substr(ct.seq, CAST(pos + 1 AS BIGINT), CAST(v.m - pos AS BIGINT)) || alt ELSE txt END, CAST(CASE WHEN take THEN v.stop ELSE pos END AS BIGINT), CAST(CASE WHEN take THEN v.stop ELSE past END AS BIGINT)
  FROM hap h JOIN vc v ON v.tx = h.tx AND v.j = h.j + 1 JOIN ct ON ct.tx = h.tx, (SELECT unnest([true, false]) AS take) WHERE NOT take OR v.m > h.past
), hs AS (SELECT hap.tx, txt || substr(ct.seq, pos + 1) AS seq FROM hap JOIN (SELECT DISTINCT tx, n FROM vc) c ON c.tx = hap.tx AND c.n = hap.j JOIN ct ON ct.tx = hap.tx), {_HAPLOTYPES}"""
_SPLICED = f"""WITH {_PLAIN}, jx AS (SELECT o, any_value(w.strand) AS strand, any_value(n) AS n, list({{'s': s, 't': t, 'c0': c0, 'c1': c1}} ORDER BY i) AS x FROM k JOIN w USING (o) GROUP BY o
), ri AS (SELECT ct.tx, ct.seq, orf_start, CASE WHEN strand = 1 THEN x[1].c1 ELSE x[2].c1 END AS a, x[1].t AS g0, x[2].s AS g1, strand, jx.o FROM jx JOIN ct ON ct.o = jx.o WHERE n >= 2
), rh AS (SELECT ri.tx, substr(ri.seq, 1, a) || CASE WHEN ri.strand = 1 THEN substr(q.seq, g0 + 1, g1 - g0) ELSE {_rc("substr(q.seq, g0 + 1, g1 - g0)")} END || substr(ri.seq, a + 1) AS seq FROM ri JOIN q USING (o) WHERE a - 1 >= orf_start + 3
), sh AS (SELECT ct.tx, substr(ct.seq, 1, x[2].c0) || substr(ct.seq, x[2].c1 + 1) AS seq FROM jx JOIN ct ON ct.o = jx.o WHERE n > 3 AND x[2].c0 - 1 >= orf_start + 3
), hs AS (SELECT * FROM rh UNION ALL SELECT * FROM sh), {_HAPLOTYPES}"""
_FUSED = f"""WITH {_PLAIN}, fu AS (SELECT ct.tx, ct.seq, greatest(orf_start + 5, length(ct.seq) * 2 // 3) AS last, ts.seq AS other FROM ct JOIN ts ON ts.tx = 'T' || (ct.o + 1)
), hs AS (SELECT tx, substr(seq, 1, last + 1) || substr(other, length(other) // 3 + 1) AS seq FROM fu WHERE last < length(seq)), {_HAPLOTYPES}"""
_STARTS = "(SELECT unnest(range(0, greatest(length({0}) - 2, 0))) AS i)".format
#: A frame without a stop is that of an endless reading: what ends where the fourth round does is no peptide.
_CIRCLED = f"""WITH {_PLAIN}, y1 AS (SELECT o, any_value(w.strand) AS strand, any_value(n) AS n, o % 4 = 3 AND any_value(n) >= 2 AS intron, list({{'s': s, 't': t}} ORDER BY i) AS x, any_value(stop) AS stop, any_value(w.len) AS size FROM k JOIN w USING (o) GROUP BY o HAVING o % 3 >= 1 AND o % 5 > 0 AND o % 7 > 0
), y2 AS (SELECT o, strand, size, unnest(CASE WHEN intron THEN [{{'s': x[1].t, 't': x[2].s}}] WHEN n = 1 THEN x[1:1] ELSE x[2:3] END) AS f FROM y1
), y3 AS (SELECT y2.o, any_value(y2.strand) AS strand, any_value(size) AS size, min(f.s) AS lo, max(f.t) AS hi, max(f.t - f.s) AS longest, string_agg(substr(seq, f.s + 1, f.t - f.s), '' ORDER BY f.s) AS fwd FROM y2 JOIN (SELECT o, seq FROM q) q USING (o) GROUP BY y2.o
), y4 AS (SELECT o, 'CIRC-T' || o || '-' || CASE WHEN strand = 1 THEN lo ELSE size - hi END || ':' || CASE WHEN strand = 1 THEN hi ELSE size - lo END AS unit, CASE WHEN strand = 1 THEN fwd ELSE {_rc("fwd")} END AS seq FROM y3 WHERE longest > 3
), y5 AS (SELECT o, unit, i, repeat(seq, 4) AS seq FROM y4, LATERAL {_STARTS("repeat(seq, 2)")} WHERE i < length(seq) AND substr(repeat(seq, 2), i + 1, 3) = 'ATG'
), y6 AS (SELECT o, unit, {_read("seq", "i")} AS aas FROM y5, {_TABLE}
), y7 AS (SELECT row_number() OVER () AS pid, o, unit, split_part(aas, '*', 1) AS seq, contains(aas, '*') AS ended FROM y6
), y8 AS (SELECT pid, pep FROM {_digested("y7", "ended")}
), y9 AS (SELECT DISTINCT o, unit, pep FROM y8 JOIN y7 USING (pid))
SELECT unit, pep AS seq FROM y9 WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.tx = 'T' || y9.o AND pp.pep = y9.pep)"""
_ORFS = f"""{_W}, nc AS (SELECT tx, o, seq FROM ts WHERE (tx LIKE 'U%' OR o % 3 = 0) AND length(seq) >= 21
), os AS (SELECT tx, o, seq, i FROM nc, LATERAL {_STARTS("seq")} WHERE substr(seq, i + 1, 3) = 'ATG'
), oc AS (SELECT row_number() OVER () AS pid, tx, i, tx || '|G' || o || '.' || o % 3 || '|ORF' || row_number() OVER (PARTITION BY tx ORDER BY i) AS label, split_part({_read("seq", "i")}, '*', 1) AS seq FROM os, {_TABLE}
), od AS (SELECT DISTINCT pid, pep FROM {_digested("oc")})"""
_W2F = f"""{_PLAIN}, wp AS (SELECT tx, pep, [x FOR x IN range(1, length(pep) + 1) IF substr(pep, x, 1) = 'W'] AS ws FROM pp WHERE contains(pep, 'W')
), wm AS (SELECT tx, pep, ws, unnest(range(1, CAST(2 ** len(ws) AS BIGINT))) AS mask FROM wp
), wc AS (SELECT tx, pep, [ws[j] FOR j IN range(1, len(ws) + 1) IF (mask >> (j - 1)) & 1 = 1] AS chosen FROM wm
), wq AS (SELECT tx, array_to_string([CASE WHEN list_contains(chosen, x) THEN 'F' ELSE substr(pep, x, 1) END FOR x IN range(1, length(pep) + 1)], '') AS seq, tx || '|' || array_to_string(['W2F-' || x FOR x IN chosen], '|') AS label FROM wc)"""

SQL = {
    "call_small": _SMALL,
    "call_splicing": _SPLICED,
    "call_fusions": _FUSED,
    "call_circles": _CIRCLED,
    "call_novel_orf": f"WITH {_ORFS} SELECT tx AS tx_id, pep AS seq, arg_max(label, i) AS label FROM od JOIN oc USING (pid) GROUP BY tx, i % 3, pep",
    "novel_orfs": f"WITH {_ORFS} SELECT tx AS tx_id, label, CAST(i AS INT) AS orf_start, CAST(i + 3 * length(seq) AS INT) AS orf_end, seq AS protein FROM oc WHERE length(seq) >= 7 OR pid IN (SELECT pid FROM od)",
    "call_alt_translation": f"WITH {_W2F} SELECT DISTINCT tx AS tx_id, seq, label FROM wq WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.tx = wq.tx AND pp.pep = wq.seq) AND {_mass('seq')} >= 500",
}
