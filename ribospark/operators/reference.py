"""The reference: genes, transcripts with their exons, sequences, and the coordinates between them.

A transcript is one row that carries its exons as an array sorted on the genome. A position is mapped by expressions
over that array, so records meet transcripts by equality of ids and no interval join is needed. Tables are lazy; a
``Reference`` built from Parquet reads only the columns and rows that a query uses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribospark.functions import fixed, intervals
from ribospark.functions.digest import Cleavage, canonical_pool
from ribospark.functions.sequence import slice_of, stranded, translate_dna, until_stop
from ribospark.sources import text

# --- one transcript -------------------------------------------------------------------------------------------------


def transcript_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0), lambda a, e: a + e["end"] - e["start"])


def genomic_to_transcript(position: Column, exons: Column, strand: Column) -> Column:
    """Index on the transcript of a genomic position; null in an intron or outside."""
    before = F.aggregate(exons, F.lit(0), lambda a, e: a + F.greatest(F.least(e["end"], position) - e["start"], F.lit(0)))
    exonic = F.exists(exons, lambda e: intervals.holds(e["start"], e["end"], position))
    return F.when(exonic, F.when(strand == -1, transcript_length(exons) - 1 - before).otherwise(before))


def transcript_to_genomic(index: Column, exons: Column, strand: Column) -> Column:
    """Genomic position of an index on the transcript; null outside."""
    forward = F.when(strand == -1, transcript_length(exons) - 1 - index).otherwise(index)
    zero = F.struct(F.lit(0).alias("left"), F.lit(None).cast("int").alias("at"))
    found = F.aggregate(
        exons,
        zero,
        lambda a, e: F.struct(
            (a["left"] + e["end"] - e["start"]).alias("left"),
            F.coalesce(a["at"], F.when(intervals.holds(a["left"], a["left"] + e["end"] - e["start"], forward), e["start"] + forward - a["left"])).cast("int").alias("at"),
        ),
    )
    return F.when(forward >= 0, found["at"])


def upstream_exon_end(position: Column, exons: Column, strand: Column) -> Column:
    """Last base of the nearest exon that lies wholly before a position, along the strand."""
    plus = F.array_max(F.transform(F.filter(exons, lambda e: e["end"] <= position), lambda e: e["end"] - 1))
    minus = F.array_min(F.transform(F.filter(exons, lambda e: e["start"] >= position), lambda e: e["start"]))
    return F.when(strand == -1, minus).otherwise(plus)


def downstream_exon_start(position: Column, exons: Column, strand: Column) -> Column:
    """First base of the nearest exon that begins at or after a position, along the strand."""
    plus = F.array_min(F.transform(F.filter(exons, lambda e: e["start"] >= position), lambda e: e["start"]))
    minus = F.array_max(F.transform(F.filter(exons, lambda e: e["end"] - 1 <= position), lambda e: e["end"] - 1))
    return F.when(strand == -1, minus).otherwise(plus)


def junctions(exons: Column) -> Column:
    """array<struct<start, end>> of the introns: end of an exon, start of the next."""
    n = F.size(exons)
    return F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(exons, i)["end"].alias("start"), F.get(exons, i + 1)["start"].alias("end"))
        ),
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def has_junction(exons: Column, start: Column, end: Column) -> Column:
    return F.exists(junctions(exons), lambda j: (j["start"] == start) & (j["end"] == end))


def cds_start(exons: Column, cds: Column, strand: Column) -> Column:
    """Index on the transcript of the first base of the first codon: that of the CDS, plus its frame."""
    first = F.get(cds, F.lit(0))
    last = F.element_at(cds, -1)
    plus = genomic_to_transcript(first["start"], exons, strand) + F.coalesce(first["frame"], F.lit(0))
    minus = genomic_to_transcript(last["end"] - 1, exons, strand) + F.coalesce(last["frame"], F.lit(0))
    return F.when(F.size(cds) > 0, F.when(strand == -1, minus).otherwise(plus))


def three_utr(cds: Column, utr: Column, strand: Column) -> Column:
    """UTR intervals that aren't before the CDS along the strand."""
    first, last = F.get(cds, F.lit(0)), F.element_at(cds, -1)
    return F.when(
        F.size(cds) > 0,
        F.filter(utr, lambda u: ~F.when(strand == -1, u["start"] > last["start"]).otherwise(u["start"] < first["start"])),
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def five_utr(cds: Column, utr: Column, strand: Column) -> Column:
    return F.array_except(utr, three_utr(cds, utr, strand))


def cds_end(exons: Column, cds: Column, utr: Column, strand: Column, start: Column) -> Column:
    """End of the last whole codon before the 3' UTR, or before the end of the transcript."""
    tail = three_utr(cds, utr, strand)
    at = F.when(
        F.size(tail) > 0,
        F.when(strand == -1, genomic_to_transcript(F.element_at(tail, -1)["end"] - 1, exons, strand)).otherwise(
            genomic_to_transcript(F.get(tail, F.lit(0))["start"], exons, strand)
        ),
    ).otherwise(transcript_length(exons))
    return at - (at - start) % 3


# --- stretches of the genome -----------------------------------------------------------------------------------------

#: Bases of a piece of a contig, and how far each goes on into the next one.
PIECE, REACH = 65_536, 4_096


def pieces(genome: DataFrame, size: int = PIECE, reach: int = REACH) -> DataFrame:
    """(seqname, k, seq): contigs (seqname, seq) cut into pieces of ``size`` and the ``reach`` bases after them.

    Contigs that are in pieces already stay as they are. Bytes are cut, not characters, which takes no search.
    """
    if "k" in genome.columns:
        return genome
    last = F.greatest(F.ceil(F.octet_length("seq") / size) - 1, F.lit(0)).cast("int")
    each = genome.select("seqname", F.explode(F.sequence(F.lit(0), last)).alias("k"), F.col("seq").cast("binary").alias("seq"))
    return each.select("seqname", "k", F.substring("seq", F.col("k") * size + 1, F.lit(size + reach)).cast("string").alias("seq"))


def sliced(rows: DataFrame, genome: DataFrame, chrom: str, start: str, end: str, out: str, short: bool | None = None, size: int = PIECE, reach: int = REACH) -> DataFrame:
    """``rows`` with the bases [start, end) of a contig, all three columns, as column ``out``; null if any of them is.

    No row ever carries more than a piece. A stretch of at most ``reach`` bases lies in one piece; a longer one is put
    together from those it crosses, once for all rows that ask for it. ``short`` says that all rows are of the one kind.
    """
    if short is None:
        is_long = F.coalesce(F.col(end) - F.col(start) > reach, F.lit(False))
        return sliced(rows.where(~is_long), genome, chrom, start, end, out, True, size, reach).unionByName(
            sliced(rows.where(is_long), genome, chrom, start, end, out, False, size, reach)
        )
    p = pieces(genome, size, reach).select(F.col("seqname").alias("__name"), F.col("k").alias("__k"), F.col("seq").alias("__piece"))
    first = F.floor(F.greatest(F.col(start), F.lit(0)) / size).cast("int")
    if short:
        joined = rows.withColumn("__first", first).join(p, (F.col(chrom) == F.col("__name")) & (F.col("__first") == F.col("__k")), "left")
        base = F.col("__k") * size
        return joined.withColumn(out, slice_of(F.col("__piece"), F.col(start) - base, F.col(end) - base)).drop("__first", "__name", "__k", "__piece")
    asked = rows.select(F.col(chrom).alias("__c"), F.col(start).alias("__s"), F.col(end).alias("__e")).distinct()
    crossed = asked.withColumn("__at", F.explode(F.sequence(F.floor(F.greatest("__s", F.lit(0)) / size).cast("int"), F.floor((F.col("__e") - 1) / size).cast("int"))))
    base = F.col("__k") * size
    part = slice_of(F.col("__piece"), F.greatest(F.col("__s") - base, F.lit(0)), F.least(F.col("__e") - base, F.lit(size)))
    parts = crossed.join(p, (F.col("__c") == F.col("__name")) & (F.col("__at") == F.col("__k"))).select("__c", "__s", "__e", F.struct("__k", part.alias("part")).alias("p"))
    whole = parts.groupBy("__c", "__s", "__e").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "").alias(out))
    return rows.join(whole, (F.col(chrom) == F.col("__c")) & (F.col(start) == F.col("__s")) & (F.col(end) == F.col("__e")), "left").drop("__c", "__s", "__e")


# --- tables ----------------------------------------------------------------------------------------------------------


def _intervals(feature: Column, *more: str) -> Column:
    item = F.struct("start", "end", *more)
    return F.array_sort(F.collect_list(F.when(feature, item)))


def transcripts_of(rows: DataFrame, biotypes: list[str] | None = None) -> DataFrame:
    """One row per transcript of ``sources.text.gtf`` rows, with its features as sorted arrays, and its rank in the file."""
    rows = rows.where("transcript_id is not null")
    kind = F.coalesce("gene_type", "gene_biotype")
    if biotypes is not None:
        rows = rows.where(kind.isin(*biotypes))
    f = F.col("feature")
    is_tx = f == "transcript"

    def of_transcript(c) -> Column:
        return F.coalesce(F.max(F.when(is_tx, F.col(c))), F.max(c)).alias(c)

    flag = F.max(F.when(is_tx & (F.lower("is_protein_coding") == "true"), 1))
    grouped = rows.groupBy("transcript_id").agg(
        *(of_transcript(c) for c in ("gene_id", "protein_id", "gene_name", "gene_type", "gene_biotype", "strand")),
        F.max("seqname").alias("chrom"),
        F.coalesce(F.max(F.when(is_tx, F.col("start"))), F.min("start")).alias("start"),
        F.coalesce(F.max(F.when(is_tx, F.col("end"))), F.max("end")).alias("end"),
        _intervals(f == "exon").alias("exons"),
        _intervals(f == "CDS", "frame").alias("cds"),
        _intervals(f == "UTR").alias("utr"),
        _intervals(f.isin("five_prime_UTR", "five_prime_utr")).alias("utr5"),
        _intervals(f.isin("three_prime_UTR", "three_prime_utr")).alias("utr3"),
        _intervals(F.lower(f) == "selenocysteine").alias("sec"),
        F.flatten(F.collect_list(F.when(is_tx, F.col("tags")))).alias("tags"),
        flag.alias("flag"),
        F.min("pos").alias("pos"),
    )
    utr = F.array_sort(F.concat("utr", "utr5", "utr3"))
    return grouped.select(
        F.col("transcript_id").alias("tx_id"), "gene_id", "protein_id", "gene_name", F.coalesce("gene_type", "gene_biotype").alias("biotype"), "chrom",
        "start", "end", "strand", "exons", "cds", utr.alias("utr"), "sec", "tags", (F.col("flag") == 1).alias("is_coding"), "pos",
    )


def genes_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("feature") == "gene").select(
        "gene_id", "gene_name", F.coalesce("gene_type", "gene_biotype").alias("biotype"), F.col("seqname").alias("chrom"), "start", "end", "strand", "pos"
    ).dropDuplicates(["gene_id"])


def unversioned(genes: DataFrame) -> DataFrame:
    """(unversioned, gene_id): one gene per id without version; one of a pseudoautosomal copy (`_PAR_Y`) comes last."""
    base = F.substring_index("gene_id", ".", 1)
    order = Window.partitionBy("unversioned").orderBy(F.col("gene_id").contains("_PAR_Y"), "gene_id")
    return genes.select(base.alias("unversioned"), "gene_id").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def exon_table(transcripts: DataFrame) -> DataFrame:
    """(tx_id, gene_id, strand, idx, n5, start, end, cum_start, cum_end): exons with their place on the genome (idx from 0),
    along the transcript (n5 from 1), and their range on the transcript."""
    rows = transcripts.select("tx_id", "gene_id", "strand", F.posexplode("exons").alias("idx", "e")).select("tx_id", "gene_id", "strand", "idx", "e.start", "e.end")
    along = Window.partitionBy("tx_id").orderBy(F.when(F.col("strand") == -1, -F.col("idx")).otherwise(F.col("idx")))
    cum = F.sum(F.col("end") - F.col("start")).over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.select("*", F.row_number().over(along).alias("n5"), (cum - (F.col("end") - F.col("start"))).alias("cum_start"), cum.alias("cum_end"))


def exons_of_gene(transcripts: DataFrame) -> DataFrame:
    """(gene_id, exons): the distinct exons of each gene, sorted."""
    return transcripts.select("gene_id", F.explode("exons").alias("e")).groupBy("gene_id").agg(F.array_sort(F.collect_set("e")).alias("exons"))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """(key, rank) by the order of the file. Ranks need no single partition: `pos` already has the order."""
    return df.select(key, F.col("pos").alias("rank"))


@dataclass
class Reference:
    """Lazily built tables. ``proteome`` decides which transcripts code, unless the annotation says so itself.

    ``genome`` has contigs (seqname, seq), or their ``pieces``.
    """

    genes: DataFrame
    transcripts: DataFrame
    genome: DataFrame
    proteome: DataFrame | None = None

    @classmethod
    def from_files(cls, spark: SparkSession, gtf: str, genome: str, proteome: str | None = None, invalid_as_noncoding: bool = False) -> Reference:
        rows = text.gtf(spark, gtf)
        transcripts = transcripts_of(rows)
        proteins = text.proteome(spark, proteome) if proteome else None
        if proteins is not None:
            transcripts = coding_flag(transcripts, proteins, invalid_as_noncoding)
        return cls(genes_of(rows), transcripts, text.genome(spark, genome), proteins)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Reference:
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("genes", "transcripts", "genome")]
        return cls(*tables, spark.read.parquet(f"{path}/proteome"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """The tables as Parquet, sorted by id so that row groups can be skipped; the genome in pieces."""
        self.genes.sort("gene_id").write.mode(mode).parquet(f"{path}/genes")
        self.transcripts.sort("tx_id").write.mode(mode).parquet(f"{path}/transcripts")
        pieces(self.genome).write.mode(mode).parquet(f"{path}/genome")
        if self.proteome is not None:
            self.proteome.write.mode(mode).parquet(f"{path}/proteome")

    def pool_path(self, path: str, cleavage: Cleavage) -> str:
        """Folder of the canonical pool of six digestion parameters."""
        c = cleavage
        return f"{path}/canonical/enzyme={c.enzyme}/exception={c.exception}/{c.miscleavage}-{c.min_mw}-{c.min_length}-{c.max_length}"

    def canonical(self, cleavage: Cleavage = Cleavage()) -> DataFrame:
        nf = self.transcripts.select(F.col("tx_id").alias("transcript_id"), F.array_contains("tags", "cds_start_NF").alias("cds_start_nf"))
        return canonical_pool(self.proteome.join(nf, "transcript_id", "left"), cleavage)

    def save_canonical(self, path: str, cleavage: Cleavage = Cleavage(), override: bool = False) -> None:
        """Digests and registers a pool; parameters that have one already are an error unless overridden."""
        self.canonical(cleavage).write.mode("overwrite" if override else "errorifexists").parquet(self.pool_path(path, cleavage))

    def gene_sequences(self, codes: DataFrame | None = None) -> DataFrame:
        """(gene_id, gene_seq), along the strand."""
        genes = self.genes if codes is None else self.genes.join(codes, "gene_id", "left_semi")
        rows = sliced(genes.select("gene_id", "chrom", "start", "end", "strand"), self.genome, "chrom", "start", "end", "bases")
        return rows.where("bases is not null").select("gene_id", stranded(F.col("bases"), F.col("strand")).alias("gene_seq"))

    def stretches(self, wanted: DataFrame) -> DataFrame:
        """(s_gene, s_start, s_end, stretch): the bases of ``wanted`` (gene_id, start, end), intervals on genes, each once."""
        genes = self.genes.select("gene_id", "chrom", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "strand")
        rows = wanted.select("gene_id", "start", "end").distinct().join(genes, "gene_id")
        span = intervals.range_gene_to_genomic(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"), F.col("strand"))
        placed = rows.select("gene_id", "chrom", "strand", "start", "end", span["start"].alias("lo"), span["end"].alias("hi"))
        short = wanted.where(F.col("end") - F.col("start") > REACH).isEmpty() or None
        found = sliced(placed, self.genome, "chrom", "lo", "hi", "bases", short)
        return found.select(
            F.col("gene_id").alias("s_gene"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), stranded(F.col("bases"), F.col("strand")).alias("stretch")
        )

    def _spliced(self, txs: DataFrame, parts: str) -> DataFrame:
        """``txs`` with the intervals of an array column cut out and joined along the strand, as column ``spliced``.

        What spans no more than a piece's reach is cut from one piece by one row; intervals farther apart are rows of
        their own, put together after. Transcripts without bases are left out.
        """
        lo, hi = F.array_min(F.transform(parts, lambda e: e["start"])), F.array_max(F.transform(parts, lambda e: e["end"]))
        is_near = F.coalesce(hi - lo <= REACH, F.lit(False))
        placed = sliced(txs.where(is_near).withColumns({"__lo": lo, "__hi": hi}), self.genome, "chrom", "__lo", "__hi", "__all", True).where("__all is not null")
        cut = F.array_join(F.transform(parts, lambda e: slice_of(F.col("__all"), e["start"] - F.col("__lo"), e["end"] - F.col("__lo"))), "")
        near = placed.withColumn("spliced", stranded(cut, F.col("strand"))).drop("__lo", "__hi", "__all")
        if self.transcripts.where(~is_near & (F.size(parts) > 0)).isEmpty():
            return near
        far = txs.where(~is_near & (F.size(parts) > 0))
        rows = far.select("tx_id", "chrom", "strand", F.posexplode(parts).alias("i", "e")).select("tx_id", "chrom", "strand", "i", "e.start", "e.end")
        each = sliced(rows, self.genome, "chrom", "start", "end", "bases").where("bases is not null")
        joined = each.groupBy("tx_id", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "bases"))), lambda x: x["bases"]), "").alias("bases"))
        return near.unionByName(far.join(joined.select("tx_id", stranded(F.col("bases"), F.col("strand")).alias("spliced")), "tx_id").select(near.columns))

    def transcript_sequences(self, wanted: DataFrame | None = None) -> DataFrame:
        """(tx_id, …, tx_seq, orf_start, orf_end, sec_sites): spliced sequences with the annotated ORF and Sec sites."""
        txs = self.transcripts if wanted is None else self.transcripts.join(wanted, "tx_id", "left_semi")
        joined = self._spliced(txs, "exons")
        start = cds_start(F.col("exons"), F.col("cds"), F.col("strand"))
        strand = F.col("strand")
        sites = F.array_sort(
            F.transform(
                "sec", lambda s: F.when(strand == -1, genomic_to_transcript(s["end"] - 1, F.col("exons"), strand)).otherwise(genomic_to_transcript(s["start"], F.col("exons"), strand))
            )
        )
        out = joined.select(*(c for c in txs.columns), F.col("spliced").alias("tx_seq"), start.alias("orf_start"), sites.alias("sec_sites"))
        return out.withColumn("orf_end", cds_end(F.col("exons"), F.col("cds"), F.col("utr"), F.col("strand"), F.col("orf_start")))

    def cds_sequences(self) -> DataFrame:
        """(tx_id, cds_seq): the coding bases alone, along the strand."""
        return self._spliced(self.transcripts.where(F.size("cds") > 0), "cds").select("tx_id", F.col("spliced").alias("cds_seq"))

    def translated(self) -> DataFrame:
        """(tx_id, protein) of the annotated ORFs with the standard table, up to the first stop."""
        seqs = self.transcript_sequences().where("orf_start is not null")
        return seqs.select("tx_id", until_stop(translate_dna(F.col("tx_seq"), F.col("orf_start"))).alias("protein"))


def coding_flag(transcripts: DataFrame, proteome: DataFrame, invalid_as_noncoding: bool = False) -> DataFrame:
    """``is_coding`` by whether the proteome has the transcript; with ``invalid_as_noncoding`` a protein with `*` inside isn't counted."""
    known = proteome.select(F.col("transcript_id").alias("tx_id"), F.col("seq").contains("*").alias("invalid"))
    if invalid_as_noncoding:
        known = known.where("not invalid")
    known = known.select("tx_id", F.lit(True).alias("known")).distinct()
    joined = transcripts.join(known, "tx_id", "left")
    return joined.select(*(c for c in transcripts.columns if c != "is_coding"), F.coalesce("known", F.lit(False)).alias("is_coding"))


def codon_columns(chrom: Column, default: str = "Standard", per_chrom: dict[str, str] | None = None, starts: tuple[str, ...] = ("ATG",), chrom_starts: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """codon_table and start_codons of a contig; mitochondrial ones have their own unless told otherwise."""
    tables = {c: fixed.MITOCHONDRIAL_TABLE for c in fixed.MITOCHONDRIAL} | (per_chrom or {})
    firsts = {c: fixed.MITOCHONDRIAL_STARTS for c in fixed.MITOCHONDRIAL} | (chrom_starts or {})
    table, start = F.lit(default), F.array(*(F.lit(s) for s in starts))
    for c, t in tables.items():
        table = F.when(chrom == c, t).otherwise(table)
    for c, s in firsts.items():
        start = F.when(chrom == c, F.array(*(F.lit(x) for x in s))).otherwise(start)
    return {"codon_table": table, "start_codons": start}


def codon_tables(chroms: DataFrame, default: str = "Standard", per_chrom: dict[str, str] | None = None, starts: tuple[str, ...] = ("ATG",), chrom_starts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(chrom, codon_table, start_codons) for a table of contigs (chrom), see ``codon_columns``."""
    return chroms.select("chrom").distinct().withColumns(codon_columns(F.col("chrom"), default, per_chrom, starts, chrom_starts))


def novel_orf_transcripts(reference: Reference, coding: bool = False, include: DataFrame | None = None, exclude: tuple[str, ...] = fixed.EXCLUDED_BIOTYPES, min_length: int = 21) -> DataFrame:
    """Transcripts whose ORFs are novel: not coding (or coding, if asked), of the wanted biotypes, not in the proteome, long enough."""
    txs = reference.transcripts.where(transcript_length(F.col("exons")) >= min_length)
    if coding:
        return txs.where("is_coding")
    txs = txs.where("not coalesce(is_coding, false)")
    if include is not None:
        txs = txs.join(F.broadcast(include.select(F.col("name").alias("biotype"))), "biotype", "left_semi")
    elif exclude:
        txs = txs.where(~F.coalesce(F.col("biotype"), F.lit("")).isin(*exclude))
    if reference.proteome is not None:
        txs = txs.join(reference.proteome.select(F.col("transcript_id").alias("tx_id")), "tx_id", "left_anti")
    return txs


def subset(reference: Reference, tx_ids: list[str], margin: int = 0) -> Reference:
    """The reference of a few transcripts, with each contig cut to their genes and coordinates counted from the cut."""
    txs = reference.transcripts.where(F.col("tx_id").isin(*tx_ids))
    genes = reference.genes.join(txs.select("gene_id").distinct(), "gene_id", "left_semi")
    cut = genes.groupBy("chrom").agg(F.greatest(F.min("start") - margin, F.lit(0)).alias("lo"), (F.max("end") + margin).alias("hi"))

    def moved(a: str) -> Column:
        return F.transform(a, lambda e: F.struct((e["start"] - F.col("lo")).alias("start"), (e["end"] - F.col("lo")).alias("end")))

    cds = F.transform("cds", lambda e: F.struct((e["start"] - F.col("lo")).alias("start"), (e["end"] - F.col("lo")).alias("end"), e["frame"].alias("frame")))
    shift = {"start": F.col("start") - F.col("lo"), "end": F.col("end") - F.col("lo")}
    txs = txs.join(cut, "chrom").withColumns(shift | {"exons": moved("exons"), "utr": moved("utr"), "sec": moved("sec"), "cds": cds}).drop("lo", "hi")
    genes = genes.join(cut, "chrom").withColumns(shift).drop("lo", "hi")
    seqs = sliced(cut, reference.genome, "chrom", "lo", "hi", "seq").select(F.col("chrom").alias("seqname"), "seq")
    proteins = None
    if reference.proteome is not None:
        proteins = reference.proteome.join(txs.select(F.col("tx_id").alias("transcript_id")), "transcript_id", "left_semi")
    return Reference(genes, txs, seqs, proteins)
