"""Stretches of contigs longer than several pieces, on both strands, and what is cut out of them."""

import random

import pytest

from ribospark.functions.digest import Cleavage, Digester, digest, digest_rows
from ribospark.functions.sequence import translate_dna
from ribospark.operators import reference, routing
from ribospark.operators.reference import Reference
from pyspark.sql import functions as F

RND = random.Random(1)
SEQ = "".join(RND.choice("ACGT") for _ in range(1_000))
TURN = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize("short", [None, True, False])
def test_slices(spark, short):
    genome = spark.createDataFrame([("c", SEQ), ("d", "ACGT"), ("e", "")], "seqname string, seq string")
    rows = [(i, *sorted(RND.sample(range(1_001), 2))) for i in range(200)] + [(200, 0, 1_000), (201, 99, 100), (202, 100, 200), (203, 100, 101)]
    if short:
        rows = [(i, a, min(b, a + 30)) for i, a, b in rows]
    df = spark.createDataFrame([(i, "c", a, b) for i, a, b in rows] + [(-1, "none", 0, 5), (-2, None, 0, 5), (-3, "d", 1, 3)], "i int, chrom string, a int, b int")
    got = {r.i: r.s for r in reference.sliced(df, genome, "chrom", "a", "b", "s", short, size=100, reach=30).collect()}
    assert got == {i: SEQ[a:b] for i, a, b in rows} | {-1: None, -2: None, -3: "CG"}
    pieces = reference.pieces(genome, 100, 30)
    assert pieces.count() == 12 and reference.pieces(pieces) is pieces
    assert reference.sliced(df.limit(0), genome, "chrom", "a", "b", "s", short).count() == 0


def a_reference(spark):
    size = 150_000
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(size))
    genome = spark.createDataFrame([("c", seq)], "seqname string, seq string")
    genes = spark.createDataFrame([("G", "N", "b", "c", 10, 149_000, 1, 0), ("H", "N", "b", "c", 60_000, 70_000, -1, 1)], "gene_id string, gene_name string, biotype string, chrom string, start int, end int, strand int, pos int")
    exons = {"T": [(20, 90), (65_530, 65_545), (131_000, 140_000)], "U": [(60_010, 60_020), (65_000, 69_000)]}
    columns = "tx_id string, gene_id string, protein_id string, gene_name string, biotype string, chrom string, start int, end int, strand int, exons array<struct<start:int,end:int>>, cds array<struct<start:int,end:int,frame:int>>, utr array<struct<start:int,end:int>>, sec array<struct<start:int,end:int>>, tags array<string>, is_coding boolean, pos int"
    rows = [(t, g, None, "N", "b", "c", e[0][0], e[-1][1], s, e, [(a, b, 0) for a, b in e], [], [], [], True, 0) for t, g, s, e in (("T", "G", 1, exons["T"]), ("U", "H", -1, exons["U"]))]
    return seq, exons, Reference(genes, spark.createDataFrame(rows, columns), genome)


def test_genes_and_transcripts_across_pieces(spark, tmp_path):
    seq, exons, ref = a_reference(spark)
    ref.save(str(tmp_path / "index"))
    loaded = Reference.load(spark, str(tmp_path / "index")) if ref.proteome is not None else Reference(ref.genes, ref.transcripts, spark.read.parquet(str(tmp_path / "index/genome")))
    for r in (ref, loaded):
        genes = {x.gene_id: x.gene_seq for x in r.gene_sequences().collect()}
        assert genes == {"G": seq[10:149_000], "H": seq[60_000:70_000].translate(TURN)[::-1]}
        spliced = {t: "".join(seq[a:b] for a, b in e) for t, e in exons.items()}
        txs = {x.tx_id: x.tx_seq for x in r.transcript_sequences().collect()}
        assert txs == {"T": spliced["T"], "U": spliced["U"].translate(TURN)[::-1]} == {x.tx_id: x.cds_seq for x in r.cds_sequences().collect()}
        wanted = spark.createDataFrame([("G", 5, 100_000), ("H", 3, 9), ("H", 3, 9)], "gene_id string, start int, end int")
        cut = {(x.s_gene, x.s_start): x.stretch for x in r.stretches(wanted).collect()}
        assert cut == {("G", 5): seq[15:100_010], ("H", 3): seq[60_000:70_000].translate(TURN)[::-1][3:9]}


def test_variants_back_on_genes(spark):
    _, _, ref = a_reference(spark)
    v = [("T", 5, 6, "A", "C", "SNV", "SNV-1"), ("T", 68, 72, "ACGT", "A", "INDEL", "INDEL-69-ACCCT-A"), ("T", 68, 72, "ACGT", "TTTT", "MNV", "MNV-1"), ("X", 1, 2, "A", "C", "SNV", "SNV-2"), ("U", 0, 1, "A", "C", "SNV", "SNV-3")]
    rows = spark.createDataFrame(v, "tx_id string, start int, end int, ref string, alt string, type string, id string")
    got = {(r.tx_id, r.type): (r.start, r.end, r.ref, r.status) for r in routing.on_gene(rows, ref.transcripts, ref.genes).collect()}
    assert got["T", "SNV"] == (15, 16, "A", "ok") and got["T", "MNV"][3] == "spans an intron" and got["X", "SNV"][3] == "unknown transcript"
    assert got["T", "INDEL"] == (78, 65_522, "ACCCT", "ok") and got["U", "SNV"][:2] == (1_000, 1_001)


def test_digest_by_rows_equals_the_expression(spark):
    rnd = random.Random(3)
    proteins = ["".join(rnd.choice("ACDEFGHIKLMNPQRSTVWYXU*") if rnd.random() < 0.02 else rnd.choice("MAGKRPWCDHL") for _ in range(rnd.randint(0, 90))) for _ in range(200)]
    rows = [(i, p, i % 3 == 0) for i, p in enumerate([*proteins, "", None, "M", "MK", "K" * 40])]
    df = spark.createDataFrame(rows, "i int, seq string, nf boolean")
    for cleavage in (Cleavage(), Cleavage(exception=None), Cleavage("lysc", None, 1), Cleavage("asp-n", None, min_length=2, min_mw=0)):
        want = df.select("i", F.explode(digest(F.col("seq"), cleavage, F.col("nf"))).alias("pep"))
        got = digest_rows(df, cleavage, keep=["i"], nf="nf")
        once = digest_rows(df, cleavage, keep=["i"], nf="nf", distinct=True)
        every = sorted(map(tuple, got.collect()))
        assert every == sorted(map(tuple, want.collect())) and sorted(set(every)) == sorted(map(tuple, once.collect()))
    assert digest_rows(df.limit(0)).count() == 0 and Digester(Cleavage()).peptides("") == []


def test_translation(spark):
    seqs = ["ATGGCTNNNTAA", "atggc", "", None, "ACACACACACACAC", "GCTGCTTGA" * 50, "NN", "AT,GCT"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = [tuple(r) for r in df.select(translate_dna(F.col("s")), translate_dna(F.col("s"), 1), translate_dna(F.col("s"), 0, "SGC1")).collect()]
    assert got[0] == ("MAX*", "WXX", "MAX*") and got[1] == ("M", "W", "M") and got[2] == ("", "", "") and got[3] == (None, None, None)
    assert got[4][0] == "THTH" and got[5][0] == "AA*" * 50 and got[6][0] == ""
