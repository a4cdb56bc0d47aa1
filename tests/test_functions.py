"""Column functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ribospark.functions import decoy, fixed, intervals
from ribospark.functions import digest as dg
from ribospark.functions import sequence as sq
from ribospark.functions.digest import Cleavage
from ribospark.kernel import caller


@pytest.fixture(scope="module")
def proteins(spark):
    rnd = random.Random(2)
    rows = ["".join(rnd.choice("ACDEFGHIKLMNPQRSTVWYKRDEPMW") for _ in range(rnd.randint(1, 120))) for _ in range(150)]
    return spark.createDataFrame([(r,) for r in [*rows, "", "M", "K", "MK"]], "seq string").cache()


def plain_sites(seq, enzyme, exception):
    barred = {m.end() for m in re.finditer(exception, seq)} if exception else set()
    return [m.end() for m in re.finditer(fixed.ENZYMES[enzyme], seq) if m.end() not in barred]


@pytest.mark.parametrize("enzyme", sorted(fixed.ENZYMES))
def test_sites_of_every_enzyme(proteins, enzyme):
    c = Cleavage(enzyme)
    cut = caller.cutter(enzyme, "auto")
    ranges = re.compile(f"(?=({fixed.range_pattern(enzyme)}))")
    for r in proteins.select("seq", dg.cleavage_sites(F.col("seq"), c).alias("s")).collect():
        assert list(r.s) == plain_sites(r.seq, enzyme, c.exception_pattern())
        assert [s for s, _, _ in cut.sites(r.seq)] == list(r.s)
        if not c.exception_pattern():
            spans = {(m.start(), m.end(1)) for m in ranges.finditer(r.seq)}
            assert all((a, b) in spans for _, a, b in cut.sites(r.seq))
        assert all(r.seq[s - 1] in cut.residues for s in r.s)


def plain_digest(seq, c, nf=False):
    sites = [0, *plain_sites(seq, c.enzyme, c.exception_pattern()), len(seq)]
    out = []
    for i in range(len(sites) - 1):
        for j in range(i + 1, min(len(sites), i + 2 + c.miscleavage)):
            p = seq[sites[i] : sites[j]]
            out += [p, *([p[1:]] if i == 0 and not nf and p.startswith("M") else [])]
    return sorted(p for p in out if c.min_length <= len(p) <= c.max_length and "X" not in p and caller.weight(p) > c.min_mw)


@pytest.mark.parametrize("c", [Cleavage(), Cleavage("lysc", None, 1), Cleavage("proteinase k", None, 4, 300.0, 3, 30)])
def test_digest(proteins, c):
    for r in proteins.select("seq", dg.digest(F.col("seq"), c).alias("p"), dg.digest(F.col("seq"), c, True).alias("nf")).collect():
        assert sorted(r.p) == plain_digest(r.seq, c)
        assert sorted(r.nf) == plain_digest(r.seq, c, True)


def test_mass_and_letters_without_mass(spark):
    df = spark.createDataFrame([("PEPTIDEK",), ("GGGGGGG",), ("PEPTXDEK",), ("PEPTBDEK",), ("",)], "p string")
    rows = {r.p: r for r in df.select("p", dg.mass(F.col("p")).alias("m"), dg.is_valid_digest(F.col("p")).alias("v")).collect()}
    assert rows["PEPTIDEK"].m == pytest.approx(caller.weight("PEPTIDEK")) and rows["PEPTIDEK"].v
    assert not rows["GGGGGGG"].v and not rows["PEPTXDEK"].v and not rows["PEPTBDEK"].v and rows["PEPTBDEK"].m is None


def test_dna(spark):
    rnd = random.Random(8)
    seqs = ["".join(rnd.choice("ACGTN" if i % 9 == 0 else "ACGT") for _ in range(rnd.randint(0, 90))) for i in range(80)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    table = fixed.codons()
    comp = str.maketrans("ACGTN", "TGCAN")
    out = df.select(
        "s", sq.reverse_complement(F.col("s")).alias("rc"), sq.translate_dna(F.col("s"), 1).alias("p"), sq.start_codon_sites(F.col("s")).alias("a"),
        sq.in_frame_stop(F.col("s"), 2).alias("stop"), sq.first_orf(F.col("s")).alias("orf"), sq.stop_sites(sq.translate_dna(F.col("s"))).alias("stars"),
    )
    for r in out.collect():
        assert r.rc == r.s.translate(comp)[::-1]
        assert r.p == "".join(table.get(r.s[i : i + 3], "X") for i in range(1, len(r.s) - 2, 3))
        assert list(r.a) == [m.start() for m in re.finditer("ATG", r.s)]
        stops = [i for i in range(2, len(r.s) - 2, 3) if r.s[i : i + 3] in ("TAA", "TAG", "TGA")]
        assert r.stop == (stops[0] if stops else -1)
        whole = "".join(table.get(r.s[i : i + 3], "X") for i in range(0, len(r.s) - 2, 3))
        assert list(r.stars) == [i for i, c in enumerate(whole) if c == "*"]
        if r.s.find("ATG") < 0:
            assert r.orf is None
        else:
            assert r.orf.start == r.s.find("ATG") and (r.orf.end - r.orf.start) % 3 == 0


def test_codon_tables():
    assert fixed.codons("SGC1") == fixed.codons("Vertebrate Mitochondrial")
    assert all(len(set(fixed.codons(t))) == 64 and fixed.codons(t)["ATG"] == "M" for t in fixed.CODON_TABLES)
    assert fixed.codons("SGC1")["TGA"] == "W" and fixed.codons()["TGA"] == "*"


def test_matched_locations(spark):
    kind = "l array<struct<q_start:int,q_end:int,ref_start:int,ref_end:int>>"
    df = spark.createDataFrame([([(0, 5, 10, 15), (5, 9, 15, 19), (9, 12, 40, 43)],)], kind)
    r = df.select(
        sq.merge_locations(F.col("l")).alias("m"), sq.slice_locations(F.col("l"), F.lit(3), F.lit(10)).alias("s"), sq.query_index(F.col("l"), F.lit(41)).alias("q"), sq.query_index(F.col("l"), F.lit(30)).alias("none")
    ).first()
    assert [tuple(x) for x in r.m] == [(0, 9, 10, 19), (9, 12, 40, 43)]
    assert [tuple(x) for x in r.s] == [(0, 2, 13, 15), (2, 6, 15, 19), (6, 7, 40, 41)]
    assert (r.q, r.none) == (10, -1)


def test_intervals(spark):
    rows = [(a, a + n, b, b + m) for a in range(0, 6) for n in (1, 3) for b in range(0, 6) for m in (1, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    cols = [F.col(x) for x in "abcd"]
    out = df.select("*", intervals.overlaps(*cols).alias("o"), intervals.contains(*cols).alias("h"), intervals.intersection(*cols).alias("i"), intervals.codon_range(F.col("a"), F.col("b"), F.lit(1)).alias("k"))
    for r in out.collect():
        both = set(range(r.a, r.b)) & set(range(r.c, r.d))
        assert r.o == bool(both) and r.h == (set(range(r.c, r.d)) <= set(range(r.a, r.b)))
        assert (r.i is None) == (not both) and (not both or (r.i.start, r.i.end) == (min(both), max(both) + 1))
        assert (r.k.start, r.k.end) == ((r.a - 1) // 3, -(-(r.b - 1) // 3))


def test_gene_coordinates(spark):
    df = spark.createDataFrame([(p, s) for p in range(95, 125) for s in (1, -1)], "p int, s int")
    g = intervals.genomic_to_gene(F.col("p"), F.lit(100), F.lit(120), F.col("s"))
    out = df.select("*", g.alias("g"), intervals.gene_to_genomic(g, F.lit(100), F.lit(120), F.col("s")).alias("back"))
    for r in out.collect():
        assert (r.g is None) == (not 100 <= r.p < 120)
        assert r.g is None or r.back == r.p and r.g == (r.p - 100 if r.s == 1 else 119 - r.p)


def test_rearranged_peptides(spark):
    df = spark.createDataFrame([("MWKAWRW",), ("W",), ("UAUKM",), ("",)], "s string")
    out = df.select(
        "s", decoy.w2f_variants(F.col("s")).alias("w"), decoy.sec_truncations(F.col("s"), True).alias("u"), decoy.reverse(F.col("s"), decoy.fixed_positions(F.col("s"), Cleavage(), "A")).alias("r")
    ).collect()
    rows = {r.s: r for r in out}
    assert sorted(rows["MWKAWRW"].w) == sorted({"MFKAWRW", "MWKAFRW", "MWKAWRF", "MFKAFRW", "MFKAWRF", "MWKAFRF", "MFKAFRF"})
    assert list(rows["W"].w) == ["F"] and list(rows[""].w) == [] and list(rows["UAUKM"].u) == ["", "UA"]
    assert rows["MWKAWRW"].r == "MRWAKWW"
