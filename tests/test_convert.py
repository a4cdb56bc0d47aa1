"""Conversion of caller records, against variant files that hold the expected records."""

import golden
import pytest
from pyspark.sql import functions as F

from ribospark.operators import convert
from ribospark.operators.reference import Reference
from ribospark.sources import callers, gvf

@pytest.fixture(scope="module")
def reference(spark):
    return Reference.from_files(spark, *golden.small_reference())


def keys(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


COLUMNS = ("gene_id", "tx_id", "start", "end", "ref", "alt", "id")


@pytest.mark.parametrize("word", ["SNV", "INDEL"])
def test_vep(spark, reference, word):
    """Records whose place some variant file has come out as that file has them."""
    out = convert.vep(callers.vep_tsv(spark, golden.vep_tables()), reference).where(F.col("type") == word)
    want = gvf.variants(spark, golden.variant_files(word))
    got, known = keys(out.where("status = 'ok'"), *COLUMNS), keys(want, *COLUMNS)
    places = {k[:3] for k in known}
    assert got & known and len({k for k in got if k[:3] in places} - known) <= len(got & known)
    for gene, tx, start, end, ref, alt, name in got:
        assert end - start == len(ref) and name.endswith(f"-{start + 1}-{ref}-{alt}")


def test_vep_reference_bases(spark, reference):
    out = convert.vep(callers.vep_tsv(spark, golden.vep_tables()), reference).where("status = 'ok'")
    wrong = out.join(reference.gene_sequences(), "gene_id").where(F.substring("gene_seq", F.col("start") + 1, F.length("ref")) != F.col("ref"))
    assert wrong.count() == 0
    assert convert.tally(convert.vep(callers.vep_tsv(spark, golden.vep_tables()), reference)).count() >= 1


def test_vep_vcf_has_samples_and_phases(spark, reference):
    rows = callers.vep_vcf(spark, golden.with_head("^#CHROM.*FORMAT", ".vcf")[-1])
    out = convert.vep(rows, reference).where("status = 'ok'")
    assert out.count() > 0 and out.where("sample is null").count() == 0
    with pytest.raises(ValueError, match="nobody"):
        callers.vep_vcf(spark, golden.with_head("^#CHROM.*FORMAT", ".vcf")[-1], ["nobody"])


def test_reditools(spark, reference):
    out = convert.reditools(callers.reditools(spark, golden.with_head("^Region\tPosition")), reference)
    want = gvf.variants(spark, golden.variant_files("RES"))
    got = keys(out, "gene_id", "tx_id", "start", "ref", "alt")
    assert got & keys(want, "gene_id", "tx_id", "start", "ref", "alt")
    strict = convert.reditools(callers.reditools(spark, golden.with_head("^Region\tPosition")), reference, min_coverage_rna=10_000)
    assert strict.count() == 0


def test_fusions(spark, reference):
    star = convert.star_fusion(callers.star_fusion(spark, golden.with_head("^#FusionName.*est_J")[0]), reference)
    for r in star.collect():
        assert r.id == f"FUSION-{r.tx_id}:{r.start}-{r.attrs['ACCEPTER_TRANSCRIPT_ID']}:{r.attrs['ACCEPTER_POSITION']}"
    assert star.count() > 0
    assert convert.star_fusion(callers.star_fusion(spark, golden.with_head("^#FusionName\t[^\t]*\t[^\t]*\tSpliceType")[0]), reference).count() == star.count()
    assert convert.star_fusion(callers.star_fusion(spark, golden.with_head("^#FusionName.*est_J")[0]), reference, 1e9).count() == 0
    catcher = convert.fusion_catcher(callers.fusion_catcher(spark, golden.with_head("^Gene_1_symbol")[0]), reference)
    assert catcher.count() > 0
    arriba = callers.arriba(spark, golden.with_head("^#gene1")[0])
    loose = convert.arriba(arriba, reference, min_confidence="low").count()
    assert loose >= convert.arriba(arriba, reference, min_confidence="high").count()


def test_circles(spark, reference):
    for version in (2, 3):
        out = convert.circexplorer(callers.circexplorer(spark, golden.circle_table(version), version), reference)
        assert out.count() > 0
        for r in out.where("status = 'ok'").collect():
            assert r.id.startswith(f"CIRC-{r.tx_id}-{r.start}:") and r.start == r.fragments[0].start
    assert convert.circexplorer(callers.circexplorer(spark, golden.circle_table(2)), reference, 10**6).count() == 0


@pytest.mark.parametrize("event,mark", [("SE", "\\texonStart_0base"), ("A5SS", "longExonStart"), ("A3SS", "longExonStart"), ("MXE", "1stExonStart"), ("RI", "riExonStart")])
def test_splicing(spark, reference, event, mark):
    out = convert.rmats(callers.rmats(spark, golden.with_head(mark)[0], event), reference, event)
    seqs = reference.gene_sequences()
    for r in out.join(seqs, "gene_id").collect():
        assert r.type in ("Insertion", "Deletion", "Substitution") and r.start < r.end <= len(r.gene_seq)
        assert r.ref == r.gene_seq[r.start]
        if r.type != "Deletion":
            assert int(r.attrs["DONOR_START"]) < int(r.attrs["DONOR_END"]) <= len(r.gene_seq)
    strict = convert.rmats(callers.rmats(spark, golden.with_head(mark)[0], event), reference, event, 10**6, 10**6)
    assert strict.count() == 0
