"""Variant files in order, peptide tables merged and sorted, and checks of names."""

import pytest

from ribospark.sources import gvf, sinks, text


def test_variant_files_are_sorted_in_parts(spark, tmp_path):
    rows = [(f"G{i % 7}", i, i + 1, "A", "C", "SNV", f"SNV-{i}", f"T{i % 3}", {"TRANSCRIPT_ID": f"T{i % 3}", "GENE_SYMBOL": "N"}) for i in range(300, 0, -1)]
    path = str(tmp_path / "v.gvf")
    sinks.write_gvf(spark.createDataFrame(rows, gvf.VARIANT).repartition(5), path, {"parser": "p", "source": "s"})
    lines = [x for part in sorted((tmp_path / "v.gvf").glob("part-*")) for x in part.read_text().splitlines()]
    head = [x for x in lines if x.startswith("#")]
    assert lines[: len(head)] == head and head[0] == "##fileformat=VCFv4.2" and head[-1].startswith("#CHROM")
    places = [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines[len(head) :]]
    assert places == sorted(places) and len(places) == 300
    assert gvf.metadata(spark, path)["source"] == "s" and gvf.variants(spark, path).count() == 300
    empty = str(tmp_path / "e.gvf")
    sinks.write_gvf(spark.createDataFrame([], gvf.VARIANT), empty, {"source": "s"})
    assert gvf.variants(spark, empty).count() == 0 and gvf.metadata(spark, empty)["source"] == "s"
    wanted = spark.createDataFrame([("T1",), ("T1",)], "tx_id string")
    kept = [r.value for r in gvf.extract(spark, path, wanted).collect()]
    assert kept[: len(head)] == head and len(kept) == len(head) + 100 and all("TRANSCRIPT_ID=T1" in x for x in kept[len(head) :])


def test_peptide_tables(spark):
    def lines(*rows):
        return spark.createDataFrame([(i, "\t".join([s, h, s[a:b], str(a), str(b), *"." * 7])) for i, (s, h, a, b) in enumerate(rows)], "pos bigint, value string")

    one = gvf.peptide_table(spark, lines(("BBBB", "x", 2, 4), ("AAAA", "z", 0, 4), ("BBBB", "x", 0, 2), ("AAAA", "y", 0, 4)))
    two = gvf.peptide_table(spark, lines(("AAAA", "y", 0, 4), ("CCCC", "y", 0, 4)))
    assert [(r.sequence, r.header, r.start) for r in gvf.sorted_table(one).collect()] == [("BBBB", "x", 0), ("BBBB", "x", 2), ("AAAA", "y", 0), ("AAAA", "z", 0)]
    merged = gvf.merge_tables([one, two], spark.createDataFrame([("BBBB",)], "seq string"))
    assert sorted((r.sequence, r.header) for r in merged.collect()) == [("AAAA", "y"), ("AAAA", "z"), ("CCCC", "y")]
    assert gvf.merge_tables([one.limit(0)]).count() == 0


def test_names_of_files():
    text.check_format("/a/b.vcf.gz", [".vcf", ".vcf.gz"])
    with pytest.raises(ValueError, match="must end"):
        text.check_format("/a/b.txt", [".gtf"])
