"""Arriving variant files: repeats are dropped, and a second run reads only what is new."""

import os
import time

from ribospark.streaming import variants

LINE = "G1\t{p}\tSNV-{p}-A-T\tA\tT\t.\t.\tTRANSCRIPT_ID=T{p};GENE_SYMBOL=X\n"


def test_files_arrive(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.gvf").write_text("##head\n#CHROM\n" + LINE.format(p=5) + LINE.format(p=6))
    (inbox / "b.gvf").write_text(LINE.format(p=6) + LINE.format(p=7))
    seen = []

    def run():
        rows = variants.without_repeats(variants.arriving(spark, str(inbox)))
        variants.ingest(rows, out, state, lambda t: seen.extend(r.tx_id for r in t.collect())).awaitTermination()

    run()
    assert sorted(r.start for r in spark.read.parquet(out).collect()) == [4, 5, 6]
    (inbox / "c.gvf").write_text(LINE.format(p=7) + LINE.format(p=9))
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.start for r in rows) == [4, 5, 6, 8]
    assert {r.type for r in rows} == {"SNV"} and set(seen) == {"T5", "T6", "T7", "T9"}


def test_files_with_an_old_time(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def run(name, state, days, *places):
        (inbox / name).write_text("".join(LINE.format(p=p) for p in places))
        then = time.time() - days * 86_400
        os.utime(inbox / name, (then, then))
        variants.ingest(variants.without_repeats(variants.arriving(spark, str(inbox))), out, state).awaitTermination()
        return sorted(r.start for r in spark.read.parquet(out).collect())

    assert run("a.gvf", state, 0, 5) == [4]
    assert run("b.gvf", state, 0, 6) == [4, 5]
    assert run("c.gvf", state, 30, 5, 7) == [4, 5, 6]
    # a second stream knows only the written table
    assert run("d.gvf", str(tmp_path / "other"), 0, 7, 8) == [4, 5, 6, 7]


def test_a_batch_that_is_tried_again(spark, tmp_path):
    """A batch written twice, as after a failure, leaves its records once."""
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.gvf").write_text(LINE.format(p=5) + LINE.format(p=6))
    failed = []

    def once(txs):
        if not failed:
            failed.append(txs.count())
            raise RuntimeError("the first time")

    for _ in range(2):
        query = variants.ingest(variants.without_repeats(variants.arriving(spark, str(inbox))), out, state, once)
        try:
            query.awaitTermination()
        except Exception as error:
            assert "the first time" in str(error)
    assert failed == [2] and sorted(r.start for r in spark.read.parquet(out).collect()) == [4, 5]
