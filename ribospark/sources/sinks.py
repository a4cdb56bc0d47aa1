"""Writers. Each task writes its own part; where a file has an order, the names of its parts follow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.sources import gvf


def fasta_record(header: Column, seq: Column, width: int = 60) -> Column:
    """One FASTA record, the sequence wrapped."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, F.lit(f"(.{{{width}}})(?!$)"), F.lit("$1\n")))


def write_fasta(pool: DataFrame, path: str, mode: str = "errorifexists", header: str = "header") -> None:
    pool.select(fasta_record(F.col(header), F.col("seq")).alias("value")).write.mode(mode).text(path)


def write_split(databases: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of FASTA parts per database, `database=<key>`."""
    record = fasta_record(F.col("header"), F.col("seq")).alias("value")
    databases.select("database", record).write.mode(mode).partitionBy("database").text(path)


def with_head(rows: DataFrame, lines: Sequence[str]) -> DataFrame:
    """(value): head lines, then rows (value) in their order. For files that must be read by others as one."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    return head.unionByName(rows)


def write_ordered(head: Sequence[str], rows: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """Head lines and rows (value, …) sorted by the columns ``order``, in parts whose names follow that order.

    The head sorts first; rows are range-partitioned, so no task holds more than a part of them.
    """
    spark = rows.sparkSession
    first = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "__at int, value string")
    keyed = rows.select(F.lit(None).cast("int").alias("__at"), "value", *order)
    every = first.unionByName(keyed, allowMissingColumns=True)
    every.orderBy(F.col("__at").asc_nulls_last(), *order).select("value").write.mode(mode).text(path)


def write_gvf(variants: DataFrame, path: str, values: dict[str, str], order: Sequence[str] = ("gene_id", "start", "end", "alt", "type"), mode: str = "errorifexists") -> None:
    """Variants sorted by ``order`` under a head that describes the attributes that occur (found by one aggregation)."""
    keys = [r.k for r in variants.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().orderBy("k").collect()]
    lines = gvf.metadata_lines(values, [k for k in gvf.ATTR_ORDER if k in keys] + [k for k in keys if k not in gvf.ATTR_ORDER])
    write_ordered(lines, variants.select(*order, gvf.variant_line().alias("value")), path, order, mode)


def write_circles(circles: DataFrame, path: str, values: dict[str, str], order: Sequence[str] = ("gene_id", "start", "id"), mode: str = "errorifexists") -> None:
    keys = ("OFFSET", "LENGTH", "INTRON", "TRANSCRIPT_ID", "GENE_SYMBOL", "GENOMIC_POSITION")
    write_ordered(gvf.metadata_lines(values, keys), circles.select(*order, gvf.circle_line().alias("value")), path, order, mode)


def gtf_lines(rows: DataFrame) -> DataFrame:
    """(value) of ``sources.text.gtf`` rows, positions from 1, attributes unquoted."""
    names = ("gene_id", "transcript_id", "protein_id", "gene_name", "gene_type", "gene_biotype", "is_protein_coding")
    attrs = F.concat_ws(
        "; ",
        *(F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n} "), F.col(n))) for n in names),
        F.array_join(F.transform("tags", lambda t: F.concat(F.lit("tag "), t)), "; "),
    )
    strand = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").when(F.col("strand") == 0, "?").otherwise(".")
    line = F.concat_ws(
        "\t", "seqname", F.coalesce("source", F.lit(".")), "feature", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."),
        strand, F.coalesce(F.col("frame").cast("string"), F.lit(".")), F.regexp_replace(attrs, "(; )+$", ""),
    )
    return rows.select(line.alias("value"))


def write_gtf(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    gtf_lines(rows.orderBy("pos")).write.mode(mode).text(path)


def peptide_table_lines(rows: DataFrame) -> DataFrame:
    """(value) of peptide table rows; null is `.`."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in gvf.TABLE)).alias("value"))
