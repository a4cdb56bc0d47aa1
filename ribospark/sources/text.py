"""Sequence and annotation files as DataFrames: FASTA, GTF, expression tables and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attributes of a GTF line that are kept; `tag` may occur more than once.
GTF_ATTRIBUTES = ("gene_id", "transcript_id", "protein_id", "gene_name", "gene_type", "gene_biotype", "is_protein_coding")


def read_lines(spark: SparkSession, source: str | Sequence[str] | DataFrame, line_sep: str | None = None) -> DataFrame:
    """(value, pos): the lines of text files and their order. A DataFrame (value[, pos]) stands for lines that are at hand already."""
    if isinstance(source, DataFrame):
        return source if "pos" in source.columns else source.withColumn("pos", F.monotonically_increasing_id())
    text = spark.read.text(source if isinstance(source, str) else list(source), lineSep=line_sep)
    return text.select("value", F.monotonically_increasing_id().alias("pos"))


def fasta(spark: SparkSession, path: str | Sequence[str] | DataFrame) -> DataFrame:
    """(description, seq): one row per record, line breaks removed. An empty file gives no rows. A DataFrame has records."""
    records = read_lines(spark, path, "\n>")
    text = F.regexp_replace("value", r"\A>|\r", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(text.contains("\n"), F.substring(text, F.length(head) + 2, F.length(text))).otherwise("")
    return records.select(F.trim(head).alias("description"), F.regexp_replace(body, r"\s+", "").alias("seq")).where(
        (F.col("description") != "") | (F.col("seq") != "")
    )


def genome(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, seq): the name runs to the first blank, then to the first bar."""
    name = F.substring_index(F.substring_index("description", " ", 1), "|", 1)
    return fasta(spark, path).select(name.alias("seqname"), F.upper("seq").alias("seq"))


def check_format(path: str, suffixes: Sequence[str]) -> None:
    """An error unless a path has one of the suffixes, compressed or not, such as `.gtf` or `.vcf.gz`."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not any(name.endswith(s) for s in suffixes):
        raise ValueError(f"{path} must end in one of {', '.join(suffixes)}")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, which a reference must not have."""
    return df.groupBy(key).count().where("count > 1")


def _gencode_ids(d: Column) -> Column:
    parts = F.split(d, r"\|")
    return F.when(
        F.size(parts) >= 3,
        F.struct(F.get(parts, F.lit(0)).alias("protein_id"), F.get(parts, F.lit(1)).alias("transcript_id"), F.get(parts, F.lit(2)).alias("gene_id")),
    )


def _ensembl_ids(d: Column) -> Column:
    """Ids of an ENSEMBL header, without their versions."""

    def field(name: str) -> Column:
        return F.substring_index(F.regexp_extract(d, rf"\b{name}:(\S+)", 1), ".", 1)

    return F.when(
        d.rlike(r"\A\S+ pep .*\bgene:\S+.*\btranscript:\S+"),
        F.struct(
            F.substring_index(F.substring_index(d, " ", 1), ".", 1).alias("protein_id"),
            field("transcript").alias("transcript_id"),
            field("gene").alias("gene_id"),
        ),
    )


def header_style(proteins: DataFrame, sample: int = 101) -> str:
    """GENCODE or ENSEMBL, by a vote of the first records; the choice then holds for the whole file."""
    votes = proteins.limit(sample).select(
        F.when(_ensembl_ids(F.col("description")).isNotNull(), "ENSEMBL").when(_gencode_ids(F.col("description")).isNotNull(), "GENCODE").alias("style")
    )
    row = votes.where("style is not null").groupBy("style").count().orderBy(F.desc("count"), "style").first()
    return row.style if row else "GENCODE"


def proteome(spark: SparkSession, path: str, style: str | None = None) -> DataFrame:
    """(protein_id, transcript_id, gene_id, seq)."""
    records = fasta(spark, path)
    style = style or header_style(records)
    ids = _ensembl_ids(F.col("description")) if style == "ENSEMBL" else _gencode_ids(F.col("description"))
    return records.select(ids.alias("ids"), "seq").where("ids is not null").select("ids.*", "seq")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: seqname, source, feature, start (from 0), end, strand, frame, the kept attributes and tags.

    ``pos`` is the place of the line in the file, which ranks genes and transcripts.
    """
    lines = read_lines(spark, path)
    f = F.split(F.regexp_replace("value", r"\s+\z", ""), "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 9)).select("pos", f.alias("f"))
    field = [F.get("f", F.lit(i)) for i in range(9)]

    def attribute(name: str) -> Column:
        value = F.regexp_extract(field[8], rf'(?:\A|;)\s*{name} "?([^";]*)"?', 1)
        return F.when(value != "", value).alias(name)

    tags = F.regexp_extract_all(field[8], F.lit(r'(?:\A|;)\s*tag "?([^";]*)"?'), F.lit(1))
    strand = F.when(field[6] == "+", 1).when(field[6] == "-", -1).when(field[6] == "?", 0)
    return rows.select(
        "pos",
        field[0].alias("seqname"),
        field[1].alias("source"),
        field[2].alias("feature"),
        (field[3].cast("int") - 1).alias("start"),
        field[4].cast("int").alias("end"),
        strand.alias("strand"),
        field[7].try_cast("int").alias("frame"),
        *(attribute(a) for a in GTF_ATTRIBUTES),
        tags.alias("tags"),
    )


def annotation_source(rows: DataFrame, sample: int = 101) -> str:
    """GENCODE or ENSEMBL, by a vote on the contig names of the first lines."""
    name = F.col("seqname")
    style = F.when(name.rlike(r"\Achr([0-9]+|[XYM])\z"), "GENCODE").when(name.rlike(r"\A([0-9]+|[XY]|MT)\z"), "ENSEMBL")
    votes = rows.limit(sample).select(style.alias("style")).where("style is not null")
    row = votes.groupBy("style").count().orderBy(F.desc("count"), "style").first()
    return row.style if row else "GENCODE"


def expression(spark: SparkSession, path: str, tx_col: str | int, quant_col: str | int, sep: str = "\t", skip: int = 0, header: bool = True) -> DataFrame:
    """(tx_id, quant): columns by name, or by number from 1. Of a repeated transcript the last line counts."""
    lines = read_lines(spark, path)
    rows = lines.where(F.trim("value") != "").select(F.split(F.regexp_replace("value", r"\r\z", ""), f"\\Q{sep}\\E").alias("f"), "pos")
    start = skip + (1 if header else 0)
    first = rows.orderBy("pos").limit(start).collect()
    names = first[-1].f if header and first else []

    def column(c: str | int) -> Column:
        return F.get("f", F.lit(names.index(c) if isinstance(c, str) else c - 1))

    last = first[-1].pos if first else -1
    return rows.where(F.col("pos") > last).groupBy(column(tx_col).alias("tx_id")).agg(
        F.max_by(column(quant_col).try_cast("double"), "pos").alias("quant")
    )


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): one per line, blank lines left out."""
    return read_lines(spark, path).select(F.trim("value").alias("name")).where("name != ''")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha512) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 512).alias("sha512"))
