"""Variant files as they arrive: a stream of records without repeats, and peptide units to be called again.

Files are finite and read once, so the sensible trigger is availableNow. Repeats are dropped by the key of a record
within a watermark on the time it is read, which bounds the state, and those that come later by the written table.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ribospark.sources.gvf import parse_info, small_type

KEY = ("tx_id", "gene_id", "start", "end", "ref", "alt", "type")


def arriving(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Variant records of the files that appear in a folder, with the time each file came."""
    # by default the source ignores files that are a week older than the latest one
    source = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d")
    lines = source.load(folder).select(
        "value", F.col("_metadata.file_modification_time").alias("arrived")
    )
    f = F.split(F.regexp_replace("value", r"\s+\z", ""), "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 8)).select("arrived", f.alias("f"))
    at = [F.get("f", F.lit(i)) for i in range(8)]
    attrs, start = parse_info(at[7]), at[1].cast("int") - 1
    symbolic = at[4].startswith("<")
    kind = F.when(~symbolic, small_type(at[3], at[4])).otherwise(
        F.element_at(F.create_map(*(F.lit(x) for p in (("<FUSION>", "Fusion"), ("<DEL>", "Deletion"), ("<INS>", "Insertion"), ("<SUB>", "Substitution")) for x in p)), at[4])
    )
    end = F.when(~symbolic, start + F.length(at[3])).when(at[4].isin("<DEL>", "<SUB>"), attrs["END"].cast("int")).otherwise(start + 1)
    return rows.select(
        "arrived", at[0].alias("gene_id"), start.alias("start"), end.alias("end"), at[3].alias("ref"), at[4].alias("alt"), kind.alias("type"),
        at[2].alias("id"), attrs["TRANSCRIPT_ID"].alias("tx_id"), attrs.alias("attrs"),
    )


def without_repeats(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Records whose key wasn't read before, as far back as the watermark reaches; later repeats come through again.

    The watermark is on the time of reading, so that files with an old modification time aren't taken for late.
    """
    read = records.withColumn("read_at", F.current_timestamp()).withWatermark("read_at", late)
    return read.dropDuplicatesWithinWatermark(list(KEY)).drop("read_at")


def _unwritten(df: DataFrame, path: str, batch: str) -> DataFrame:
    """One record of each key of ``df`` that no other batch of the table at ``path`` holds."""
    df = df.dropDuplicates(list(KEY))
    try:
        held = df.sparkSession.read.parquet(path).where(F.col("batch") != batch).select(*(F.col(k).alias(f"held_{k}") for k in KEY))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return df
    same = [df[k].eqNullSafe(held[f"held_{k}"]) for k in KEY]
    return df.join(held, same, "left_anti")


def ingest(records: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Adds what arrived and isn't written yet to Parquet, batch by batch; ``after`` gets each batch's transcripts, whose peptides have changed.

    A batch has a folder of its own, named by the stream and its number, which it overwrites: one that is tried again
    after a failure leaves what it would have left the first time.
    """
    stream = f"{crc32(checkpoint.encode()):08x}"

    def batch(df: DataFrame, epoch: int) -> None:
        name = f"{stream}-{epoch}"
        df = df.persist()
        try:
            _unwritten(df, path, name).write.mode("overwrite").parquet(f"{path}/batch={name}")
            if after is not None:
                after(df.select("tx_id").distinct())
        finally:
            df.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
