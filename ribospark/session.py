"""Session helpers shared by every operator: tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it holds at most this many rows and bytes; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine. On a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ribospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over as many partitions as the session has cores, for work that outweighs a shuffle of its input.

    Files of few row groups keep most cores idle. A scan of that many partitions stays as it is, and so does what has
    been shuffled already; on a large table nothing is moved.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= n:
        return df
    return df.repartition(n)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that losing an executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Only a local-mode session without that setting, as in tests,
    gets a folder of its own; a cluster without it is refused, since a machine-local folder would not survive.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ribospark-"))
    return df.checkpoint()


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and, written out as JSON, bytes. No more than ``max_rows + 1`` rows are read."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(row)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it ``is_small``, else as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
