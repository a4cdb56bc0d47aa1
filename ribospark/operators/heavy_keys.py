"""Per-key results where a handful of keys hold most rows.

Rows are range-partitioned by (key, secondary order) with sampled quantiles, so a heavy key is spread over as many
partitions as its share asks for. Each partition folds its sorted rows into one partial state per key; the states of
a key that crosses partition boundaries are stitched in order. Only states are exchanged after the first shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMS = ("n_dispatches", "n_variants", "n_fusions", "n_circ", "n_succeeded", "elapsed_us")
_STATE = "tx_id string, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", first_us bigint, last_us bigint, gap_us bigint"


def clean_key(key: Column) -> Column:
    """Trimmed and in upper case; null for an absent key (null, empty or `-`)."""
    trimmed = F.upper(F.regexp_replace(key, r"\A\s+|\s+\z", ""))
    return F.when(~trimmed.isin("", "-"), trimmed)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One state per run of equal keys; the last run of a batch is carried into the next."""
    carry: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["tx_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out = {"tx_id": key[starts]}
        for c in _SUMS:
            out[c] = np.add.reduceat(pdf[c].to_numpy(np.int64), starts)
        at = pdf["at_us"]  # sorted within a run, nulls first
        seen = at.notna().to_numpy()
        us = at.fillna(0).to_numpy(np.int64)
        big = np.iinfo(np.int64)
        first = np.minimum.reduceat(np.where(seen, us, big.max), starts)
        last = np.maximum.reduceat(np.where(seen, us, big.min), starts)
        step = np.zeros(len(us), np.int64)
        step[1:] = np.where(seen[1:] & seen[:-1], us[1:] - us[:-1], 0)
        step[starts] = 0
        states = pd.DataFrame(out)
        states["gap_us"] = np.maximum.reduceat(step, starts)
        empty = first == big.max
        states["first_us"] = pd.array(first, "Int64")
        states["last_us"] = pd.array(last, "Int64")
        states.loc[empty, ["first_us", "last_us"]] = pd.NA
        if carry is not None:
            if carry["tx_id"].iloc[0] == states["tx_id"].iloc[0]:
                states = _joined(carry, states)
            else:
                yield carry
        if len(states) > 1:
            yield states.iloc[:-1]
        carry = states.iloc[-1:]
    if carry is not None:
        yield carry


def _joined(carry: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    states = states.copy()
    a, b, i = carry.iloc[0], states.iloc[0], states.index[0]
    for c in _SUMS:
        states.loc[i, c] = a[c] + b[c]
    between = 0 if pd.isna(a["last_us"]) or pd.isna(b["first_us"]) else b["first_us"] - a["last_us"]
    states.loc[i, "gap_us"] = max(a["gap_us"], b["gap_us"], between)
    if not pd.isna(a["first_us"]):
        states.loc[i, "first_us"] = a["first_us"]
    if pd.isna(b["last_us"]) and not pd.isna(a["last_us"]):
        states.loc[i, "last_us"] = a["last_us"]
    return states


def boundary_states(dispatches: DataFrame) -> DataFrame:
    """One partial state per (key, partition it lies in) of the range-partitioned dispatches."""

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)

    rows = (
        dispatches.withColumn("tx_id", clean_key(F.col("tx_id")))
        .where(F.col("tx_id").isNotNull())
        .select(
            "tx_id",
            F.unix_micros(F.col("dispatched_at").cast("timestamp")).alias("at_us"),
            "dispatch_id",
            F.lit(1).cast("bigint").alias("n_dispatches"),
            whole("n_variants"),
            whole("n_fusions"),
            whole("n_circ"),
            F.coalesce(F.col("succeeded").cast("bigint"), F.lit(0)).alias("n_succeeded"),
            F.coalesce(F.round(F.col("elapsed_ms") * 1000).cast("bigint"), F.lit(0)).alias("elapsed_us"),
        )
    )
    order = ("tx_id", "at_us", "dispatch_id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("dispatch_id").mapInPandas(_fold, _STATE)


def per_key(dispatches: DataFrame) -> DataFrame:
    """Per tx_id (trimmed, upper case): counts, sums, first and last dispatch and the longest gap between two in a row.

    Absent keys (null, empty, `-`) have no row; a null number counts as 0, a null dispatched_at takes part in no gap;
    a key without any time has null first_at, last_at and a gap of 0. An empty table gives no rows.
    """
    states = boundary_states(dispatches)
    pieces = F.array_sort(
        F.filter(F.collect_list(F.struct("first_us", "last_us", "gap_us")), lambda s: s["first_us"].isNotNull())
    )
    stitched = F.aggregate(
        "pieces",
        F.struct(F.lit(None).cast("bigint").alias("last_us"), F.lit(0).cast("bigint").alias("gap_us")),
        lambda a, s: F.struct(
            s["last_us"].alias("last_us"),
            F.greatest(a["gap_us"], s["gap_us"], F.coalesce(s["first_us"] - a["last_us"], F.lit(0))).alias("gap_us"),
        ),
    )
    return (
        states.groupBy("tx_id")
        .agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), pieces.alias("pieces"))
        .select(
            "tx_id",
            "n_dispatches",
            F.col("n_variants").alias("sum_variants"),
            F.col("n_fusions").alias("sum_fusions"),
            F.col("n_circ").alias("sum_circ"),
            "n_succeeded",
            (F.col("elapsed_us") / 1000).alias("sum_elapsed_ms"),
            F.timestamp_micros("first_us").cast("timestamp_ntz").alias("first_at"),
            F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_at"),
            stitched["gap_us"].alias("longest_gap_us"),
        )
    )


def heavy_keys(dispatches: DataFrame, share: float = 0.01) -> DataFrame:
    """Rows of ``per_key`` with more than ``share`` of all rows of ``dispatches``, absent keys counted in all rows."""
    total = dispatches.select(F.count(F.lit(1)).alias("n")).scalar()
    return per_key(dispatches).where(F.col("n_dispatches") * 1_000_000 > total * round(share * 1_000_000))
