"""How often every distinct value occurs, and in how many records.

Vertical layout: per term a compressed bitmap of the identifiers of the records that hold it, cut into containers of
65,536 consecutive identifiers. A container holds sorted 16-bit positions while it is sparse and a bit field when it
is dense. Each task builds containers with occurrence counters beside them, containers of the same (term, range) are
merged by union, and the document frequency is the sum of their cardinalities. Because a container has at most 8 KB,
a term that a third of all records hold is spread over its ranges, not gathered in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Containers with more records than this are bit fields of 8 KB, others arrays of two bytes a record.
DENSE = 4096
#: A task hands its containers on when it holds this many.
FLUSH = 200_000

_CONTAINER = "field_name string, term string, high bigint, n_occurrences bigint, container binary"
_ARROW = pa.schema(
    [("field_name", pa.string()), ("term", pa.string()), ("high", pa.int64()), ("n_occurrences", pa.int64()), ("container", pa.binary())]
)
_MERGED = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_records", pa.int64())])


def pack(low: np.ndarray) -> bytes:
    """A container of sorted distinct 16-bit positions."""
    if len(low) <= DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return b"\x01" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    if len(container) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little")).astype(np.uint16)
    return np.frombuffer(container, "<u2")


def union(containers: list[bytes]) -> bytes:
    if len(containers) == 1:
        return containers[0]
    if any(len(c) % 2 for c in containers):
        bits = np.zeros(65536, np.uint8)
        for c in containers:
            bits[unpack(c)] = 1
        return pack(np.flatnonzero(bits))
    return pack(np.unique(np.concatenate([unpack(c) for c in containers])))


def cardinality(container: bytes) -> int:
    if len(container) % 2:
        return int(np.unpackbits(np.frombuffer(container, np.uint8, offset=1)).sum())
    return len(container) // 2


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of each batch; batches are joined until they make ``FLUSH`` of rows, to write fewer, fuller ones."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FLUSH:
            yield from _containers(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from _containers(pa.Table.from_batches(held))


def _containers(table: pa.Table) -> Iterator[pa.RecordBatch]:
    fields = table.column("field_name").combine_chunks().dictionary_encode()
    terms = table.column("term").combine_chunks().dictionary_encode()
    known = table.column("record_id").is_valid().to_numpy(zero_copy_only=False)
    ids = table.column("record_id").fill_null(0).to_numpy()
    key = fields.indices.to_numpy().astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
    high = np.where(known, ids >> 16, 0)
    low = np.where(known, ids & 0xFFFF, -1)  # a row without identifier counts as occurrence only
    order = np.lexsort((low, high, key))
    key, high, low = key[order], high[order], low[order]
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (high[1:] != high[:-1])])
    counts = np.diff(np.r_[starts, len(key)])
    fresh = np.r_[True, (low[1:] != low[:-1]) | (key[1:] != key[:-1]) | (high[1:] != high[:-1])] & (low >= 0)
    lows = low.astype(np.uint16)
    packed = [pack(lows[a : a + n][fresh[a : a + n]]) for a, n in zip(starts, counts, strict=True)]
    f, t = np.divmod(key[starts], len(terms.dictionary))
    out = pa.table(
        [fields.dictionary.take(pa.array(f)), terms.dictionary.take(pa.array(t)), pa.array(high[starts]), pa.array(counts), pa.array(packed, pa.binary())],
        schema=_ARROW,
    )
    yield from out.to_batches()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of containers that are sorted by (field, term, range); one row per run of equal keys."""
    key, held, occurrences = None, [], 0
    for batch in batches:
        out: list[tuple] = []
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for f, t, h, n, c in zip(*cols, strict=True):
            if (f, t, h) != key:
                if key is not None:
                    out.append((key[0], key[1], occurrences, cardinality(union(held))))
                key, held, occurrences = (f, t, h), [], 0
            held.append(c)
            occurrences += n
            if len(held) >= 64:
                held = [union(held)]
        yield _rows(out)
    if key is not None:
        yield _rows([(key[0], key[1], occurrences, cardinality(union(held)))])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MERGED, strict=True)], schema=_MERGED)


def clean_value(value: Column) -> Column:
    """Without white space around; null for `.` and the empty string, which are no values."""
    v = F.regexp_replace(value, r"\A\s+|\s+\z", "")
    return F.when(~v.isin("", "."), v)


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(field_name, term, n_occurrences, n_records) of a table of (field_name, record_id, term).

    A record that holds a term twice adds two occurrences and one record. A null term is no value; a row whose
    record_id is null adds an occurrence but no record. An empty table gives no rows.
    """
    rows = terms.where(F.col("term").isNotNull()).select("field_name", F.col("record_id").cast("bigint").alias("record_id"), "term")
    keys = ("field_name", "term", "high")
    containers = rows.mapInArrow(_build, _CONTAINER).repartition(*keys).sortWithinPartitions(*keys)
    merged = containers.mapInArrow(_merge, "field_name string, term string, n_occurrences bigint, n_records bigint")
    return merged.groupBy("field_name", "term").agg(
        F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records")
    )


def marked(frequencies: DataFrame, totals: DataFrame, rare: int = 3, common: int = 5) -> DataFrame:
    """``frequencies`` with a mark: `rare` for at most ``rare`` records, `common` for more than 1/``common`` of all rows.

    ``totals`` has one row (field_name, n_rows) per field, so its broadcast is bounded by the number of fields.
    A term that is both is `common`: it can only happen in a table of fewer than ``rare * common`` rows.
    """
    is_common = F.col("n_records") * common > F.col("n_rows")
    mark = F.when(is_common, "common").when(F.col("n_records") <= rare, "rare")
    return frequencies.join(F.broadcast(totals), "field_name").select(
        "field_name", "term", "n_occurrences", "n_records", mark.alias("mark")
    )
