"""References to records that don't exist: composite keys with partial nulls, and keys with life spans.

References are grouped by their null mask: which key columns are present. The references of each mask are anti-joined
with the targets on that mask's columns alone, by plain equality; which targets they may match is a matter of semantics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.session import is_small

#: simple: a key with any null is satisfied. full: the same, but a partly null key is an orphan.
#: partial: the non-null columns must match some target. exact: null matches only null.
SEMANTICS = ("simple", "partial", "full", "exact")


def _has(columns: Sequence[str], mask: Sequence[bool]) -> Column:
    """Whether exactly the columns of a mask aren't null."""
    return reduce(and_, (F.col(c).isNotNull() if present else F.col(c).isNull() for c, present in zip(columns, mask, strict=True)))


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    key: Sequence[str],
    semantics: str = "simple",
    at: str | None = None,
    span: tuple[str, str] | None = None,
) -> DataFrame:
    """The rows of ``references`` whose key (columns ``key`` of both sides) no row of ``targets`` holds.

    With ``at`` and ``span = (added, retired)`` a target counts only if added <= at < retired (null retired: for
    ever); a null ``at`` lies in no span. A wholly null key is no reference and never an orphan. Repeated targets
    and repeated references are allowed; the columns of ``references`` come out unchanged.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    key, names = list(key), [f"__t{i}" for i in range(len(key))]
    spans = [F.col(c).alias(n) for c, n in zip(span or (), ("__added", "__retired"), strict=False)]
    ends = ["__added", "__retired"][: len(spans)]
    keys = targets.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), *spans).distinct()
    small = is_small(keys)
    found = []
    for mask in product((True, False), repeat=len(key)):
        of_mask = references.where(_has(key, mask))
        if not any(mask) or (semantics == "simple" and not all(mask)):
            continue  # no reference, or one that counts as satisfied
        if semantics == "full" and not all(mask):
            found.append(of_mask)
            continue
        own = [n for n, present in zip(names, mask, strict=True) if present]
        fitting = keys.where(_has(names, mask)) if semantics == "exact" else keys.where(_has(own, [True] * len(own)))
        # fewer columns than the whole key make repeats
        fitting = fitting.select(*own, *ends) if len(own) == len(key) or semantics == "exact" else fitting.select(*own, *ends).distinct()
        on = reduce(and_, (of_mask[c] == fitting[n] for c, n, present in zip(key, names, mask, strict=True) if present))
        if span:
            on = on & (fitting["__added"] <= of_mask[at]) & (fitting["__retired"].isNull() | (of_mask[at] < fitting["__retired"]))
        found.append(of_mask.join(F.broadcast(fitting) if small else fitting, on, "left_anti"))
    return reduce(DataFrame.unionByName, found)


def last_part(value: Column) -> Column:
    """The key inside a reference written `symbol^id`: the part after the last `^`, trimmed and in upper case."""
    return F.upper(F.trim(F.regexp_replace(F.substring_index(value, "^", -1), r"\A\s+|\s+\z", "")))


def reference_rows(df: DataFrame, table_name: str, fields: dict[str, str], id_column: str = "record_id", at: str = "called_at") -> DataFrame:
    """(table_name, record_id, field_name, kind, base, version, at): one row per reference of a record table.

    ``fields`` maps a field to the kind of record it names. The key is taken apart into its base and its version
    (null if the id has none). Null, empty, `-` and `.` are no references. Kind and base are never null, which Catalyst
    knows: it reads nothing for the masks without them.
    """
    entries = F.array(
        *(F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), last_part(F.col(f)).alias("key")) for f, k in fields.items())
    )
    rows = df.select(F.col(id_column).alias("record_id"), F.col(at).alias("at"), F.explode(entries).alias("r"))
    key = F.col("r.key")
    return rows.where(key.isNotNull() & ~key.isin("", "-", ".")).select(
        F.lit(table_name).alias("table_name"), "record_id", "r.field_name", "r.kind", *_versioned(key), "at"
    )


def target_rows(df: DataFrame, kind: str, id_column: str) -> DataFrame:
    """(kind, base, version, added_at, retired_at) of a table of life spans."""
    return df.select(F.lit(kind).alias("kind"), *_versioned(F.upper(F.trim(F.col(id_column)))), "added_at", "retired_at")


def _versioned(key: Column) -> tuple[Column, Column]:
    dot = F.length(key) - F.length(F.substring_index(key, ".", -1))
    base = F.when(key.contains("."), F.substring(key, F.lit(1), dot - 1)).otherwise(key)
    return F.coalesce(base, F.lit("")).alias("base"), F.when(key.contains("."), F.substring_index(key, ".", -1)).alias("version")


def orphans(references: DataFrame, targets: DataFrame) -> DataFrame:
    """Orphans among ``reference_rows`` against ``target_rows``: a null version matches only a null version."""
    return orphan_references(references, targets, ["kind", "base", "version"], "exact", at="at", span=("added_at", "retired_at"))


def orphan_report(found: DataFrame, period: str = "month") -> DataFrame:
    """(table_name, field_name, period, n_orphans, n_keys): orphans per table, field and period of the reference."""
    return found.groupBy("table_name", "field_name", F.date_trunc(period, "at").cast("date").alias("period")).agg(
        F.count(F.lit(1)).alias("n_orphans"),
        F.countDistinct(F.concat_ws(".", "base", "version")).alias("n_keys"),
    )
