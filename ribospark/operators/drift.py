"""Schemas that drift from file to file: one consistent table and the ordered list of changes.

The schema of every file (header names, and per column the highest type of its values in the lattice
none < integer < decimal < text) is read in parallel by one partial aggregation. What is then folded, in the order
of delivery within a stream, is one row per file: a streaming pass whose state is the last schema only. The renames of
all streams link names to one another, so that a column has one name in the union schema whatever a stream calls it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribospark.operators.rejects import split_fields
from ribospark.session import checkpointed

#: The type lattice in order; the promotion of two types is the later one.
LATTICE = ("none", "integer", "decimal", "text")
NONE, TEXT = 0, 3
SPARK_TYPES = {"none": "string", "integer": "bigint", "decimal": "double", "text": "string"}

#: More distinct columns than this in the union schema are refused rather than collected; so are more pairs of names.
MAX_COLUMNS, MAX_PAIRS = 5_000, 1_000_000

_FOLDED = (
    "file_id string, stream_id string, tool string, seq int, "
    "columns array<struct<pos:int,name:string,base:string,line:int,rank:int>>, "
    "changes array<struct<field_name:string,change_kind:string,old_name:string,old_type:string,new_type:string>>"
)


def value_rank(value: Column) -> Column:
    """Rank of one cell in the lattice; null, blank and NA are no values."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | v.isin("", "NA"), NONE)
        .when(v.rlike(r"\A[+-]?[0-9]+\z"), 1)
        .when(v.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), 2)
        .otherwise(TEXT)
    )


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def header_names(line: Column) -> Column:
    """Names of a header line, without the leading `#` and the blanks around each."""
    names = F.split(F.regexp_replace(_bare(line), r"\A\s*#", ""), "\t")
    return F.transform(names, lambda n: F.regexp_replace(n, r"\A[\s#]+|\s+\z", ""))


def file_schemas(lines: DataFrame) -> DataFrame:
    """(file_id, stream_id, tool, delivered_at, names, ranks): the schema of each file; a file of a header only has ranks 0."""
    keyed = lines.select("file_id", "line_no", _bare(F.col("line")).alias("line")).where(F.col("line").isNotNull())
    cells = keyed.where((F.col("line_no") > 1) & (F.trim("line") != "")).select(
        "file_id", F.posexplode(split_fields(F.col("line"))).alias("pos", "value")
    )
    ranks = (
        cells.groupBy("file_id", "pos")
        .agg(F.max(value_rank(F.col("value"))).alias("rank"))
        .where(F.col("rank") > NONE)
        .groupBy("file_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("by_pos"))
    )
    heads = lines.where((F.col("line_no") == 1) & F.col("line").isNotNull()).select(
        "file_id", "stream_id", "tool", "delivered_at", header_names(F.col("line")).alias("names")
    ).dropDuplicates(["file_id"])
    rank = F.transform("names", lambda _, i: F.coalesce(F.try_element_at("by_pos", i), F.lit(NONE)))
    return heads.join(ranks, "file_id", "left").select(
        "file_id", "stream_id", "tool", "delivered_at", "names", rank.alias("ranks")
    )


@dataclass
class Schema:
    """Keys (name, occurrence) in file order, with what has been learnt of each column.

    A column's line is its number within the stream, which it keeps through renames; its base is the name it began with.
    """

    keys: list[tuple[str, int]] = field(default_factory=list)
    rank: dict[tuple[str, int], int] = field(default_factory=dict)
    line: dict[tuple[str, int], tuple[int, str]] = field(default_factory=dict)
    lines: int = 0


def _keys(names: list[str]) -> list[tuple[str, int]]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append((n, seen[n]))
    return out


def _gaps(keys: list, shared: set) -> list[list]:
    """Keys that aren't shared, by the gap between shared ones they lie in."""
    out: list[list] = [[]]
    for k in keys:
        if k in shared:
            out.append([])
        else:
            out[-1].append(k)
    return out


def _numbered(schema: Schema) -> Schema:
    """Gives the columns that go on from none before them lines of their own."""
    for k in schema.keys:
        if k not in schema.line:
            schema.lines += 1
            schema.line[k] = (schema.lines, k[0])
    return schema


def fold(last: Schema | None, names: list[str], ranks: list[int]) -> tuple[Schema, list[tuple]]:
    """The schema after a file, and the file's changes (field_name, kind, old name, old type, new type) in column order."""
    keys = _keys(names)
    rank = dict(zip(keys, ranks, strict=False))
    new = Schema(keys, rank)
    if last is None:
        return _numbered(new), []
    new.lines = last.lines
    shared = set(last.keys) & set(keys)
    came_from = {k: k for k in shared}
    gone: list = [k for k in last.keys if k not in shared]
    if [k for k in last.keys if k in shared] == [k for k in keys if k in shared]:
        for old, cur in zip(_gaps(last.keys, shared), _gaps(keys, shared), strict=True):
            if len(old) == len(cur):
                for a, b in zip(old, cur, strict=True):
                    # a column without any value so far goes with either kind
                    known = NONE not in (last.rank[a], rank[b])
                    if not known or (last.rank[a] == TEXT) == (rank[b] == TEXT):
                        came_from[b] = a
                        gone.remove(a)
    changes = [(k[0], "removed", k[0], LATTICE[last.rank[k]], None) for k in gone]
    for k in keys:
        a = came_from.get(k)
        if a is None:
            changes.append((k[0], "added", None, None, LATTICE[rank[k]]))
            continue
        new.line[k] = last.line[a]
        before = last.rank[a]
        if rank[k] == NONE:
            new.rank[k] = before
        if a != k:
            changes.append((k[0], "renamed", a[0], LATTICE[before], LATTICE[new.rank[k]]))
        if NONE not in (before, rank[k]) and before != rank[k]:
            changes.append((k[0], "retyped", a[0], LATTICE[before], LATTICE[rank[k]]))
    return _numbered(new), changes


def _fold_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stream, last, seq = object(), None, 0
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.stream_id != stream:
                stream, last, seq = r.stream_id, None, 0
            seq += 1
            last, changes = fold(last, list(r.names), [int(x) for x in r.ranks])
            cols = [
                {"pos": i, "name": k[0], "base": last.line[k][1], "line": last.line[k][0], "rank": last.rank[k]}
                for i, k in enumerate(last.keys)
            ]
            named = ("field_name", "change_kind", "old_name", "old_type", "new_type")
            out.append((r.file_id, r.stream_id, r.tool, seq, cols, [dict(zip(named, c, strict=True)) for c in changes]))
        yield pd.DataFrame(out, columns=["file_id", "stream_id", "tool", "seq", "columns", "changes"])


def folded_schemas(lines: DataFrame) -> DataFrame:
    """One row per file in its stream's order: its columns with their lines and types, and its changes.

    ``lines`` needs file_id, stream_id, tool, delivered_at, line_no, line. Files delivered at the same time go by
    file_id. Repeated names in a header are told apart by occurrence. The first file of a stream has no changes.
    """
    schemas = file_schemas(lines).withColumn("stream_id", F.coalesce("stream_id", F.lit("")))
    ordered = schemas.repartition("stream_id").sortWithinPartitions("stream_id", "delivered_at", "file_id")
    return ordered.select("file_id", "stream_id", "tool", "names", "ranks").mapInPandas(_fold_streams, _FOLDED)


def schema_changes(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, file_id, field_name, change_kind, old_name, old_type, new_type): the ordered log of changes."""
    return (
        folded_schemas(lines)
        .select("stream_id", "seq", "file_id", F.explode("changes").alias("c"))
        .select("stream_id", "seq", "file_id", "c.*")
    )


def _bounded(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct {what}")
    return rows


def one_name(folded: DataFrame) -> dict[str, str]:
    """Name -> the name its column goes under, for the names that take part in renames.

    Renames link names, the most frequent first, unless a file has a column of either name or of what is linked to it
    already: such names can't be one column. A column goes under the name that most files give it.
    """
    renames = folded.select(F.explode("changes").alias("c")).where("c.change_kind = 'renamed'").groupBy("c.old_name", "c.field_name")
    edges = _bounded(renames.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "old_name", "field_name"), MAX_COLUMNS, "renames")
    linked = sorted({x for e in edges for x in (e.old_name, e.field_name)})
    if not linked:
        return {}
    own = F.array_sort(F.array_distinct(F.filter(F.transform("columns", lambda c: c["name"]), lambda n: n.isin(*linked))))
    named = folded.select(own.alias("names"))
    files = {r.name: r.n for r in _bounded(named.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")), MAX_COLUMNS, "names")}
    both = named.where(F.size("names") > 1).distinct().select(F.explode("names").alias("a"), "names").select("a", F.explode("names").alias("b"))
    together: dict[str, set[str]] = {n: {n} for n in linked}
    for r in _bounded(both.where("a < b").distinct(), MAX_PAIRS, "pairs of names"):
        together[r.a].add(r.b)
        together[r.b].add(r.a)
    group = {n: frozenset([n]) for n in linked}
    for e in edges:
        x, y = group[e.old_name], group[e.field_name]
        if x is not y and not any(together[n] & y for n in x):
            for n in x | y:
                group[n] = x | y
    return {n: min(g, key=lambda m: (-files.get(m, 0), m)) for n, g in group.items()}


def named_columns(folded: DataFrame, names: dict[str, str]) -> DataFrame:
    """(file_id, stream_id, pos, rank, name, number): the column of the union schema that each column of a file goes to.

    Columns of one name that stand side by side in some file of a stream are numbered there in the order they came.
    """
    name = F.col("c.base")
    if names:
        known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        name = F.coalesce(F.try_element_at(known, name), name)
    rows = folded.select("file_id", "stream_id", "seq", F.explode("columns").alias("c")).select(
        "file_id", "stream_id", "seq", "c.pos", "c.rank", "c.line", name.alias("name")
    )
    beside = rows.groupBy("stream_id", "file_id", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("stream_id", "name").agg(F.max("n").alias("n"))
    lines = rows.groupBy("stream_id", "name", "line").agg(F.min(F.struct("seq", "pos")).alias("came"))
    order = Window.partitionBy("stream_id", "name").orderBy("came")
    numbered = lines.withColumn("k", F.row_number().over(order)).join(beside, ["stream_id", "name"])
    numbered = numbered.select("stream_id", "name", "line", F.when(F.col("n") > 1, F.col("k")).otherwise(1).alias("number"))
    return rows.join(numbered, ["stream_id", "name", "line"]).select("file_id", "stream_id", "pos", "rank", "name", "number")


def union_schema(columns: DataFrame) -> list[tuple[str, int, str, str]]:
    """(name, number, column, type) of ``named_columns``, types promoted through the lattice, in the order of position.

    The column is the name, with a number from the second one of that name on, or where another differs by case only.
    At most ``MAX_COLUMNS`` are collected; more are an error, never dropped.
    """
    found = columns.groupBy("name", "number").agg(F.max("rank").alias("rank"), F.min("pos").alias("pos"))
    rows = _bounded(found.orderBy("pos", "name", "number"), MAX_COLUMNS, "columns")
    held, out = {*RESERVED}, {}
    for r in sorted(rows, key=lambda r: r.number):
        first = f"{r.name}_" if r.name.lower() in RESERVED else r.name
        name, number = (first, 1) if r.number == 1 else (f"{first}#{r.number}", r.number)
        while name.lower() in held:  # Spark's writers don't tell names by case
            number += 1
            name = f"{first}#{number}"
        held.add(name.lower())
        out[r.name, r.number] = name
    return [(r.name, r.number, out[r.name, r.number], LATTICE[r.rank]) for r in rows]


RESERVED = ("file_id", "stream_id", "tool", "line_no")


def unified_table(lines: DataFrame) -> DataFrame:
    """All data lines under the union schema: file_id, stream_id, tool, line_no and a column for each of ``union_schema``, cast.

    A column that streams or files name differently goes under one name (``one_name``); NA, blank and columns the file
    lacks are null. Columns of one name in one file, and those whose names differ by case only, each have their own.
    """
    folded = checkpointed(folded_schemas(lines))
    columns = checkpointed(named_columns(folded, one_name(folded)))
    schema = union_schema(columns)
    place = F.map_from_entries(F.collect_list(F.struct(F.struct("name", "number"), "pos")))
    places = columns.groupBy("file_id", "stream_id").agg(place.alias("place"))
    files = folded.select("file_id", "stream_id", "tool").join(places, ["file_id", "stream_id"])
    data = lines.select("file_id", "line_no", _bare(F.col("line")).alias("line")).where(
        (F.col("line_no") > 1) & F.col("line").isNotNull() & (F.trim("line") != "")
    )
    joined = data.join(files, "file_id").withColumn("fields", split_fields(F.col("line")))

    def cell(name: str, number: int, kind: str) -> Column:
        key = F.struct(F.lit(name).alias("name"), F.lit(number).alias("number"))
        v = F.trim(F.get("fields", F.try_element_at("place", key)))
        v = F.when(~v.isin("", "NA"), v)
        return v if kind in ("text", "none") else v.try_cast(SPARK_TYPES[kind])

    return joined.select(*RESERVED, *(cell(name, number, kind).alias(column) for name, number, column, kind in schema))
