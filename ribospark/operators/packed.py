"""Split fields that hold several values, by delimiter skeletons.

A field's text is cut into tokens: runs of ordinary characters and single packing characters. Masking each run gives
the skeleton. Where the values lie depends on the skeleton alone, so the splitting rule (token ranges, in order) is
resolved once per distinct skeleton, broadcast if the skeletons are few enough, and applied by position.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.session import broadcast_if_small, checkpointed

_ORD = r"""[^,;|"'\[\]\s]"""
_WORD = rf"(?:{_ORD}++(?:\[[^\[\]]*+\])?+)++"
# A whole value in quotes is one token, so that what it holds makes no skeletons of its own.
_QUOTED = "|".join(
    rf"(?<=\A\s{{0,9}}|[,;|\[]\s{{0,9}}){q}(?!\s*+\[)[^{q}]++{q}(?=\s*+(?:[,;|\]]|\z))" for q in ('"', "'")
)


@dataclass(frozen=True)
class Packing:
    """How a kind of field is cut. ``run`` matches ordinary runs; ``listed`` fields know quotes and brackets."""

    name: str
    run: str
    listed: bool = False

    @property
    def token(self) -> str:
        return rf"{_QUOTED}|{self.run}|\s++|[\s\S]" if self.listed else rf"{self.run}|\s++|[\s\S]"


# The characters of the values of each kind of field.
READS = Packing("reads", r"[A-Za-z0-9@:&_-]++")
TERMS = Packing("terms", r"[A-Za-z0-9_]++")
COUNTS = Packing("counts", r"(?:[0-9]++|NA)")
LISTED = Packing("listed", rf"{_WORD}(?:\s++{_WORD})*+", listed=True)


def tokens(text: Column, packing: Packing) -> Column:
    return F.regexp_extract_all(text, F.lit(packing.token), F.lit(0))


def skeleton(toks: Column, packing: Packing) -> Column:
    """One character per token: `x` a run or quoted value with a letter or digit, `o` one without, a blank, or the packing character."""

    def mask(t: Column) -> Column:
        run = t.rlike(rf"\A{packing.run}\z")
        if packing.listed:
            run = run | ((F.length(t) > 1) & t.rlike("""\\A["']"""))
        return (
            F.when(run & t.rlike("[A-Za-z0-9]"), "x")
            .when(run, "o")
            .when(t.rlike(r"\A\s"), " ")
            .when(t.rlike(r"""\A[,;|"'\[\]]\z"""), t)
            .otherwise("~")
        )

    return F.array_join(F.transform(toks, mask), "")


def value_ranges(skel: str, listed: bool) -> tuple[list[tuple[int, int]], bool]:
    """Token ranges [i, j) of the values of a skeleton, and whether quotes are doubled inside them."""
    if not listed:
        return [(i, i + 1) for i, c in enumerate(skel) if c == "x"], False
    lo, hi = _trim(skel, 0, len(skel), " ")
    doubled = False
    # A pair of double quotes around the whole bracketed list, every quote inside doubled.
    if hi - lo >= 4 and skel[lo] == skel[hi - 1] == '"':
        a, b = _trim(skel, lo + 1, hi - 1, " ")
        inner = skel[lo + 1 : hi - 1]
        if b - a >= 2 and skel[a] == "[" and skel[b - 1] == "]" and '"' not in inner.replace('""', ""):
            lo, hi, doubled = a, b, True
    marks = list(_marks(skel, lo, hi, doubled))
    if len(marks) >= 2 and marks[0][0] == "[" and marks[-1][0] == "]" and _closing(marks) == len(marks) - 1:
        marks = marks[1:-1]
    out = []
    for piece in _pieces(marks):
        while piece and piece[0][0] in " \"'":
            piece = piece[1:]
        while piece and piece[-1][0] in " \"'":
            piece = piece[:-1]
        if any(c == "x" for c, _, _ in piece):
            out.append((piece[0][1], piece[-1][2]))
    return out, doubled


Mark = tuple[str, int, int]


def _trim(s: str, lo: int, hi: int, chars: str) -> tuple[int, int]:
    while lo < hi and s[lo] in chars:
        lo += 1
    while lo < hi and s[hi - 1] in chars:
        hi -= 1
    return lo, hi


def _marks(skel: str, lo: int, hi: int, doubled: bool) -> Iterator[Mark]:
    """(character, first token, end token); a doubled quote counts as one mark."""
    i = lo
    while i < hi:
        j = i + 2 if doubled and skel[i : i + 2] == '""' else i + 1
        yield skel[i], i, j
        i = j


def _quote_end(marks: Sequence[Mark], i: int, closers: str) -> int | None:
    """Where the quote that opens at i closes: the next such quote before a separator, a bracket's end or the end."""
    for k in range(i + 1, len(marks)):
        if marks[k][0] == marks[i][0]:
            after = next((c for c, _, _ in marks[k + 1 :] if c != " "), "")
            if after == "" or after in closers:
                return k
    return None


def _closing(marks: Sequence[Mark]) -> int:
    """Index of the bracket that closes the one at 0, quoted parts skipped; -1 if none does."""
    depth, i, fresh = 0, 0, True
    while i < len(marks):
        c = marks[i][0]
        if c in "\"'" and fresh and (end := _quote_end(marks, i, ",;|]")) is not None:
            i = end + 1
            fresh = False
            continue
        depth += (c == "[") - (c == "]")
        if depth == 0:
            return i
        if c != " ":
            fresh = c in ",;|["
        i += 1
    return -1


def _pieces(marks: Sequence[Mark]) -> Iterator[list[Mark]]:
    """Parts between separators that lie outside quotes and brackets."""
    piece: list[Mark] = []
    depth, i = 0, 0
    while i < len(marks):
        c = marks[i][0]
        if c in "\"'" and depth == 0 and all(p[0] == " " for p in piece) and (end := _quote_end(marks, i, ",;|")) is not None:
            piece += marks[i : end + 1]
            i = end + 1
            continue
        if c in ",;|" and depth == 0:
            yield piece
            piece = []
        else:
            depth = max(0, depth + (c == "[") - (c == "]"))
            piece.append(marks[i])
        i += 1
    yield piece


def _rules(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [value_ranges(s, p == LISTED.name) for s, p in zip(pdf["skeleton"], pdf["packing"], strict=True)]
        yield pdf.assign(
            starts=[[i for i, _ in r] for r, _ in found],
            lengths=[[j - i for i, j in r] for r, _ in found],
            doubled=[d for _, d in found],
        )


def packed_fields(df: DataFrame, table_name: str, fields: dict[str, Packing], id_column: str = "record_id") -> DataFrame:
    """(table_name, record_id, field_name, packing, tokens, skeleton) of the packed fields of one table, read once."""

    def entry(field: str, packing: Packing) -> Column:
        return F.struct(
            F.lit(field).alias("field_name"), F.lit(packing.name).alias("packing"), tokens(F.col(field), packing).alias("tokens")
        )

    rows = df.select(
        F.lit(table_name).alias("table_name"),
        F.col(id_column).alias("record_id"),
        F.explode(F.array(*(entry(f, p) for f, p in fields.items()))).alias("e"),
    ).where(F.size("e.tokens") > 0)
    skel = F.lit(None).cast("string")
    for packing in {p.name: p for p in fields.values()}.values():
        skel = F.when(F.col("e.packing") == packing.name, skeleton(F.col("e.tokens"), packing)).otherwise(skel)
    return rows.select("table_name", "record_id", "e.field_name", "e.packing", "e.tokens", skel.alias("skeleton"))


def split_packed(packed: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, pos, item_text): one row per value of ``packed_fields``, pos from 1 in order.

    Null and empty fields, and fields of packing only, give no rows; repeated values are kept. The distinct
    skeletons are checkpointed, so their rules are resolved once; they are broadcast only while they are few.
    """
    distinct = packed.where(F.col("skeleton").contains("x")).select("packing", "skeleton").distinct()
    schema = "packing string, skeleton string, starts array<int>, lengths array<int>, doubled boolean"
    rules = broadcast_if_small(checkpointed(distinct.mapInPandas(_rules, schema)), 50_000)
    text = F.transform(
        F.arrays_zip("starts", "lengths"), lambda r: F.array_join(F.slice("tokens", r["starts"] + 1, r["lengths"]), "")
    )
    plain = F.when(F.col("doubled"), F.transform(text, lambda t: F.replace(t, F.lit('""'), F.lit('"')))).otherwise(text)
    edges = r"""\A[\s"']+|[\s"']+\z"""
    plain = F.when(F.col("packing") == LISTED.name, F.transform(plain, lambda t: F.regexp_replace(t, edges, ""))).otherwise(plain)
    return (
        packed.join(rules, ["packing", "skeleton"])
        .select("table_name", "record_id", "field_name", F.posexplode(plain).alias("at", "item_text"))
        .select("table_name", "record_id", "field_name", (F.col("at") + 1).alias("pos"), "item_text")
    )
