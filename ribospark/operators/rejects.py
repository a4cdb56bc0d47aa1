"""Separate lines of delivered files that fail to parse from the valid rows, with the reasons.

The lines of a file are parsed into cells with Catalyst's regular expressions; the cells are exploded into
(row, column, value), joined to a small rule table, validated, and the failures are grouped per line. The
valid rows are the anti-join of all data lines with the failing ones, cast to their types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The checked columns of each file kind.
RULES = [
    ("star_fusion", "JunctionReadCount", "digits"),
    ("star_fusion", "SpanningFragCount", "digits"),
    ("star_fusion", "FFPM", "number"),
    ("rmats_mxe", "1stExonStart_0base", "digits"),
    ("rmats_mxe", "1stExonEnd", "digits"),
    ("rmats_mxe", "2ndExonStart_0base", "digits"),
    ("rmats_mxe", "2ndExonEnd", "digits"),
    ("rmats_mxe", "upstreamES", "digits"),
    ("rmats_mxe", "upstreamEE", "digits"),
    ("rmats_mxe", "downstreamES", "digits"),
    ("rmats_mxe", "downstreamEE", "digits"),
    ("rmats_mxe", "PValue", "probability"),
    ("vep", "cDNA_position", "cdna"),
]
#: Pseudo columns of a line whose cells can't be told apart, so that whole-line failures go through the same join.
QUOTING, COUNT, HEADER = "*quoting*", "*column count*", "*header*"
TOOLS = sorted({tool for tool, _, _ in RULES})
RULES += [(tool, column, "never") for tool in TOOLS for column in (QUOTING, COUNT, HEADER)]

#: Typed columns of the valid rows, every column of the files' headers: output name, file column, type. A file column
#: that is listed again stands for its next occurrence in the header.
TYPED = {
    "star_fusion": [
        ("fusion_name", "FusionName", "string"),
        ("junction_read_count", "JunctionReadCount", "bigint"),
        ("spanning_frag_count", "SpanningFragCount", "bigint"),
        ("est_j", "est_J", "double"),
        ("est_s", "est_S", "double"),
        ("splice_type", "SpliceType", "string"),
        ("left_gene", "LeftGene", "string"),
        ("left_breakpoint", "LeftBreakpoint", "string"),
        ("right_gene", "RightGene", "string"),
        ("right_breakpoint", "RightBreakpoint", "string"),
        ("junction_reads", "JunctionReads", "string"),
        ("spanning_frags", "SpanningFrags", "string"),
        ("large_anchor_support", "LargeAnchorSupport", "string"),
        ("ffpm", "FFPM", "double"),
        ("left_break_dinuc", "LeftBreakDinuc", "string"),
        ("left_break_entropy", "LeftBreakEntropy", "double"),
        ("right_break_dinuc", "RightBreakDinuc", "string"),
        ("right_break_entropy", "RightBreakEntropy", "double"),
        ("annots", "annots", "string"),
    ],
    "rmats_mxe": [
        ("event_id", "ID", "bigint"),
        ("gene_id", "GeneID", "string"),
        ("gene_symbol", "geneSymbol", "string"),
        ("chrom", "chr", "string"),
        ("strand", "strand", "string"),
        ("first_exon_start", "1stExonStart_0base", "bigint"),
        ("first_exon_end", "1stExonEnd", "bigint"),
        ("second_exon_start", "2ndExonStart_0base", "bigint"),
        ("second_exon_end", "2ndExonEnd", "bigint"),
        ("upstream_exon_start", "upstreamES", "bigint"),
        ("upstream_exon_end", "upstreamEE", "bigint"),
        ("downstream_exon_start", "downstreamES", "bigint"),
        ("downstream_exon_end", "downstreamEE", "bigint"),
        ("event_id_again", "ID", "bigint"),
        ("ijc_sample_1", "IJC_SAMPLE_1", "string"),
        ("sjc_sample_1", "SJC_SAMPLE_1", "string"),
        ("ijc_sample_2", "IJC_SAMPLE_2", "string"),
        ("sjc_sample_2", "SJC_SAMPLE_2", "string"),
        ("inc_form_len", "IncFormLen", "bigint"),
        ("skip_form_len", "SkipFormLen", "bigint"),
        ("pvalue", "PValue", "double"),
        ("fdr", "FDR", "double"),
        ("inc_level_1", "IncLevel1", "string"),
        ("inc_level_2", "IncLevel2", "string"),
        ("inc_level_difference", "IncLevelDifference", "double"),
    ],
    "vep": [
        ("uploaded_variation", "Uploaded_variation", "string"),
        ("var_location", "Location", "string"),
        ("allele", "Allele", "string"),
        ("gene", "Gene", "string"),
        ("feature", "Feature", "string"),
        ("feature_type", "Feature_type", "string"),
        ("consequences", "Consequence", "string"),
        ("cdna_position", "cDNA_position", "string"),
        ("cds_position", "CDS_position", "string"),
        ("protein_position", "Protein_position", "string"),
        ("amino_acids", "Amino_acids", "string"),
        ("codons", "Codons", "string"),
        ("existing_variation", "Existing_variation", "string"),
        ("extra", "Extra", "string"),
    ],
}

# One field: a quoted one runs to its closing quote (or the end), any other to the next tab. Possessive, so that
# the matcher neither backtracks nor recurses on very long lines.
_FIELD = r'\t("(?:[^"]++|"")*+(?:"[^\t]*+|\z)|[^\t]*+)'
_NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def split_fields(line: Column) -> Column:
    """The fields of one tab-separated line, quotes and all; a tab inside a quoted field belongs to it."""
    return F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(_FIELD), F.lit(1))


def unquoted(field: Column) -> Column:
    inner = r'\A"((?:[^"]++|"")*+)"?([\s\S]*)\z'
    return F.when(
        field.startswith('"'),
        F.concat(F.replace(F.regexp_extract(field, inner, 1), F.lit('""'), F.lit('"')), F.regexp_extract(field, inner, 2)),
    ).otherwise(field)


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def _is_hash(tool: Column, line: Column) -> Column:
    return line.startswith("#") & (tool != "rmats_mxe")


def _is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def file_headers(lines: DataFrame) -> DataFrame:
    """(file_name, names, keys): line 1 of an rmats_mxe file, else the last `#` line before the file's first data line.

    A key is a name with its occurrence before it, as in `2:ID`.
    """
    base = lines.select("file_name", "tool", "line_no", _bare(F.col("line")).alias("line")).where(
        F.col("line").isNotNull() & ~_is_blank(F.col("line"))
    )
    mxe = base.where((F.col("tool") == "rmats_mxe") & (F.col("line_no") == 1)).select("file_name", "line_no", "line")
    others = base.where(F.col("tool") != "rmats_mxe")
    starts = (
        others.where(~F.col("line").startswith("#")).groupBy("file_name").agg(F.min("line_no").alias("data_start"))
    )
    hashed = others.where(F.col("line").startswith("#")).select("file_name", "line_no", "line")
    before = hashed.join(starts, "file_name").where(F.col("line_no") < F.col("data_start"))
    last = (
        before.select("file_name", "line_no", "line")
        .unionByName(mxe)
        .groupBy("file_name")
        .agg(F.max_by("line", "line_no").alias("line"))
    )
    names = F.transform(split_fields(F.regexp_replace("line", r"\A#", "")), unquoted)
    keys = F.transform(
        "names",
        lambda n, i: F.concat(F.size(F.filter(F.slice("names", F.lit(1), i + 1), lambda m: m == n)).cast("string"), F.lit(":"), n),
    )
    return last.select("file_name", names.alias("names")).select("file_name", "names", keys.alias("keys"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Every data line with its fields and the names and keys of its file's header (null if the file has none)."""
    line = _bare(F.col("line"))
    data = lines.select("line_id", "file_name", "tool", "line_no", line.alias("line")).where(
        F.col("tool").isin(TOOLS)
        & F.col("line").isNotNull()
        & ~_is_blank(F.col("line"))
        & ~_is_hash(F.col("tool"), F.col("line"))
        & ~((F.col("tool") == "rmats_mxe") & (F.col("line_no") == 1))
    )
    return data.join(file_headers(lines), "file_name", "left").withColumn("fields", split_fields(F.col("line")))


def _passes(check: Column, value: Column) -> Column:
    """Whether a cell's value satisfies a named check."""
    low, high = (F.regexp_extract(value, r"\A0*([0-9]+)-0*([0-9]+)\z", i) for i in (1, 2))
    ordered = (F.length(low) < F.length(high)) | ((F.length(low) == F.length(high)) & (low <= high))
    positive = r"0*[1-9][0-9]*"
    cdna = (
        value.rlike(rf"\A(?:-|{positive}|\?-{positive}|{positive}-\?)\z")
        | (value.rlike(rf"\A{positive}-{positive}\z") & ordered)
    )
    probability = (value == "NA") | (value.rlike(rf"\A{_NUMBER}\z") & (value.try_cast("double") <= 1.0))
    return (
        F.when(check == "digits", value.rlike(r"\A[0-9]+\z"))
        .when(check == "number", value.rlike(rf"\A{_NUMBER}\z"))
        .when(check == "probability", probability)
        .when(check == "cdna", cdna)
        .otherwise(F.lit(False))
    )


def failing_cells(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, tool, line_no, column_name, value, reason): one row per failed cell or whole-line failure.

    ``lines`` needs line_id, file_name, tool, line_no, line; other columns are ignored. A null or blank line and
    a comment is no data. A line of a file without header fails with the reason `header`; a repeated line_id
    fails once per row. Lines with odd quotes or a wrong field count aren't checked cell by cell.
    """
    rules = lines.sparkSession.createDataFrame(RULES, "rule_tool string, column_name string, check string")
    data = data_lines(lines)
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1

    def whole(column: str) -> Column:
        return F.array(F.struct(F.lit(column).alias("column_name"), F.lit(None).cast("string").alias("value")))

    cells = (
        F.when(odd, whole(QUOTING))
        .when(F.col("names").isNull(), whole(HEADER))
        .when(F.size("fields") != F.size("names"), whole(COUNT))
        .otherwise(
            F.zip_with("names", "fields", lambda n, f: F.struct(n.alias("column_name"), f.alias("value")))
        )
    )
    exploded = data.select("line_id", "file_name", "tool", "line_no", F.explode(cells).alias("cell")).select(
        "line_id", "file_name", "tool", "line_no", "cell.column_name", "cell.value"
    )
    # The rule table is a constant of this module, so its broadcast can't grow.
    ruled = exploded.join(
        F.broadcast(rules), (F.col("tool") == F.col("rule_tool")) & (exploded.column_name == rules.column_name)
    ).select("line_id", "file_name", "tool", "line_no", exploded.column_name, unquoted(F.col("value")).alias("value"), "check")
    reason = (
        F.when(F.col("column_name") == QUOTING, "quoting")
        .when(F.col("column_name") == COUNT, "column count")
        .when(F.col("column_name") == HEADER, "header")
        .otherwise("value")
    )
    return ruled.where(~_passes(F.col("check"), F.col("value"))).select(
        "line_id", "file_name", "tool", "line_no", "column_name", "value", reason.alias("reason")
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, tool, line_no, reason, columns): one row per failing line, its reasons and columns joined by `;`."""
    return failing_cells(lines).groupBy("line_id", "file_name", "tool", "line_no").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reason"),
        F.array_join(F.array_sort(F.collect_set("column_name")), ";").alias("columns"),
    )


def valid_rows(lines: DataFrame, tool: str) -> DataFrame:
    """The valid data lines of one tool as typed rows: line_id, file_name, line_no, the columns of ``TYPED[tool]``, other.

    A column that the file lacks, NA and the empty string come out null where the type is a number. ``other`` holds
    (pos, name, value) of every field that no typed column holds: unlisted columns, further occurrences of a name, and
    text that isn't a number of its column's type.
    """
    own = lines.where(F.col("tool") == tool)
    bad = failing_cells(own).select(F.col("line_id").alias("bad_id")).distinct()
    good = data_lines(own)
    good = good.join(bad, good.line_id.eqNullSafe(bad.bad_id), "left_anti")

    listed: dict[str, str] = {}
    columns = []
    for name, column, kind in TYPED[tool]:
        key = f"{sum(k.partition(':')[2] == column for k in listed) + 1}:{column}"
        listed[key] = kind
        value = unquoted(F.get("fields", F.array_position("keys", F.lit(key)).cast("int") - 1))
        columns.append((value if kind == "string" else value.try_cast(kind)).alias(name))

    def unheld(field: Column) -> Column:
        key, value = field["key"], field["value"]
        out = ~key.isin(*listed)
        for kind in {*listed.values()} - {"string"}:
            number = value.try_cast(kind)
            lost = number.isNull() | (F.abs(number.cast("double")) == float("inf"))
            out = out | (key.isin(*(k for k, of in listed.items() if of == kind)) & ~value.isin("", "NA") & lost)
        return out

    fields = F.transform(
        "fields",
        lambda f, i: F.struct(
            F.get("keys", i).alias("key"), (i + 1).alias("pos"), F.get("names", i).alias("name"), unquoted(f).alias("value")
        ),
    )
    other = F.transform(F.filter(fields, unheld), lambda f: F.struct(f["pos"].alias("pos"), f["name"].alias("name"), f["value"].alias("value")))
    return good.select("line_id", "file_name", "line_no", *columns, other.alias("other"))
