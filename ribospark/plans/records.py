"""Queries over the record tables and raw lines, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.operators import drift, heavy_keys, orphans, packed, rejects
from ribospark.session import table


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected_lines(table(spark, d, "raw_lines"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("line_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).groupBy("tool", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _valid(tool: str):
    return lambda spark, d: rejects.valid_rows(table(spark, d, "raw_lines"), tool)


def _references(spark: SparkSession, d: str) -> DataFrame:
    star = orphans.reference_rows(table(spark, d, "star_fusion"), "star_fusion", {"left_gene": "gene", "right_gene": "gene"})
    circ = orphans.reference_rows(table(spark, d, "circ_known"), "circ_known", {"isoform_name": "transcript"})
    vep = table(spark, d, "vep_records").where(F.col("feature_type") == "Transcript")
    return star.unionByName(circ).unionByName(orphans.reference_rows(vep, "vep_records", {"feature": "transcript"}))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    targets = orphans.target_rows(table(spark, d, "genes"), "gene", "gene_id").unionByName(
        orphans.target_rows(table(spark, d, "transcripts"), "transcript", "transcript_id")
    )
    return orphans.orphans(_references(spark, d), targets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "field_name")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def _p1_typed(tool: str):
    """The typed columns of the valid rows, without what no column holds."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return rejects.valid_rows(table(spark, d, "raw_lines"), tool).drop("other")

    return query


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """The values of the fields that have no quotes or brackets of their own."""
    return p3_found(spark, d).where("field_name <> 'annots'")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = packed.packed_fields(
        table(spark, d, "star_fusion"), "star_fusion", {"junction_reads": packed.READS, "annots": packed.LISTED}
    )
    parts = parts.unionByName(packed.packed_fields(table(spark, d, "vep_records"), "vep_records", {"consequences": packed.TERMS}))
    parts = parts.unionByName(packed.packed_fields(table(spark, d, "rmats_mxe"), "rmats_mxe", {"ijc_sample_1": packed.COUNTS}))
    return packed.split_packed(parts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "drift_lines")).select("file_id", "field_name", "change_kind")


def p4_log(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "drift_lines"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(table(spark, d, "drift_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_keys(table(spark, d, "dispatches")).select("tx_id")


def p6_per_key(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.per_key(table(spark, d, "dispatches"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p1_valid_star_fusion": _valid("star_fusion"),
    "p1_valid_rmats_mxe": _valid("rmats_mxe"),
    "p1_valid_vep": _valid("vep"),
    "p2_found": p2_found,
    "p2_report": p2_report,
    **{f"p1_typed_{tool}": _p1_typed(tool) for tool in rejects.TOOLS},
    "p3_found": p3_found,
    "p3_plain": p3_plain,
    "p4_found": p4_found,
    "p4_log": p4_log,
    "p4_table": p4_table,
    "p6_found": p6_found,
    "p6_per_key": p6_per_key,
}

_KEY = "upper(trim(regexp_extract({0}, '([^^]*)$', 1)))"
_REFS = f"""
refs AS (
  SELECT 'star_fusion' AS table_name, record_id, 'left_gene' AS field_name, 'gene' AS kind, {_KEY.format('left_gene')} AS k, called_at FROM star_fusion
  UNION ALL SELECT 'star_fusion', record_id, 'right_gene', 'gene', {_KEY.format('right_gene')}, called_at FROM star_fusion
  UNION ALL SELECT 'circ_known', record_id, 'isoform_name', 'transcript', {_KEY.format('isoform_name')}, called_at FROM circ_known
  UNION ALL SELECT 'vep_records', record_id, 'feature', 'transcript', {_KEY.format('feature')}, called_at FROM vep_records WHERE feature_type = 'Transcript'
), spans AS (
  SELECT 'gene' AS kind, upper(trim(gene_id)) AS k, added_at, retired_at FROM genes
  UNION ALL SELECT 'transcript', upper(trim(transcript_id)), added_at, retired_at FROM transcripts
), orphan AS (
  SELECT * FROM refs r WHERE k IS NOT NULL AND k NOT IN ('', '-', '.') AND NOT EXISTS (
    SELECT 1 FROM spans s WHERE s.kind = r.kind AND s.k = r.k AND s.added_at <= r.called_at AND (s.retired_at IS NULL OR r.called_at < s.retired_at))
)"""
_NUM = "[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?"
_POS = "0*[1-9][0-9]*"


def _cell(name: str) -> str:
    return f"regexp_replace(fields[list_position(names, '{name}')], '^\"(.*)\"$', '\\1')"


def _fails(name: str, check: str) -> str:
    """SQL that is true where a line has the column and its value isn't valid."""
    v = _cell(name)
    good = {
        "digits": f"regexp_full_match({v}, '[0-9]+')",
        "number": f"regexp_full_match({v}, '{_NUM}')",
        "probability": f"({v} = 'NA' OR (regexp_full_match({v}, '{_NUM}') AND TRY_CAST({v} AS DOUBLE) <= 1))",
        "cdna": f"(regexp_full_match({v}, '-|{_POS}|\\?-{_POS}|{_POS}-\\?') OR (regexp_full_match({v}, '{_POS}-{_POS}') AND "
        f"TRY_CAST(split_part({v}, '-', 1) AS HUGEINT) <= TRY_CAST(split_part({v}, '-', 2) AS HUGEINT)))",
    }[check]
    return f"coalesce(NOT {good}, false)"


def _invalid(tool: str) -> str:
    return " OR ".join(_fails(column, check) for t, column, check in rejects.RULES if t == tool and check != "never")


_LINES = f"""b AS (
  SELECT line_id, file_name, tool, line_no, regexp_replace(line, '\\r$', '') AS s FROM raw_lines WHERE line IS NOT NULL
), l AS (SELECT * FROM b WHERE trim(s) <> ''
), d AS (SELECT file_name, min(line_no) AS first FROM l WHERE tool <> 'rmats_mxe' AND s NOT LIKE '#%' GROUP BY file_name
), h AS (
  SELECT file_name, arg_max(s, line_no) AS head FROM (
    SELECT file_name, line_no, s FROM l JOIN d USING (file_name) WHERE tool <> 'rmats_mxe' AND s LIKE '#%' AND line_no < first
    UNION ALL SELECT file_name, line_no, s FROM l WHERE tool = 'rmats_mxe' AND line_no = 1) GROUP BY file_name
), f AS (
  SELECT l.*, string_split(regexp_replace(head, '^#', ''), chr(9)) AS names,
    regexp_extract_all(chr(9) || s, '\\t("(?:[^"]|"")*"[^\\t]*|[^\\t]*)', 1) AS fields
  FROM l LEFT JOIN h USING (file_name) WHERE CASE WHEN tool = 'rmats_mxe' THEN line_no > 1 ELSE s NOT LIKE '#%' END
), r AS (
  SELECT line_id, tool, CASE
    WHEN (length(s) - length(replace(s, '"', ''))) % 2 = 1 THEN 'quoting'
    WHEN names IS NULL THEN 'header'
    WHEN len(fields) <> len(names) THEN 'column count'
    WHEN CASE tool WHEN 'star_fusion' THEN {_invalid('star_fusion')} WHEN 'rmats_mxe' THEN {_invalid('rmats_mxe')} ELSE {_invalid('vep')} END THEN 'value'
  END AS reason FROM f
)"""


def _typed(tool: str) -> str:
    """SQL of the typed columns of a tool; a name that is listed again is looked for after its first place."""
    columns, seen = [], set()
    for name, column, kind in rejects.TYPED[tool]:
        at = f"list_position(names, '{column}')"
        if column in seen:
            at = f"({at} + list_position(names[{at} + 1:], '{column}'))"
        seen.add(column)
        field = f"fields[{at}]"
        value = f"CASE WHEN starts_with({field}, '\"') THEN replace(regexp_replace({field}, '^\"(.*)\"$', '\\1'), '\"\"', '\"') ELSE {field} END"
        columns.append((value if kind == "string" else f"TRY_CAST({value} AS {kind})") + f" AS {name}")
    return f"WITH {_LINES} SELECT line_id, file_name, line_no, {', '.join(columns)} FROM f JOIN r USING (line_id) WHERE f.tool = '{tool}' AND reason IS NULL"


def _split(table_name: str, field: str, pattern: str) -> str:
    found = f"[x FOR x IN regexp_extract_all({field}, '{pattern}') IF regexp_matches(x, '[A-Za-z0-9]')]"
    return f"SELECT '{table_name}' AS table_name, record_id, '{field}' AS field_name, CAST(unnest(range(1, len({found}) + 1)) AS INT) AS pos, unnest({found}) AS item_text FROM {table_name}"


_CLEAN = "upper(regexp_replace(tx_id, '^\\s+|\\s+$', '', 'g'))"

SQL = {
    **{f"p1_typed_{tool}": _typed(tool) for tool in rejects.TOOLS},
    "p3_plain": " UNION ALL ".join(
        [_split("star_fusion", "junction_reads", "[A-Za-z0-9@:&_-]+"), _split("vep_records", "consequences", "[A-Za-z0-9_]+"), _split("rmats_mxe", "ijc_sample_1", "[0-9]+|NA")]
    ),
    "p1_found": f"WITH {_LINES} SELECT line_id FROM r WHERE reason IS NOT NULL",
    "p1_reasons": f"WITH {_LINES} SELECT tool, reason, count(*) AS n_lines FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": f"WITH {_REFS} SELECT table_name, record_id, field_name FROM orphan",
    "p2_report": f"""WITH {_REFS} SELECT table_name, field_name, CAST(date_trunc('month', called_at) AS DATE) AS period,
        count(*) AS n_orphans, count(DISTINCT k) AS n_keys FROM orphan GROUP BY ALL""",
    "p6_found": f"""WITH t AS (SELECT {_CLEAN} AS tx_id FROM dispatches)
        SELECT tx_id FROM t WHERE tx_id NOT IN ('', '-') GROUP BY tx_id HAVING count(*) * 100 > (SELECT count(*) FROM dispatches)""",
    "p6_per_key": f"""WITH t AS (
          SELECT {_CLEAN} AS tx_id, * EXCLUDE (tx_id), epoch_us(dispatched_at) AS us FROM dispatches
        ), g AS (
          SELECT *, us - lag(us) OVER (PARTITION BY tx_id ORDER BY us, dispatch_id) AS gap FROM t WHERE tx_id NOT IN ('', '-')
        )
        SELECT tx_id, count(*) AS n_dispatches, CAST(coalesce(sum(n_variants), 0) AS BIGINT) AS sum_variants,
          CAST(coalesce(sum(n_fusions), 0) AS BIGINT) AS sum_fusions, CAST(coalesce(sum(n_circ), 0) AS BIGINT) AS sum_circ,
          CAST(count(*) FILTER (WHERE succeeded) AS BIGINT) AS n_succeeded,
          CAST(coalesce(sum(CAST(round(elapsed_ms * 1000) AS BIGINT)), 0) AS BIGINT) / 1000 AS sum_elapsed_ms,
          min(dispatched_at) AS first_at, max(dispatched_at) AS last_at, coalesce(max(gap), 0) AS longest_gap_us
        FROM g GROUP BY tx_id""",
}
