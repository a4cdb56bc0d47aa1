"""Lines that fail to parse, against a character-by-character reader."""

import re

import pyarrow.parquet as pq
import pytest

from ribospark.operators import rejects

SCHEMA = "line_id bigint, file_name string, tool string, line_no int, line string, value string, fields string"
NUMBER = re.compile(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def fields(line):
    out, i = [], 0
    while True:
        text = ""
        if line[i : i + 1] == '"':
            text, i = '"', i + 1
            while i < len(line):
                if line[i] == '"' and line[i + 1 : i + 2] != '"':
                    text, i = text + '"', i + 1
                    break
                step = 2 if line[i] == '"' else 1
                text, i = text + line[i : i + step], i + step
        while i < len(line) and line[i] != "\t":
            text, i = text + line[i], i + 1
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def value(field):
    if not field.startswith('"'):
        return field
    body = field[1:]
    m = re.match(r'((?:[^"]|"")*)"?(.*)\Z', body, re.S)
    return m[1].replace('""', '"') + m[2]


def ok(check, v):
    if check == "digits":
        return bool(re.fullmatch("[0-9]+", v))
    if check == "number":
        return bool(NUMBER.fullmatch(v))
    if check == "probability":
        return v == "NA" or bool(NUMBER.fullmatch(v)) and 0 <= float(v) <= 1
    if v == "-":
        return True
    parts = v.split("-")
    if len(parts) > 2 or parts.count("?") > 1 or v == "?":
        return False
    if not all(p == "?" or re.fullmatch("[0-9]+", p) and int(p) > 0 for p in parts):
        return False
    return "?" in parts or int(parts[0]) <= int(parts[-1])


def failing(rows):
    by_file, bad = {}, set()
    for r in rows:
        by_file.setdefault(r["file_name"], []).append(r)
    for own in by_file.values():
        own.sort(key=lambda r: r["line_no"])
        header, started = None, False
        for r in own:
            line = re.sub(r"\r\Z", "", r["line"] or "")
            if not line.strip(" "):
                continue
            if r["tool"] == "rmats_mxe":
                if r["line_no"] == 1:
                    header = [value(f) for f in fields(line)]
                    continue
            elif line.startswith("#"):
                if not started:
                    header = [value(f) for f in fields(line[1:])]
                continue
            started = True
            cells = fields(line)
            if line.count('"') % 2 or header is None or len(cells) != len(header):
                bad.add(r["line_id"])
                continue
            checks = {c: k for t, c, k in rejects.RULES if t == r["tool"]}
            if not all(ok(checks[n], value(c)) for n, c in zip(header, cells, strict=True) if n in checks):
                bad.add(r["line_id"])
    return bad


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_a_plain_reader(spark, sf):
    path = f"/root/testdata/{sf}/raw_lines.parquet"
    rows = pq.read_table(path, columns=["line_id", "file_name", "tool", "line_no", "line"]).to_pylist()
    found = [r.line_id for r in rejects.rejected_lines(spark.read.parquet(path)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == failing(rows)


def lines(spark, tool, *texts):
    rows = [(i, "f", tool, i, t, "clash", "clash") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_each_reason(spark):
    df = lines(
        spark, "vep", "## note", "#Allele\tcDNA_position", "A\t5\r", "A\t7-3", "A\t?-?", "A\t0", 'A\t"5"', 'A"\t5', "A\t5\t", "",
        None, "# later", '"a\tb"\t3-?', "A\t00012-13",
    )
    got = {r.line_id: r.reason for r in rejects.rejected_lines(df).collect()}
    assert got == {4: "value", 5: "value", 6: "value", 8: "quoting", 9: "column count"}
    assert sorted(r.line_id for r in rejects.valid_rows(df, "vep").collect()) == [3, 7, 13, 14]


def test_no_header_empty_table_and_long_line(spark):
    df = lines(spark, "star_fusion", "A\t1")
    assert [r.reason for r in rejects.rejected_lines(df).collect()] == ["header"]
    assert rejects.rejected_lines(df.limit(0)).count() == 0
    assert rejects.valid_rows(df.limit(0), "star_fusion").count() == 0
    long = lines(spark, "star_fusion", "#FFPM\tannots", '0.5\t"' + '""x' * 200_000 + '"', "1e-3\t" + "y" * 500_000)
    assert rejects.rejected_lines(long).count() == 0


def test_valid_rows_are_typed(spark):
    df = lines(spark, "star_fusion", "#FusionName\tJunctionReadCount\tFFPM\tJunctionReadCount", "A--B\t3\t0.25\t4", "A--B\t3\tx\t4")
    (row,) = rejects.valid_rows(df, "star_fusion").collect()
    assert (row.fusion_name, row.junction_read_count, row.ffpm, row.est_j) == ("A--B", 3, 0.25, None)


@pytest.mark.parametrize("tool", rejects.TOOLS)
def test_valid_rows_keep_every_field(spark, tool):
    path = "/root/testdata/sf0.01/raw_lines.parquet"
    rows = [r for r in pq.read_table(path, columns=["line_id", "file_name", "tool", "line_no", "line"]).to_pylist() if r["tool"] == tool]
    bad, heads, started, want = failing(rows), {}, set(), {}
    for r in sorted(rows, key=lambda r: (r["file_name"], r["line_no"])):
        line = re.sub(r"\r\Z", "", r["line"] or "")
        if not line.strip(" "):
            continue
        if (r["line_no"] == 1) if tool == "rmats_mxe" else line.startswith("#"):
            if r["file_name"] not in started:
                heads[r["file_name"]] = [value(f) for f in fields(line.removeprefix("#"))]
            continue
        started.add(r["file_name"])
        if r["line_id"] not in bad:
            want[r["line_id"]] = dict(enumerate(zip(heads[r["file_name"]], map(value, fields(line)), strict=True), 1))
    got = {r.line_id: r for r in rejects.valid_rows(spark.read.parquet(path), tool).collect()}
    assert set(got) == set(want)
    for i, cells in want.items():
        held = {o.pos: (o.name, o.value) for o in got[i].other}
        left = iter(rejects.TYPED[tool])
        for pos, (name, text) in cells.items():
            if pos in held:
                assert held[pos] == (name, text)
                continue
            out, _, kind = next(x for x in left if x[1] == name)
            typed = got[i][out]
            assert typed == text if kind == "string" else (typed is None) == (text in ("", "NA")) and (typed is None or typed == float(text))


def test_fields_that_no_column_holds(spark):
    head = "#FusionName\tJunctionReadCount\tnew\tFusionName\tFFPM\tLeftBreakEntropy\tnew"
    df = lines(spark, "star_fusion", head, "A--B\t3000000000\tx\tC--D\t0.5\t.\t", "A--B\t" + "9" * 30 + "\tx\t\t1e999\tNA\ty")
    one, two = sorted(rejects.valid_rows(df, "star_fusion").collect(), key=lambda r: r.line_id)
    assert (one.fusion_name, one.junction_read_count, one.ffpm, one.left_break_entropy) == ("A--B", 3_000_000_000, 0.5, None)
    assert [tuple(o) for o in one.other] == [(3, "new", "x"), (4, "FusionName", "C--D"), (6, "LeftBreakEntropy", "."), (7, "new", "")]
    assert two.junction_read_count is None
    assert [tuple(o) for o in two.other] == [
        (2, "JunctionReadCount", "9" * 30), (3, "new", "x"), (4, "FusionName", ""), (5, "FFPM", "1e999"), (7, "new", "y"),
    ]
