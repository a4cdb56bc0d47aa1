"""Packed fields: fixed examples, and a plain parser over the tables."""

import re

import pyarrow.parquet as pq
import pytest

from ribospark.operators import packed

EXAMPLES = [
    ('["a[b]","c d"]', ["a[b]", "c d"]),
    ('"[""N:-:+:[82084]""]"', ["N:-:+:[82084]"]),
    ('"[""depth 8|6"", ""B""]"', ["depth 8|6", "B"]),
    ("'x, y',\"p, -, q\",z[1],\"w\"", ["x, y", "p, -, q", "z[1]", "w"]),
    ("[a , loci[5, 1, 5];b[c:9]]", ["a", "loci[5, 1, 5]", "b[c:9]"]),
    ('["a"|"b[1;2]";"c"]', ["a", "b[1;2]", "c"]),
    ('"a","b",', ["a", "b"]),
    ("a b[1,2]", ["a b[1,2]"]),
    (".", []),
    ("[]", []),
    (" , ;|", []),
    ("3'UTR;x", ["3'UTR", "x"]),
    ('"a"', ["a"]),
    ("[a],[b]", ["[a]", "[b]"]),
    ("a,a", ["a", "a"]),
    ("-,+,b", ["b"]),
]
SCHEMA = "record_id bigint, annots string, pos int, item_text string, tokens string"


def plain_list(s):
    """A reader of annots that walks over the text itself."""
    s = s.strip()
    m = re.fullmatch(r'"\s*(\[.*\])\s*"', s, re.S)
    if m and '"' not in m[1].replace('""', ""):
        s = m[1].replace('""', '"')
    parts, text, depth, quote = [], "", 0, ""
    body = s[1:-1] if s.startswith("[") and s.endswith("]") else s
    for i, c in enumerate(body):
        if quote:
            text += c
            quote = "" if c == quote and re.match(r"\s*([,;|]|\Z)", body[i + 1 :]) else quote
        elif c in "\"'" and depth == 0 and not text.strip():
            quote, text = c, text + c
        elif c in ",;|" and depth == 0:
            parts.append(text)
            text = ""
        else:
            depth += (c == "[") - (c == "]")
            text += c
    return [p for p in (p.strip(" \"'\t") for p in [*parts, text]) if re.search("[A-Za-z0-9]", p)]


def test_examples(spark):
    df = spark.createDataFrame([(i, t, 0, "", "") for i, (t, _) in enumerate(EXAMPLES)], SCHEMA)
    out = packed.split_packed(packed.packed_fields(df, "t", {"annots": packed.LISTED})).collect()
    for i, (text, expected) in enumerate(EXAMPLES):
        got = sorted((r.pos, r.item_text) for r in out if r.record_id == i)
        assert got == list(enumerate(expected, 1)), text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    from ribospark.plans.records import p3_found

    got = sorted((r.table_name, r.record_id, r.field_name, r.pos, r.item_text) for r in p3_found(spark, f"/root/testdata/{sf}").collect())
    cut = {
        ("star_fusion", "junction_reads"): lambda s: [x for x in re.findall(r"[A-Za-z0-9@:&_-]+", s) if re.search("[A-Za-z0-9]", x)],
        ("star_fusion", "annots"): plain_list,
        ("vep_records", "consequences"): lambda s: [x for x in re.findall(r"[A-Za-z0-9_]+", s) if x.strip("_")],
        ("rmats_mxe", "ijc_sample_1"): lambda s: re.findall(r"[0-9]+|NA", s),
    }
    expected = []
    for (name, field), f in cut.items():
        for r in pq.read_table(f"/root/testdata/{sf}/{name}.parquet", columns=["record_id", field]).to_pylist():
            expected += [(name, r["record_id"], field, i, v) for i, v in enumerate(f(r[field] or ""), 1)]
    assert got == sorted(expected)


def test_nulls_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, None, 0, "", ""), (2, "", 0, "", ""), (3, "x," * 20_000, 0, "", ""), (None, "a", 0, "", "")], SCHEMA)
    fields = {"annots": packed.LISTED}
    out = packed.split_packed(packed.packed_fields(df, "t", fields))
    assert out.where("record_id = 3").count() == 20_000
    assert out.where("record_id in (1, 2)").count() == 0
    assert out.where("record_id is null").count() == 1
    assert packed.split_packed(packed.packed_fields(df.limit(0), "t", fields)).count() == 0
