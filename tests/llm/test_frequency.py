"""Term frequencies: containers, merging and the defined corner cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ribospark.llm import frequency as fq

SCHEMA = "field_name string, record_id bigint, term string, n_records string, high string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535), max_size=300), min_size=1, max_size=5), st.booleans())
def test_union_is_set_union(sets, dense):
    if dense:
        sets = [s | set(range(0, 60000, 7)) for s in sets]
    packed = [fq.pack(np.array(sorted(s), np.uint16)) for s in sets]
    whole = fq.union(packed)
    assert set(fq.unpack(whole).tolist()) == set().union(*sets)
    assert fq.cardinality(whole) == len(set().union(*sets))
    assert len(whole) <= 8193


def counted(df):
    return {(r.field_name, r.term): (r.n_occurrences, r.n_records) for r in fq.term_frequencies(df).collect()}


def test_repeats_nulls_and_ranges(spark):
    rows = [("f", i * 40_000, "a") for i in range(50)] + [("f", 0, "a"), ("f", 0, "b"), ("f", None, "b"), ("f", 3, None), ("g", -5, "a"), ("g", -5, "a")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert counted(df) == {("f", "a"): (51, 50), ("f", "b"): (2, 1), ("g", "a"): (2, 1)}
    assert counted(df.limit(0)) == {}


@pytest.mark.parametrize("flush", [7, 10**6])
def test_a_term_in_most_records(spark, monkeypatch, flush):
    monkeypatch.setattr(fq, "FLUSH", flush)
    df = spark.range(30_000).selectExpr("'f' field_name", "id record_id", "if(id % 3 = 0, 'hot', concat('t', id % 997)) term", "'' n_records", "'' high")
    got = counted(df)
    assert got["f", "hot"] == (10_000, 10_000)
    assert sum(n for n, _ in got.values()) == 30_000


def test_marks(spark):
    df = spark.createDataFrame([("f", i, "big" if i < 5 else f"t{i % 3}", "", "") for i in range(20)], SCHEMA)
    totals = spark.createDataFrame([("f", 20)], "field_name string, n_rows bigint")
    marks = {r.term: r.mark for r in fq.marked(fq.term_frequencies(df), totals).collect()}
    assert marks == {"big": "common", "t0": "common", "t1": "common", "t2": "common"}
    few = {r.term: r.mark for r in fq.marked(fq.term_frequencies(df.where("record_id < 8")), totals).collect()}
    assert few == {"big": "common", "t0": "rare", "t1": "rare", "t2": "rare"}
