"""Orphans, drift and heavy keys: small cases and brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ribospark.operators import drift, heavy_keys, orphans

T0 = datetime(2024, 1, 1)


# --- orphans ---

REF = "id int, a string, b string, at timestamp_ntz, added timestamp_ntz, __tmask string"
TGT = "a string, b string, added timestamp_ntz, retired timestamp_ntz, at string"


def holds(semantics, ref, targets):
    """Whether a reference is no orphan."""
    if ref == (None, None):
        return True
    if None in ref and semantics in ("simple", "full"):
        return semantics == "simple"
    if semantics == "partial":
        return any(all(x is None or x == y for x, y in zip(ref, t, strict=True)) for t in targets)
    return ref in targets


@pytest.mark.parametrize("semantics", orphans.SEMANTICS)
def test_partly_null_keys(spark, semantics):
    values = [None, "x", "y"]
    refs = [(a, b) for a in values for b in values]
    targets = [("x", "x"), ("y", None), ("x", "x"), (None, "y")]
    r = spark.createDataFrame([(i, a, b, T0, T0, "") for i, (a, b) in enumerate(refs * 2)], REF)
    t = spark.createDataFrame([(a, b, T0, None, "") for a, b in targets], TGT)
    found = sorted(x.id for x in orphans.orphan_references(r, t, ["a", "b"], semantics).collect())
    assert found == [i for i, ref in enumerate(refs * 2) if not holds(semantics, ref, targets)]


def test_life_spans_and_empty_tables(spark):
    day = timedelta(days=1)
    t = spark.createDataFrame([("x", None, T0, T0 + day, ""), ("x", None, T0 + 3 * day, None, ""), ("x", None, T0 + 3 * day, None, "")], TGT)
    times = [T0 - day, T0, T0 + day, T0 + 2 * day, T0 + 3 * day, None]
    r = spark.createDataFrame([(i, "x", None, at, T0, "") for i, at in enumerate(times)], REF)
    out = orphans.orphan_references(r, t, ["a", "b"], "exact", "at", ("added", "retired"))
    assert sorted(x.id for x in out.collect()) == [0, 2, 3, 5]
    assert orphans.orphan_references(r, t.limit(0), ["a", "b"], "exact").count() == 6
    assert orphans.orphan_references(r.limit(0), t, ["a", "b"]).count() == 0
    with pytest.raises(ValueError, match="semantics"):
        orphans.orphan_references(r, t, ["a"], "other")


# --- drift ---

LINES = "stream_id string, file_id string, tool string, delivered_at timestamp_ntz, line_no int, line string, seq string"


def lines(spark, *files):
    rows = []
    for k, (head, *body) in enumerate(files):
        rows += [("s", f"f{k}", "t", T0 + timedelta(days=k), n, x, "") for n, x in enumerate([head, *body], 1)]
    return spark.createDataFrame(rows, LINES)


def changes(spark, *files):
    return sorted((r.file_id, r.field_name, r.change_kind) for r in drift.schema_changes(lines(spark, *files)).collect())


def test_kinds_of_change(spark):
    assert changes(spark, ("#a\tb\tc", "1\tx\t2"), ("#a\tb2\tc", "1\ty\t2.5")) == [("f1", "b2", "renamed"), ("f1", "c", "retyped")]
    assert changes(spark, ("#a\tb", "1\tx"), ("#a\tn", "1\t3")) == [("f1", "b", "removed"), ("f1", "n", "added")]
    assert changes(spark, ("#a\tb\tc", "1\t2\t3"), ("#c\ta\tz", "1\t2\t3")) == [("f1", "b", "removed"), ("f1", "z", "added")]
    assert changes(spark, ("#a\tb\tc", "1\t2\t3"), ("#a\tx\ty\tc", "1\t2\t3\t4")) == [("f1", "b", "removed"), ("f1", "x", "added"), ("f1", "y", "added")]
    assert changes(spark, ("# a\t b ", "1\t2"), ("#b\ta", "1\t2")) == []


def test_a_column_without_values_keeps_its_type(spark):
    files = (("#a\tb", "1\t2"), ("#a\tb", "1\tNA"), ("#a\tb", "1\t"), ("#a\tb", "1\tx"))
    assert changes(spark, *files) == [("f3", "b", "retyped")]
    assert changes(spark, ("#a\tb", "1\t2"), ("#a\tb",), ("#a\tB", "1\t5")) == [("f2", "B", "renamed")]


def test_unified_table(spark):
    df = lines(spark, ("#a\tb", "1\tx", "2\tNA"), ("#a\tb2\td", "1.5\ty\t\r"), ("#b2\td\tfile_id", "z\t5\tq"))
    rows = {(r.file_id, r.line_no): r for r in drift.unified_table(df).collect()}
    assert (rows["f0", 2].a, rows["f0", 2].b, rows["f0", 3].b) == (1.0, "x", None)
    assert (rows["f1", 2].a, rows["f1", 2].b2, rows["f2", 2].b2, rows["f2", 2].file_id_) == (1.5, "y", "z", "q")
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_unified_table_keeps_columns_of_one_name(spark):
    df = lines(spark, ("#a\tX", "1\t2"), ("#a\tY", "3\t4"), ("#a\tY\tX", "5\t6\t7"), ("#a\tX", "8\t9"))
    rows = {r.file_id: r.asDict() for r in drift.unified_table(df).collect()}
    got = {f: (r["a"], r["X"], r["X#2"]) for f, r in rows.items()}
    assert got == {"f0": (1, 2, None), "f1": (3, 4, None), "f2": (5, 6, 7), "f3": (8, None, 9)}
    twice = lines(spark, ("#a\ta\ta#2\tb", "1\t2\t3\tx"), ("#a\ta\ta\ta#2\tb", "4\t5\t6\t7\ty"))
    rows = sorted(drift.unified_table(twice).collect(), key=lambda r: r.file_id)
    assert [(r["a"], r["a#3"], r["a#2"], r["b"]) for r in rows] == [(1, 2, 3, "x"), (4, 5, 7, "y")]
    assert rows[1]["a#4"] == 6
    case = drift.unified_table(lines(spark, ("#b\tB", "1\tx"), ("#b\tB", "2\ty")))
    assert len({c.lower() for c in case.columns}) == len(case.columns)
    assert sorted((r["b"], r["B#2"]) for r in case.collect()) == [(1, "x"), (2, "y")]


def test_one_name_across_streams(spark):
    """A rename in one stream names the column of the others; names that some file has side by side stay apart."""
    a = lines(spark, ("#x\test_J", "1\t2"), ("#x\tEST_J", "1\t3"), ("#x\tjunctions", "1\t4"))
    b = lines(spark, ("#x\tEST_J", "5\t6")).withColumn("stream_id", F.lit("u")).withColumn("file_id", F.lit("g"))
    c = lines(spark, ("#junctions\tx", "7\t8"), ("#other\tx", "9\t8"), ("#other\tx\tjunctions", "9\t8\t3"))
    c = c.withColumn("stream_id", F.lit("w")).withColumn("file_id", F.concat(F.lit("h"), "file_id"))
    out = drift.unified_table(a.unionByName(b).unionByName(c))
    rows = {r.file_id: r.asDict() for r in out.collect()}
    assert {f: r["junctions"] for f, r in rows.items()} == {"f0": 2, "f1": 3, "f2": 4, "g": 6, "hf0": 7, "hf1": 9, "hf2": 9}
    assert rows["hf2"]["junctions#2"] == 3 and sorted(out.columns) == sorted(["file_id", "stream_id", "tool", "line_no", "junctions", "x", "junctions#2"])
    out.write.format("noop").mode("overwrite").save()


def test_repeated_names_in_a_header(spark):
    out = drift.unified_table(lines(spark, ("#a\tb\ta", "1\tx\t7"), ("#a\tb\ta", "2\ty\t8")))
    assert sorted((r["a"], r["b"], r["a#2"]) for r in out.collect()) == [(1, "x", 7), (2, "y", 8)]


def test_drift_against_a_plain_fold(spark):
    path = "/root/testdata/sf0.01/drift_lines.parquet"
    streams = defaultdict(lambda: defaultdict(list))
    for r in pq.read_table(path).to_pylist():
        streams[r["stream_id"]][r["delivered_at"], r["file_id"]].append((r["line_no"], r["line"]))

    def rank(v):
        v = v.strip()
        if v in ("", "NA"):
            return 0
        body = v.lstrip("+-")
        if body.isdigit():
            return 1
        try:
            float(v)
            return 3 if any(c in v.lower() for c in ("n", "f", "_")) else 2
        except ValueError:
            return 3

    expected = []
    for files in streams.values():
        last = None
        for (_, file_id), rows in sorted(files.items()):
            rows.sort()
            names = [x.strip(" #") for x in rows[0][1].split("\t")]
            cells = [x.split("\t") for _, x in rows[1:]]
            types = {n: max((rank(c[i]) for c in cells), default=0) for i, n in enumerate(names)}
            if last is not None:
                old, had = last
                shared = [n for n in names if n in had]
                kept = [n for n in old if n in types] == shared
                pairs = {}
                if kept:
                    bounds = [None, *shared, None]
                    for lo, hi in zip(bounds, bounds[1:], strict=False):
                        def between(seq, lo=lo, hi=hi):
                            return seq[(seq.index(lo) + 1 if lo else 0) : (seq.index(hi) if hi else len(seq))]

                        gone, new = between(old), between(names)
                        if len(gone) == len(new):
                            pairs |= {b: a for a, b in zip(gone, new, strict=True) if 0 in (had[a], types[b]) or (had[a] == 3) == (types[b] == 3)}
                expected += [(file_id, n, "removed") for n in old if n not in types and n not in pairs.values()]
                for n in names:
                    before = n if n in had else pairs.get(n)
                    if before is None:
                        expected.append((file_id, n, "added"))
                        continue
                    if before != n:
                        expected.append((file_id, n, "renamed"))
                    if types[n] and had[before] and types[n] != had[before]:
                        expected.append((file_id, n, "retyped"))
                    types[n] = types[n] or had[before]
            last = (names, types)
    got = [(r.file_id, r.field_name, r.change_kind) for r in drift.schema_changes(spark.read.parquet(path)).collect()]
    assert sorted(got) == sorted(expected)


# --- heavy keys ---

DISPATCH = "dispatch_id bigint, tx_id string, n_variants int, n_fusions int, n_circ int, succeeded boolean, elapsed_ms double, dispatched_at timestamp_ntz, at_us string, pieces string"


def test_heavy_keys_and_gaps(spark):
    rnd = random.Random(4)
    rows, expected = [], defaultdict(list)
    for i in range(3_000):
        key = rnd.choice(["hot", " HOT ", "b", None, "", "-", f"k{i % 40}"])
        at = None if rnd.random() < 0.05 else T0 + timedelta(seconds=rnd.randint(0, 10**6))
        rows.append((i, key, rnd.choice([None, 1, 2]), 1, 0, rnd.choice([True, False, None]), 1.5, at, "", ""))
        clean = (key or "").strip().upper()
        if clean not in ("", "-"):
            expected[clean].append(rows[-1])
    df = spark.createDataFrame(rows, DISPATCH).repartition(7)
    got = {r.tx_id: r for r in heavy_keys.per_key(df).collect()}
    assert set(got) == set(expected)
    for key, own in expected.items():
        times = sorted(r[7] for r in own if r[7])
        gap = max(((b - a) // timedelta(microseconds=1) for a, b in zip(times, times[1:], strict=False)), default=0)
        r = got[key]
        assert (r.n_dispatches, r.sum_variants, r.longest_gap_us) == (len(own), sum(x[2] or 0 for x in own), gap)
        assert (r.first_at, r.last_at, r.n_succeeded) == (times[0] if times else None, times[-1] if times else None, sum(x[5] is True for x in own))
    heavy = {r.tx_id for r in heavy_keys.heavy_keys(df).collect()}
    assert heavy == {k for k, own in expected.items() if len(own) * 100 > len(rows)}
    assert heavy_keys.per_key(df.limit(0)).count() == 0


def test_a_heavy_key_is_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).selectExpr(
            "id dispatch_id", "if(id % 3 = 0, concat('k', id % 50), 'HOT') tx_id", "1 n_variants", "0 n_fusions", "0 n_circ", "true succeeded", "1.0D elapsed_ms",
            "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) dispatched_at",
        )
        pieces = {r.tx_id: r["count"] for r in heavy_keys.boundary_states(df).groupBy("tx_id").count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert pieces["HOT"] >= 2
