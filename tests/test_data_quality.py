"""Records that fail to parse, orphan references, heavy keys: against brute force, and hard cases."""

import random
import re
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.operators.delimited import DelimitedRecords, parse_batch
from veldt.operators.orphans import References, asof_missing, contiguous_runs, orphan_references
from veldt.operators.skew import _trim, degree_profile, heavy_hitters


def fields(body):
    """The fields of a record by a plain state machine; None for a quoting fault."""
    body = (body or "").removesuffix("\r")
    out, i, n = [], 0, len(body)
    while True:
        while i < n and body[i] in " \t":
            i += 1
        if i < n and body[i] == '"':
            value, i = "", i + 1
            while True:
                if i >= n:
                    return None
                if body[i] == '"' and body[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                elif body[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + body[i], i + 1
            while i < n and body[i] in " \t":
                i += 1
            if i < n and body[i] != ",":
                return None
            out.append(value)
        else:
            j = body.find(",", i) % (n + 1)
            if '"' in body[i:j]:
                return None
            out.append(body[i:j].strip(" \t"))
            i = j
        if i >= n:
            return out
        i += 1


def expected(body):
    f = fields(body)
    if f is None:
        return "quoting", None
    if len(f) != 4:
        return "columns", None
    for k, name in enumerate(("src", "dst")):
        if not re.fullmatch("[+-]?[0-9]+", f[k]) or not -(2**63) <= int(f[k]) < 2**63:
            return name, None
    if f[2] and (not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f[2]) or abs(float(f[2])) == float("inf")):
        return "weight", None
    return None, (int(f[0]), int(f[1]), float(f[2]) if f[2] else None, f[3])


def parsed(bodies):
    out = parse_batch(pa.array(bodies, pa.string()))
    return list(zip(out["reason"].to_pylist(), zip(*(out[c].to_pylist() for c in ("src", "dst", "weight", "label")), strict=True), strict=True))


PIECES = ["1", "22", '"', ",", " ", "\t", "\r", '""', "x", "-5", "+07", "1e5", "1e999", ".5", "5.", ".", str(2**63 - 1), str(2**63), str(-(2**63)), "\n", "é", '"3"', "0" * 30 + "7"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.none(), max_size=30))
def test_parser_against_state_machine(bodies):
    for body, (reason, values) in zip(bodies, parsed(bodies), strict=True):
        want, row = expected(body)
        assert reason == want, body
        if want is None:
            assert values == row


def test_parser_hard_cases():
    long = "9" * 100_000
    cases = {"": "columns", "\r": "columns", None: "columns", "1,2,,": None, f"{long},1,,": "src", "1,2,3,4,": "columns", '1,2,3,"a': "quoting", '1,2,3,a"b': "quoting", '1,2,3,"a"b': "quoting", '"1" , "2",3,"a,b"': None, "1,2,nan,x": "weight", "1,2,inf,x": "weight", "1,2,1e400,x": "weight", "x,y,z,w": "src", "1,y,z,w": "dst", "١,2,3,4": "src", "1;2;3;4": "columns", f"1,2,3,{long}": None}
    got = dict(zip(cases, (r for r, _ in parsed(list(cases))), strict=True))
    assert got == cases


def test_parser_on_frames(spark):
    df = spark.createDataFrame([(1, "1,2,0.5,a", "x"), (1, "1,2,0.5,a", "x"), (2, None, None), (3, "1,2", "y")], "line_id long, body string, src string")
    x = DelimitedRecords(df)
    assert sorted(map(tuple, x.valid().collect())) == [(1, 1, 2, 0.5, "a")] * 2
    assert sorted(map(tuple, x.rejects().collect())) == [(2, "columns"), (3, "columns")]
    assert DelimitedRecords(df.limit(0)).records.count() == 0
    with pytest.raises(ValueError, match="src"):
        DelimitedRecords(df, keys=("src",))


def day(n, hour=0):
    return datetime(2024, 1 + (n - 1) // 28, 1 + (n - 1) % 28, hour)


VERSIONS = "id long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, kind string"


def orphan_cases(versions, refs):
    out = set()
    for key, field, i, t in refs:
        if i is None:
            continue
        mine = [v for v in versions if v[0] == i]
        if not mine:
            out.add(("edges", key, field, "missing", t and t.strftime("%Y-%m")))
        elif t is not None:
            seen = [v for v in mine if v[1] is None or v[1] <= t]
            if not seen:
                out.add(("edges", key, field, "late", t.strftime("%Y-%m")))
            elif all(v[2] is not None and v[2] <= t for v in seen):
                out.add(("edges", key, field, "deleted", t.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize(("salt_rows", "broadcast_rows"), [(500_000, 400_000), (9, 400_000), (9, 0), (40, 20)])
def test_orphans_against_brute_force(spark, salt_rows, broadcast_rows):
    """Also with hot keys over several salts, and with suspects beyond the size check."""
    r = random.Random(5)
    versions = []
    for i in [x for x in range(-20, 60) if x % 7]:
        for _ in range(r.choice((1, 1, 1, 2, 3))):
            a = day(r.randrange(1, 100))
            versions.append((i, a, r.choice((None, None, day(r.randrange(1, 120)))), "k"))
    versions += [versions[0], (None, day(1), None, "k"), (1000, None, None, "k")]
    edges = [(k, r.choice((None, 13, *range(-25, 70))), 13 if k % 3 == 0 else r.randrange(-25, 1003), r.choice((None, *(day(n) for n in range(1, 120)))), 1.0) for k in range(400)]
    edges += edges[:5]
    v = spark.createDataFrame(versions, VERSIONS)
    e = spark.createDataFrame(edges, "edge_id long, src long, dst long, loaded_at timestamp_ntz, id double")
    refs = [(k, f, x, t) for k, s, d, t, _ in edges for f, x in (("src", s), ("dst", d))]
    got = orphan_references(v, [References(e, "edges", "edge_id", ("src", "dst"), "loaded_at")], block_bits=3, salt_rows=salt_rows, broadcast_rows=broadcast_rows)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == orphan_cases(versions, refs)


def test_orphans_of_empty_tables(spark):
    v = spark.createDataFrame([], VERSIONS)
    e = spark.createDataFrame([(1, 5, None, day(1))], "edge_id long, src long, dst long, loaded_at timestamp_ntz")
    ref = lambda df: [References(df, "edges", "edge_id", ("src", "dst"), "loaded_at")]
    assert [tuple(x) for x in orphan_references(v, ref(e)).collect()] == [("edges", 1, "src", "missing", "2024-01")]
    assert orphan_references(v, ref(e.limit(0))).count() == 0


def test_runs_and_asof(spark):
    keys = [-9, -8, -7, 0, 1, 2, 3, 8, 9, 15, 16, 2**62]
    runs = contiguous_runs(spark.createDataFrame([(k,) for k in keys + keys], "id long"), block_bits=3)
    assert sorted((r.run_start, r.run_end) for r in runs.collect()) == [(-9, -9), (-8, -7), (0, 3), (8, 9), (15, 15), (16, 16), (2**62, 2**62)]
    asked = list(range(-12, 20)) + [2**62, 2**62 + 1]
    got = asof_missing(runs, spark.createDataFrame([(k,) for k in asked], "id long"), block_bits=3)
    assert {r.id for r in got.collect() if not r.missing} == set(keys)


def test_sketch_error_bound():
    r = random.Random(3)
    import numpy as np

    values = np.array([int(r.paretovariate(0.6)) for _ in range(20_000)])
    m = 50
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in np.array_split(values, 37):
        kept = _trim(np.concatenate([kept[0], part]), np.concatenate([kept[1], np.ones(len(part), np.int64)]), m)
        assert len(kept[0]) <= m
    found = dict(zip(kept[0].tolist(), kept[1].tolist(), strict=True))
    true = {int(v): int(n) for v, n in zip(*np.unique(values, return_counts=True), strict=True)}
    for v, n in true.items():
        assert n - len(values) / (m + 1) <= found.get(v, 0) <= n


def test_heavy_hitters_and_profile(spark):
    r = random.Random(9)
    rows = [(7 if k % 3 == 0 else r.randrange(200), r.choice((None, 1, 1, 2, *range(50))), r.choice((None, 1.5, -2.0, float("nan"), float("inf"))), "id") for k in range(3000)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double, id string")
    for share in (0.01, 0.05, 0.4):
        want = {(s, i) for s, c in (("src", 0), ("dst", 1)) for i in {x[c] for x in rows} - {None} if sum(x[c] == i for x in rows) >= share * len(rows)}
        assert {(x.side, x.id) for x in heavy_hitters(df, ["src", "dst"], share).collect()} == want
    for heavy in (0.001, 0.2):
        got = {(x.side, x.id): tuple(x)[2:] for x in degree_profile(df, heavy_share=heavy).collect()}
        for side, c in (("src", 0), ("dst", 1)):
            for i in {x[c] for x in rows} - {None}:
                mine = [x for x in rows if x[c] == i]
                w = [x[2] for x in mine if x[2] is not None and abs(x[2]) < 10]
                degree, weighted, total, near = got.pop((side, i))
                assert (degree, weighted, near) == (len(mine), len(w), len({x[1 - c] for x in mine} - {None}))
                assert (total is None and not w) or abs(total - sum(w)) < 1e-9
        assert not got
    assert heavy_hitters(df.limit(0), ["src"], 0.01).count() == 0 and degree_profile(df.limit(0)).count() == 0


def test_orphans_of_an_id_deleted_very_often(spark):
    """10^5 lifetimes of one id are 10^5 rows, never one value; half of its references fall between two."""
    n = 100_000
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    at = lambda minutes: start + F.make_dt_interval(mins=minutes)
    k = F.col("id").cast("int")
    v = spark.range(n).select(F.lit(5).cast("long").alias("id"), at(4 * k).alias("loaded_at"), at(4 * k + 2).alias("deleted_at"))
    e = spark.range(1000).select(F.col("id").alias("edge_id"), F.lit(5).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), at(398 * k + 1).alias("loaded_at"))
    found = orphan_references(v, [References(e, "edges", "edge_id", ("src", "dst"), "loaded_at")], salt_rows=100)
    got = {r.ref_key: r.cause for r in found.collect()}
    assert got == {i: "deleted" for i in range(1000) if (398 * i + 1) % 4 >= 2}
    assert "collect_" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_profile_shuffles_light_keys_once(spark):
    df = spark.createDataFrame([(k % 5, k % 17, 1.0) for k in range(100)], "src long, dst long, weight double")
    plan = degree_profile(df)._jdf.queryExecution().executedPlan().toString()
    light, heavy = plan.split("LeftSemi")[0], plan.count("Exchange hashpartitioning")
    assert light.count("REPARTITION_BY_COL") == 1 and heavy == 3  # one of light keys, two of heavy ones
