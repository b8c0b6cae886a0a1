"""Top N per group, distinct counts, linked groups: against brute force, and hard cases."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm.groups import decompose, group_sizes, link_groups
from veldt.llm.kmv import _spread, compress, cube_sets, distinct_counts, distinct_cube, estimate, hash63, merge_cube, overlap, sketch_groups
from veldt.llm.topn import top_n
from veldt.plans.materialize import Scratch


@pytest.mark.parametrize("heavy_rows", [5, 60, 100_000])
def test_top_n_against_brute_force(spark, heavy_rows):
    r = random.Random(4)
    odd = (None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -1.5)
    rows = [(1 if k % 3 == 0 else r.choice((None, *range(2, 30))), r.choice((None, *range(40))), r.choice((*odd, *(x / 4 for x in range(8)))), "x") for k in range(900)]
    df = spark.createDataFrame(rows + rows[:50], "community long, id long, pagerank double, score string")
    best = {}
    for c, i, s, _ in rows:
        if None not in (c, i, s) and np.isfinite(s):
            best[c, i] = max(best.get((c, i), -1e9), s)
    want = set()
    for c in {c for c, _ in best}:
        for rank, (_, i) in enumerate(sorted((-s, i) for (g, i), s in best.items() if g == c)[:10]):
            want.add((c, i, best[c, i], rank + 1))
    got = [tuple(x) for x in top_n(df, "community", "id", "pagerank", 10, heavy_rows).collect()]
    assert len(got) == len(want) and set(got) == want
    assert top_n(df.limit(0), "community", "id", "pagerank").count() == 0


def test_sketch_algebra():
    r = np.random.default_rng(1)
    a, b, c = (np.unique(hash63(r.integers(0, 5000, n))) for n in (3000, 2000, 10))
    k = 64
    merge = lambda x, y: np.union1d(x[:k], y[:k])[:k]
    assert (merge(a, b) == merge(b, a)).all() and (merge(merge(a, b), c) == merge(a, merge(b, c))).all() and (merge(a, a) == a[:k]).all()
    assert (merge(a, b) == np.union1d(a, b)[:k]).all()
    assert estimate(c, k) == (10.0, 10.0, 10.0, 1.0)
    assert estimate(np.zeros(0, np.uint64), k)[0] == 0


def test_estimates_keep_their_bounds():
    r, k, within, trials = np.random.default_rng(2), 256, 0, 200
    for t in range(trials):
        ids = r.integers(-(2**62), 2**62, 5000)
        mid, low, high, _ = estimate(np.sort(hash63(np.unique(ids)))[:k], k)
        within += low <= len(np.unique(ids)) <= high
        assert abs(mid / 5000 - 1) < 0.4
    assert within >= 0.9 * trials
    a, b = np.sort(hash63(np.arange(4000))), np.sort(hash63(np.arange(1000, 6000)))
    x = overlap(a[:k], b[:k], k)
    for name, true in (("both", 3000), ("a_only", 1000), ("b_only", 2000)):
        assert x[name][1] <= true <= x[name][2]


def test_compress_keeps_known_values_too():
    h = np.arange(1, 21, dtype=np.uint64)
    known = (np.arange(20) >= 12).astype(np.uint64)
    g, e = compress(np.zeros(40, np.int64), np.concatenate([h * 2 + known] * 2), 5)
    assert (e // 2).tolist() == [1, 2, 3, 4, 5, 13, 14, 15, 16, 17]
    g, e = compress(np.zeros(2, np.int64), np.array([6, 7], np.uint64), 5)
    assert e.tolist() == [7]


def edges(r, n):
    return [(r.choice((None, *(date(2024, 1, d) for d in range(1, 9)))), r.choice((None, "a", "b")), r.choice(("x", "y")), r.choice((None, *range(60))), r.choice((None, *range(-10, 90)))) for _ in range(n)]


def test_distinct_cube_is_exact_for_small_groups(spark):
    r = random.Random(6)
    rows = edges(r, 1500)
    df = spark.createDataFrame(rows + rows[:99], "day date, relation string, feed string, src long, dst long").withColumn("sketch", F.lit(1)).repartition(3)
    parents = spark.createDataFrame([(i,) for i in [None, *range(0, 80, 2), 4]], "id long")
    dims = ["day", "relation", "feed"]
    got = {(x.by, x.day, x.relation, x.feed, x.what, x.scope): (x.estimate, x.lower, x.upper) for x in distinct_cube(df, dims, ("src", "dst"), parents, k=512).collect()}
    n = 0
    for dims_ in cube_sets(dims):
        groups = {}
        for row in rows:
            key = tuple(v if d in dims_ else None for d, v in zip(dims, row, strict=False))
            s, t = groups.setdefault(key, (set(), set()))
            s.update({row[3]} - {None})
            t.update({row[4]} - {None})
        for key, (s, t) in groups.items():
            for scope in ("all", "known"):
                a, b = (x if scope == "all" else {i for i in x if 0 <= i < 80 and i % 2 == 0} for x in (s, t))
                for what, want in (("src", a), ("dst", b), ("union", a | b), ("both", a & b), ("src_only", a - b), ("dst_only", b - a)):
                    if s or t:
                        assert got[",".join(dims_), *key, what, scope] == (len(want),) * 3
                        n += 1
    assert n == len(got)


def test_partial_sketches_merge_across_days(spark):
    """Sketches made apart and merged equal those made together."""
    r = random.Random(7)
    df = spark.createDataFrame([(date(2024, 1, 1 + k % 5), r.randrange(3000), r.randrange(3000)) for k in range(6000)], "day date, src long, dst long")
    dims, sides, k = ["day"], ("src", "dst"), 128
    sets = [("day",), ()]
    rows = lambda p: sorted(tuple(x) for x in distinct_counts(merge_cube(p, dims, sides, k, sets), dims, sides, k).collect() if x.by == "")
    whole = sketch_groups(df, dims, sides, k)
    parts = sketch_groups(df.filter("day <= '2024-01-02'"), dims, sides, k).union(sketch_groups(df.filter("day > '2024-01-02'"), dims, sides, k))
    assert rows(whole) == rows(parts)
    true = {"src": df.select("src").distinct().count(), "dst": df.select("dst").distinct().count()}
    for x in rows(whole):
        if x[2] in true and x[3] == "all":
            assert abs(x[4] / true[x[2]] - 1) < 0.35 and x[5] < x[4] < x[6]


def test_a_day_of_nine_tenths_is_merged_over_several_tasks(spark):
    """Its partial sketches are spread by a salt and merged there; what goes on are a few per group, and the result is the same."""
    r = random.Random(17)
    rows = [(date(2024, 1, 1) if k % 10 else date(2024, 1, 2 + k // 1000), r.choice("ab"), r.randrange(5000), r.randrange(5000)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "day date, relation string, src long, dst long").repartition(40).sortWithinPartitions("src")
    dims, sides, k, sets = ["day", "relation"], ("src", "dst"), 64, [("day", "relation"), ("day",), ()]
    partials = Scratch(spark, "test").write(sketch_groups(df, dims, sides, k), "partials")
    hot = F.col("day") == date(2024, 1, 1)
    spread = _spread(partials, dims, sides, k, 20_000)
    before, after = partials.filter(hot).count(), spread.filter(hot).count()
    assert before == 80 and after < before / 2 and spread.filter(~hot).count() == partials.filter(~hot).count()
    sizes = [x.n for x in spread.filter(hot).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 0.9 * after
    found = lambda b: sorted(tuple(x) for x in distinct_counts(merge_cube(partials, dims, sides, k, sets, b), dims, sides, k).toPandas().fillna("").itertuples(index=False))
    assert found(20_000) == found(10**12)


def test_distinct_cube_of_empty_table(spark):
    df = spark.createDataFrame([], "day date, src long, dst long")
    assert distinct_cube(df, ["day"], ("src", "dst"), spark.createDataFrame([], "id long")).count() == 0


@pytest.mark.parametrize(("last_links", "hub_rows"), [(5_000, None), (0, None), (60, 50)])
def test_link_groups(spark, last_links, hub_rows):
    """Within one task, by distributed levels alone, and by both with hubs apart."""
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1100)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(120)] + [(-5, -7), (-7, -5), (9999, 9999), (None, 3), (4, None), (5, 6), (2**62, -(2**62))]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for a, b in pairs:
        if None not in (a, b) and a != b:
            linked |= {a, b}
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "src long, dst long, component string")
    got = link_groups(df, last_links=last_links, hub_rows=hub_rows)
    rows = got.collect()
    assert len(rows) == len(linked) and {x.id: x.component for x in rows} == {i: top(i) for i in linked}
    sizes = {x.size: x.groups for x in group_sizes(got).collect()}
    assert sizes[61] == 1 and sizes[100] == 1


def test_decomposition_of_a_long_path_and_a_star():
    n = 3000
    a = np.r_[np.arange(n), np.full(500, 10_000)]
    b = np.r_[np.arange(1, n + 1), np.arange(10_001, 10_501)]
    ids, center = decompose(a, b, 5, 0.3, 42)
    assert len(ids) == n + 1 + 501 and len(set(center[ids <= n])) == 1 and len(set(center[ids > n])) == 1
    assert set(center) <= set(ids)


def test_link_groups_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")
    assert link_groups(df).count() == 0 and link_groups(df.limit(0)).columns == ["id", "component"]
