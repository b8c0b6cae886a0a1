"""Reducers, field maps and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from veldt.functions.gf64 import affine, affine_column, multiply
from veldt.functions.reducers import h_index, hll_estimate, hll_long, hll_union, hll_union_agg, mode_min

EDGE = [0, 1, -1, 2**62, -(2**63), 2**63 - 1]


def test_field_laws():
    r = random.Random(1)
    for _ in range(30):
        a, b, c = (r.randrange(-(2**63), 2**63) for _ in range(3))
        assert multiply(a, b) == multiply(b, a) and multiply(a, multiply(b, c)) == multiply(multiply(a, b), c)
        assert multiply(a, b ^ c) == multiply(a, b) ^ multiply(a, c)
        assert affine(0, b, c) == c and affine(a, 0, c) == c and affine(1, b, c) == b ^ c
        assert affine(a, b, c) == affine(a, b, 0) ^ c
    assert affine(-(2**63), 3, 0) == -(2**63) ^ 0x1B
    assert affine(None, 1, 1) is None and affine(1, None, 1) is None and affine(1, 1, None) is None


def test_affine_column(spark):
    r = random.Random(2)
    xs = EDGE + [r.randrange(-(2**63), 2**63) for _ in range(40)]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x long")
    for a, b in ((0, 5), (1, -7), (3, 0), (-(2**63), 9), (r.randrange(2**63), r.randrange(2**63))):
        got = {row.x: row.y for row in df.select("x", affine_column(a, F.col("x"), b).alias("y")).collect()}
        assert got == {x: affine(a, x, b) for x in xs} | {None: None}


@pytest.mark.parametrize(("given", "want"), [([3, 3, 3], 3), ([2, 2, 1], 2), ([5, 5, 5], 3), ([1], 1), ([10, 1], 1), ([], 0), ([0, 0], 0), ([-5, 3], 1), ([None, 2, 2], 2), (None, 0)])
def test_h_index(spark, given, want):
    assert spark.createDataFrame([(given,)], "x array<int>").select(h_index(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(("given", "want"), [([5, 5, 5, 3, 3], 5), ([5, 5, 2, 2], 2), ([1, 2, 3, 4, 4, 4, 2, 2], 2), ([], None), ([None, None, 4], 4)])
def test_mode_min(spark, given, want):
    df = spark.createDataFrame([(x,) for x in given], "x long")
    assert df.agg(mode_min(F.col("x"))).first()[0] == want


def test_sketches(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 0)], "x long, g int")
    one = hll_long(df, "x", 12)
    assert one.count() == 200 and {r[0] for r in one.select(hll_estimate(F.col("sketch"))).collect()} == {1.0}
    whole = one.agg(hll_union_agg(F.col("sketch")).alias("u")).select(hll_estimate(F.col("u")), hll_estimate(hll_union(F.col("u"), F.col("u"))), hll_estimate(hll_union(F.col("u"), F.lit(None).cast("binary")))).first()
    assert abs(whole[0] - 200) < 10 and whole[0] == whole[1] and whole[2] is None
    with pytest.raises(Exception, match="(?i)lg"):
        hll_long(df, "x", 22).collect()
