"""The importance network in batches of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from precis.operators import network as NW


def test_network_passes_batches_of_rows(spark):
    net = NW.fixed_network()
    rnd = random.Random(3)
    rows = [(i, *[rnd.uniform(-1, 2) for _ in range(5)]) for i in range(2 * NW.CHUNK + 5)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double").coalesce(1)
    out = df.select("i", net.apply(*[F.col(c) for c in "abcde"]).alias("p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    got = {r.i: r.p for r in out.collect()}
    for i, *x in rows:
        assert got[i] == pytest.approx(net.score(x), abs=1e-12)
    assert df.limit(0).select(net.apply(*[F.col(c) for c in "abcde"])).count() == 0


@pytest.mark.parametrize("first", ["relu", "sigmoid", "linear"])
def test_network_of_missing_and_extreme_features(spark, first):
    """A null feature gives no sum; relu makes 0 of it, as greatest() does."""
    net = NW.Network((NW.Layer(((1.0, 2.0), (3.0, -1.0)), (0.5, 0.0), first), NW.Layer(((1.0, -1.0),), (0.25,), "sigmoid")))
    df = spark.createDataFrame([(0, None, 1.0), (1, math.nan, 1.0), (2, 1e9, -1e9), (3, 1.0, 2.0)], "i int, a double, b double")
    got = {r.i: r.p for r in df.select("i", net.apply(F.col("a"), F.col("b")).alias("p")).collect()}
    assert got[0] == (pytest.approx(1 / (1 + math.exp(-0.25))) if first == "relu" else None)
    assert math.isnan(got[1]) and 0.0 <= got[2] <= 1.0
    assert got[3] == pytest.approx(net.score([1.0, 2.0]), abs=1e-12)
