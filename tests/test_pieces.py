import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import Feature, features
from tidemark.plans.pieces import features_in_pieces, look_back, numbered

WANTED = [
    Feature("RollingVolatility", ["x"], "v", {"period": 20}),
    Feature("KolmogorovZurbenko", ["x"], "k", {"window": 5}),
    Feature("Periodogram", ["x"], "p", {"window": 16, "update_every": 5}),
    Feature("EntropicVaR", ["x"], "e", {"window": 30, "update_every": 7}),
    Feature("FlemingOstdiekWhaleyVIX", ["x"], "f", {}),
]


def test_pieces_equal_whole(spark):
    rows = [("hot", i, math.sin(i * 0.7) + 0.1 * (i % 5)) for i in range(1000)] + [("cold", i, math.cos(i)) for i in range(45)]
    df = spark.createDataFrame(rows, ["series", "t", "x"])
    order = [F.col("series"), F.col("t")]
    whole = features(df, ["series"], ["t"], WANTED).orderBy(*order).collect()
    cut = features_in_pieces(df.repartition(6), ["series"], ["t"], WANTED, rows=90).orderBy(*order).collect()
    assert len(whole) == len(cut)
    for a, b in zip(whole, cut):
        assert a.asDict().keys() == b.asDict().keys()
        for c in ("v", "k", "e", "f"):
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or a[c] == pytest.approx(b[c], rel=1e-9))
        assert (a.p is None) == (b.p is None) and (a.p is None or a.p["power"] == pytest.approx(b.p["power"], rel=1e-9))


def test_numbers(spark):
    df = spark.createDataFrame([(k, t) for k in ("a", "b", None) for t in range(137)], "series string, t long")
    got = numbered(df.orderBy(F.rand(3)), ["series"], ["t"], "n", 7).collect()
    assert all(r.n == r.t + 1 for r in got) and len(got) == 411


def test_unbounded_operators_are_refused():
    for f in (Feature("Garch", ["x"], "g"), Feature("WelchPsd", ["x"], "w"), Feature("PageHinkley", ["x"], "h")):
        with pytest.raises(ValueError):
            look_back(f)
