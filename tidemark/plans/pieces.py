"""Very long series in pieces: operators that look back a bounded number of rows need not keep a series in one task.

Rows are numbered without gathering a series: they are dealt by range of key and order, counted per range, and numbered from the sums of
the ranges before. A series is then cut into pieces of ``rows`` rows, each preceded by as many rows of the one before as any of the
features looks back; the pieces run like series of their own and the extra rows go. With a third of all rows in one
series, its work spreads over rows / ``rows`` tasks, at a replication of 1 + look-back / ``rows``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from inspect import signature

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import KERNELS, WINDOWS, Feature, features, named
from ..plans.ordered import Frame

#: Operators over all rows so far, or with a state of their own: these stay whole.
_WHOLE = {"GlostenMilgrom", "PageHinkley", "PortfolioReturns"}


def look_back(feature: Feature) -> int:
    """How many rows before its own an output depends on; ValueError where that is not bounded."""
    name, p = named(feature.operator), feature.params
    if name in KERNELS:
        kernel = KERNELS[name](**p)
        if not isinstance(kernel, Frame) or kernel.begin() is not None:
            raise ValueError(f"{name} carries a state through the whole series")
        return kernel.window - 1
    if name not in WINDOWS:
        return 0
    if name in _WHOLE:
        raise ValueError(f"{name} depends on all rows so far")
    given = {n: p.get(n, v.default) for n, v in signature(WINDOWS[name]).parameters.items()}
    sizes = [int(given[n]) for n in ("period", "window", "noise_window", "beta_window", "stability_window") if n in given]
    return sum(sizes) * int(given.get("passes", 1)) + 3  # three more for lags


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``, the place of each row in its series from 1. The dealt rows are checkpointed, so that a retry sees the same ranges."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))  # one machine: the cluster names its own
    at = [*key, *order]
    dealt = df.repartitionByRange(*at) if ranges is None else df.repartitionByRange(ranges, *at)
    dealt = dealt.withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    own = [f"__own{i}" for i in range(len(key))]
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).select(*[F.col(k).alias(o) for k, o in zip(key, own, strict=True)], F.col("__range").alias("__of"), "__before")
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(key, own, strict=True)] + [F.col("__range") == F.col("__of")]
    joined = dealt.join(counts, on).drop("__of", *own)
    inside = F.row_number().over(Window.partitionBy(*key, "__range").orderBy(*order))
    return joined.withColumn(out, (F.col("__before") + inside).cast("long")).drop("__range", "__before")


def features_in_pieces(df: DataFrame, key: Sequence[str], order: Sequence[str], wanted: Sequence[Feature], rows: int = 100_000, check: bool = True) -> DataFrame:
    """What ``features`` gives, for features that look back a bounded number of rows, with no series in one task."""
    back = max((look_back(f) for f in wanted), default=0)
    if rows <= back:
        raise ValueError(f"pieces must be longer than the {back} rows the features look back")
    seq, piece = F.col("__seq"), F.floor((F.col("__seq") - 1) / rows).cast("long")
    cut = numbered(df, key, order, "__seq").withColumn("__own", piece)
    near_end = (seq - 1) % rows >= rows - back
    cut = cut.withColumn("__piece", F.explode(F.when(near_end, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    out = features(cut, [*key, "__piece"], ["__seq"], wanted, check, number="__seq")
    return out.filter("__piece = __own").drop("__seq", "__own", "__piece")
