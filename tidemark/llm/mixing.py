"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

A document's size is its number of whitespace-delimited words. Sources in code-point order (null last) weigh
1, 2, 3, 1, 2, 3, ... and share the total of all sizes; a source's target stops at three times its size and the excess is
shared again by weight, which ends at target = min(3 * size, level * weight) for one common level.
A source with target t and size S takes every document t / S times in expectation: the whole part of that is taken
outright, and the fractional parts are rounded together. Two fractional documents exchange expected words, in a
random direction that keeps both expectations, until one of them is all in or all out;
the words of a source are preserved exactly, so only the last fractional document of a source can move it off its target.

The tree: leaves are (source, salt) groups of about ``LEAF`` documents, each leaving at most one fractional document;
``FAN`` neighbours combine at a time until one is left per source. Documents go by falling size, so that the one left is small.
All draws are seeded by source, salt and level, so reruns agree whatever the partitioning.

Nulls and edge cases: null or wordless text has size 0 and takes 0. A null source is a source of its own. Rows are dealt to salts by doc_id and text, so
rows without a doc_id spread like others. Rows that repeat a doc_id are rounded apart in the query. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, unused

LEAF, FAN, MOST_COPIES, LARGE = 4096, 32, 3, 0.01
_FIELDS = "doc_id long, source string, size long, mark long, source_size long, target double, salt long, mass double, extra int"


def with_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``; one row per source passes through a single window."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    cap = (most * F.col("source_size")).cast("double")
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    # were all before it at their caps, this would be the level of the rest
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("free", F.when(F.col("level") * F.col("weight") <= cap, F.col("level")))
    level = F.first("free", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def pivot(sizes: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Masses after pairing: each 0 or its size, but one at most. They keep their sum, and each its expectation.

    A document above ``LARGE`` of all that follow it is paired with those together, in proportion to what each
    can give or take, so that no long document is the one left over; the others pair one with one.
    """
    mass, held = mass.copy(), -1
    draws, first = rng.random(len(mass)), 0
    for j in np.flatnonzero((mass > 0) & (mass < sizes)):
        rest, room = mass[j + 1 :], sizes[j + 1 :] - mass[j + 1 :]
        gain, loss = sizes[j] - mass[j], mass[j]
        if sizes[j] <= LARGE * sizes[j + 1 :].sum() or gain > rest.sum() or loss > room.sum():
            break
        if draws[j] * sizes[j] < mass[j]:
            mass[j] = sizes[j]
            rest -= rest * (gain / rest.sum())
        else:
            mass[j] = 0.0
            rest += room * (loss / room.sum())
        first = j + 1
    for j in range(first, len(mass)):
        if not 0 < mass[j] < sizes[j]:
            continue
        if held < 0:
            held = j
            continue
        gain, loss = min(sizes[held] - mass[held], mass[j]), min(mass[held], sizes[j] - mass[j])
        if draws[j] * (gain + loss) < loss:
            a, b, by = held, j, gain
        else:
            a, b, by = j, held, loss
        up, down = by == sizes[a] - mass[a], by == mass[b]
        mass[a] = sizes[a] if up else mass[a] + by
        mass[b] = 0.0 if down else mass[b] - by
        held = next((k for k in (held, j) if 0 < mass[k] < sizes[k]), -1)
    return mass


def _combine(level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        names = table.schema.names
        source, salt = table["source"][0].as_py(), table["salt"][0].as_py()
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("mark", "ascending")])
        sizes = table["size"].to_numpy().astype(float)
        seed = [level, salt, 0 if source is None else 1, zlib.crc32((source or "").encode())]
        rng = np.random.Generator(np.random.PCG64(seed))
        mass = pivot(sizes, table["mass"].to_numpy(), rng)
        left = (mass > 0) & (mass < sizes)
        if last:
            for k in np.flatnonzero(left):
                mass[k] = sizes[k] if rng.random() * sizes[k] < mass[k] else 0.0
            left[:] = False
        extra = pa.array(np.where(mass >= sizes, 1, 0) * (sizes > 0), pa.int32(), mask=left)
        return table.set_column(names.index("mass"), "mass", pa.array(mass)).set_column(names.index("extra"), "extra", extra)

    return run


def mix(docs: DataFrame, most: int = MOST_COPIES, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target, taken, copies, source, and a hash of the text."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), _mark().alias("mark")), "mix-sizes")
    targets = with_targets(sizes, most)
    known = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", "d.source", "size", "mark", "source_size", "target")
    groups = max(1, -(-sizes.count() // leaf))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(rate + 1e-12), F.lit(most))
    part = F.greatest(rate - whole, F.lit(0.0))
    rows = known.select("*", F.pmod(F.xxhash64("doc_id", "mark", F.lit(11)), F.lit(groups)).alias("salt"), (part * F.col("size")).alias("mass"), F.lit(None).cast("int").alias("extra"))
    done, level = [], 0
    while True:
        last = groups == 1
        rows = cut(rows.groupBy("source", "salt").applyInArrow(_combine(level, last), _FIELDS), "mix-level")
        done.append(rows.filter("extra is not null"))
        if last:
            break
        groups, level = -(-groups // fan), level + 1
        rows = rows.filter("extra is null").withColumn("salt", F.floor(F.col("salt") / fan).cast("long"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = (whole + F.col("extra")).cast("long")
    return every.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "mark")


def mixed(docs: DataFrame, **how: int) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it. Rows that repeat both doc_id and text share their copies, the odd ones going to the first of them."""
    own, mark, copies, rows = (unused(docs, f"__{x}") for x in ("id", "mark", "copies", "rows"))
    drawn = mix(docs, **how).groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark)).agg(F.sum("copies").cast("int").alias(copies), F.count(F.lit(1)).cast("int").alias(rows))
    drawn = cut(drawn.filter(F.col(copies) > 0), "mix-drawn")
    met = docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (_mark() == F.col(mark)))
    times = F.col(copies)
    if not drawn.filter(F.col(rows) > 1).isEmpty():
        place = F.row_number().over(Window.partitionBy(own, mark).orderBy(F.lit(1)))
        met = met.withColumn(rows, F.struct(F.col(rows).alias("n"), place.alias("k")))
        share = F.floor(F.col(copies) / F.col(rows)["n"])
        times = (share + (F.col(rows)["k"] <= F.col(copies) - share * F.col(rows)["n"]).cast("int")).cast("int")
    return met.select(*docs.columns, times.alias(copies)).filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("copies", "source", "mark")
