"""Near-duplicate documents by b-bit MinHash.

Word shingles of whole texts become sets of 64-bit hashes. ``HASHES`` minima are taken of each set:
full minima of ``BANDS`` x ``ROWS`` of them give band keys, and the low two bits of all are packed into eight
longs. Documents that share a band key are candidates; the share of equal two-bit values, corrected for
chance collisions (a quarter of unequal minima agree), estimates their similarity by bit counts, and a pair is
confirmed on the full sets.

A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 = 1.3e-7 and falls
five standard deviations below the mean before the estimate drops it (``MOST_UNEQUAL``).

Groups are never expanded into all pairs. Equal sets collapse to one representative. First, families: components of
the estimated links. In each bucket the members of largest degree lead; every member of another family is compared with
the leaders, estimated links merge families, buckets whose members share one family are done, spent leaders leave,
and the rest goes to the next round with more leaders, until each pair in a bucket either is in one family or was
estimated apart. Then each family is settled exactly: up to ``BLOCK`` documents in one task, larger families
by pairs of blocks of like size (sets whose sizes differ by a quarter cannot be linked), where the full intersections of all
pairs are counted by products of incidence matrices and only a spanning forest of the confirmed links leaves the task.

Nulls and edge cases: a null or wordless text has an empty set, n_shingles 0, and links with nothing. A null
doc_id links with nothing and stays. Rows that repeat a doc_id are one document: they share a component.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, Words, byte_slices, components, cut, frugal, give_back, mix, read_table, strings

HASHES, BANDS, ROWS = 256, 40, 5
#: Of 256 two-bit values, so many may differ: 38.4 are expected at similarity 0.8, standard deviation 5.7.
MOST_UNEQUAL = 68
#: Leaders of a bucket in its first, second, ... round; the last repeats, times eight each time.
LEADERS = (1, 16, 256)
#: Documents of a family, or of one side of a pair of blocks, that meet in one task; columns of its incidence matrix at a time.
BLOCK, COLUMNS = 512, 4096

_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIG = [f"s{i}" for i in range(8)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; of a shorter text the whole sequence as one."""
    words = Words(data, offsets, SPACED)
    h = words.hashes()
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled += h[i : i + len(rolled)] * _ORDER[i]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            sets.append(mix(np.array([(h[a:b] * _ORDER[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES x len(sets) minima; every set has a member."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, v = np.empty((HASHES, len(sets)), np.uint32), np.empty_like(x)
    for k in range(HASHES):
        np.bitwise_xor(x, _XOR[k], out=v)
        np.multiply(v, _MUL[k], out=v)
        np.minimum.reduceat(v, at, out=out[k])
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    wide = m[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS, -1)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], m.shape[1], axis=1)
    for r in range(ROWS):
        key = mix(key + wide[:, r] * _ORDER[r])
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """8 x n longs: of each minimum, mixed with the number of its hash, four of the lowest bits, four of the second.

    Bits of the minima themselves would not do: the low two of (x ^ a) * m depend on the low two of x alone, so two shingles
    would agree or differ under all hashes alike.
    """
    planes = np.empty((2, *m.shape), np.uint8)
    for k, row in enumerate(m):
        v = mix(row.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(32)))
        planes[0, k], planes[1, k] = v & np.uint64(1), (v >> np.uint64(1)) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(planes.reshape(-1, m.shape[1]), axis=0).T).view(np.int64).T


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for i, j, data, offsets in byte_slices(texts):
                sets = shingle_sets(data, offsets, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                cols = [np.zeros(j - i, np.int64) for _ in range(10)]
                bands = np.zeros((j - i, BANDS), np.int64)
                if len(full):
                    own = [sets[k] for k in full]
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    flat = np.concatenate(own)
                    m = minima(own)
                    for c, v in zip(cols, [np.add.reduceat(flat, at).view(np.int64), np.add.reduceat(mix(flat), at).view(np.int64), *packed(m)], strict=True):
                        c[full] = v
                    bands[full] = band_keys(m).T
                keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), *map(pa.array, cols), keys], ["doc_id", "n", "f1", "f2", *_SIG, "bands"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one it is connected with by pairs of 100 * intersection >= percent * union."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        hits = np.zeros((n, COLUMNS), np.float32)
        hits[row[part], column[part] - c] = 1
        both += hits @ hits.T
    both = both.astype(np.int64)
    link = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    label = np.arange(n)
    while True:
        near = np.minimum(label, np.where(link, label[None, :], n).min(axis=1))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _settle(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sets = [x for _, _, data, offsets in byte_slices(strings(table["text"])) for x in shingle_sets(data, offsets, width)]
        first = ids[linked(sets, percent)]
        apart = first != ids
        if table.nbytes > 1 << 22:
            give_back()
        return pa.table({"a": np.minimum(first, ids)[apart], "b": np.maximum(first, ids)[apart]})

    return run


def with_units(families: DataFrame) -> DataFrame:
    """(id, units) of ``families(id, family, n)``: the tasks a document takes part in."""
    of = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    rows = families.join(of, "family").withColumn("like", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int"))
    blocks = rows.filter(F.col("members") > BLOCK).groupBy("family", "like").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("like", "blocks"))).alias("blocks"))
    rows = rows.join(blocks, "family", "left")

    def met(step: int):
        other = F.coalesce(F.try_element_at("blocks", F.col("like") + step), F.lit(0))
        name = lambda j: F.concat_ws(":", "family", F.least(F.col("like"), F.col("like") + step), *((F.least("own", j), F.greatest("own", j)) if step == 0 else ("own", j) if step > 0 else (j, "own")), F.lit(abs(step)))
        return F.when(other > 0, F.transform(F.sequence(F.lit(0), F.greatest(other, F.lit(1)) - 1), name)).otherwise(F.array().cast("array<string>"))

    own = F.pmod(F.xxhash64("id", F.lit(3)), F.try_element_at("blocks", F.col("like"))).cast("int")
    rows = rows.withColumn("own", own)
    many = F.concat(met(-1), met(0), met(1))
    return rows.select("id", F.when(F.col("members") > BLOCK, many).otherwise(F.array(F.col("family").cast("string"))).alias("units"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Links join documents with 100 * intersection >= ``percent`` * union of their shingle sets; ``percent`` must be 80 or more for the recall above.
    """
    if percent < 80:
        raise ValueError("bands are chosen for a similarity of 0.8 or more")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = ", ".join(f"{c} long" for c in _SIG)
    feats = cut(source.mapInArrow(frugal(_features(width)), f"doc_id long, n long, f1 long, f2 long, {sig}, bands array<long>"), "near-features")
    full = feats.filter("n > 0 and doc_id is not null")
    classes = cut(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = full.join(classes, ["f1", "f2", "n"]).filter("doc_id = rep").dropDuplicates(["doc_id", "f1", "f2"])

    every = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "f1")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    every = cut(every.join(shared, "key"), "near-buckets")
    degree = every.groupBy("id", "f1").agg(F.sum("size").alias("degree"))
    known = reps.select(F.col("doc_id").alias("id"), "f1", "n", *_SIG).join(degree, ["id", "f1"])
    members = cut(every.drop("size").join(known, ["id", "f1"]).withColumn("comp", F.col("id")), "near-members")

    spark = docs.sparkSession
    families, turn = None, 0
    while True:
        open_keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
        here = cut(members.join(open_keys, "key"), "near-open")
        if here.isEmpty():
            break
        lead = LEADERS[min(turn, len(LEADERS) - 1)] * 8 ** max(0, turn - len(LEADERS) + 1)
        of_leader = [F.col(c).alias(f"l_{c}") for c in ("id", "f1", "n", "comp", *_SIG)]
        if lead == 1:
            order = F.struct("degree", (-F.col("id")).alias("i"), "f1")
            leaders = here.groupBy("key").agg(F.max_by(F.struct(*of_leader), order).alias("l")).select("key", "l.*")
        else:
            ranked = here.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "id", "f1"))).filter(F.col("r") <= lead)
            leaders = ranked.select("key", *of_leader)
        leaders = cut(leaders, "near-leaders")
        unequal = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"l_s{i}")).bitwiseOR(F.col(f"s{i + 4}").bitwiseXOR(F.col(f"l_s{i + 4}")))) for i in range(4)), F.lit(0))
        near = (F.col("comp") != F.col("l_comp")) & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")) & (unequal <= MOST_UNEQUAL)
        met = here.alias("m").join(leaders.alias("l"), (F.col("m.key") == F.col("l.key")) & near)
        pairs = cut(met.select(F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b")).distinct(), "near-pairs")
        if families is None:
            families = components(pairs, "near")
        elif not pairs.isEmpty():
            families = merged(families, pairs)
        rest = here.join(leaders.select("key", F.col("l_id").alias("id"), F.col("l_f1").alias("f1")), ["key", "id", "f1"], "left_anti").drop("comp")
        rest = rest.join(families.select("id", F.col("component").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")
        members = cut(rest.select(*members.columns), "near-members")
        turn += 1

    comps = None
    if families is not None:
        sized = reps.select(F.col("doc_id").alias("id"), "n").distinct().join(families.withColumnRenamed("component", "family"), "id")
        units = cut(with_units(sized), "near-units")
        texts = source.filter("doc_id is not null").withColumnRenamed("doc_id", "id").join(units, "id")
        texts = texts.select("id", "text", F.explode("units").alias("unit"))
        comps = components(cut(texts.groupBy("unit").applyInArrow(_settle(width, percent), "a long, b long").distinct(), "near-links"), "near")
    if comps is None:
        comps = spark.createDataFrame([], "id long, component long")
    out = feats.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    # a repeated doc_id with differing texts has several classes; they meet in the smallest component
    named = F.when(F.col("n") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"), F.col("doc_id").eqNullSafe(named).alias("kept"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after more ``links(a, b)``: components of the graph whose vertices are the present components."""
    known = comps.select("id", "component")
    ends = links.join(known.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(known.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = cut(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "near-contracted")
    over = components(ends, "near")
    renamed = known.join(over.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return cut(renamed.unionByName(over).groupBy("id").agg(F.min("component").alias("component")), "near-components")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
