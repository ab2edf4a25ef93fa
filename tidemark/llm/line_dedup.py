"""Fuzzy line dedup by MinHash: character shingles, banding, exact verification, union-find.

A line is a stretch of a text between newlines. Equal lines collapse first, under an identifier that is verified: if two distinct lines share
their 64-bit hash anywhere, SHA-256 identifies all. A line's signature is ``BANDS`` x ``ROWS`` independent
minima over all its shingles of ``EXACT`` characters, the same set that verifies. Each band is a bucket key; a pair of similarity
0.8 misses all bands with probability (1 - 0.8^6)^20 = 2.3e-3, one of 0.85 with 8e-5, one of 0.9 with 3e-7. There is no other filter: every
banded candidate that is not yet in one component with its leader is verified on the full sets of both lines, Jaccard similarity of at least
``LEAST_PERCENT``. Verified links run through distributed label propagation (union-find), and one line of each
component stays: the first by (doc_id, line number).

In a bucket every line is first compared with its leader, the one with the smallest identifier; those of a bucket that are not in one
component after that are compared with each other, all with all, in blocks of lines: a row holds two blocks, not two lines, and the
similarities of many pairs come of one product of their blocks' incidence matrices. Nothing is capped.

Signatures and verification are vectorised functions over Arrow batches; built-in functions made a string of every shingle, and took
several times the time the operator may take (figures in the README). All else is DataFrame operations.

Nulls and edge cases: a null text has no lines. Lines of white space alone are kept and never linked. Lines shorter than a
shingle are one shingle. Rows that repeat a doc_id keep or lose their lines alike; a null doc_id sorts last; of equal (doc_id, line number)
both stay or both go. An empty table gives an empty result. Extra columns of any name go with their rows in ``without_similar_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Spans, byte_slices, components, frugal, mix, one_file_a_task, read_table, strings, unused
from .common import cut as _cut

cut = partial(_cut, codec="zstd", release=True)

EXACT, BANDS, ROWS, LEAST_PERCENT = 5, 20, 6, 80
#: Bytes of lines whose shingles are handled together, so that they stay in a core's cache.
TOGETHER = 1 << 16
#: Lines and bytes of a block (or one longer line); pairs of two blocks up to which each is verified alone; columns of a matrix at a time.
BLOCK_LINES, BLOCK_BYTES, FEW, COLUMNS = 256, 1 << 19, 16, 4096

_rng = np.random.Generator(np.random.PCG64(8))
_MUL = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDER = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of line i the shingles ``first[i]:first[i + 1]``, repeats included; a line of fewer characters is its own only one."""
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
    chars = np.searchsorted(leads, offsets)
    size = np.diff(chars)
    count = np.where(size > 0, np.maximum(size - EXACT + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(chars[:-1] - first[:-1], count)
    spans = Spans(data)
    every = spans.spans(leads[:-EXACT], leads[EXACT:])  # also across lines, which ``at`` passes over
    hashes = every.take(at, mode="clip") if len(every) else np.empty(len(at), np.uint64)
    few = np.flatnonzero((size > 0) & (size < EXACT))
    hashes[first[few]] = spans.spans(leads[chars[few]], leads[chars[few + 1]])
    return hashes, first


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """lines x BANDS; every line has a shingle."""
    # the k-th order is by an odd number times k - 1 others; odd hashes, so that none is 0 in every order
    v, at = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1), first[:-1]
    least = np.empty((BANDS * ROWS, len(at)), np.uint32)
    for k in range(BANDS * ROWS):
        np.multiply(v, _MUL[k], out=v)
        np.minimum.reduceat(v, at, out=least[k])
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(at), axis=1)
    for row in range(ROWS):
        keys = mix(keys + least[row::ROWS] * _ORDER[row])
    return np.ascontiguousarray(keys.T).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keys) of lines (id, line) that are not empty."""
    for batch in batches:
        for i, j, data, offsets in byte_slices(strings(batch.column(1)), TOGETHER):
            keys = band_keys(*shingles(data, offsets)).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(keys))], ["id", "keys"])


def similar(hashes: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Whether lines 2k and 2k + 1 are similar, for each k, by their sets of shingles.

    One sort of pair, hash and side in a word; the pairs handled together leave the hash no fewer than 44 bits, and 62 where there is one pair.
    """
    pairs = (len(first) - 1) // 2
    bits = max(1, (pairs - 1).bit_length())
    low, top = np.uint64(1), np.uint64(64 - bits)
    line = np.arange(2 * pairs, dtype=np.uint64)
    word = np.repeat((line >> low) << top | line & low, np.diff(first)) | (hashes >> np.uint64(bits + 1)) << low
    word.sort()
    once = np.ones(len(word), bool)
    once[1:] = word[1:] != word[:-1]
    word = word[once]
    pair = (word >> top).astype(np.int64)
    both = np.bincount(pair[1:][(word[1:] ^ word[:-1]) == low], minlength=pairs)
    return 100 * both >= percent * (np.bincount(pair, minlength=pairs) - both)


def alike(lines: pa.Array, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether lines a[k] and b[k] are similar, for each k."""
    n, good, k = len(a), np.zeros(len(a), bool), 0
    size = pa.compute.binary_length(lines).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size[a].astype(np.int64) + size[b])
    while k < n:  # runs of whole pairs
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 8 * TOGETHER, "right")))
        (_, _, data, offsets), = byte_slices(lines.take(pa.array(np.stack([a[k:j], b[k:j]], axis=1).ravel())), 1 << 62)
        good[k:j] = similar(*shingles(data, offsets), percent)
        k = j
    return good


def all_alike(lines: pa.Array, n: int, percent: int) -> np.ndarray:
    """Whether lines i < n and n + j are similar, for each i and j; where there is no line from n on, lines i and j."""
    (_, _, data, offsets), = byte_slices(lines, 1 << 62)
    hashes, first = shingles(data, offsets)
    m = len(lines)
    kinds, code = np.unique(hashes, return_inverse=True)
    of = np.unique(code * m + np.repeat(np.arange(m), np.diff(first)))  # each shingle once a line, by shingle
    code, line = np.divmod(of, m)
    size = np.bincount(line, minlength=m)
    held = np.bincount(code, minlength=len(kinds)) > 1
    line, code = line[held[code]], (np.cumsum(held) - 1)[code[held[code]]]
    other = slice(n, m) if m > n else slice(0, n)
    both = np.zeros((n, len(size[other])), np.float64)
    for c in range(0, int(held.sum()), COLUMNS):
        i, j = np.searchsorted(code, (c, c + COLUMNS))
        has = np.zeros((m, min(COLUMNS, int(code[j - 1]) - c + 1)), np.float32)
        has[line[i:j], code[i:j] - c] = 1
        both += has[:n] @ has[other].T
    return 100 * both >= percent * (size[:n, None] + size[None, other] - both)


def _confirmed(percent: int):
    """(a, b) of the pairs (a, b, la, lb) whose lines are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                good = alike(pa.concat_arrays([strings(batch.column(2)), strings(batch.column(3))]), np.arange(n), np.arange(n, 2 * n), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _linked(percent: int):
    """(a, b) of similar lines of two components, from rows of two blocks, or of one and an empty one, of (id, comp, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(0), batch.column(1)]
            flat = [side.flatten() for side in sides]
            ids, comps, lines = (pa.concat_arrays([f.field(k) for f in flat]) for k in range(3))
            comp = comps.dictionary_encode().indices.to_numpy()
            size = [pa.compute.list_value_length(side).to_numpy() for side in sides]
            ends = [np.concatenate([[at], at + np.cumsum(s)]) for at, s in zip((0, len(flat[0])), size, strict=True)]
            a, b, few = [], [], []
            for r in range(batch.num_rows):
                i, j = (np.arange(e[r], e[r + 1]) for e in ends)
                alone = not len(j)
                apart = comp[i][:, None] != comp[i if alone else j][None, :]
                x, y = np.nonzero(np.triu(apart) if alone else apart)
                if not len(x):
                    continue
                left, right = i[x], (i if alone else j)[y]
                if len(x) <= FEW:
                    few.append((left, right))
                    continue
                good = all_alike(lines.take(pa.array(np.concatenate([i, j]))), len(i), percent)[x, y]
                a.append(left[good])
                b.append(right[good])
            if few:
                left, right = (np.concatenate(side) for side in zip(*few, strict=True))
                good = alike(lines, left, right, percent)
                a.append(left[good])
                b.append(right[good])
            if a:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(side))) for side in (a, b)], ["a", "b"])

    return run


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line, from 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))


def similar_lines(lines: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(id, component) of the distinct ``lines(id, line)`` that are linked with another."""
    kind = lines.schema["id"].dataType.simpleString()
    found = f"a {kind}, b {kind}"
    signed = lines.select("id", "line").mapInArrow(frugal(_signed), f"id {kind}, keys array<long>")
    by_key = Window.partitionBy("key").orderBy("id")
    met = signed.select("id", F.explode("keys").alias("key")).select("key", "id", F.min("id").over(Window.partitionBy("key")).alias("leader"))
    # a leader meets every other line of its bucket here, and is not among the bucket's lines after that
    members = cut(met.filter("id != leader").select("key", "id", "leader"), "line-members")
    pairs = cut(members.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "line-pairs")
    pool = cut(lines.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "line"), "line-pool")
    sides = pairs.join(pool.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(pool.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    links = cut(sides.select("a", "b", "la", "lb").mapInArrow(frugal(_confirmed(percent)), found), "line-links")
    comps = components(links, "line")

    placed = members.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    placed = cut(placed, "line-placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    here = placed.join(open_keys, "key").join(pool, "id")
    row, so_far = F.row_number().over(by_key), F.sum(F.octet_length("line")).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    block = (F.floor((row - 1) / BLOCK_LINES) + F.floor(F.coalesce(so_far, F.lit(0)) / BLOCK_BYTES)).alias("block")
    blocks = here.select("key", block, F.struct("id", "comp", "line").alias("one")).groupBy("key", "block").agg(F.collect_list("one").alias("own"))
    blocks = cut(blocks, "line-blocks")
    more = blocks.filter("block > 0").select("key").distinct()
    several = cut(blocks.join(more, "key", "left_semi"), "line-several")
    two = several.join(several.select("key", F.col("block").alias("later"), F.col("own").alias("other")), "key").filter("block < later").select("own", "other")
    rows = blocks.select("own", F.slice("own", 1, 0).alias("other")).unionByName(two)
    others = cut(rows.mapInArrow(frugal(_linked(percent)), found), "line-links")
    if others.isEmpty():
        return comps
    return components(others.unionByName(comps.filter("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))), "line")


def _places(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: places (doc_id, line_no, id; null for white space) and own (id, c, first, copies), what each distinct line of component c brings."""
    lines, worded = line_table(docs), F.ltrim(F.col("line"), F.lit(" \t\x0b\f\r")) != ""
    for identifier in (F.xxhash64, lambda c: F.sha2(c, 256)):
        distinct = cut(lines.filter(worded).select(identifier(F.col("line")).alias("id"), "line").groupBy("id", "line").agg(F.lit(1).alias("one")).select("id", "line"), "line-distinct")
        if distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    else:
        raise ValueError("distinct lines share an identifier of every kind")
    places = cut(lines.select("doc_id", "line_no", F.when(worded, identifier(F.col("line"))).alias("id")), "line-places")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "line_no")
    own = places.filter("id is not null").groupBy("id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    linked = similar_lines(distinct, percent)
    own = cut(own.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "first", "copies"), "line-own")
    return places, own


def fuzzy_lines(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per line of ``docs(doc_id, text)``: doc_id, line_no, first_doc, first_line, copies, kept.

    (first_doc, first_line) is the line that stays for the line's component, and copies how many lines the component has.
    """
    with one_file_a_task(docs.sparkSession):
        places, own = _places(docs, percent)
    # what each component brings; places meet it once, by their own line
    whole = own.groupBy("c").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    told = own.select("id", "c").join(whole, "c").select("id", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "copies")
    blank = F.col("id").isNull()
    met = places.join(told, "id", "left").select(
        "doc_id", "line_no",
        F.when(blank, F.col("doc_id")).otherwise(F.col("first_doc")).alias("first_doc"),
        F.when(blank, F.col("line_no")).otherwise(F.col("first_line")).alias("first_line"),
        F.when(blank, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"),
    )
    return met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))


def without_similar_lines(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; rows and other columns stay."""
    own, out = unused(docs, "__id"), unused(docs, "__gone")
    gone = fuzzy_lines(docs, percent).filter("not kept").groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(out))
    rows = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left")
    kept = F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(out, i), F.lit(False)))
    return rows.select(*[F.when(F.col(out).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(read_table(spark, sf_dir, "documents"))
