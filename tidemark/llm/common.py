"""What several operators of this package share: written tables, byte-level words, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (tests, one machine) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, codec: str = "snappy", release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs a reread.

    With ``release`` the shuffle files behind the table go once it is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_PARTITIONS, _FILES = "spark.sql.shuffle.partitions", "spark.shuffle.sort.bypassMergeThreshold"


@contextmanager
def one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Within, a task that shuffles writes one sorted file.

    Up to a threshold of partitions (200, the default number) Spark opens a file and a compressor for each of them in every task, however few
    rows it has; with many shuffles of tasks of some MB that took a third of an operator's time. A number far below the threshold stays.
    """
    before, most = spark.conf.get(_PARTITIONS), int(spark.conf.get(_FILES, "200"))
    if most // 4 < int(before) <= most:
        spark.conf.set(_PARTITIONS, str(most + most // 4))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def without(docs: DataFrame, *made: str) -> DataFrame:
    """``docs`` less its columns whose names, in any case, an operator is about to make: the operator's own take their place."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {m.lower() for m in made}])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words on UTF-8 bytes

#: Bytes of a whitespace-delimited word: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of an alphanumeric word: 0-9, a-z, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        steps = np.full((n | 0xFFFF) + 1, _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 1 << 20:  # those of a very long text are not kept
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of spans of some bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self._sums = data, None

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans: equal bytes have equal hashes wherever they stand."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * _power("up", n), out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _power("down", n + 1)[start])


class Words(Spans):
    """The words of some texts: byte spans, 64-bit hashes, and ``first[i]:first[i+1]`` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: bool = True):
        super().__init__(_LOWER[data] if lower else data)
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word_byte[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def byte_slices(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) for runs of texts of about ``limit`` bytes; a longer text makes a run of its own. Null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` giving the memory it freed back to the system at its end: a worker lives on after its task, and so would that memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others do without
    if trim is not None:
        trim(0)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


# ---------------------------------------------------------------- components


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) per vertex, component being its smallest reachable id.

    Distributed label propagation with pointer jumping: every round takes the smallest label among a
    vertex and its neighbours, then follows that label's own label, so stars end in one round and chains in a logarithmic number.
    Minima are pre-aggregated before each shuffle; only the count of changed labels reaches the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), f"{label}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        step = cut(step, f"{label}-step")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        moved = cut(step.join(jump, "new").select("id", "old", F.least("new", "far").alias("component")), f"{label}-labels")
        labels = moved.select("id", "component")
        if moved.filter("component != old").isEmpty():
            return labels
