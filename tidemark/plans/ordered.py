"""Ordered series in a DataFrame, and the two ways to run an operator over them.

A series is the rows of one key in the total order of the order columns. *Window expressions* compile to Catalyst windows: all
features of one specification share a single exchange and sort. *Kernels* carry a state along the series: rows are
hash-partitioned by key and sorted within partitions (a sort that spills), and each task streams its Arrow batches through, so
memory is bounded by a batch and the states, never by the length of a series. Several kernels fuse into one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# ---------------------------------------------------------------- window expressions


@dataclass
class Frames:
    """Window specifications of a DataFrame's series, and the columns staged for nested windows."""

    df: DataFrame
    key: Sequence[str]
    order: Sequence[str]
    staged: list[str] = field(default_factory=list)
    #: A column that numbers the rows of a series from 1, where the partition is only a piece of one.
    number: str | None = None

    @property
    def ordered(self):
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def rows(self, period: int):
        return self.ordered.rowsBetween(1 - period, 0)

    @property
    def whole(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def hold(self, value: Column) -> Column:
        """Stage ``value`` as a column: a window cannot contain another."""
        name = f"__stage{len(self.staged)}"
        self.df = self.df.withColumn(name, value)
        self.staged.append(name)
        return F.col(name)

    @property
    def seq(self) -> Column:
        return F.col(self.number) if self.number else F.row_number().over(self.ordered)

    def from_tick(self, tick: int, value: Column) -> Column:
        """``value`` from tick ``tick`` on, null before."""
        return F.when(self.seq >= tick, value)

    def on_ticks(self, window: int, every: int, value: Column) -> Column:
        """``value`` at ticks window + every - 1 + j * every."""
        first = window + max(1, every) - 1
        return F.when((self.seq >= first) & ((self.seq - first) % max(1, every) == 0), value)


# ---------------------------------------------------------------- kernels


class Kernel:
    """A fold along a series. ``type`` is the Arrow type of its output; null where nothing is emitted."""

    type: pa.DataType = pa.float64()

    def start(self) -> Any:
        """A fresh state; states pickle."""
        return None

    def step(self, state: Any, *columns: np.ndarray) -> tuple[Any, Any]:
        """The state and outputs after the next rows: a list, or (values, valid) arrays."""
        raise NotImplementedError


class Loop(Kernel):
    """A kernel that goes row by row: ``tick(state, *values)`` returns an output or None and changes ``state`` in place."""

    def tick(self, state: Any, *values: float) -> Any:
        raise NotImplementedError

    def step(self, state: Any, *columns: np.ndarray) -> tuple[Any, Any]:
        rows = [c.tolist() if c.ndim == 1 else list(c) for c in columns]
        tick = self.tick
        return state, [tick(state, *v) for v in zip(*rows, strict=True)]


class Frame(Kernel):
    """A kernel over the last ``window`` rows at ticks window + every - 1 + j * every, each computed from many windows at once."""

    #: Windows computed together.
    together = 512

    def __init__(self, window: int, every: int):
        if window < 1:
            raise ValueError("window must be positive")
        self.window, self.every = int(window), max(1, int(every))

    def start(self) -> dict:
        return {"seen": 0, "tail": None, "own": self.begin()}

    def begin(self) -> Any:
        """A state of the kernel's own, carried from tick to tick."""
        return None

    def compute(self, own: Any, *windows: np.ndarray) -> Sequence:
        """Outputs for windows[i][t], t the tick; ``own`` may change in place."""
        raise NotImplementedError

    def step(self, state: dict, *columns: np.ndarray) -> tuple[dict, list]:
        n, w, first = len(columns[0]), self.window, self.window + self.every - 1
        data = columns if state["tail"] is None else [np.concatenate([t, c]) for t, c in zip(state["tail"], columns, strict=True)]
        before = state["seen"]
        lead = len(data[0]) - n  # rows of the tail
        out: list = [None] * n
        seq = np.arange(before + 1, before + n + 1)
        ticks = np.flatnonzero((seq >= first) & ((seq - first) % self.every == 0))
        for a in range(0, len(ticks), self.together):
            at = ticks[a : a + self.together]
            index = (lead + at)[:, None] + np.arange(1 - w, 1)[None, :]
            for i, value in zip(at.tolist(), self.compute(state["own"], *[d[index] for d in data]), strict=True):
                out[i] = value
        state["seen"] = before + n
        state["tail"] = [d[max(0, len(d) - w + 1) :].copy() for d in data]
        return state, out


def finite(name: str, values: np.ndarray) -> None:
    if not np.isfinite(values).all():
        raise ValueError(f"{name} has a value that is not finite")


def as_numpy(column: pa.Array) -> np.ndarray:
    """Floats, or rows of floats for lists of one length."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.array(column.to_pylist(), float).reshape(len(column), -1)
    if pa.types.is_boolean(column.type):
        return column.to_numpy(zero_copy_only=False).astype(float)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def as_arrow(values: Any, kind: pa.DataType, valid: np.ndarray, n: int) -> pa.Array:
    """Outputs for the valid rows spread over all n."""
    if isinstance(values, tuple):
        wide, mask = np.zeros(n), np.ones(n, bool)
        wide[valid], mask[valid] = values[0], ~np.asarray(values[1], bool)
        return pa.array(wide, kind, mask=mask)
    if len(valid) < n:
        spread: list = [None] * n
        for i, v in zip(valid.tolist(), values, strict=True):
            spread[i] = v
        values = spread
    return pa.array(values, kind)


@dataclass
class Job:
    kernel: Kernel
    inputs: Sequence[str]
    out: str


def advance(jobs: Sequence[Job], states: list, columns: dict[str, pa.Array], n: int, check: bool) -> list[pa.Array]:
    """The next n rows of one series through every job. A row with a null input is passed over: null out, state as it was."""
    out = []
    for k, job in enumerate(jobs):
        held = [columns[c] for c in job.inputs]
        valid = np.ones(n, bool)
        for c in held:
            if c.null_count:
                valid &= c.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(valid)
        arrays = [as_numpy(c if len(at) == n else c.take(pa.array(at))) for c in held]
        if check:
            for name, a in zip(job.inputs, arrays, strict=True):
                finite(name, a)
        values: Any = []
        if len(at):
            states[k], values = job.kernel.step(states[k], *arrays)
        out.append(as_arrow(values, job.kernel.type, at, n))
    return out


def run_kernels(df: DataFrame, key: Sequence[str], order: Sequence[str], jobs: Sequence[Job], check: bool = True, number: str | None = None) -> DataFrame:
    """``df`` and a column for every job; one exchange and one sort for all of them.

    ``check`` fails the query on a NaN or infinite input. One series is one task, for its state passes from row to row; ``number`` is
    a column that numbers a series' rows where ``key`` cuts it into pieces (see ``pieces``).
    """
    clash = {j.out for j in jobs} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    names = [*df.columns, *(j.out for j in jobs)]
    where = {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, last = [j.kernel.start() for j in jobs], None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(where[k]).dictionary_encode() for k in key]
            change = np.zeros(batch.num_rows, bool)
            for c in codes:
                i = c.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= i[1:] != i[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            parts: list[list[pa.Array]] = [[] for _ in jobs]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = tuple(batch.column(where[k])[a].as_py() for k in key)
                if own != last:
                    states, last = [j.kernel.start() for j in jobs], own
                    if number:
                        for state in states:
                            state["seen"] = batch.column(where[number])[a].as_py() - 1
                columns = {c: batch.column(where[c]).slice(a, b - a) for j in jobs for c in j.inputs}
                for p, x in zip(parts, advance(jobs, states, columns, b - a, check), strict=True):
                    p.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.concat_arrays(p) for p in parts)], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    kinds += [f"`{j.out}` {from_arrow_type(j.kernel.type).simpleString()}" for j in jobs]
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, ", ".join(kinds))
