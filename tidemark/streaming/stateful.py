"""The same kernels on unbounded input: keyed state in the state store, rows in event-time order.

Rows wait in their key's buffer until the watermark passes them and are then taken in the order of the order columns, so a
stream gives what a batch over the same rows gives. Rows behind the watermark are late and dropped by the engine's own rule. With
``in_order=False`` nothing waits: rows are ordered within each micro-batch only, and results depend on arrival.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import KERNELS, Feature, named
from ..plans.ordered import Job, advance

#: Set by whoever owns the session: timers and list state need this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Fold(StatefulProcessor):
    def __init__(self, jobs: Sequence[Job], schema: StructType, order: Sequence[str], time: str | None, check: bool):
        self.jobs, self.arrow, self.order, self.time, self.check = list(jobs), to_arrow_schema(schema), list(order), time, check

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("states", "blob binary")
        self.waiting = handle.getValueState("waiting", "blob binary")

    def _take(self, state: Any, default: Any) -> Any:
        return pickle.loads(bytes(state.get()[0])) if state.exists() else default

    def _advance(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(self.order, kind="stable").reset_index(drop=True)
        states = self._take(self.state, [j.kernel.start() for j in self.jobs])
        table = pa.Table.from_pandas(rows, self.arrow, preserve_index=False).combine_chunks()
        columns = {c: table[c].combine_chunks() for j in self.jobs for c in j.inputs}
        made = advance(self.jobs, states, columns, len(rows), self.check)
        self.state.update((pickle.dumps(states),))
        return rows.assign(**{j.out: m.to_pylist() for j, m in zip(self.jobs, made, strict=True)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows), ignore_index=True)
        if self.time is None:
            yield self._advance(new)
            return
        held = pd.concat([self._take(self.waiting, new.iloc[:0]), new], ignore_index=True)
        self.waiting.update((pickle.dumps(held),))
        self._wake(held)

    def _wake(self, held: pd.DataFrame) -> None:
        """Once the watermark passes the earliest row that waits."""
        if len(held):
            self.handle.registerTimer(int(held[self.time].min().timestamp() * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self._take(self.waiting, None)
        if held is None or not len(held):
            return
        passed = held[self.time] <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        left = held[~passed].reset_index(drop=True)
        self.waiting.update((pickle.dumps(left),))
        self._wake(left)
        if passed.any():
            yield self._advance(held[passed])

    def close(self) -> None:
        pass


def stream(df: DataFrame, key: Sequence[str], order: Sequence[str], wanted: Sequence[Feature], time: str | None = None, in_order: bool = True, check: bool = True) -> DataFrame:
    """A streaming DataFrame with a column for every feature (kernels only: window expressions over all rows have no stream form).

    ``time`` is the event-time column that carries the watermark; it is needed unless ``in_order`` is off.
    """
    if in_order and time is None:
        raise ValueError("event-time order needs a time column with a watermark")
    jobs = []
    for f in wanted:
        name = named(f.operator)
        if name not in KERNELS:
            raise ValueError(f"{name} is a window expression; only kernels run on streams")
        jobs.append(Job(KERNELS[name](**f.params), list(f.inputs), f.out))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    kinds += [f"`{j.out}` {from_arrow_type(j.kernel.type).simpleString()}" for j in jobs]
    fold = _Fold(jobs, df.schema, order, time if in_order else None, check)
    return df.groupBy(*key).transformWithStateInPandas(fold, outputStructType=", ".join(kinds), outputMode="Append", timeMode="EventTime" if in_order else "None")
