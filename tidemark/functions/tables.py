"""Kernels as SQL table functions: SELECT * FROM ewma_volatility(TABLE(t) PARTITION BY series ORDER BY seq)."""

from __future__ import annotations

import re
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_type


def register(spark: SparkSession, name: str, operator: str, row: str, inputs: list[str], **params: Any) -> None:
    """Register ``operator`` as table function ``name``; its rows are those of the table (columns ``row``, as DDL) and a value.

    A partition is one series, in the order its call asks for. A row with a null input passes through with a null value.
    """
    from ..operators import KERNELS, named

    if not re.fullmatch(r"\w+", name):
        raise ValueError("a function name is a word")
    plain = named(operator)
    kind = from_arrow_type(KERNELS[plain](**params).type).simpleString()
    columns = [c.strip().split()[0] for c in row.split(",")]

    class Table:
        def __init__(self) -> None:
            from tidemark.operators import KERNELS as known

            self.kernel = known[plain](**params)
            self.state = self.kernel.start()

        def eval(self, r):  # noqa: ANN001, ANN201
            given = [r[c] for c in inputs]
            value = None
            if all(v is not None for v in given):
                arrays = [np.array([v], float) for v in given]
                if not all(np.isfinite(a).all() for a in arrays):
                    raise ValueError(f"{inputs} has a value that is not finite")
                self.state, out = self.kernel.step(self.state, *arrays)
                value = (float(out[0][0]) if out[1][0] else None) if isinstance(out, tuple) else out[0]
            yield (*[r[c] for c in columns], value)

    spark.udtf.register(name, udtf(Table, returnType=f"{row}, value {kind}"))
