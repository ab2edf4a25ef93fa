"""All operators by name, and how to put them on a DataFrame.

``features`` computes any number of them at once: window expressions of one specification share an exchange and a sort, and all
kernels run in a single pass over the sorted partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import Frames, Job, Kernel, run_kernels
from . import decomposition, pointwise, prediction, recursive, rolling, spectral, tails, timefreq, wavelets

WINDOWS = rolling.ALL
KERNELS: dict[str, type[Kernel]] = {}
for _module in (recursive, spectral, timefreq, wavelets, decomposition, prediction, tails):
    KERNELS |= _module.ALL
POINTWISE = pointwise.ALL | {"spectral_shape": spectral.spectral_shape}

# Other names of the same operators.
ALIASES = {
    "ExpectedShortfall": "ConditionalValueAtRisk",
    "CVaR": "ConditionalValueAtRisk",
    "ES": "ConditionalValueAtRisk",
    "WelchPSD": "WelchPsd",
    "BetaAlpha": "Capm",
    "FamaFrenchThree": "FamaFrench3",
    "FamaFrenchFive": "FamaFrench5",
    "Carhart": "Carhart4",
    "UpDownCapture": "CaptureRatios",
    "DWT": "DiscreteWaveletTransform",
    "MODWT": "Modwt",
    "CWT": "CwtMorlet",
    "RLS": "RlsFilter",
    "LMS": "LmsFilter",
}


def named(name: str) -> str:
    plain = ALIASES.get(name, name)
    if plain not in WINDOWS and plain not in KERNELS and plain not in POINTWISE:
        raise ValueError(f"unknown operator {name}")
    return plain


@dataclass
class Feature:
    """An operator, the columns it reads in its own order, the column it makes, and its parameters."""

    operator: str
    inputs: Sequence[str]
    out: str
    params: dict[str, Any] = field(default_factory=dict)


def as_record(value: Column | dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in value.items()]) if isinstance(value, dict) else value


def features(df: DataFrame, key: Sequence[str], order: Sequence[str], wanted: Sequence[Feature], check: bool = True, number: str | None = None) -> DataFrame:
    """``df`` with a column for every feature. ``order`` must be total within a key, or results depend on how ties fall.

    ``number`` is for ``plans.pieces``: a column that numbers a series' rows where ``key`` cuts it into pieces.
    """
    frames, jobs = Frames(df, list(key), list(order), number=number), []
    for f in wanted:
        name = named(f.operator)
        if name in KERNELS:
            jobs.append(Job(KERNELS[name](**f.params), list(f.inputs), f.out))
        elif name in WINDOWS:
            value = as_record(WINDOWS[name](frames, *[F.col(c) for c in f.inputs], **f.params))
            frames.df = frames.df.withColumn(f.out, value)
        else:
            frames.df = frames.df.withColumn(f.out, as_record(POINTWISE[name](*[F.col(c) for c in f.inputs], **f.params)))
    out = frames.df.drop(*frames.staged)
    return run_kernels(out, list(key), list(order), jobs, check, number) if jobs else out


def apply(operator: str, df: DataFrame, key: Sequence[str], order: Sequence[str], inputs: Sequence[str], out: str = "value", /, **params: Any) -> DataFrame:
    """``df`` with one operator's column."""
    return features(df, key, order, [Feature(operator, inputs, out, params)])


def spectrogram(df: DataFrame, key: Sequence[str], order: Sequence[str], spectrum: str, max_frames: int = 64, out: str = "spectrogram") -> DataFrame:
    """The last ``max_frames`` power vectors of a spectrum column, oldest first, at each of its ticks."""
    ticks = df.filter(F.col(spectrum).isNotNull())
    frames = Frames(ticks, list(key), list(order))
    return ticks.withColumn(out, F.collect_list(F.col(spectrum)["power"]).over(frames.rows(max_frames)))
