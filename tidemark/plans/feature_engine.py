"""Several named features of bars in one plan, by kind, channel and at most one number each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import Feature, features

# Kind -> operator, the parameter its number sets (None: it has none), default, and the record field it emits.
KINDS = {
    "ewma_volatility": ("EwmaVolatility", "alpha", 0.06, None),
    "garch": ("Garch", None, None, None),
    "realized_volatility": ("RealizedVolatility", "period", 20, None),
    "rolling_volatility": ("RollingVolatility", "period", 20, None),
    "rolling_returns": ("RollingReturns", "period", 20, None),
    "sharpe": ("SharpeRatio", "period", 252, None),
    "sortino": ("SortinoRatio", "period", 252, "sortino"),
    "lo_sharpe": ("LoAutocorrelationSharpe", "period", 252, "lo_sharpe"),
    "gain_loss": ("GainLossRatio", "period", 252, None),
    "value_at_risk": ("ValueAtRisk", "period", 252, None),
    "page_hinkley": ("PageHinkley", "threshold", 1.0, "score"),
    "teager_kaiser": ("TeagerKaiser", None, None, None),
    "zero_crossing": ("ZeroCrossingRate", "window", 32, None),
    "savgol": ("SavitzkyGolay", "window", 9, None),
    "kz": ("KolmogorovZurbenko", "window", 11, None),
    "wiener": ("WienerFilter", "window", 9, None),
    "adaptive_notch": ("AdaptiveNotchFilter", None, None, "frequency"),
    "alpha_beta": ("AlphaBetaTracker", None, None, "value"),
    "kalman": ("KalmanFilter", "r", 1.0, "value"),
    "adaptive_kalman": ("AdaptiveKalman", None, None, "value"),
    "lms": ("LmsFilter", "order", 4, None),
    "rls": ("RlsFilter", "order", 4, None),
}
# Second spellings.
SPELLINGS = {"ewmavol": "ewma_volatility", "lo_autocorrelation_sharpe": "lo_sharpe", "var": "value_at_risk", "savitzky_golay": "savgol", "kolmogorov_zurbenko": "kz"}
# Channel -> column.
CHANNELS = {"open": "open", "high": "high", "low": "low", "close": "close", "price": "close", "volume": "volume", "return": "__return", "returns": "__return"}


class FeatureEngine:
    """``names``, ``kinds``, ``channels`` and ``params`` of one length; ``apply`` adds a column per name to bars.

    The return channel is close / previous close - 1, and 0 on the first bar or after a close of 0.
    """

    def __init__(self, names: Sequence[str], kinds: Sequence[str], channels: Sequence[str], params: Sequence[float | None] | None = None):
        params = [None] * len(names) if params is None else params
        if not len(names) == len(kinds) == len(channels) == len(params):
            raise ValueError("names, kinds, channels and params must have one length")
        self.names, self.wanted, self.fields = list(names), [], []
        for name, kind, channel, number in zip(names, kinds, channels, params, strict=True):
            kind, channel = SPELLINGS.get(kind.lower(), kind.lower()), channel.lower()
            if kind not in KINDS or channel not in CHANNELS:
                raise ValueError(f"unknown kind or channel: {kind}, {channel}")
            operator, parameter, default, part = KINDS[kind]
            given = {} if parameter is None else {parameter: default if number is None else number}
            if parameter in ("period", "window", "order"):
                given[parameter] = max(int(given[parameter]), 2 if kind in ("rolling_volatility", "sharpe", "lo_sharpe", "zero_crossing") else 1)
            if kind == "savgol":
                given = {"window": given["window"] + 1 - given["window"] % 2, "order": 2}
            if kind == "ewma_volatility":
                given["alpha"] = min(max(float(given["alpha"]), 1e-6), 1 - 1e-6)
            self.wanted.append(Feature(operator, [CHANNELS[channel]], name, given))
            self.fields.append(part)

    def __len__(self) -> int:
        return len(self.names)

    def apply(self, bars: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
        before = F.lag("close").over(Window.partitionBy(*key).orderBy(*order))
        rows = bars if "volume" in bars.columns else bars.withColumn("volume", F.lit(0.0))
        rows = rows.withColumn("__return", F.when(before.isNull() | (before == 0), 0.0).otherwise(F.col("close") / before - 1.0))
        out = features(rows, key, order, self.wanted, check=False)
        picked = {n: F.col(n)[p] if p else F.col(n) for n, p in zip(self.names, self.fields, strict=True)}
        return out.withColumns(picked).drop("__return")

    def apply_scalar(self, values: DataFrame, key: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
        """One column as every price; the volume is 0."""
        bars = values.withColumns({c: F.col(column) for c in ("open", "high", "low", "close")}).withColumn("volume", F.lit(0.0))
        return self.apply(bars, key, order).drop("open", "high", "low", "close", "volume")
