"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the engine's expressions.

Window operators use the same ROWS frames; recursions are recursive CTEs; spectra are sums over a table of bins.
"""

from __future__ import annotations

import re

from ..functions.normal import cdf_sql, probit
from ..operators.rolling import savgol_weights

BARS = """
hourly AS (SELECT event_type AS series, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
                  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER o AS seq, coalesce(close / lag(close) OVER o - 1.0::DOUBLE, 0.0::DOUBLE) AS ret FROM hourly WINDOW o AS (PARTITION BY series ORDER BY hour))"""
TICKS = """
raw AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, value AS x FROM events),
b AS (SELECT series, seq, x, coalesce(lag(x, 3) OVER (PARTITION BY series ORDER BY seq), x) AS y FROM raw)"""
PAIRS = """
daily AS (SELECT o_orderpriority AS series, o_orderdate AS day, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2),
whole AS (SELECT o_orderdate AS day, avg(o_totalprice) AS m FROM orders GROUP BY 1),
moved AS (SELECT series, day, p / lag(p) OVER o - 1.0::DOUBLE AS asset, m / lag(m) OVER o - 1.0::DOUBLE AS market FROM daily JOIN whole USING (day) WINDOW o AS (PARTITION BY series ORDER BY day)),
b AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY day) AS seq, asset, market, 0.001::DOUBLE AS rf FROM moved WHERE asset IS NOT NULL)"""
VECTORS = BARS + """,
kind AS (SELECT * FROM (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view')) t(k, series)),
hours AS (SELECT hour, row_number() OVER (ORDER BY hour) AS seq FROM (SELECT DISTINCT hour FROM hourly)),
cell AS (SELECT hours.seq, CAST(k AS BIGINT) AS k, coalesce(b.ret, 0.0::DOUBLE) AS ret, k / 15.0::DOUBLE AS weight
         FROM hours CROSS JOIN kind LEFT JOIN b ON b.hour = hours.hour AND b.series = kind.series)"""
BASES = {"bars": BARS, "ticks": TICKS, "pairs": PAIRS}


def rounded(x: str) -> str:
    """The engine's rounding: six places below a thousand, four below ten million, else millions to three; see PLACES for others."""
    return f"list_transform([{x}], lambda v: CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN v WHEN abs(v) < 1e3 THEN round(v, 6) WHEN abs(v) < 1e7 THEN round(v, 4) ELSE round(v / 1e6, 3) END + 0.0::DOUBLE)[1]"


#: Places of queries other than six: long sums agree in fewer digits, and slopes of two-digit prices have exact ties at six.
PLACES = {"glosten_milgrom": 9} | dict.fromkeys(
    (
        "periodogram", "fft_spectral_density", "welch_psd", "bartlett_method", "short_time_fourier_transform", "daniell_periodogram", "parzen_periodogram", "chirp_z_transform",
        "cross_spectrum", "coherence", "goertzel", "page_hinkley", "higher_order_cumulants", "wiener_filter", "wigner_ville_distribution",
    ), 4,
)


def placed(sql: str, places: int) -> str:
    """``sql`` with its rounding to six places (four from a thousand on) made one to ``places`` (two fewer), as the engine rounds."""
    return re.sub(r"round\(v, ([46])\)", lambda m: f"round(v, {int(m[1]) + places - 6})", sql)


def windowed(base: str, period: int, columns: dict[str, str], first: int | None = None, stages: str = "", source: str = "b", where: str | None = None, raw: tuple[str, ...] = ()) -> str:
    """``columns`` over w (the last ``period`` rows), o (order) and u (all so far), null before tick ``first``."""
    gate = where or f"seq >= {period if first is None else first}"
    made = ", ".join(f"CASE WHEN {gate} THEN {v if k in raw else rounded(v)} END AS {k}" for k, v in columns.items())
    return f"""WITH {BASES[base]}{stages}
SELECT series, seq, {made} FROM {source}
WINDOW w AS (PARTITION BY series ORDER BY seq ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW), o AS (PARTITION BY series ORDER BY seq),
       u AS (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING)"""


def stage(name: str, columns: dict[str, str], period: int = 1, source: str = "b", extra: str = "") -> str:
    made = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f""",
{name} AS (SELECT *, {made} FROM {source} {extra}
  WINDOW w AS (PARTITION BY series ORDER BY seq ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW), o AS (PARTITION BY series ORDER BY seq),
         u AS (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def recursion(base: str, first: dict[str, str], then: dict[str, str], out: dict[str, str], raw: tuple[str, ...] = ()) -> str:
    """State columns ``first`` at tick 1 from b, ``then`` from the state r and the next row b; ``out`` from the state."""
    start = ", ".join(f"{v} AS {k}" for k, v in first.items())
    step = ", ".join(f"{then[k]} AS {k}" for k in first)
    made = ", ".join(f"{v if k in raw else rounded(v)} AS {k}" for k, v in out.items())
    return f"""WITH RECURSIVE {BASES[base]},
r AS (SELECT b.series, b.seq, {start} FROM b WHERE seq = 1
      UNION ALL SELECT b.series, b.seq, {step} FROM r JOIN b ON b.series = r.series AND b.seq = r.seq + 1)
SELECT series, seq, {made} FROM r"""


def frames(window: int = 64, every: int = 16) -> str:
    """win(series, tick, v): the last ``window`` ticks at each due one."""
    return f"""WITH {TICKS},
due AS (SELECT series, seq AS tick FROM b WHERE {cadence(window, every)}),
win AS (SELECT due.series, tick, list(x ORDER BY seq) AS v FROM due JOIN b ON b.series = due.series AND b.seq BETWEEN tick - {window - 1} AND tick GROUP BY ALL)"""


def listed(made: str, source: str = "win") -> str:
    """The elements of the list ``made`` as rows (series, seq, bin, power)."""
    return f""",
got AS (SELECT series, tick, {made} AS p FROM {source}),
told AS (SELECT series, tick, p, unnest(range(0, len(p))) AS bin FROM got)
SELECT series, tick AS seq, CAST(bin AS BIGINT) AS bin, {rounded("p[bin + 1]")} AS power FROM told"""


def framed(value: str) -> str:
    """``value`` of v, the last 64 ticks, and d, those less their mean, at every sixteenth; null between."""
    return f"""{frames()},
dev AS (SELECT *, list_transform(v, lambda q: q - list_avg(v)) AS d FROM win),
got AS (SELECT series, tick, {value} AS made FROM dev)
SELECT b.series, b.seq, {rounded("made")} AS value FROM b LEFT JOIN got ON got.series = b.series AND got.tick = b.seq"""


def cadence(window: int, every: int) -> str:
    first = window + every - 1
    return f"seq >= {first} AND (seq - {first}) % {every} = 0"


def spectrum(window: int, every: int, weight: str, power: str, bins: int | None = None, freq: str | None = None, cross: bool = False, length: int | None = None) -> str:
    """Rows (series, seq, bin, power): a Fourier sum of each due window for each bin; ``power`` from re, im (and re2, im2), n, k, ww.

    ``weight`` is the taper at i of n; ``freq`` a bin's cycles per row (k / n unless given).
    """
    n, length = window, length or window
    angle = f"(2 * pi() * ({freq or f'k::DOUBLE / {length}'}) * i)"
    second = f", sum(y * {weight} * cos{angle}) AS re2, -sum(y * {weight} * sin{angle}) AS im2" if cross else ""
    return f"""WITH {TICKS},
due AS (SELECT series, seq AS tick FROM b WHERE {cadence(window, every)}),
win AS (SELECT b.series, tick, seq - tick + {n - 1} AS i, x, y FROM due JOIN b ON b.series = due.series AND b.seq BETWEEN tick - {n - 1} AND tick),
bin AS (SELECT CAST(unnest(range(0, {bins if bins is not None else length // 2 + 1})) AS BIGINT) AS k),
tap AS (SELECT sum({weight} * {weight}) AS ww FROM (SELECT unnest(range(0, {n})) AS i)),
sums AS (SELECT series, tick, k, sum(x * {weight} * cos{angle}) AS re, -sum(x * {weight} * sin{angle}) AS im{second} FROM win CROSS JOIN bin GROUP BY ALL),
pow AS (SELECT series, tick AS seq, k, {power} AS p FROM sums CROSS JOIN tap)"""


HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 15))"
TWO = "(CASE WHEN k = 0 OR k = 8 THEN 1 ELSE 2 END)"


def _plain(power: str = "p") -> str:
    return f"\nSELECT series, seq, k AS bin, {rounded(power)} AS power FROM pow"


def skew(x: str, p: int) -> str:
    """Population skewness and excess kurtosis over the last p rows, from central moments."""
    return stage("c1", {"mu": f"avg({x}) OVER w", "xs": f"list({x}) OVER w"}, p) + """,
c2 AS (SELECT *, list_avg(list_transform(xs, lambda v: (v - mu) ** 2)) AS m2, list_avg(list_transform(xs, lambda v: (v - mu) ** 3)) AS m3,
              list_avg(list_transform(xs, lambda v: (v - mu) ** 4)) AS m4 FROM c1)"""


def oracles() -> dict[str, str]:
    p, out = 20, {}
    z = probit(0.05)

    # volatility
    out["realized_volatility"] = windowed("bars", p, {"value": "sqrt(sum(ret * ret) OVER w)"})
    out["rolling_volatility"] = windowed("bars", p, {"value": "stddev_samp(ret) OVER w"})
    out["rolling_returns"] = windowed("bars", p, {"value": "list_product(list(1.0::DOUBLE + ret) OVER w) - 1.0::DOUBLE"})
    out["parkinson"] = windowed("bars", p, {"value": "sqrt(avg(ln(high / low) ** 2) OVER w / (4 * ln(2.0::DOUBLE)))"})
    out["garman_klass"] = windowed("bars", p, {"value": "sqrt(greatest(0.0::DOUBLE, avg(ln(high / low) ** 2 / 2 - (2 * ln(2.0::DOUBLE) - 1) * ln(close / open) ** 2) OVER w))"})
    out["rogers_satchell"] = windowed("bars", p, {"value": "sqrt(greatest(0.0::DOUBLE, avg(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)) OVER w))"})
    out["variance_swap"] = windowed("bars", p, {"realized_variance": "sum(ret * ret) OVER w", "realized_volatility": "sqrt(sum(ret * ret) OVER w)", "pnl": "100.0::DOUBLE * (sum(ret * ret) OVER w - 0.04::DOUBLE)"})
    due = cadence(22, 5)
    out["fleming_ostdiek_whaley_vix"] = windowed("bars", 22, {"value": "100 * sqrt(252.0::DOUBLE) * stddev_pop(ret) OVER w"}, where=due)
    out["vandermeer_vix"] = windowed("bars", 22, {"value": "100 * sqrt(252.0::DOUBLE) * (list_sort(list(ret) OVER w)[17] - list_sort(list(ret) OVER w)[6]) / 1.35::DOUBLE"}, where=due)
    fix = "((22 * avg(ret) OVER w) ** 2 / (2 * 0.082::DOUBLE * 252))"
    out["demeterfi_variance_swap"] = windowed("bars", 22, {"strike": f"greatest(0.0::DOUBLE, var_pop(ret) OVER w * 252 + {fix})", "realized_variance": "var_pop(ret) OVER w", "correction": fix}, where=due)

    # microstructure
    lags = stage("s", {"ph": "lag(high) OVER o", "pl": "lag(low) OVER o"}) + """,
t AS (SELECT *, ln(high / low) ** 2 + ln(ph / pl) ** 2 AS beta, ln(greatest(high, ph) / least(low, pl)) ** 2 AS gamma, 3 - 2 * sqrt(2.0::DOUBLE) AS k FROM s),
a AS (SELECT *, greatest(0.0::DOUBLE, (sqrt(2 * beta) - sqrt(beta)) / k - sqrt(gamma / k)) AS alpha FROM t)"""
    out["corwin_schultz"] = windowed("bars", 1, {"value": "2 * (exp(alpha) - 1) / (exp(alpha) + 1)"}, 2, lags, "a")
    steps = stage("s", {"d1": "close - lag(close) OVER o", "d2": "lag(close) OVER o - lag(close, 2) OVER o"}) + """,
t AS (SELECT *, CASE WHEN d2 IS NOT NULL THEN greatest(d1, 0.0::DOUBLE) * greatest(-d2, 0.0::DOUBLE) END AS bounce FROM s)"""
    out["abdi_ranaldo"] = windowed("bars", p, {"value": "CASE WHEN avg(close) OVER w > 0 THEN least(2 * sqrt(avg(bounce) OVER w) / avg(close) OVER w, avg((high - low) / close) OVER w) END"}, p, steps, "t")
    quote = stage("s", {"mid": "(low + high) / 2", "dm": "(low + high) / 2 - lag((low + high) / 2) OVER o"}) + """,
t AS (SELECT *, CASE WHEN close >= high THEN 1.0::DOUBLE WHEN close <= low THEN -1.0::DOUBLE WHEN close > mid THEN 1.0::DOUBLE WHEN close < mid THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS dir FROM s),
v AS (SELECT *, CASE WHEN dm IS NULL THEN NULL ELSE dir END AS d FROM t),
q AS (SELECT *, count(dm) OVER u AS n, sum(d) OVER u AS sx, sum(dm) OVER u AS sy, sum(d * d) OVER u AS sxx, sum(d * dm) OVER u AS sxy FROM v WINDOW u AS (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
    out["glosten_milgrom"] = windowed("bars", 1, {"spread": "(high - low) / mid", "price_impact": "CASE WHEN abs(n * sxx - sx * sx) >= 1e-18 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0::DOUBLE END"}, 1, quote, "q")

    # tail risk
    out["value_at_risk"] = windowed("bars", p, {"value": "-quantile_cont(ret, 0.05) OVER w"})
    low, high = "list_avg(list_sort(list(ret) OVER w)[1:1])", "list_avg(list_sort(list(ret) OVER w)[20:20])"
    out["conditional_value_at_risk"] = windowed("bars", p, {"value": f"-({low})"})
    out["rachev_ratio"] = windowed("bars", p, {"value": f"CASE WHEN abs({low}) < 1e-18 THEN 'nan'::DOUBLE ELSE {high} / -({low}) END"})
    cf = stage("c", {"sd": "stddev_samp(ret) OVER w"}, p, "c2") + f""",
c4 AS (SELECT *, CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END AS s, CASE WHEN m2 > 0 THEN m4 / m2 ** 2 - 3 ELSE -3 END AS k, {z!r}::DOUBLE AS z FROM c)"""
    out["cornish_fisher_var"] = windowed("bars", p, {"value": "-(mu + sd * (z + (z ** 2 - 1) * s / 6 + (z ** 3 - 3 * z) * k / 24 - (2 * z ** 3 - 5 * z) * s * s / 36))"}, p, skew("ret", p) + cf, "c4")

    # factor models
    reg = {"vx": "var_samp(market - rf) OVER w", "cxy": "covar_samp(asset - rf, market - rf) OVER w", "mx": "avg(market - rf) OVER w", "my": "avg(asset - rf) OVER w", "vy": "var_samp(asset - rf) OVER w"}
    slope = "(CASE WHEN vx > 1e-18 THEN cxy / vx ELSE 0 END)"
    out["capm"] = windowed("pairs", p, {"alpha": f"my - {slope} * mx", "beta": slope, "r2": "CASE WHEN vx > 1e-18 AND vy > 1e-18 THEN cxy ** 2 / (vx * vy) ELSE 0 END", "residual_variance": "'nan'::DOUBLE"}, p, stage("s", reg, p), "s")
    out["jensen_alpha"] = windowed("pairs", p, {"value": f"my - {slope} * mx"}, p, stage("s", reg, p), "s")
    beta = "CASE WHEN var_samp(market) OVER w > 1e-18 THEN covar_samp(asset, market) OVER w / var_samp(market) OVER w ELSE 0 END"
    out["rolling_beta"] = windowed("pairs", p, {"beta": beta, "correlation": "greatest(-1, least(1, coalesce(corr(asset, market) OVER w, 0)))"})
    out["rolling_beta_stability"] = windowed("pairs", p, {"value": "stddev_samp(beta) OVER w"}, 2 * p - 1, stage("s", {"beta": f"CASE WHEN row_number() OVER o >= {p} THEN {beta} END"}, p), "s")
    out["tracking_error"] = windowed("pairs", p, {"value": "stddev_samp(asset - market) OVER w"})

    # performance
    out["sharpe_ratio"] = windowed("bars", p, {"value": "CASE WHEN stddev_samp(ret) OVER w > 1e-18 THEN (avg(ret) OVER w - 0.001::DOUBLE) / stddev_samp(ret) OVER w END"})
    down = "sqrt(avg(least(ret - 0.001::DOUBLE, 0) ** 2) OVER w)"
    out["sortino_ratio"] = windowed("bars", p, {"sortino": f"CASE WHEN {down} > 1e-18 THEN (avg(ret) OVER w - 0.001::DOUBLE) / {down} END", "downside_deviation": down})
    omega = lambda t: f"CASE WHEN sum(greatest({t} - ret, 0)) OVER w > 1e-18 THEN sum(greatest(ret - {t}, 0)) OVER w / sum(greatest({t} - ret, 0)) OVER w END"
    out["omega_ratio"] = windowed("bars", p, {"value": omega("0.01::DOUBLE")})
    out["gain_loss_ratio"] = windowed("bars", p, {"value": omega("0.0::DOUBLE")})
    cap = lambda c: f"CASE WHEN abs(sum(market) FILTER ({c}) OVER w) >= 1e-18 THEN avg(asset) FILTER ({c}) OVER w / avg(market) FILTER ({c}) OVER w ELSE 'nan'::DOUBLE END"
    out["capture_ratios"] = windowed("pairs", p, {"up_capture": cap("market > 0"), "down_capture": cap("market < 0")})
    cs = lambda c: f"CASE WHEN count(*) FILTER ({c}) OVER w >= 2 AND stddev_samp(asset) FILTER ({c}) OVER w > 1e-18 THEN avg(asset) FILTER ({c}) OVER w / stddev_samp(asset) FILTER ({c}) OVER w ELSE 'nan'::DOUBLE END"
    out["conditional_sharpe"] = windowed("pairs", p, {"up_sharpe": cs("market > 0"), "down_sharpe": cs("market < 0"), "is_ready": f"seq >= {p}"}, 1, raw=("is_ready",))
    n = 10
    z1, z2 = probit(1 - 1 / n), probit(1 - 1 / (n * 2.718281828459045))
    dsr = stage("c", {"sd": "stddev_samp(ret) OVER w"}, p, "c2") + f""",
c4 AS (SELECT *, mu / sd AS sr, CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END AS s, CASE WHEN m2 > 0 THEN m4 / m2 ** 2 ELSE 0 END AS k FROM c),
c5 AS (SELECT *, (1 - s * sr + (k - 1) / 4 * sr * sr) / {p - 1} AS vs FROM c4),
c6 AS (SELECT *, CASE WHEN vs > 0 THEN sqrt(vs) END AS ss FROM c5),
c7 AS (SELECT *, (sr - ss * (0.4227843350984671::DOUBLE * {z1!r}::DOUBLE + 0.5772156649015329::DOUBLE * {z2!r}::DOUBLE)) / ss AS z FROM c6)"""
    out["deflated_sharpe_ratio"] = windowed("bars", p, {"value": f"coalesce({cdf_sql('z')}, 'nan'::DOUBLE)"}, p, skew("ret", p) + dsr, "c7")
    lo = stage("s", {"pr": "lag(ret) OVER o"}) + stage("t", {"sd": "stddev_samp(ret) OVER w", "mu": "avg(ret) OVER w", "rho": "CASE WHEN var_samp(ret) OVER w > 1e-18 THEN covar_samp(ret, pr) OVER w / var_samp(ret) OVER w ELSE 0 END"}, p, "s") + """,
v AS (SELECT *, greatest(-0.999::DOUBLE, least(0.999::DOUBLE, rho)) AS held FROM t)"""
    out["lo_autocorrelation_sharpe"] = windowed("bars", p, {"lo_sharpe": "CASE WHEN sd > 1e-18 THEN mu / sd * sqrt((1 - held) / (1 + held)) END", "autocorrelation": "greatest(-1, least(1, rho))"}, p + 1, lo, "v")

    # signal
    weights = " + ".join(f"({float(w)!r})::DOUBLE * lag(x, {8 - i}) OVER o" for i, w in enumerate(savgol_weights(9, 2)))
    out["savitzky_golay"] = windowed("ticks", 9, {"value": weights})
    kz = stage("s1", {"a1": "avg(x) OVER w"}, 11) + stage("s2", {"a2": "avg(a1) OVER w"}, 11, "s1")
    out["kolmogorov_zurbenko"] = windowed("ticks", 11, {"value": "avg(a2) OVER w"}, 11, kz, "s2")
    wf = stage("s1", {"mu": "avg(x) OVER w", "v": "CASE WHEN row_number() OVER o >= 9 THEN var_samp(x) OVER w END"}, 9) + stage("s2", {"noise": "avg(v) OVER w"}, 32, "s1")
    out["wiener_filter"] = windowed("ticks", 9, {"value": "mu + CASE WHEN v > 1e-18 THEN greatest(v - noise, 0) / v ELSE 0 END * (x - mu)"}, 9, wf, "s2")
    ph = stage("s1", {"g": "ret - avg(ret) OVER u - 0.005::DOUBLE"}) + stage("s2", {"lv": "sum(g) OVER u"}, 1, "s1") + stage("s3", {"score": "lv - least(min(lv) OVER u, 0)"}, 1, "s2")
    out["page_hinkley"] = windowed("bars", 1, {"changed": "score > 50", "score": "score"}, 1, ph, "s3", raw=("changed",))
    out["teager_kaiser"] = windowed("ticks", 1, {"value": "lag(x) OVER o ** 2 - lag(x, 2) OVER o * x"}, 3).replace("lag(x) OVER o ** 2", "(lag(x) OVER o) ** 2")
    zc = stage("s1", {"side": "x >= 50"}) + stage("s2", {"crossed": "CASE WHEN side <> lag(side) OVER o THEN 1.0::DOUBLE ELSE 0 END"}, 1, "s1")
    out["zero_crossing_rate"] = windowed("ticks", 31, {"value": "sum(crossed) OVER w / 31"}, 32, zc, "s2")
    hoc = skew("x", 64)
    out["higher_order_cumulants"] = windowed("ticks", 64, {"skewness": "m3 / m2 ** 1.5", "kurtosis": "m4 / m2 ** 2 - 3", "nonlinearity_index": "abs(m4 / m2 ** 2 - 3)"}, stages=hoc, source="c2", where=cadence(64, 16))

    # recursions
    a = "0.06::DOUBLE"
    ewma = {"v": "b.ret * b.ret"}, {"v": f"(1 - {a}) * r.v + {a} * b.ret * b.ret"}
    out["ewma_variance"] = recursion("bars", *ewma, {"value": "v"})
    out["ewma_volatility"] = recursion("bars", *ewma, {"value": "sqrt(v)"})
    out["garch"] = recursion("bars", {"v": "1e-6::DOUBLE + 0.99::DOUBLE * b.ret ** 2", "p": "b.ret"}, {"v": "1e-6::DOUBLE + 0.09::DOUBLE * r.p ** 2 + 0.9::DOUBLE * r.v", "p": "b.ret"}, {"value": "sqrt(v)"})
    guess = "(r.x + r.v)"
    out["alpha_beta_tracker"] = recursion("ticks", {"x": "b.x", "v": "0.0::DOUBLE"}, {"x": f"{guess} + 0.5::DOUBLE * (b.x - {guess})", "v": f"r.v + 0.1::DOUBLE * (b.x - {guess})"}, {"value": "x", "velocity": "v", "variance": "NULL::DOUBLE"}, ("variance",))
    sp = "(r.s + 0.001::DOUBLE)"
    out["square_root_kalman"] = recursion("ticks", {"x": "b.x", "s": "1.0::DOUBLE"}, {"x": f"r.x + {sp} / ({sp} + 0.01::DOUBLE) * (b.x - r.x)", "s": f"(1 - {sp} / ({sp} + 0.01::DOUBLE)) * {sp}"}, {"value": "x", "velocity": "NULL::DOUBLE", "variance": "s"}, ("velocity",))
    ap, ay, ad = "(r.p + 0.001::DOUBLE)", "(b.x - r.x)", "0.05::DOUBLE"
    m1, m2 = f"((1 - {ad}) * r.m1 + {ad} * {ay})", f"((1 - {ad}) * r.m2 + {ad} * {ay} * {ay})"
    out["adaptive_kalman"] = recursion(
        "ticks", {"x": "b.x", "p": "0.01::DOUBLE", "q": "0.01::DOUBLE", "m1": "0.0::DOUBLE", "m2": "0.0::DOUBLE"},
        {"x": f"r.x + {ap} / ({ap} + r.q) * {ay}", "p": f"(1 - {ap} / ({ap} + r.q)) * {ap}", "q": f"(1 - {ad}) * r.q + {ad} * greatest(greatest({m2} - {m1} * {m1}, 1e-12) - {ap}, 1e-9)", "m1": m1, "m2": m2},
        {"value": "x", "velocity": "NULL::DOUBLE", "variance": "p"}, ("velocity",),
    )
    a00, a01, a11 = "(r.a + 2 * r.b + r.c + 0.001::DOUBLE / 3)", "(r.b + r.c + 0.0005::DOUBLE)", "(r.c + 0.001::DOUBLE)"
    gain0, gain1, gone = f"({a00} / ({a00} + 1))", f"({a01} / ({a00} + 1))", "(b.x - r.x - r.v)"
    out["kalman_filter"] = recursion(
        "ticks", {"x": "b.x", "v": "0.0::DOUBLE", "a": "0.5::DOUBLE", "b": "0.0::DOUBLE", "c": "1.0::DOUBLE"},
        {"x": f"r.x + r.v + {gain0} * {gone}", "v": f"r.v + {gain1} * {gone}", "a": f"(1 - {gain0}) * {a00}", "b": f"(1 - {gain0}) * {a01}", "c": f"{a11} - {gain1} * {a01}"},
        {"value": "x", "velocity": "v", "variance": "a"},
    )
    pa, pb, pc = "(2.0::DOUBLE + 0.001::DOUBLE / 3)", "1.0005::DOUBLE", "1.001::DOUBLE"
    first = {"x": f"b.x * {pa} / ({pa} + 1)", "v": f"b.x * {pb} / ({pa} + 1)", "a": f"{pa} - {pa} * {pa} / ({pa} + 1)", "b": f"{pb} - {pa} * {pb} / ({pa} + 1)", "c": f"{pc} - {pb} * {pb} / ({pa} + 1)"}
    then = {"x": f"r.x + r.v + {gain0} * {gone}", "v": f"r.v + {gain1} * {gone}", "a": f"(1 - {gain0}) * {a00}", "b": f"(1 - {gain0}) * {a01}", "c": f"{a11} - {gain1} * {a01}"}
    out["extended_kalman"] = recursion("ticks", first, then, {"value": "x", "velocity": "v", "variance": "a"})
    # the sigma points are drawn before process noise is added, so the gain does not see it
    n00, n01 = "(r.a + 2 * r.b + r.c)", "(r.b + r.c)"
    u0, u1 = f"({n00} / ({n00} + 1))", f"({n01} / ({n00} + 1))"
    out["unscented_kalman"] = recursion(
        "ticks", {"x": "b.x * 2 / 3", "v": "b.x / 3", "a": "2.0::DOUBLE + 0.001::DOUBLE / 3 - 4.0::DOUBLE / 3", "b": "1.0005::DOUBLE - 2.0::DOUBLE / 3", "c": "1.001::DOUBLE - 1.0::DOUBLE / 3"},
        {"x": f"r.x + r.v + {u0} * {gone}", "v": f"r.v + {u1} * {gone}", "a": f"{n00} + 0.001::DOUBLE / 3 - {u0} * {n00}", "b": f"{n01} + 0.0005::DOUBLE - {u0} * {n01}", "c": f"r.c + 0.001::DOUBLE - {u1} * {n01}"},
        {"value": "x", "velocity": "v", "variance": "a"},
    )
    ck = "(r.a + 0.01::DOUBLE)"
    out["cubature_kalman"] = recursion("ticks", {"x": "b.x", "a": "0.1::DOUBLE"}, {"x": f"r.x + {ck} / ({ck} + 0.1::DOUBLE) * (b.x - r.x)", "a": f"{ck} - {ck} * {ck} / ({ck} + 0.1::DOUBLE)"}, {"value": "x", "velocity": "0.0::DOUBLE", "variance": "a"})
    cosw, sinw, rho = "cos(r.w)", "sin(r.w)", "0.95::DOUBLE"
    y = f"(b.ret - 2 * {cosw} * r.x1 + r.x2 + 2 * {rho} * {cosw} * r.y1 - {rho} * {rho} * r.y2)"
    g = f"(2 * {sinw} * (r.x1 + {rho} * r.y1) + 2 * {rho} * {cosw} * r.d1 - {rho} * {rho} * r.d2)"
    zero = "0.0::DOUBLE"
    out["adaptive_notch_filter"] = recursion(
        "bars", {"w": "0.1::DOUBLE * pi()", "x1": "b.ret", "x2": zero, "y1": "b.ret", "y2": zero, "d1": zero, "d2": zero},
        {"w": f"greatest(1e-4::DOUBLE, least(pi() - 1e-4::DOUBLE, r.w - 0.001::DOUBLE * {y} * {g}))", "x1": "b.ret", "x2": "r.x1", "y1": y, "y2": "r.y1", "d1": g, "d2": "r.d1"},
        {"frequency": "w / (2 * pi())", "filtered": "y1"},
    )
    guess = "(r.w1 * r.x2 + r.w2 * r.x1)"
    out["lms_filter"] = recursion(
        "bars", {"n": "1", "w1": zero, "w2": zero, "x1": "b.ret", "x2": zero, "g": "NULL::DOUBLE"},
        {"n": "r.n + 1", "w1": f"CASE WHEN r.n >= 2 THEN r.w1 + 1e-4::DOUBLE * (b.ret - {guess}) * r.x2 ELSE r.w1 END", "w2": f"CASE WHEN r.n >= 2 THEN r.w2 + 1e-4::DOUBLE * (b.ret - {guess}) * r.x1 ELSE r.w2 END", "x1": "b.ret", "x2": "r.x1", "g": f"CASE WHEN r.n >= 2 THEN {guess} END"},
        {"value": "g"},
    )

    # spectra, window 16 every 8
    density = f"{TWO} * (re * re + im * im) / ww"
    for name in ("periodogram", "fft_spectral_density"):
        out[name] = spectrum(16, 8, HANN, density) + _plain()
    for name in ("welch_psd", "bartlett_method"):
        out[name] = spectrum(16, 8, HANN, density) + _plain("avg(p) OVER (PARTITION BY series, k ORDER BY seq ROWS UNBOUNDED PRECEDING)")
    out["short_time_fourier_transform"] = spectrum(16, 8, HANN, "sqrt(re * re + im * im)") + _plain()
    near = "avg(p) OVER (PARTITION BY series, seq ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    out["daniell_periodogram"] = spectrum(16, 8, "1.0::DOUBLE", density) + _plain(near)
    t = "(abs(i - 8.0::DOUBLE) / 8)"
    out["parzen_periodogram"] = spectrum(16, 8, f"(CASE WHEN {t} <= 0.5 THEN 1 - 6 * {t} ** 2 + 6 * {t} ** 3 ELSE 2 * (1 - {t}) ** 3 END)", density) + _plain()
    out["chirp_z_transform"] = spectrum(16, 8, "1.0::DOUBLE", "re * re + im * im", 10, "(0.1::DOUBLE + k * 0.2::DOUBLE / 9)") + _plain()
    pair = f"{TWO} * (re * re2 + im * im2) / ww AS a, {TWO} * (im * re2 - re * im2) / ww AS c, {TWO} * (re * re + im * im) / ww AS xx, {TWO} * (re2 * re2 + im2 * im2) / ww"
    run = lambda v: f"sum({v}) OVER (PARTITION BY series, k ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    out["cross_spectrum"] = spectrum(16, 8, HANN, pair, cross=True) + f", tot AS (SELECT series, seq, k, {run('a')} AS a, {run('c')} AS c, {run('1')} AS n FROM pow)\nSELECT series, seq, k AS bin, {rounded('sqrt(a * a + c * c) / n')} AS power FROM tot"
    out["coherence"] = spectrum(16, 8, HANN, pair, cross=True) + f", tot AS (SELECT series, seq, k, {run('a')} AS a, {run('c')} AS c, {run('xx')} AS xx, {run('p')} AS yy FROM pow)\nSELECT series, seq, k AS bin, {rounded('CASE WHEN xx * yy > 1e-30 THEN greatest(0, least(1, (a * a + c * c) / (xx * yy))) ELSE 0 END')} AS power FROM tot"
    out["goertzel"] = f"""WITH {TICKS},
k AS (SELECT * FROM (VALUES (0, 0.05::DOUBLE), (1, 0.1::DOUBLE), (2, 0.25::DOUBLE)) t(bin, f)),
s AS (SELECT series, (seq - 1) // 16 AS blk, count(*) AS n, bin, sum(x * cos(2 * pi() * f * ((seq - 1) % 16))) AS re, sum(x * sin(2 * pi() * f * ((seq - 1) % 16))) AS im FROM b CROSS JOIN k GROUP BY ALL)
SELECT series, blk * 16 + 16 AS seq, CAST(bin AS BIGINT) AS bin, {rounded("(re * re + im * im) / 256")} AS power FROM s WHERE n = 16"""

    # Haar differences of windows of 8 every 8
    out["modwt"] = f"""WITH {TICKS},
due AS (SELECT series, seq AS tick FROM b WHERE {cadence(8, 8)}),
win AS (SELECT due.series, tick, list(x ORDER BY seq) AS v FROM due JOIN b ON b.series = due.series AND b.seq BETWEEN tick - 7 AND tick GROUP BY ALL)
SELECT series, tick AS seq, CAST(u.bin AS BIGINT) AS bin, {rounded("u.d")} AS power FROM
  (SELECT series, tick, unnest([{{'bin': 0, 'd': (v[8] - v[7]) / 2}}, {{'bin': 1, 'd': ((v[8] + v[7]) / 2 - (v[6] + v[5]) / 2) / 2}}]) AS u FROM win)"""
    out["multiresolution_analysis"] = out["modwt"]

    # frames of the last 64 ticks, each 16
    out["realized_kernel"] = framed("greatest(0, list_sum(list_transform(range(0, 11), lambda h: CASE WHEN h = 0 THEN 1.0::DOUBLE WHEN h / 11.0::DOUBLE <= 0.5 THEN 2 - 12 * (h / 11.0::DOUBLE) ** 2 + 12 * (h / 11.0::DOUBLE) ** 3 ELSE 4 * (1 - h / 11.0::DOUBLE) ** 3 END * list_sum(list_transform(range(1, 65 - h), lambda i: d[i] * d[i + h])) / 64))) * 252")
    moves = "list_transform(range(1, 60), lambda i: (v[i + 5] - v[i]) ** 2)"
    out["two_scale_realized_variance"] = framed(f"greatest(0, list_sum({moves}) / 5 - list_avg(list_transform(range(1, 60, 5), lambda i: (v[i + 5] - v[i]) ** 2)) * 64 / 5) * 252")
    rising = "exp(-0.05::DOUBLE * (1 - i / 64.0::DOUBLE))"
    out["spectral_risk_measure"] = framed(f"list_sum(list_transform(range(1, 65), lambda i: abs(list_sort(v)[i]) * {rising})) / list_sum(list_transform(range(1, 65), lambda i: {rising}))")

    half = lambda x, sign: f"list_transform(range(1, len({x}) // 2 + 1), lambda i: ({x}[2 * i - 1] {sign} {x}[2 * i]) / sqrt(2.0::DOUBLE))"
    tree, level = "", "win"
    for j in range(6):
        low = f"s{j}" if j else "v"
        tree += f",\nl{j + 1} AS (SELECT *, {half(low, '+')} AS s{j + 1}, {half(low, '-')} AS d{j + 1} FROM {level})"
        level = f"l{j + 1}"
    out["discrete_wavelet_transform"] = frames() + tree + listed("flatten([s6, d6, d5, d4, d3, d2, d1])", "l6")
    node = lambda x: f"{half(x, '+')}, {half(x, '-')}"
    out["wavelet_packet"] = frames() + f",\nl1 AS (SELECT *, {half('v', '+')} AS s1, {half('v', '-')} AS d1 FROM win)" + listed(f"flatten([{node('s1')}, {node('d1')}])", "l1")
    tau = "((i - 63) / {s}.0::DOUBLE)"
    part = lambda s, trig: f"list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * exp(-0.5::DOUBLE * {tau.format(s=s)} ** 2) * {trig}(6 * {tau.format(s=s)})))"
    out["cwt_morlet"] = frames() + listed("[" + ", ".join(f"sqrt({part(s, 'cos')} ** 2 + {part(s, 'sin')} ** 2) * pi() ** (-0.25::DOUBLE) / sqrt({s}.0::DOUBLE)" for s in (2, 4, 8, 16)) + "]")
    turn = lambda trig: f"list_sum(list_transform(range(0, 64), lambda i: v[33 + i // 2] * v[33 - i // 2] * {trig}(pi() * i * k / 64)))"
    out["wigner_ville_distribution"] = frames() + listed(f"list_transform(range(0, 33), lambda k: sqrt({turn('cos')} ** 2 + {turn('sin')} ** 2) / 64)")
    # the analytic signal in closed form: rows an odd number away weigh by a cotangent
    away = lambda t: f"list_sum(list_transform(range(0, 128), lambda i: CASE WHEN ({t} - i) % 2 = 0 THEN 0.0::DOUBLE ELSE v[i + 1] / tan(pi() * ({t} - i) / 128) / 64 END))"
    analytic = frames(128, 64) + f""",
z AS (SELECT *, v[65] AS re, {away(64)} AS im, atan2({away(64)}, v[65]) AS a, atan2({away(63)}, v[64]) AS before FROM win),
got AS (SELECT series, tick, sqrt(re * re + im * im) AS amplitude, a AS phase, (CASE WHEN a - before > pi() THEN a - before - 2 * pi() WHEN a - before < -pi() THEN a - before + 2 * pi() ELSE a - before END) / (2 * pi()) AS frequency FROM z)
SELECT b.series, b.seq"""
    there = " FROM b LEFT JOIN got ON got.series = b.series AND got.tick = b.seq"
    out["hilbert_transform"] = analytic + "".join(f", {rounded(c)} AS {c}" for c in ("amplitude", "phase", "frequency")) + there
    out["instantaneous_frequency"] = analytic + f", {rounded('frequency')} AS value" + there

    # all event types at an hour
    whole = f"WITH {VECTORS},\ndot AS (SELECT 'all' AS series, seq, sum(ret * weight) AS value FROM cell GROUP BY seq)\nSELECT series, seq, {rounded('value')} AS value"
    out["portfolio_duration"] = whole + " FROM dot"
    out["portfolio_returns"] = whole + f", {rounded('sum(value) OVER u')} AS cumulative, {rounded('avg(value) OVER u')} AS mean FROM dot WINDOW u AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    out["ewma_covariance_matrix"] = f"""WITH RECURSIVE {VECTORS},
outer_ AS (SELECT a.seq, (a.k - 1) * 5 + b.k - 1 AS bin, a.ret * b.ret AS p FROM cell a JOIN cell b USING (seq)),
r AS (SELECT seq, bin, p AS c FROM outer_ WHERE seq = 1
      UNION ALL SELECT o.seq, o.bin, (1 - 0.94::DOUBLE) * r.c + 0.94::DOUBLE * o.p FROM r JOIN outer_ o ON o.bin = r.bin AND o.seq = r.seq + 1)
SELECT 'all' AS series, seq, bin, {rounded('c')} AS power FROM r"""

    # wealth against its peak, and a loop with a phase
    grown = "(r.w * (1 + b.ret))"
    wealth = recursion("bars", {"w": "1 + b.ret", "top": "1 + b.ret"}, {"w": grown, "top": f"greatest(r.top, {grown})"}, {}).split("\nSELECT")[0]
    out["conditional_drawdown_at_risk"] = f"""{wealth},
f AS (SELECT series, seq, CASE WHEN top > 0 THEN (top - w) / top ELSE 0 END AS down FROM r),
g AS (SELECT series, seq, list(down) OVER w AS recent, quantile_cont(down, 0.9) OVER w AS edge, max(down) OVER u AS most FROM f
      WINDOW w AS (PARTITION BY series ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), u AS (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT series, seq, {rounded("list_avg(list_filter(recent, lambda q: q >= edge))")} AS cdar, {rounded("most")} AS max_drawdown FROM g"""
    err = "(-b.ret * sin(r.ph))"
    freq = f"least(0.5::DOUBLE, greatest(-0.5::DOUBLE, r.fr + 0.2::DOUBLE * {err} + (r.sm + 0.01::DOUBLE * {err})))"
    turned = f"(r.ph + 2 * pi() * {freq})"
    out["phase_locked_loop"] = recursion(
        "bars", {"ph": "2 * pi() * 0.1::DOUBLE", "fr": "0.1::DOUBLE", "sm": zero, "calm": "1", "i": "1.0::DOUBLE", "q": zero},
        {"ph": f"CASE WHEN abs({turned}) > pi() THEN {turned} - 2 * pi() * sign({turned}) ELSE {turned} END", "fr": freq, "sm": f"r.sm + 0.01::DOUBLE * {err}", "calm": f"CASE WHEN abs({err}) < 0.1 THEN r.calm + 1 ELSE 0 END", "i": "cos(r.ph)", "q": "sin(r.ph)"},
        {"frequency": "fr", "in_phase": "i", "quadrature": "q", "locked": "calm > 50"}, ("locked",),
    )

    # single rows
    d1 = "((ln(spot / strike) + (rate + sigma ** 2 / 2) * ttm) / (sigma * sqrt(ttm)))"
    out["bs_price"] = f"""WITH {TICKS},
c AS (SELECT series, seq, 100.0::DOUBLE AS spot, 60.0::DOUBLE + least(x, 80) AS strike, 0.1::DOUBLE + (seq % 20) / 10.0::DOUBLE AS ttm, 0.03::DOUBLE AS rate, 0.1::DOUBLE + (seq % 7) / 20.0::DOUBLE AS sigma, seq % 2 = 0 AS is_call FROM b),
d AS (SELECT *, {d1} AS d1 FROM c), e AS (SELECT *, d1 - sigma * sqrt(ttm) AS d2, CASE WHEN is_call THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g FROM d), f AS (SELECT *, g * d1 AS a, g * d2 AS c FROM e)
SELECT series, seq, {rounded(f"g * (spot * {cdf_sql('a')} - strike * exp(-rate * ttm) * {cdf_sql('c')})")} AS value FROM f"""
    return {k: placed(v, PLACES.get(k, 6)) for k, v in out.items()}
