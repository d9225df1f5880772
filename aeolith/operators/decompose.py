"""Trend, season and rest; harmonics and spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classical(df: DataFrame, keys: list[str], period: int, model: str = "additive", ts: str = "ts", v: str = "v") -> DataFrame:
    """Centred moving average of one period (half weights at the ends if it is even), mean of the rest by phase, centred; null within half a period of the ends or of gaps."""
    w = Window.partitionBy(*keys).orderBy(ts)
    h = period // 2
    d = df.withColumn("_r", F.row_number().over(w) - 1)
    if period % 2:
        full, n = w.rowsBetween(-h, h), period
        mean = F.sum(v).over(full) / period
    else:
        full, n = w.rowsBetween(-h, h), period + 1
        ends = F.lag(v, h).over(w) + F.lead(v, h).over(w)
        mean = (F.sum(v).over(full) - ends / 2) / period
    d = d.withColumn("trend", F.when(F.count(v).over(full) == n, mean))
    off = F.col(v) - F.col("trend") if model == "additive" else F.try_divide(F.col(v), F.col("trend"))
    d = d.withColumn("_o", off).withColumn("_p", F.col("_r") % period)
    phase = F.avg("_o").over(Window.partitionBy(*keys, "_p"))
    d = d.withColumn("_s", phase)
    s = d.groupBy(*keys, "_p").agg(F.first("_s").alias("x")).groupBy(*keys).agg(F.avg("x").alias("_c"))
    d = d.join(s, keys)
    if model == "additive":
        d = d.withColumn("seasonal", F.col("_s") - F.col("_c")).withColumn("residual", F.col(v) - F.col("trend") - F.col("seasonal"))
    else:
        d = d.withColumn("seasonal", F.try_divide(F.col("_s"), F.col("_c"))).withColumn("residual", F.try_divide(F.col(v), F.col("trend") * F.col("seasonal")))
    return d.drop("_r", "_o", "_p", "_s", "_c")


def harmonics(df: DataFrame, keys: list[str], period: int, n: int = 5, ts: str = "ts", v: str = "v") -> DataFrame:
    """(keys, harmonic, amplitude, phase, power): sums of sine and cosine over the records with a value, by their place in the series."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1).where(F.col(v).isNotNull())
    d = d.withColumn("_x", F.col(v) - F.avg(v).over(Window.partitionBy(*keys)))
    angle = lambda k: 2 * F.pi() * k * F.col("_r") / period
    sums = [F.struct(F.lit(k).alias("harmonic"), (2 * F.avg(F.col("_x") * F.cos(angle(k)))).alias("a"), (2 * F.avg(F.col("_x") * F.sin(angle(k)))).alias("b")) for k in range(1, n + 1)]
    out = d.groupBy(*keys).agg(F.array(*sums).alias("h")).select(*keys, F.inline("h"))
    return out.select(*keys, "harmonic", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("amplitude"), F.atan2("b", "a").alias("phase"), (F.col("a") ** 2 + F.col("b") ** 2).alias("power"))


def _loess(y: np.ndarray, q: int, at: np.ndarray, weight: np.ndarray, degree: int = 1) -> np.ndarray:
    """Locally weighted regression on record numbers 0..n-1, tricube weights of the q nearest."""
    n = len(y)
    x = np.arange(n)
    out = np.empty(len(at))
    for i, p in enumerate(at):
        lo = int(np.clip(round(p) - q // 2, 0, max(0, n - q)))
        s = slice(lo, min(n, lo + q))
        d = np.abs(x[s] - p)
        far = max(d.max(), 1e-9) * (1 if q <= n else q / n) * 1.0001
        w = (1 - (d / far) ** 3) ** 3 * weight[s]
        t = w.sum()
        if t <= 0:
            out[i] = y[s].mean()
            continue
        m, c = (w * x[s]).sum() / t, (w * y[s]).sum() / t
        v = (w * (x[s] - m) ** 2).sum()
        out[i] = c + ((w * (x[s] - m) * (y[s] - c)).sum() / v * (p - m) if degree and v > 1e-9 else 0.0)
    return out


def _average(x: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(x, np.ones(k) / k, "valid")


def stl_arrays(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, rounds: int = 2, robust: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by loess (Cleveland et al. 1990) of a series without gaps: trend, seasonal, residual."""
    n = len(y)
    trend = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    low = period | 1
    t, weight = np.zeros(n), np.ones(n)
    s = np.zeros(n)
    for outer in range(robust + 1):
        for _ in range(rounds):
            c = np.zeros(n + 2 * period)
            for p in range(period):
                own = (y - t)[p::period]
                if len(own):
                    c[p::period][: len(own) + 2] = _loess(own, min(seasonal, len(own)) if len(own) > 1 else 1, np.arange(-1, len(own) + 1), weight[p::period])
            smooth = _average(_average(_average(c, period), period), 3)
            s = c[period : period + n] - _loess(smooth, low, np.arange(n), np.ones(len(smooth)))
            t = _loess(y - s, trend, np.arange(n), weight)
        if outer < robust:
            r = np.abs(y - s - t)
            h = 6 * np.median(r)
            weight = (1 - np.minimum(r / h, 1) ** 2) ** 2 if h > 0 else np.ones(n)
    return t, s, y - s - t


def stl(df: DataFrame, keys: list[str], period: int, seasonal: int = 7, ts: str = "ts", v: str = "v") -> DataFrame:
    """df with trend, seasonal, residual; one series is one task. Gaps are interpolated for the fit and null in the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[v].astype(float).interpolate(limit_direction="both").to_numpy()
        parts = stl_arrays(y, period, seasonal) if len(y) >= 2 * period and not np.isnan(y).any() else (np.full(len(y), np.nan),) * 3
        gone = pdf[v].isna().to_numpy()
        for name, x in zip(("trend", "seasonal", "residual"), parts, strict=True):
            pdf[name] = pd.Series(np.where(gone, np.nan, x), index=pdf.index)
        return pdf

    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", trend double, seasonal double, residual double"
    out = df.groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("trend", "seasonal", "residual")})


def seasonality(df: DataFrame, keys: list[str], most: int = 730, top: int = 5, ts: str = "ts", v: str = "v") -> DataFrame:
    """(keys, rank, period, power): the highest local peaks of the detrended periodogram."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[v].astype(float).interpolate(limit_direction="both").to_numpy()
        out = {c: [pdf[c].iloc[0]] for c in keys}
        if len(y) < 8 or np.isnan(y).any():
            return pd.DataFrame({c: [] for c in [*keys, "rank", "period", "power"]})
        x = np.arange(len(y))
        y = y - np.polyval(np.polyfit(x, y, 1), x)
        p = np.abs(np.fft.rfft(y)) ** 2 / len(y)
        k = np.array([i for i in range(1, len(p)) if len(y) / i <= most and p[i] >= p[i - 1] and (i + 1 == len(p) or p[i] >= p[i + 1])], int)
        k = k[np.argsort(-p[k], kind="stable")][:top]
        return pd.DataFrame({c: out[c] * len(k) for c in keys} | {"rank": np.arange(1, len(k) + 1), "period": len(y) / k, "power": p[k]})

    types = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", rank int, period double, power double")


def reconstruct(parts: DataFrame, keep: tuple[str, ...] = ("trend", "seasonal", "residual"), model: str = "additive", name: str = "reconstructed") -> DataFrame:
    """Sum or product of the parts kept; null where one of them is."""
    total = F.lit(0.0) if model == "additive" else F.lit(1.0)
    for c in keep:
        total = total + F.col(c) if model == "additive" else total * F.col(c)
    return parts.withColumn(name, total)
