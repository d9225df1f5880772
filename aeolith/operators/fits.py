"""Curves through pairs of values, their bands, tests of precedence, entropy, and short-time spectra.

What a fit needs of the data are sums, taken where the data are; only these come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers of x by kind of curve.
CURVES = {"linear": (1, 0), "quadratic": (2, 1), "quadratic_offset": (2, 1, 0), "cubic": (3, 2, 1, 0)}


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d if abs(1 + n * d) > tiny else tiny)
        c = 1 + n / c if abs(1 + n / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """Chance of a larger F."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile(p: float, d: float) -> float:
    """Student's t below which a share p >= 0.5 lies."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - incomplete_beta(d / 2, 0.5, d / (d + mid * mid)) / 2
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Curve:
    """A fitted curve: coefficients by falling power, their covariance, goodness of fit, and what bands need."""

    kind: str
    coefficients: tuple[float, ...]
    covariance: np.ndarray
    r2: float
    mae_known: bool
    rmse: float
    n: int
    mean_x: float
    sum_xx: float
    x_min: float
    x_max: float

    @property
    def adjusted_r2(self) -> float:
        p = len(self.coefficients) - (0 in CURVES[self.kind])
        return 1 - (1 - self.r2) * (self.n - 1) / max(self.n - p - 1, 1)

    def value(self, x: Column) -> Column:
        return sum((c * F.pow(x, F.lit(p)) if p else F.lit(c) for c, p in zip(self.coefficients, CURVES[self.kind], strict=True)), F.lit(0.0))

    def predictions(self, n: int = 1000, x_min: float | None = None, x_max: float | None = None) -> pd.DataFrame:
        """fit_x, fit_y, 95 % limits of the curve and of single values at n equal steps."""
        x = np.linspace(self.x_min if x_min is None else x_min, self.x_max if x_max is None else x_max, n)
        basis = np.stack([x**p for p in CURVES[self.kind]], 1)
        y = basis @ np.array(self.coefficients)
        sd = np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", basis, self.covariance, basis), 0))
        free = self.n - len(self.coefficients)
        band = t_quantile(0.975, free) * self.rmse * math.sqrt(self.n / free) * np.sqrt(1 + 1 / self.n + (x - self.mean_x) ** 2 / self.sum_xx)
        return pd.DataFrame({"fit_x": x, "fit_y": y, "std": sd, "lower_ci": y - 1.96 * sd, "upper_ci": y + 1.96 * sd, "lower_band": y - band, "upper_band": y + band})


def fit_curve(df: DataFrame, x: str, y: str, kind: str = "quadratic_offset", bins: int = 0, how: str = "mean") -> Curve:
    """A least squares curve of y on x, through all pairs or through means or medians of quantile bins of x. Fewer pairs than coefficients raise ValueError."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if bins:
        from aeolith.operators.binning import bin_of, quantile_edges

        mid = F.avg if how == "mean" else lambda c: F.percentile(c, F.lit(0.5))
        e = quantile_edges(d, [], "x", bins)
        d = d.join(F.broadcast(e), F.lit(True)).groupBy(bin_of(F.col("x"), F.col("edges")).alias("bin")).agg(mid("x").alias("x"), mid("y").alias("y"))
    powers = CURVES[kind]
    s = d.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max(F.abs("x")).alias("scale"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if s.n <= len(powers):
        raise ValueError(f"{s.n} pairs are too few for a {kind} curve")
    z = F.col("x") / (s.scale or 1.0)
    sums = d.agg(
        *[F.sum(F.pow(z, F.lit(p))).alias(f"z{p}") for p in range(2 * max(powers) + 1)], *[F.sum(F.pow(z, F.lit(p)) * F.col("y")).alias(f"y{p}") for p in powers],
        F.sum((F.col("y") - s.my) ** 2).alias("syy"), F.sum((F.col("x") - s.mx) ** 2).alias("sxx"),
    ).first()
    gram = np.array([[sums[f"z{p + q}"] for q in powers] for p in powers])
    inverse = np.linalg.inv(gram)
    b = inverse @ np.array([sums[f"y{p}"] for p in powers])
    curve = sum((float(c) * F.pow(z, F.lit(p)) for c, p in zip(b, powers, strict=True)), F.lit(0.0))
    rss = d.agg(F.sum((F.col("y") - curve) ** 2)).first()[0]
    unit = np.array([(s.scale or 1.0) ** -p for p in powers])
    return Curve(kind, tuple((b * unit).tolist()), inverse * rss / (s.n - len(powers)) * np.outer(unit, unit), 1 - rss / sums["syy"] if sums["syy"] else 0.0, False, math.sqrt(rss / s.n), s.n, s.mx, sums["sxx"], s.lo, s.hi)


def zscore(v: str, keys: list[str], absolute: bool = True) -> Column:
    """Distance from the mean in population standard deviations."""
    w = Window.partitionBy(*keys)
    z = F.try_divide(F.col(v) - F.avg(v).over(w), F.stddev_pop(v).over(w))
    return F.abs(z) if absolute else z


def from_zscore(v: str, z: Column | float, keys: list[str]) -> Column:
    """The value that stands z population standard deviations above the mean."""
    w = Window.partitionBy(*keys)
    return F.avg(v).over(w) + z * F.stddev_pop(v).over(w)


def nearest_value(df: DataFrame, keys: list[str], v: str, value: float) -> DataFrame:
    """(keys, nearest): the value nearest to one given, ties to the smaller."""
    return df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(v) - value).alias("d"), F.col(v).alias("nearest"))).alias("s")).select(*keys, "s.nearest")


def granger(df: DataFrame, keys: list[str], x: str, y: str, most: int = 5, ts: str = "ts") -> DataFrame:
    """(keys, lag, f, p): does x's past help to tell y, beyond y's own? F tests of 1 to most lags over records with both values.

    The sums of products that both regressions need are aggregated; a series sends one row. One with too few records or
    lags that depend on one another gives null.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, ts, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    every = Window.partitionBy(*keys)
    d = d.withColumn("x", F.col("x") - F.avg("x").over(every)).withColumn("y", F.col("y") - F.avg("y").over(every)).withColumn("one", F.lit(1.0))
    names = ["y", "one", *[f"y{i}" for i in range(1, most + 1)], *[f"x{i}" for i in range(1, most + 1)]]
    d = d.withColumns({f"{c}{i}": F.lag(c, i).over(w) for c in ("x", "y") for i in range(1, most + 1)}).withColumn("rn", F.row_number().over(w))
    sums = []
    for p in range(1, most + 1):  # the first p records have no p lags
        own = [n for n in names if n in ("y", "one") or int(n[1:]) <= p]
        sums += [F.sum(F.when(F.col("rn") > p, F.col(a) * F.col(b))).alias(f"{p}_{a}_{b}") for i, a in enumerate(own) for b in own[i:]]
    totals = d.groupBy(*keys).agg(*sums)
    types = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                for p in range(1, most + 1):
                    own = [n for n in names if n in ("y", "one") or int(n[1:]) <= p]
                    get = lambda a, b, p=p, r=r, own=own: r[f"{p}_{a}_{b}"] if own.index(a) <= own.index(b) else r[f"{p}_{b}_{a}"]

                    def rss(use: list[str], get=get) -> float:
                        g, h = np.array([[get(a, b) for b in use] for a in use], float), np.array([get(a, "y") for a in use], float)
                        return float(get("y", "y") - h @ np.linalg.lstsq(g, h, rcond=None)[0])

                    n, f, chance = get("one", "one"), None, None
                    free = (n or 0) - 2 * p - 1
                    if free > 0:
                        short, full = rss([c for c in own[1:] if c[0] != "x"]), rss(own[1:])
                        if full > 1e-12 * max(float(get("y", "y")), 1e-300):
                            f = (short - full) / p / (full / free)
                            chance = f_tail(f, p, free)
                    rows.append((*[r[k] for k in keys], p, f, chance))
            yield pd.DataFrame(rows, columns=[*keys, "lag", "f", "p"])

    return totals.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", lag int, f double, p double")


def approximate_entropy(df: DataFrame, keys: list[str], m: int = 2, r: float | None = None, v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, entropy): regularity of a series; r is 0.2 population standard deviations unless given. Patterns are compared with one another, so a series should be short."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts)[v].to_numpy(float)
        near = r if r is not None else 0.2 * float(x.std()) if len(x) else 0.0

        def phi(size: int) -> float:
            n = len(x) - size + 1
            own = np.lib.stride_tricks.sliding_window_view(x, size)
            total = 0.0
            for a in range(0, n, 256):
                total += float(np.log((np.abs(own[a : a + 256, None] - own[None]).max(2) <= near).mean(1)).sum())
            return total / n

        e = phi(m) - phi(m + 1) if len(x) > m + 1 else None
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "entropy": [e]})

    return df.where(F.col(v).isNotNull()).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", entropy double")


def spectrogram(df: DataFrame, keys: list[str], size: int = 256, overlap: int | None = None, v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, segment, start, frequency, power, db): spectra of windows of size records, by Hann's weights, the mean taken out. Frequencies are per record; only whole windows without gaps count.

    A window is a group of its own, so a long series is many tasks.
    """
    hop = size - (size // 8 if overlap is None else overlap)
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1)
    last, first = F.floor(F.col("_r") / hop), F.greatest(F.ceil((F.col("_r") - size + 1) / hop), F.lit(0))
    d = d.withColumn("segment", F.explode(F.sequence(first, last)))
    d = d.withColumn("_c", F.count(v).over(Window.partitionBy(*keys, "segment"))).where(F.col("_c") == size).drop("_c")
    types = dict(df.dtypes)
    weight = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        x = pdf[v].to_numpy(float)
        f = np.fft.rfft((x - x.mean()) * weight)
        p = np.abs(f) ** 2 / weight.sum() ** 2
        p[1 : None if size % 2 else -1] *= 2
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "segment": int(pdf["segment"].iloc[0]), "start": pdf[ts].iloc[0], "frequency": np.fft.rfftfreq(size), "power": p, "db": 10 * np.log10(np.maximum(p, 1e-20))})

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", segment long, start {types[ts]}, frequency double, power double, db double"
    return d.groupBy(*keys, "segment").applyInPandas(run, schema)
