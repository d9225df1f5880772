"""Features of regular series for models, stage by stage: lags, rolling statistics, differences, exponential means, powers, seasonal parts, calendar, record number."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators import decompose

#: Rolling statistics beyond mean and standard deviation, by name.
STATISTICS = {
    "median": ("MEDIAN", lambda c: F.percentile(c, F.lit(0.5))), "min": ("MIN", F.min), "max": ("MAX", F.max), "std": ("SD", F.stddev_pop), "q25": ("Q25", lambda c: F.percentile(c, F.lit(0.25))), "q75": ("Q75", lambda c: F.percentile(c, F.lit(0.75))),
}


def exponential_mean(values: Column, span: int) -> Column:
    """Of values in order of time, their exponential mean; a missing value lets the weight of what is known decay."""
    a = 2 / (span + 1)

    def step(s: Column, x: Column) -> Column:
        old = s["w"] * (1 - a)
        new = F.when(s["m"].isNull(), x).otherwise((old * s["m"] + a * x) / (old + a))
        return F.struct(F.when(x.isNull(), s["m"]).otherwise(new).alias("m"), F.when(x.isNull(), old).otherwise(F.lit(1.0)).alias("w"))

    return F.aggregate(values, F.struct(F.lit(None).cast("double").alias("m"), F.lit(1.0).alias("w")), step, lambda s: s["m"])


@dataclass(frozen=True)
class Engineer:
    """The stages to make; those left empty are skipped. New columns are ``.{column}{sign}{n}``; columns that begin with a stop are no sources.

    lags is (first, last), without 0; rolling, differences and exponential are window lengths, orders and spans; powers
    the highest degree; seasonal a period in records. not_from names, by stage, columns that it leaves out.
    """

    target: str
    lags: tuple[int, int] | None = None
    lag_step: int = 1
    rolling: tuple[int, ...] = ()
    statistics: tuple[str, ...] = ()
    differences: tuple[int, ...] = ()
    exponential: tuple[int, ...] = ()
    powers: int = 0
    seasonal: int = 0
    clock: bool = False
    record_number: bool = False
    not_from: dict[str, tuple[str, ...]] | None = None

    def _sources(self, df: DataFrame, keys: list[str], ts: str, stage: str) -> list[str]:
        out = {self.target, ts, *keys, *(self.not_from or {}).get(stage, ())}
        numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
        return [c for c, k in df.dtypes if c not in out and not c.startswith(".") and (k in numeric or k.startswith("decimal"))]

    def transform(self, df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
        """df with the features. Series are windows of their own; one without rows has none."""
        w = Window.partitionBy(*keys).orderBy(ts)
        new: dict[str, Column] = {}
        at = lambda c: F.col(f"`{c}`")
        if self.lags:
            for c in self._sources(df, keys, ts, "lags"):
                new |= {f".{c}{n:+d}": F.lag(at(c), -n).over(w) for n in range(self.lags[0], self.lags[1] + 1, self.lag_step) if n}
        for n in self.rolling:
            over = w.rowsBetween(1 - n, 0)
            for c in self._sources(df, keys, ts, "rolling"):
                new |= {f".{c}_MEAN{n}": F.avg(at(c)).over(over), f".{c}_SD{n}": F.stddev_pop(at(c)).over(over)}
                new |= {f".{c}_ROLL{STATISTICS[s][0]}{n}": STATISTICS[s][1](at(c)).over(over) for s in self.statistics}
        for order in self.differences:
            for c in self._sources(df, keys, ts, "differences"):
                # the differences of an order are a sum of values with binomial factors
                new[f".{c}_DIFF{order}"] = sum(((-1) ** k * math.comb(order, k) * (F.lag(at(c), k).over(w) if k else at(c)) for k in range(order + 1)), F.lit(0.0))
        for span in self.exponential:
            known = math.ceil(-math.log(1e-12) / -math.log(1 - 2 / (span + 1))) if span > 1 else 1
            for c in self._sources(df, keys, ts, "exponential"):
                boxed = F.transform(F.collect_list(F.struct(at(c).cast("double").alias("x"))).over(w.rowsBetween(1 - known, 0)), lambda s: s["x"])
                new[f".{c}_EMA{span}"] = exponential_mean(boxed, span)
        for degree in range(2, self.powers + 1):
            new |= {f".{c}_POL{degree}": F.pow(at(c), F.lit(degree)) for c in self._sources(df, keys, ts, "powers")}
        out = df.withColumns(new) if new else df
        if self.seasonal:
            for c in self._sources(df, keys, ts, "seasonal"):
                parts = decompose.classical(df.select(*keys, ts, at(c).alias("v")), keys, self.seasonal)
                out = out.join(parts.select(*keys, ts, *[F.col(p).alias(f".{c}_STL_{p.upper()}") for p in ("trend", "seasonal", "residual")]), [*keys, ts], "left")
        if self.clock:
            turn = lambda x, n: {f".{x}_SIN": F.sin(2 * math.pi * n), f".{x}_COS": F.cos(2 * math.pi * n)}
            out = out.withColumns({".YEAR": F.year(ts)} | turn("DOY", F.dayofyear(ts) / 365.25) | turn("HOUR", (F.hour(ts) + F.minute(ts) / 60) / 24) | turn("MONTH", F.month(ts) / 12) | turn("WEEK", F.weekofyear(ts) / 52))
        if self.record_number:
            out = out.withColumn(".RECORDNUMBER", F.row_number().over(w))
        return out
