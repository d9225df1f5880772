"""Streaming front-ends: the same results as the batch operators once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample(stream: DataFrame, keys: list[str], seconds: int, late: str = "10 minutes", ts: str = "ts", v: str = "v") -> DataFrame:
    """Means by bucket and key, given out when no earlier row can come; ts must be a timestamp with time zone."""
    b = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.avg(v).alias(v), F.count(v).alias("n"))
    return b.select(*keys, F.col("w.end").alias(ts), v, "n")


def time_since(stream: DataFrame, key: str, lo: float, ts: str = "ts", v: str = "v") -> DataFrame:
    """Records since the value of a key was last at least lo, in order of stamp within each micro-batch."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        d = pd.concat(list(batches)).sort_values(ts)
        out = []
        for x in d[v]:
            n = 0 if x is not None and x >= lo else n + 1
            out.append(n)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]] * len(d), ts: d[ts], "since": out})

    types = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {types[key]}, `{ts}` {types[ts]}, since int", "n int", "append", "NoTimeout")
