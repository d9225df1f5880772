"""Quality flags from raw codes and ratios, and the overall flag."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeolith.functions.codes import digit, hard_flag

#: The tests of a nine-digit raw-data code, by position after the leading digit.
RAW_TESTS = ("spikes", "amplitude", "dropout", "abslim", "skewkurt_hf", "skewkurt_sf", "discont_hf", "discont_sf")


def raw_data_flags(code: Column) -> dict[str, Column]:
    """Eight flags of a raw-data code; a digit 1 in hard tests is 2."""
    return {t: hard_flag(code, i + 1) for i, t in enumerate(RAW_TESTS)}


def second_digit_flag(code: Column) -> Column:
    return F.when(digit(code, 1) >= 1, 2).when(digit(code, 1) == 0, 0)


def threshold_flag(x: Column, good: float, ok: float) -> Column:
    """0 below good, 1 below ok, else 2."""
    return F.when(x < good, 0).when(x < ok, 1).when(x.isNotNull(), 2)


def completeness_flag(found: Column, expected: Column, good: float = 0.99, ok: float = 0.97) -> Column:
    r = F.try_divide(found, expected)
    return F.when(r >= good, 0).when(r >= ok, 1).when(r.isNotNull(), 2)


def signal_strength_flag(x: Column, threshold: float, discard: str = "below") -> Column:
    return F.when(x < threshold if discard == "below" else x > threshold, 2).when(x.isNotNull(), 0)


def overall(flags: list[Column], day: Column | None = None, day_from: int = 2, night_from: int = 2) -> Column:
    """0 if no flag is raised; 2 with more than three soft ones or two hard ones; 1 with up to three soft and none hard; else 2. Values from the threshold for day or night on are 2."""
    soft = reduce(add, [F.when(f == 1, 1).otherwise(0) for f in flags])
    hard = reduce(add, [F.when(f == 2, 1).otherwise(0) for f in flags])
    q = F.when(soft + hard == 0, 0).when((soft > 3) | (hard >= 1), 2).otherwise(1)
    if day is not None:
        q = F.when(day & (q >= day_from), 2).when(~day & (q >= night_from), 2).otherwise(q)
    return q


def restrict(flag: Column, ts: Column, ranges: list) -> Column:
    """The flag inside the ranges, null elsewhere."""
    inside = reduce(lambda a, b: a | b, [ts.between(F.lit(a).cast("timestamp_ntz"), F.lit(z).cast("timestamp_ntz")) for a, z in ranges])
    return F.when(inside, flag)


def screening_report(df, value: str, flags: list[str], keys: list[str]):
    """(keys, test, position, newly_rejected, retained): test by test in order, which values it is the first to reject and how many are left."""
    gone = F.lit(False)
    parts = []
    for i, f in enumerate(flags):
        bad = F.coalesce(F.col(f) == 2, F.lit(False)) & F.col(value).isNotNull()
        new = F.count_if(bad & ~gone)
        gone = gone | bad
        parts.append(F.struct(F.lit(f).alias("test"), F.lit(i).alias("position"), new.alias("newly_rejected"), F.count_if(~gone & F.col(value).isNotNull()).alias("retained")))
    return df.groupBy(*keys).agg(F.array(*parts).alias("p")).select(*keys, F.inline("p"))
