"""Sun position and potential radiation as column expressions; naive local time at a fixed UTC offset."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLAR_CONSTANT = 1367.0


def declination(doy: Column) -> Column:
    """Radians, by the Fourier series of Spencer (1971)."""
    g = 2 * math.pi * (doy - 1) / 365.0
    return 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)


def equation_of_time(doy: Column) -> Column:
    """Minutes, by Spencer (1971)."""
    g = 2 * math.pi * (doy - 1) / 365.0
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def eccentricity(doy: Column) -> Column:
    return 1 + 0.033 * F.cos(2 * math.pi * doy / 365.0)


def potential_radiation(doy: Column, hour: Column, lat: float, lon: float, utc_offset: float) -> Column:
    """W m-2 on a horizontal plane above the atmosphere at a moment."""
    phi = math.radians(lat)
    solar = hour + (equation_of_time(doy) + 4 * (lon - 15 * utc_offset)) / 60
    angle = F.radians(15 * (solar - 12))
    d = declination(doy)
    height = math.sin(phi) * F.sin(d) + math.cos(phi) * F.cos(d) * F.cos(angle)
    return F.greatest(SOLAR_CONSTANT * eccentricity(doy) * height, F.lit(0.0))


def mean_potential_radiation(middle: Column, period_minutes: int, lat: float, lon: float, utc_offset: float) -> Column:
    """Mean over an interval around its middle, of one value a minute."""
    minute = F.hour(middle) * 60 + F.minute(middle) + F.second(middle) / 60
    doy = F.dayofyear(middle)
    steps = F.sequence(F.lit(0), F.lit(period_minutes - 1))
    each = F.transform(steps, lambda i: potential_radiation(doy, (minute - period_minutes / 2 + i + 0.5) / 60, lat, lon, utc_offset))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / period_minutes


def daytime(potential: Column, threshold: float = 20.0) -> Column:
    """1 by day, 0 by night, null where unknown."""
    return F.when(potential >= threshold, 1).when(potential < threshold, 0)


def day_length_hours(doy: Column, lat: float) -> Column:
    x = -math.tan(math.radians(lat)) * F.tan(declination(doy))
    return F.degrees(F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))) * 2 / 15


def sunrise_sunset(doy: Column, lat: float) -> tuple[Column, Column]:
    """In solar hours."""
    half = day_length_hours(doy, lat) / 2
    return 12 - half, 12 + half
