"""Column expressions of meteorology; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vpd_kpa(ta: Column, rh: Column) -> Column:
    """Vapour pressure deficit from degrees Celsius and percent."""
    return 6.1078 * (1 - rh / 100) * F.exp(17.08085 * ta / (234.175 + ta)) * 0.1


def aerodynamic_resistance(u: Column, ustar: Column) -> Column:
    return F.when(ustar > 0, u / (ustar * ustar))


def dry_air_density(rho_a: Column, rho_v: Column) -> Column:
    return rho_a - rho_v


def air_temperature_from_sonic(ts: Column, h2o: Column) -> Column:
    return ts / (1 + 0.32 * h2o)


def latent_heat(ta: Column) -> Column:
    """J kg-1 from degrees Celsius."""
    return (2.501 - 0.00237 * ta) * 1e6


def et_from_le(le: Column, ta: Column) -> Column:
    """mm h-1 from W m-2."""
    return le / latent_heat(ta) * 3600


def lloyd_taylor(ta: Column, rref: Column, e0: Column, tref: float = 15.0, t0: float = -46.02) -> Column:
    return rref * F.exp(e0 * (1 / F.lit(tref - t0) - 1 / F.when(ta != t0, ta - t0)))


def lloyd_taylor_kelvin(ta: Column, rref: Column, e0: Column) -> Column:
    return lloyd_taylor(ta, rref, e0, 288.15, 227.13)


def swin_tolerance(swin: Column, lo: float = 20.0, hi: float = 50.0) -> Column:
    return F.when(swin.isNotNull(), F.least(F.greatest(swin, F.lit(lo)), F.lit(hi)))


def mds_quality_from(method: Column, window: Column) -> Column:
    """Quality 1 to 3 from the drivers used (1 all, 2 radiation, 3 mean diel course) and the window's days."""
    all_ = F.when(window <= 14, 1).when(window <= 56, 2).otherwise(3)
    radiation = F.when(window <= 14, 1).when(window <= 28, 2).otherwise(3)
    course = F.when(window <= 1, 1).when(window <= 5, 2).otherwise(3)
    return F.when(method == 1, all_).when(method == 2, radiation).when(method == 3, course)


def mds_flag(method: Column, window: Column) -> Column:
    return (method * 1000 + F.rint(window)).cast("int")


def season(month: Column, spring=(3, 4, 5), summer=(6, 7, 8), autumn=(9, 10, 11)) -> Column:
    return F.when(month.isin(*spring), 1).when(month.isin(*summer), 2).when(month.isin(*autumn), 3).when(month.isNotNull(), 4)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    return F.sin(x * 2 * F.pi() / period), F.cos(x * 2 * F.pi() / period)


def mds_description(flag: int) -> str:
    """What the flag of a filled value says."""
    if not flag:
        return "measured"
    method, days = divmod(int(flag), 1000)
    limits = {1: (14, 56), 2: (14, 28), 3: (1, 5)}.get(method, (0, 0))
    quality = 1 if days <= limits[0] else 2 if days <= limits[1] else 3
    return f"{ {1: 'radiation, temperature and deficit', 2: 'radiation', 3: 'diurnal course'}.get(method, f'method {method}') }: {days} d window (quality {quality})"


def mean_sd_count(v: Column, least: int, sample: bool = False) -> tuple[Column, Column, Column]:
    """Aggregates: mean and standard deviation where there are least values (and more than one for a sample's), and their number."""
    n = F.count(v)
    enough = (n >= least) & (n > int(sample))
    return F.when(enough, F.avg(v)), F.when(enough, F.stddev_samp(v) if sample else F.stddev_pop(v)), n
