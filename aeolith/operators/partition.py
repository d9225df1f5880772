"""Partitioning of net exchange into respiration and uptake: night-time fits over the whole record, and daytime light-response curves.

Published methods: Reichstein et al. 2005 (night), Lasslop et al. 2010 (day). A fit is of a few days' records; what
one window leaves to the next (the last good parameters) makes a series and year, or a record, one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.functions import solar

#: Lloyd-Taylor temperatures (deg C), deficit (hPa) from which uptake is limited.
T0, TREF, VPD0 = -46.02, 15.0, 10.0
#: Bounds of E0; of night fits the days at each side, step, least records and range of temperature, trimmed share a tail, best fits averaged.
E0_BOUNDS, NIGHT = (30.0, 350.0), {"half": 7, "step": 5, "least": 6, "range": 5.0, "trim": 0.05, "best": 3}
#: Days at each side, step and least records of reference respiration.
RREF = {"half": 3, "step": 4, "least": 2}
#: Radiation that parts day from night; width and step of daytime windows, days of their night windows, all in days; starts of beta; widths of the priors of alpha, beta, k, rref.
DAY_FROM, DAY_WINDOW, DAY_STEP, NIGHT_DAYS, STARTS, WIDTHS = 4.0, 4, 2, 12, (0.5, 1.0, 2.0), (10.0, 600.0, 50.0, 80.0)
#: What alpha, beta and k may be.
ALPHA_MOST, BETA_MOST = 0.22, 250.0


def arrhenius(ta: np.ndarray) -> np.ndarray:
    return 1 / (TREF - T0) - 1 / (ta - T0)


def respiration(ta: np.ndarray, rref: np.ndarray | float, e0: np.ndarray | float) -> np.ndarray:
    return rref * np.exp(np.clip(e0 * arrhenius(ta), -50, 50))


def uptake(rg: np.ndarray, vpd: np.ndarray, alpha: np.ndarray | float, beta: np.ndarray | float, k: np.ndarray | float) -> np.ndarray:
    """Rectangular hyperbola of radiation, whose plateau sinks with the deficit."""
    top = beta * np.exp(-np.clip(k * np.maximum(vpd - VPD0, 0), -50, 50))
    below = alpha * rg + top
    return np.where(np.abs(below) > 1e-12, alpha * top * rg / np.where(np.abs(below) > 1e-12, below, 1), 0.0)


def least_squares(model: Callable[[np.ndarray], np.ndarray], y: np.ndarray, sd: np.ndarray | float, start: list[float], width: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(parameters, their standard errors, root mean square error), damped Gauss-Newton; width holds parameters near the start as a prior would."""
    p, prior = np.array(start, float), np.array(start, float)
    loose = 1 / np.array(width) if width is not None else np.zeros(len(p))
    residual = lambda q: np.r_[(y - model(q)) / sd, (prior - q) * loose]
    r = residual(p)
    cost, damp = float(r @ r), 1e-3
    jac = np.zeros((len(r), len(p)))
    for _ in range(60):
        for i in range(len(p)):
            q = p.copy()
            q[i] += 1e-6 * max(abs(p[i]), 1e-3)
            jac[:, i] = (residual(q) - r) / (q[i] - p[i])
        a, g = jac.T @ jac, jac.T @ r
        moved = False
        while damp < 1e10:
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
            s = residual(p + step)
            new = float(s @ s) if np.isfinite(s).all() else np.inf
            if new < cost:
                done = cost - new <= 1e-9 * cost
                p, r, cost, damp, moved = p + step, s, new, damp / 5, True
                break
            damp *= 4
        if not moved or done:
            break
    scale = cost / max(1, len(y) - len(p))
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(jac.T @ jac)), 0) * scale)
    return p, se, float(np.sqrt(np.mean((y - model(p)) ** 2)))


def _windows(day: np.ndarray, half: float, step: float, start: float) -> list[slice]:
    """Slices of records within half days of centres from start on."""
    mids = np.arange(start, day[-1] + 1e-9, step)
    return [slice(a, b) for a, b in zip(np.searchsorted(day, mids - half), np.searchsorted(day, mids + half, "right"), strict=True)]


def whole_record_e0(nee: np.ndarray, ta: np.ndarray, day: np.ndarray) -> float:
    """Mean of the best constrained E0 of windows over a record of night values, to two places; nan with fewer than are averaged."""
    ok, fits = ~np.isnan(nee) & ~np.isnan(ta), []
    for w in _windows(day, NIGHT["half"], NIGHT["step"], NIGHT["half"] + 1):
        y, x = nee[w][ok[w]], ta[w][ok[w]]
        if len(y) <= NIGHT["least"] or np.ptp(x) < NIGHT["range"]:
            continue
        curve = lambda q, x=x: respiration(x, q[0], q[1])
        left = y - curve(least_squares(curve, y, 1.0, [2.0, 200.0])[0])
        lo, hi = np.quantile(left, [NIGHT["trim"], 1 - NIGHT["trim"]])
        kept = (left >= lo) & (left <= hi)
        if kept.sum() < 3:
            continue
        curve = lambda q, x=x[kept]: respiration(x, q[0], q[1])
        p, se, _ = least_squares(curve, y[kept], 1.0, [2.0, 200.0])
        if E0_BOUNDS[0] < p[1] - se[1] and p[1] + se[1] < E0_BOUNDS[1]:
            fits.append((se[1], p[1]))
    best = sorted(fits)[: NIGHT["best"]]
    return round(float(np.mean([e for _, e in best])), 2) if len(best) == NIGHT["best"] else float("nan")


def reference_respiration(nee: np.ndarray, ta: np.ndarray, day: np.ndarray, e0: float) -> np.ndarray:
    """Reference respiration of every record: slopes through the origin of short windows at their mean record, interpolated."""
    ok, at, found = ~np.isnan(nee) & ~np.isnan(ta), [], []
    for w in _windows(day, RREF["half"], RREF["step"], RREF["half"] + 1):
        k = np.flatnonzero(ok[w])
        if len(k) <= RREF["least"]:
            continue
        g = respiration(ta[w][k], 1.0, e0)
        slope = float(g @ nee[w][k] / (g @ g))
        if slope >= 0:
            at.append(round(float((k + w.start).mean())))
            found.append(slope)
    return np.interp(np.arange(len(nee)), at, found) if at else np.full(len(nee), np.nan)


def _run(df: DataFrame, keys: list[str], by_year: bool, extra: tuple[str, ...], f: Callable[[pd.DataFrame], None], ts: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts).reset_index(drop=True)
        for c in extra:
            pdf[c] = np.nan
        f(pdf)
        return pdf.drop(columns="_y")

    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + "".join(f", {c} double" for c in extra)
    out = df.withColumn("_y", F.year(ts) if by_year else F.lit(0)).groupBy(*keys, "_y").applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in extra})


def _days(pdf: pd.DataFrame, ts: str) -> np.ndarray:
    return ((pdf[ts] - pdf[ts].iloc[0].normalize()) / pd.Timedelta(days=1)).to_numpy()


def nighttime_whole_record(df: DataFrame, keys: list[str], lat: float, lon: float, utc_offset: float, ts: str = "ts") -> DataFrame:
    """df (nee, ta, sw_in, nee_f, ta_f) with rref, e0, reco, gpp: one E0 for the record, reference respiration by windows.

    Night is where neither measured radiation passes 10 nor potential radiation is above 0. A record without enough good
    windows stays without results. A series is a task: E0 is one number of all its years.
    """
    d = df.withColumn("_pot", solar.potential_radiation(F.dayofyear(ts), F.hour(ts) + F.minute(ts) / 60, lat, lon, utc_offset))

    def f(pdf: pd.DataFrame) -> None:
        night = (pdf["sw_in"] <= 10) & (pdf["_pot"] <= 0)
        nee, ta, day = np.where(night, pdf["nee"].to_numpy(float), np.nan), pdf["ta"].to_numpy(float), _days(pdf, ts)
        e0 = whole_record_e0(nee, ta, day)
        if not np.isnan(e0):
            rref = reference_respiration(nee, ta, day, e0)
            reco = respiration(pdf["ta_f"].to_numpy(float), rref, e0)
            pdf["rref"], pdf["e0"], pdf["reco"], pdf["gpp"] = rref, e0, reco, reco - pdf["nee_f"].to_numpy(float)

    return _run(d, keys, False, ("rref", "e0", "reco", "gpp"), f, ts).drop("_pot")


def light_response(nee: np.ndarray, rg: np.ndarray, vpd: np.ndarray, ta: np.ndarray, sd: np.ndarray | float, e0: float, guess: tuple[float, float, float, float], last_alpha: float | None, starts: tuple[float, ...] = STARTS) -> dict | None:
    """The best of the fits from several starts of beta, as alpha, beta, k, rref, se (of rref, beta), rmse; None if none is sound.

    Each start goes down a ladder of models: all four parameters; without the deficit's effect if k is negative; with
    alpha of the last sound window if it is too steep; respiration alone if alpha or beta is negative.
    """
    best = None
    for factor in starts:
        start = dict(zip(("alpha", "beta", "k", "rref"), (guess[0], guess[1] * factor, guess[2], guess[3]), strict=True))
        fixed: dict[str, float] = {}

        def fit(fixed: dict[str, float], start: dict[str, float] = start) -> tuple[dict[str, float], dict[str, float], float]:
            free = [n for n in start if n not in fixed]

            def model(q: np.ndarray) -> np.ndarray:
                v = fixed | dict(zip(free, q, strict=True))
                return respiration(ta, v["rref"], e0) - uptake(rg, vpd, v["alpha"], v["beta"], v["k"])

            p, se, rmse = least_squares(model, nee, sd, [start[n] for n in free], [WIDTHS[list(start).index(n)] for n in free])
            return fixed | dict(zip(free, p.tolist(), strict=True)), dict(zip(free, se.tolist(), strict=True)), rmse

        v, se, rmse = fit(fixed)
        if v["k"] < 0:
            fixed = fixed | {"k": 0.0}
            v, se, rmse = fit(fixed)
        if v["alpha"] > ALPHA_MOST and last_alpha:
            fixed = fixed | {"alpha": last_alpha}
            v, se, rmse = fit(fixed)
            if v["k"] < 0:
                fixed = fixed | {"k": 0.0}
                v, se, rmse = fit(fixed)
        if v["alpha"] < 0 or v["beta"] < 0:
            v, se, rmse = fit({"alpha": 0.0, "beta": 0.0, "k": 0.0})
        sound = 0 <= v["alpha"] <= ALPHA_MOST and 0 <= v["beta"] <= BETA_MOST and v["k"] >= 0 and v["rref"] > 0 and not (v["beta"] > 100 and se.get("beta", 0) > v["beta"])
        if sound and (best is None or rmse < best["rmse"]):
            best = v | {"rmse": rmse, "se_rref": se.get("rref", 0.0), "se_beta": se.get("beta", 0.0)}
    return best


def smoothed(x: np.ndarray, z: np.ndarray, se: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A Gaussian process through points (x, z) with standard errors, its length of correlation of greatest likelihood, at other places."""
    mean, spread = float(np.average(z, weights=1 / se**2)), max(float(z.var()), 1e-6)
    best = None
    for length in np.ptp(x) * np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.8]) + 1e-9:
        k = spread * np.exp(-0.5 * ((x[:, None] - x) / length) ** 2) + np.diag(se**2 + 1e-9 * spread)
        c = np.linalg.cholesky(k)
        w = np.linalg.solve(c, z - mean)
        like = -0.5 * float(w @ w) - float(np.log(np.diag(c)).sum())
        if best is None or like > best[0]:
            best = like, length, np.linalg.solve(c.T, w)
    _, length, w = best
    return mean + spread * np.exp(-0.5 * ((at[:, None] - x) / length) ** 2) @ w


def daytime(df: DataFrame, keys: list[str], vpd_in_kpa: bool = True, smooth: bool = False, least: int = 10, ts: str = "ts") -> DataFrame:
    """df (nee, ta, sw_in, ta_f, sw_in_f, vpd, perhaps nee_sd) with reco_dt, gpp_dt and, at the middle of windows, lrc_alpha, lrc_beta, lrc_k, rref_dt, e0_dt.

    Every two days a light-response curve is fitted to four days of daytime records, E0 and reference respiration coming
    from night records around. smooth takes a Gaussian process through the E0 of all windows of the record and one start
    of beta; otherwise a window's own E0 within 50 to 400, else that of the last sound window, three starts, year by
    year. Fluxes of the two nearest windows are weighted by distance. A year or record without a sound window stays empty.
    """
    lo, hi = 50.0, 400.0
    extra = ("reco_dt", "gpp_dt", "lrc_alpha", "lrc_beta", "lrc_k", "rref_dt", "e0_dt")

    def f(pdf: pd.DataFrame) -> None:
        day, n = _days(pdf, ts), len(pdf)
        col = lambda c: pdf[c].to_numpy(float)
        nee, ta, rg, ta_f, rg_f, vpd = col("nee"), col("ta"), col("sw_in"), col("ta_f"), col("sw_in_f"), col("vpd") * (10.0 if vpd_in_kpa else 1.0)
        sd = np.maximum(np.nan_to_num(col("nee_sd"), nan=1.0), 0.2) if "nee_sd" in pdf else np.ones(n)
        ok = ~np.isnan(nee) & ~np.isnan(ta)
        night, light = ok & (rg <= DAY_FROM), ok & (rg > DAY_FROM) & ~np.isnan(vpd)
        mids = np.arange(DAY_WINDOW / 2, day[-1] + 1e-9, DAY_STEP)
        nights, lights = _windows(day, NIGHT_DAYS / 2, DAY_STEP, DAY_WINDOW / 2), _windows(day, DAY_WINDOW / 2, DAY_STEP, DAY_WINDOW / 2)
        e0s: list[tuple[float, float, float] | None] = []
        for w in nights:
            y, x = nee[w][night[w]], ta[w][night[w]]
            if len(y) < least or np.ptp(x) < NIGHT["range"]:
                e0s.append(None)
                continue
            p, se, _ = least_squares(lambda q, x=x: respiration(x, q[0], q[1]), y, 1.0, [max(float(y.mean()), 0.1), 100.0], [800.0, 1000.0])
            e0s.append((float(p[1]), max(float(se[1]), 1e-3), float(p[0])))
        if smooth:
            good = [(m, e) for m, e in zip(mids, e0s, strict=True) if e and lo <= e[0] <= hi]
            if not good:
                return
            line = smoothed(np.array([m for m, _ in good]), np.array([e[0] for _, e in good]), np.array([e[1] for _, e in good]), mids)
            e0s = [(float(np.clip(z, lo, hi)), 0.0, 0.0) for z in line]
        found, last_e0, last_alpha, rref = [], None, None, 5.0
        for m, w, e in zip(mids, lights, e0s, strict=True):
            e0 = e[0] if e and lo <= e[0] <= hi else last_e0 if last_e0 is not None else float(np.clip(e[0], lo, hi)) if e else None
            k = light[w]
            if e0 is None or k.sum() < least:
                continue
            y = nee[w][k]
            dark = nee[w][night[w]]
            rref = max(float(dark @ (g := respiration(ta[w][night[w]], 1.0, e0)) / (g @ g)), 0.1) if len(dark) > 2 else rref
            beta = abs(float(np.quantile(y, 0.03) - np.quantile(y, 0.97)))
            got = light_response(y, rg[w][k], vpd[w][k], ta[w][k], sd[w][k], e0, (0.01, max(beta, 1.0), 0.0, rref), last_alpha, (1.0,) if smooth else STARTS)
            if got:
                last_e0, last_alpha = e0, got["alpha"] or last_alpha
                at = round(float((np.flatnonzero(k) + w.start).mean()))
                found.append((at, got | {"e0": e0}))
        if not found:
            return
        places = np.array([a for a, _ in found])
        of = {x: np.array([v[x] for _, v in found]) for x in ("alpha", "beta", "k", "rref", "e0")}
        here = np.arange(n)
        right = np.clip(np.searchsorted(places, here, "right"), 0, len(places) - 1)
        left = np.maximum(np.searchsorted(places, here, "right") - 1, 0)
        gap = places[right] - places[left]
        share = np.where(gap > 0, (here - places[left]) / np.where(gap > 0, gap, 1), 0.0)
        respire = lambda at: respiration(ta_f, of["rref"][at], of["e0"][at])
        assimilate = lambda at: uptake(rg_f, vpd, of["alpha"][at], of["beta"][at], of["k"][at])
        pdf["reco_dt"], pdf["gpp_dt"] = respire(left) * (1 - share) + respire(right) * share, assimilate(left) * (1 - share) + assimilate(right) * share
        for at, v in found:
            pdf.loc[at, ["lrc_alpha", "lrc_beta", "lrc_k", "rref_dt", "e0_dt"]] = [v[x] for x in ("alpha", "beta", "k", "rref", "e0")]

    return _run(df, keys, not smooth, extra, f, ts)
