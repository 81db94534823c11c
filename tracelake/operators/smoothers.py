"""Registry of smoothers: each takes a track in local metres, some inertial samples too, and returns it with e_s, n_s, u_s.

Most are folds of whole sessions. Folds that run together share one shuffle, one
sort and what several of them need (Sessions), so that a bake-off reads its track once.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import geo
from tracelake.operators import constraints, error_state, gates, inertial, kernels, preintegration, reckoning, smoothing

Smoother = Callable[..., DataFrame]
_registry: dict[str, Smoother] = {}
OUT = {"e_s": T.DoubleType(), "n_s": T.DoubleType(), "u_s": T.DoubleType()}
AXES, FORCE, RATE = ("e_m", "n_m", "u_m"), ("ax", "ay", "az"), ("gx", "gy", "gz")


def register(name: str) -> Callable[[Smoother], Smoother]:
    """Adds a smoother; a name is never taken twice, and it must take one DataFrame, and samples under the name imu if it uses them."""

    def add(f: Smoother) -> Smoother:
        if name in _registry:
            raise ValueError(f"a smoother named {name!r} is there already")
        if len([p for p in inspect.signature(f).parameters.values() if p.default is p.empty]) != 1:
            raise TypeError(f"{name!r} must take a DataFrame and nothing else without a default")
        _registry[name] = f
        return f

    return add


@dataclass(frozen=True)
class Fold:
    """A smoother of many whole sessions: their places, smoothed. needs: columns of the track and of PREPARED that it reads; imu: whether it reads samples."""

    run: Callable[[Sessions], np.ndarray]
    needs: tuple[str, ...]
    imu: bool


_folds: dict[str, Fold] = {}


def fold(name: str, *needs: str, imu: bool = False) -> Callable[[Callable[[Sessions], np.ndarray]], Callable[[Sessions], np.ndarray]]:
    """Registers a fold as a smoother."""

    def add(run: Callable[[Sessions], np.ndarray]) -> Callable[[Sessions], np.ndarray]:
        def alone(track: DataFrame, imu: DataFrame | None = None) -> DataFrame:
            return _alone(name, track, imu)

        register(name)(alone if imu else lambda track: _alone(name, track, None))
        _folds[name] = Fold(run, needs, imu)
        return run

    return add


def names() -> list[str]:
    return list(_registry)


def run(name: str, track: DataFrame, imu: DataFrame | None = None) -> DataFrame:
    """The named smoother on a track; imu (ax to gz in the body: forward, left, up) reaches those that use it."""
    if name not in _registry:
        raise KeyError(f"unknown smoother {name!r}; there are {', '.join(_registry)}")
    f = _registry[name]
    return f(track, imu=imu) if "imu" in inspect.signature(f).parameters else f(track)


#: Columns made on the JVM before a fold, by what they are made of.
PREPARED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bad_doppler": gates.bad_doppler,
    "doppler_reject": lambda df: gates.doppler_gates(df, {"doppler_reject": 5.0, "doppler_reject_4": 4.0}),
    "standing": reckoning.standing,
    "sigma_eff": lambda df: df.withColumn("sigma_eff", preintegration.sigma_eff()),
    "reckon_scale": lambda df: df.withColumn("reckon_scale", reckoning.reckon_scale()),
    "chain_scale": lambda df: df.withColumn("chain_scale", reckoning.chain_scale()),
}


def _prepared(track: DataFrame, chosen: list[str]) -> tuple[DataFrame, list[str]]:
    """track with what the chosen folds need, and the columns that they read."""
    needs = list(dict.fromkeys(c for name in chosen for c in _folds[name].needs))
    for c, make in PREPARED.items():
        if c in needs:
            track = make(track)
    if "doppler_reject" in needs:
        needs.append("doppler_reject_4")
    return track, [*AXES, *(c for c in needs if c not in AXES)]


def _samples(imu: DataFrame, t: str = "utc_s") -> DataFrame:
    """Whole samples only."""
    return imu.dropna(subset=[t, *FORCE, *RATE]).select("session_id", t, *[F.col(c).cast("double").alias(c) for c in (*FORCE, *RATE)])


class Sessions:
    """Rows of whole sessions in order of time, with their samples if there are any, and what several folds take from them, made once."""

    def __init__(self, rows: pd.DataFrame, cuts: np.ndarray, samples: pd.DataFrame | None = None, sample_cuts: np.ndarray | None = None):
        self.rows, self.cuts, self.samples, self.sample_cuts = rows, cuts, samples, sample_cuts

    def get(self, *cols: str) -> np.ndarray:
        return self.rows[[*cols]].to_numpy(float) if len(cols) > 1 else self.rows[cols[0]].to_numpy(float)

    def flag(self, col: str) -> np.ndarray:
        return self.get(col) > 0.5

    @cached_property
    def time(self) -> np.ndarray:
        return self.get("utc_s")

    @cached_property
    def place(self) -> np.ndarray:
        return self.get(*AXES)

    @cached_property
    def steps(self) -> np.ndarray:
        return kernels.usual_step(self.time, self.cuts)

    @cached_property
    def velocity(self) -> np.ndarray:
        return self.get("ve", "vn", "vu")

    @cached_property
    def good_velocity(self) -> np.ndarray:
        return np.where(self.flag("bad_doppler")[:, None], np.nan, self.velocity)

    @cached_property
    def filled(self) -> np.ndarray:
        """Positions with rejected epochs put on the line between their neighbours in the session."""
        bad, x = self.flag("doppler_reject"), self.place.copy()
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            good = np.flatnonzero(~bad[a:b]) + a
            if bad[a:b].any() and len(good):
                for k in range(3):
                    x[a:b, k] = np.interp(np.arange(a, b), good, x[good, k])
        return x

    @cached_property
    def kalman(self) -> dict[str, np.ndarray]:
        return kernels.kalman_sigma(self.rows, self.cuts)

    @cached_property
    def sums(self) -> tuple[np.ndarray, ...] | None:
        """What samples turned to local axes add to each step; None without samples at all."""
        if self.samples is None:
            return None
        ts, force = self.samples["utc_s"].to_numpy(float), self.samples[[*FORCE]].to_numpy(float)
        local = inertial.rotate(kernels.mahony_all(self.sample_cuts, ts, self.samples[[*RATE]].to_numpy(float), force), force) - [0, 0, preintegration.G]
        return preintegration.step_sums(self.cuts, self.time, self.sample_cuts, ts, local)

    @cached_property
    def error_steps(self) -> list[error_state.Steps]:
        """What samples add to each step of the error-state smoothers, one entry for each of SIGMAS_F."""
        ts, force, rate = self.samples["utc_s"].to_numpy(float), self.samples[[*FORCE]].to_numpy(float), self.samples[[*RATE]].to_numpy(float)
        return error_state.preintegrate_each(self.time, ts, force, rate, list(SIGMAS_F), cuts=self.cuts, sample_cuts=self.sample_cuts)

    def error_state(self, sigma_f: float, **options: float) -> np.ndarray:
        if self.samples is None:
            none = pd.DataFrame({c: np.zeros(0) for c in ("utc_s", *FORCE, *RATE)})
            return _places(error_state.smooth_all(self.rows, self.cuts, none, np.zeros(len(self.cuts), int), sigma_f=sigma_f, variances=False, **options))
        step = self.error_steps[SIGMAS_F.index(sigma_f)]
        return _places(error_state.smooth_all(self.rows, self.cuts, self.samples, self.sample_cuts, step=step, variances=False, **options))


#: How far samples are trusted: the usual, and by dead reckoning.
SIGMAS_F = (0.1, 0.05)


def _places(got: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([got[c] for c in OUT], 1)


def _alone(name: str, track: DataFrame, imu: DataFrame | None) -> DataFrame:
    """track with one fold's places."""
    one = _folds[name]
    rows, _ = _prepared(track, [name])
    keep = [c for c in track.columns if c not in OUT]
    out = lambda s: dict(zip(OUT, one.run(s).T, strict=True))
    if imu is None:
        return kernels.per_sessions(rows, lambda r, cuts: out(Sessions(r, cuts)), OUT).select(*keep, *OUT)
    return kernels.per_sessions_with(rows, _samples(imu), lambda *sides: out(Sessions(*sides)), OUT).select(*keep, *OUT)


#: Samples, and epochs that count for EPOCH_WEIGHT of them, that a bake-off folds at once.
TOGETHER = 400_000
#: Errors are dealt by the leading bits of a double, sixteen ranges between powers of two.
RANGE_BITS = 48


def run_all(track: DataFrame, truth: DataFrame, only: list[str] | None = None, by: str = "session_id", t: str = "utc_s", imu: DataFrame | None = None) -> DataFrame:
    """smoother, n, h_rmse_m, h_p95_m after the median offset from truth (gt_e, gt_n), best first; those without a score last.

    All folds run together on each session, whose truth comes with its samples, and
    give their errors as lists by ranges of size; other smoothers are joined to the truth one by one.
    """
    chosen = only or names()
    for name in chosen:
        if name not in _registry:
            raise KeyError(f"unknown smoother {name!r}; there are {', '.join(_registry)}")
    together = {place: name for place, name in enumerate(chosen) if name in _folds}
    errors = _errors_together(track, truth, together, by, t, imu) if together else None
    for place, name in enumerate(chosen):
        if place not in together:
            one = _errors(run(name, track, imu), truth, place, by, t)
            errors = one if errors is None else errors.unionByName(one)
    places = track.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, chosen))).alias("place", "smoother"))
    scored = places.join(F.broadcast(_scores(errors)), "place", "left")
    scored = scored.select("smoother", F.coalesce("n", F.lit(0)).alias("n"), F.round("rmse", 4).alias("h_rmse_m"), F.round("p95", 4).alias("h_p95_m"), "place")
    return scored.orderBy(F.asc_nulls_last("h_rmse_m"), "place").drop("place")


def _errors(got: DataFrame, truth: DataFrame, place: int, by: str, t: str) -> DataFrame:
    """place, range, errors of a smoother's rows."""
    d = got.select(by, t, "e_s", "n_s").join(truth.select(by, t, "gt_e", "gt_n"), [by, t]).select(by, (F.col("e_s") - F.col("gt_e")).alias("de"), (F.col("n_s") - F.col("gt_n")).alias("dn"))
    d = d.withColumns({"me": F.expr(f"median(de) OVER (PARTITION BY {by})"), "mn": F.expr(f"median(dn) OVER (PARTITION BY {by})")})
    h = F.sqrt((F.col("de") - F.col("me")) ** 2 + (F.col("dn") - F.col("mn")) ** 2)

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _by_range(place, b["h"].to_numpy(float))

    return d.select(h.alias("h")).where("h IS NOT NULL").mapInPandas(ranged, ERRORS)


ERRORS = "place int, range int, errors array<double>"


def _by_range(place: int, h: np.ndarray) -> pd.DataFrame:
    """Errors (not negative) in one list a range of size, which are in order."""
    h = np.sort(h[~np.isnan(h)] + 0.0)
    ranges = h.view(np.int64) >> RANGE_BITS
    begins = np.flatnonzero(np.diff(ranges, prepend=-1))
    return pd.DataFrame({"place": np.full(len(begins), place, np.int32), "range": ranges[begins].astype(np.int32), "errors": pd.Series(np.split(h, begins[1:]) if len(begins) else [], dtype=object)})


def _matches(rows: Sessions, truth: pd.DataFrame, truth_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and a truth at one time in one session, in order of the sessions."""
    t, tt = rows.time, truth["utc_s"].to_numpy(float)
    low, high = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for a, b, c, d in zip(rows.cuts[:-1], rows.cuts[1:], truth_cuts[:-1], truth_cuts[1:], strict=True):
        low[a:b], high[a:b] = c + np.searchsorted(tt[c:d], t[a:b], "left"), c + np.searchsorted(tt[c:d], t[a:b], "right")
    count = np.where(np.isnan(t), 0, high - low)
    return np.repeat(np.arange(len(t)), count), np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _offsets(d: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each session's medians of known values, for each of its rows."""
    out = np.full(d.shape, np.nan)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            some = d[a:b]
            if np.isnan(some).any():
                some = np.where(np.isnan(some).all(0), 0.0, some)
                out[a:b] = np.nanmedian(some, axis=0)
            else:
                out[a:b] = kernels.median(some, axis=0)
    return out


def _errors_together(track: DataFrame, truth: DataFrame, chosen: dict[int, str], by: str, t: str, imu: DataFrame | None) -> DataFrame:
    """place, range, errors of folds, which run on the same rows of each session."""
    folds = {place: _folds[name].run for place, name in chosen.items()}
    rows, needs = _prepared(track, list(chosen.values()))
    none = F.lit(None).cast("double")
    known = truth.dropna(subset=[by, t]).select(by, t, F.lit(1.0).alias("__truth"), F.col("gt_e").cast("double").alias("ax"), F.col("gt_n").cast("double").alias("ay"), *[none.alias(c) for c in ("az", *RATE)])
    with_imu = imu is not None and any(_folds[name].imu for name in chosen.values())
    if with_imu:
        known = known.unionByName(_samples(imu, t).withColumn("__truth", F.lit(0.0)))

    def run(rows: pd.DataFrame, cuts: np.ndarray, others: pd.DataFrame, other_cuts: np.ndarray) -> pd.DataFrame:
        true = others["__truth"].to_numpy(float) > 0.5
        owner = np.repeat(np.arange(len(cuts) - 1), np.diff(other_cuts))
        count = lambda at: np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(cuts) - 1))])
        sessions = Sessions(rows, cuts, others[~true].reset_index(drop=True), count(~true)) if with_imu else Sessions(rows, cuts)
        row, at = _matches(sessions, others[true], count(true))
        truth = others.loc[true, ["ax", "ay"]].to_numpy(float)[at]
        pair_cuts = np.searchsorted(row, cuts)
        found = []
        for place, one in folds.items():
            d = one(sessions)[row, :2] - truth
            d -= _offsets(d, pair_cuts)
            found.append(_by_range(place, np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2)))
        return pd.concat(found, ignore_index=True)

    # Flags go as numbers: next to samples, which have none, they would be objects.
    kinds = dict(rows.dtypes)
    own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if kinds[c] == "boolean" else c for c in needs]
    return kernels.fold_with(rows.select(by, t, *own), known, run, ERRORS, by, t, TOGETHER)


def _scores(errors: DataFrame) -> DataFrame:
    """place, n, rmse, p95 (exact, linear between neighbours) of all errors: ranges are counted, and only those that the percentile lies in are looked into.

    Both sides read the lists as they are dealt, so Spark makes and shuffles them once: as long as neither filters them in its own way.
    """
    parts = int(errors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = errors.where("place IS NOT NULL AND range IS NOT NULL").repartition(parts, "place", "range")
    sums = dealt.groupBy("place", "range").agg(F.sum(F.size("errors")).alias("m"), F.sum(F.aggregate("errors", F.lit(0.0), lambda a, x: a + x * x)).alias("s"))
    whole = Window.partitionBy("place")
    so_far = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"last": F.sum("m").over(so_far) - 1, "n": F.sum("m").over(whole), "all": F.sum("s").over(whole)})
    at = 0.95 * (F.col("n") - 1)
    sums = sums.withColumns({"lo": F.floor(at), "hi": F.ceil(at), "share": at - F.floor(at)})
    first = F.col("last") - F.col("m") + 1
    asked = sums.where((first <= F.col("hi")) & (F.col("lo") <= F.col("last"))).select(F.col("place").alias("p"), F.col("range").alias("r"), first.alias("first"), "n", "all", "lo", "hi", "share")
    values = dealt.join(F.broadcast(asked), (F.col("place") == F.col("p")) & (F.col("range") == F.col("r"))).select("place", "first", "n", "all", "lo", "hi", "share", F.explode_outer("errors").alias("v"))
    keys = ("place", "first", "n", "all", "lo", "hi", "share")
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    till = F.col("first") + F.sum("c").over(Window.partitionBy("place", "first").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    ranked = counts.withColumn("till", till)
    pick = lambda k: F.max(F.when((F.col("till") - F.col("c") + 1 <= F.col(k)) & (F.col(k) <= F.col("till")), F.col("v")))
    got = ranked.groupBy("place", "n", "all", "share").agg(pick("lo").alias("a"), pick("hi").alias("b"))
    return got.select("place", "n", F.sqrt(F.col("all") / F.col("n")).alias("rmse"), (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("p95"))


def _ecef(p: Column) -> Column:
    ref = p["__lat_deg"], p["__lon_deg"], p["__h_m"]
    away = geo.enu_vec_to_ecef(p["e_s"], p["n_s"], p["u_s"], ref[0], ref[1])
    return F.struct(*[(o + d).alias(c) for c, o, d in zip("xyz", geo.llh_to_ecef(*ref), away, strict=True)])


def tracks(enu: DataFrame, only: list[str] | None = None, imu: DataFrame | None = None, by: str = "session_id", t: str = "utc_s") -> dict[str, DataFrame]:
    """Every smoother's track in degrees (by, t, lat_deg, lon_deg, h_m), for the layers of a map; enu is with_enu()'s track, whose first row is the origin."""
    first = Window.partitionBy(by).orderBy(t)
    origin = {f"__{c}": F.first(c).over(first) for c in ("lat_deg", "lon_deg", "h_m")}
    found = {}
    for name in only or names():
        rows = run(name, enu.withColumns(origin), imu)
        found[name] = rows.select(by, t, F.inline(F.transform(F.array(F.struct(*OUT, *origin)), _ecef)).alias("__x", "__y", "__z"))
        # Each step is a row of its own, so that no expression is taken twice.
        found[name] = found[name].select(by, t, F.inline(F.array(geo.ecef_to_llh_struct(F.col("__x"), F.col("__y"), F.col("__z")))))
    return found


_SIGMAS, _RATES, _GATED = ("sd_n", "sd_e", "sd_u"), ("ve", "vn", "vu"), ("ve", "vn", "vu", "bad_doppler", "doppler_reject")
_TIERED = (*_GATED, "sd_n", "sd_e", "sigma_eff")
_WEIGHTED = (*_RATES, "sd_n", "sd_e", "ns", "quality")


@fold("raw")
def raw(s: Sessions) -> np.ndarray:
    return s.place


def _gaussian(s: Sessions, xy: float, z: float) -> np.ndarray:
    return np.concatenate([smoothing.gaussian_all(s.cuts, s.place[:, :2], xy), smoothing.gaussian_all(s.cuts, s.place[:, 2:], z)], 1)


@fold("gaussian_car")
def gaussian_car(s: Sessions) -> np.ndarray:
    return _gaussian(s, 2.0, 10.0)


@fold("gaussian_aggressive")
def gaussian_aggressive(s: Sessions) -> np.ndarray:
    return _gaussian(s, 5.0, 20.0)


@fold("cv_rts")
def cv_rts(s: Sessions) -> np.ndarray:
    return kernels.cv_rts_all(s.cuts, s.place, s.steps, np.array([2.0, 2.0, 4.0]))


@fold("cv_rts_pv", *_GATED)
def cv_rts_pv(s: Sessions) -> np.ndarray:
    return kernels.cv_rts_pv_all(s.cuts, s.filled, s.good_velocity, s.steps, 4.0, np.array([0.3, 0.3, 0.5]), np.array([0.2, 0.2, 0.5]))


@fold("gate_then_cv", *_GATED)
def gate_then_cv(s: Sessions) -> np.ndarray:
    return kernels.cv_rts_all(s.cuts, s.filled, s.steps, np.array([1.0, 1.0, 2.0]))


@fold("epoch_weight", *_RATES, "bad_doppler", "sd_n", "sd_e")
def epoch_weight(s: Sessions) -> np.ndarray:
    sd = np.hypot(s.get("sd_n"), s.get("sd_e"))
    for a, b in zip(s.cuts[:-1], s.cuts[1:], strict=True):
        known = sd[a:b][np.isfinite(sd[a:b])]
        sd[a:b] = np.where(np.isfinite(sd[a:b]), sd[a:b], np.median(known) if len(known) else 1.0)
    sd = np.sqrt(sd**2 + 0.1**2)[:, None]
    return kernels.cv_rts_pv_all(s.cuts, s.place, s.good_velocity, s.steps, sd, 0.3, 0.2)


@fold("epoch_weight_v2", *_WEIGHTED)
def epoch_weight_v2(s: Sessions) -> np.ndarray:
    return _places(kernels.epoch_weighted_v2(s.rows, s.cuts))


@fold("v2_urban_canyon", *_WEIGHTED)
def v2_urban_canyon(s: Sessions) -> np.ndarray:
    return _places(kernels.epoch_weighted_v2(s.rows, s.cuts, canyon=15.0, gate=5.0))


@fold("ctrv")
def ctrv(s: Sessions) -> np.ndarray:
    """Constant turn rate and velocity for the horizontal; heights as they are."""
    return np.concatenate([inertial.turn_rate_all(s.cuts, s.time, s.place[:, :2]), s.place[:, 2:]], 1)


_RECKONED = (*_RATES, "standing", "quality", "reckon_scale")


@fold("dead_reckoning", *_RECKONED)
def dead_reckoning(s: Sessions) -> np.ndarray:
    """Nine states with acceleration, without inertial samples."""
    return _places(reckoning.reckon_rows(s.cuts, s.place, s.velocity, s.get("reckon_scale"), s.time, s.flag("standing")))


@fold("gnss_imu_dr", *_RECKONED, imu=True)
def gnss_imu_dr(s: Sessions) -> np.ndarray:
    """Dead reckoning; with samples the error-state smoother, more trusting of them."""
    return dead_reckoning(s) if s.samples is None else s.error_state(SIGMAS_F[1], accel=1.0)


@fold("ekf_smoothed", *_RATES, "standing", imu=True)
def ekf_smoothed(s: Sessions) -> np.ndarray:
    """The error-state smoother with biases."""
    return s.error_state(SIGMAS_F[0])


def _tiered(s: Sessions, **options: float | None) -> np.ndarray:
    return _places(preintegration.tiered_rows(s.cuts, s.place, s.velocity, s.time, s.get("sigma_eff"), s.flag("doppler_reject_4"), s.flag("bad_doppler"), s.sums, **options))


@fold("v2_imu_adaptive", *_TIERED, imu=True)
def v2_imu_adaptive(s: Sessions) -> np.ndarray:
    """Tiers of epochs, the poorer ones carried by samples less the Doppler bias."""
    return _tiered(s)


@fold("epoch_weight_v2_imu_bridge", *_TIERED, imu=True)
def epoch_weight_v2_imu_bridge(s: Sessions) -> np.ndarray:
    """Only weak epochs and holes are carried by samples, without a bias."""
    return _tiered(s, medium=6.0, alpha=None)


@fold("fgo", *_RATES, "sd_n", "sd_e", "chain_scale", imu=True)
def fgo(s: Sessions) -> np.ndarray:
    """The robust chain of all epochs."""
    sums = s.sums and s.sums[:3]
    return _places(reckoning.chain_rows(s.cuts, s.place, s.velocity, s.get("chain_scale"), s.time, np.hypot(s.get("sd_e"), s.get("sd_n")), sums))


@fold("kalman_sigma", *_SIGMAS)
def kalman_sigma(s: Sessions) -> np.ndarray:
    return _places(s.kalman)


@fold("kalman_simple_cv", *_RATES)
def kalman_simple_cv(s: Sessions) -> np.ndarray:
    """The forward filter alone on positions and velocities of the horizontal; heights as they are."""
    z, v = s.place[:, :2], s.velocity[:, :2]
    v = np.where(np.isfinite(v).all(1, keepdims=True), v, np.nan)
    gaps = np.maximum(np.diff(s.time, prepend=s.time[0]), 0.0)
    gaps[s.cuts[:-1]] = 0.0
    start = z[s.cuts[:-1]], np.nan_to_num(v[s.cuts[:-1]]), 9.0, 4.0
    x = kernels.two_state(s.cuts, z, np.full(z.shape, 9.0), gaps, 0.5, start, v, np.full(z.shape, 1.0), two_way=False)[0]
    return np.concatenate([x, s.place[:, 2:]], 1)


#: Mean horizontal sigma of the filter from which on a session gets a second pass.
SMART_SIGMA = 0.40


@fold("kalman_smart", *_SIGMAS, "ve", "vn", "quality")
def kalman_smart(s: Sessions) -> np.ndarray:
    """kalman_sigma, and where its mean horizontal sigma is large the adaptive choice of a filter on top of it."""
    out, sigma = _places(s.kalman), s.kalman["sigma_h"]
    v, quality = s.get("ve", "vn"), s.get("quality")
    for a, b in zip(s.cuts[:-1], s.cuts[1:], strict=True):
        known = sigma[a:b][~np.isnan(sigma[a:b])]
        if len(known) and known.mean() >= SMART_SIGMA:
            out[a:b] = constraints.adaptive_rows(s.time[a:b], out[a:b], v[a:b], quality[a:b])
    return out
