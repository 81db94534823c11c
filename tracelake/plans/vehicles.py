"""Vehicle constraints, inertial fusion and media operators over the event tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import constraints, inertial, kernels, media
from tracelake.operators.motion import steps, with_enu
from tracelake.plans.tracks import ENU, STEPS, TRACK, rounded, sql_rounded, track
from tracelake.registry import query

KEY = "session_id, epoch_ix"


def _stops(spark: SparkSession, sf: str) -> DataFrame:
    """The track with epochs 5 to 9 of every twenty standing near where the fifth is."""
    still = (F.col("epoch_ix") % 20).between(5, 9)
    t = with_enu(track(spark, sf))
    at = F.floor(F.col("epoch_ix") / 20)
    place = lambda c: F.when(still, at * 7.0 + (F.col("k") % 5) / 10.0).otherwise(F.col(c))
    return t.withColumns({"e_m": place("e_m"), "n_m": place("n_m"), "ve": F.when(still, 0.01).otherwise(F.col("ve")), "vn": F.when(still, 0.0).otherwise(F.col("vn"))})


_STOPPED = f"""{ENU}, p AS (SELECT * EXCLUDE (e_m, n_m, ve, vn), epoch_ix % 20 BETWEEN 5 AND 9 AS s,
  CASE WHEN epoch_ix % 20 BETWEEN 5 AND 9 THEN floor(epoch_ix / 20.0E0) * 7 + (k % 5) / 10.0E0 ELSE e_m END AS e_m, CASE WHEN epoch_ix % 20 BETWEEN 5 AND 9 THEN floor(epoch_ix / 20.0E0) * 7 + (k % 5) / 10.0E0 ELSE n_m END AS n_m FROM enu),
r AS (SELECT *, s AS still, min(quality) OVER (PARTITION BY session_id, s, epoch_ix // 20) AS best, count(*) OVER (PARTITION BY session_id, s, epoch_ix // 20, quality) AS same FROM p),
u AS (SELECT *, max(CASE WHEN quality = best THEN same END) OVER (PARTITION BY session_id, s, epoch_ix // 20) AS nb FROM r),
g AS (SELECT session_id, epoch_ix // 20 AS b, list_sort(list(e_m) FILTER (nb < 2 OR quality = best)) AS le, max(utc_s) - min(utc_s) AS dur, count(*) AS c, sqrt(power(max(e_m) - min(e_m), 2) + power(max(n_m) - min(n_m), 2)) AS spread FROM u WHERE still GROUP BY 1, 2)"""


@query(f"""WITH {_STOPPED} SELECT u.session_id, u.epoch_ix, coalesce(still AND dur >= 2 AND c >= 2 AND spread <= 2, false) AS held,
  round(CASE WHEN still AND dur >= 2 AND c >= 2 AND spread <= 2 THEN le[len(le) // 2 + 1] ELSE e_m END, 4) + 0.0E0 AS e_m FROM u LEFT JOIN g ON u.session_id = g.session_id AND u.epoch_ix // 20 = g.b AND u.still""")
def constrain_hold_still(spark: SparkSession, sf: str) -> DataFrame:
    """Standing runs snap to the upper median of their best solutions."""
    rows = constraints.hold_still(constraints.classify_still(_stops(spark, sf)))
    return rounded(rows.select("session_id", "epoch_ix", "held", "e_m"), 4)


@query()
def constrain_no_sideways(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraints.no_sideways(with_enu(track(spark, sf))).select("session_id", "epoch_ix", "constrained", "side_m", "e_m", "n_m", "ve", "vn"), 4)


@query(f"""WITH {TRACK}, g AS (SELECT session_id, 100 * avg(CASE WHEN quality = 5 THEN 1.0E0 ELSE 0 END) AS single_pct, 100 * avg(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0 END) AS fix_pct FROM track GROUP BY 1)
SELECT session_id, round(single_pct, 5) AS single_pct, round(fix_pct, 5) AS fix_pct, CASE WHEN single_pct >= 10 THEN 'poor' WHEN fix_pct >= 50 THEN 'clean' ELSE 'mixed' END AS regime FROM g""")
def constrain_regime(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraints.regime(track(spark, sf), 10.0, 50.0), 5)


@query()
def constrain_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraints.adaptive(with_enu(track(spark, sf))), 4)


def _imu(spark: SparkSession, sf: str) -> DataFrame:
    t = track(spark, sf).select("session_id", "utc_s", "k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    zero = F.lit(0.0)
    return t.select("session_id", (F.col("utc_s") + F.col("j") / 10.0).alias("utc_s"), (((F.col("k") + F.col("j")) % 7 - 3) / 50.0).alias("ax"), zero.alias("ay"), F.lit(9.80665).alias("az"), zero.alias("gx"), zero.alias("gy"), zero.alias("gz"))


@query()
def kernel_strapdown(spark: SparkSession, sf: str) -> DataFrame:
    """Inertial samples and epochs of each session in one filter, forwards and back."""
    rows = with_enu(track(spark, sf)).select("session_id", "utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu")
    out = dict.fromkeys(inertial.STRAPDOWN, T.DoubleType())
    return rounded(kernels.per_sessions_with(rows, _imu(spark, sf), inertial.strapdown_rts_all, out).select("session_id", "utc_s", *out), 3)


@query()
def kernel_turn_rate(spark: SparkSession, sf: str) -> DataFrame:
    def run(r: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        out = inertial.turn_rate_all(cuts, r["utc_s"].to_numpy(float), r[["e_m", "n_m"]].to_numpy(float))
        return {"e_s": out[:, 0], "n_s": out[:, 1]}

    rows = with_enu(track(spark, sf)).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m")
    return rounded(kernels.per_sessions(rows, run, {"e_s": T.DoubleType(), "n_s": T.DoubleType()}).select("session_id", "epoch_ix", "e_s", "n_s"), 3)


@query()
def kernel_allan_parameters(spark: SparkSession, sf: str) -> DataFrame:
    def run(r: pd.DataFrame) -> pd.DataFrame:
        p = inertial.allan_parameters(r.sort_values("utc_s")["sd_n"].to_numpy(float), 1.0)
        return pd.DataFrame({"session_id": [r["session_id"].iloc[0]], **{k: [v] for k, v in p.items()}})

    return rounded(track(spark, sf).select("session_id", "utc_s", "sd_n").groupBy("session_id").applyInPandas(run, "session_id long, random_walk double, bias_instability double, rate_random_walk double, reliable boolean"))


_Z = "((x - m) / s)"
_TAIL = (
    f"(exp(-{_Z} * {_Z} / 2) / 2.5066282746310002E0 * (kk * (0.319381530E0 + kk * (-0.356563782E0 + kk * (1.781477937E0 + kk * (-1.821255978E0 + kk * 1.330274429E0))))))"
)


@query(f"""WITH v AS (SELECT l_suppkey, l_extendedprice AS x, avg(l_extendedprice) OVER w AS m, stddev_samp(l_extendedprice) OVER w AS s, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
k AS (SELECT *, 1 / (1 + 0.2316419E0 * abs({_Z})) AS kk FROM v), p AS (SELECT *, greatest(1E-12, least(1 - 1E-12, CASE WHEN {_Z} >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END)) AS p FROM k),
i AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS i FROM p)
SELECT l_suppkey, round(-any_value(n) - sum((2 * i - 1) * ln(p) + (2 * (n + 1 - i) - 1) * ln(1 - p)) / any_value(n), 4) AS a2 FROM i GROUP BY l_suppkey""")
def stats_anderson_darling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(media.anderson_darling(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice", "l_suppkey"), 4)


@query(f"""WITH {STEPS}, d2 AS (SELECT *, e_m - lag(e_m) OVER w AS se, n_m - lag(n_m) OVER w AS sn FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
m AS (SELECT {KEY}, utc_s, sqrt(power(se - ve * dt_s, 2) + power(sn - vn * dt_s, 2)) AS mis FROM d2),
b2 AS (SELECT *, median(mis) OVER (PARTITION BY session_id) AS med FROM m), a AS (SELECT *, median(abs(mis - med)) OVER (PARTITION BY session_id) AS mad FROM b2)
SELECT {KEY}, coalesce(mis > greatest(3, med + 5 * mad) AND lead(mis) OVER (PARTITION BY session_id ORDER BY utc_s) > greatest(3, med + 5 * mad), false) AS rejected FROM a""")
def gate_both_sided_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs whose steps disagree with an independent velocity on both sides."""
    w = Window.partitionBy("session_id").orderBy("utc_s")
    rows = steps(with_enu(track(spark, sf)))
    rows = rows.withColumns({"step_e": F.col("e_m") - F.lag("e_m").over(w), "step_n": F.col("n_m") - F.lag("n_m").over(w), "vis_e": F.col("ve") * F.col("dt_s"), "vis_n": F.col("vn") * F.col("dt_s")})
    return media.both_sided_steps(rows).select("session_id", "epoch_ix", "rejected")


@query(f"""WITH {TRACK}, p AS (SELECT session_id, epoch_ix * 1000000.0E0 AS x, epoch_ix * 1000000.0E0 + CASE WHEN epoch_ix % 30 >= 15 THEN 90000000.0E0 ELSE 0 END AS y FROM track),
r AS (SELECT *, (y - x) / 1E6 AS residual_ms, (y - x) / 1E6 - lag((y - x) / 1E6) OVER (PARTITION BY session_id ORDER BY x) AS jump_ms FROM p)
SELECT session_id, x, {sql_rounded('residual_ms, jump_ms')} FROM r WHERE abs(jump_ms) > 50""")
def clock_audio_jumps(spark: SparkSession, sf: str) -> DataFrame:
    t = track(spark, sf)
    x = F.col("epoch_ix") * 1.0e6
    pairs = t.select("session_id", x.alias("x"), (x + F.when(F.col("epoch_ix") % 30 >= 15, 9.0e7).otherwise(0.0)).alias("y"))
    fit = t.select("session_id").distinct().select("session_id", F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"))
    return rounded(media.discontinuities(pairs, fit))


@query(f"""WITH {TRACK}, x AS (SELECT session_id, epoch_ix AS i, sd_n AS x, count(*) OVER (PARTITION BY session_id) AS n FROM track),
s AS (SELECT a.session_id, a.i AS start, f.k, sum(b.x * (0.5E0 - 0.5E0 * cos(2 * pi() * (b.i - a.i) / 15)) * cos(2 * pi() * f.k * (b.i - a.i) / 16)) AS re, sum(b.x * (0.5E0 - 0.5E0 * cos(2 * pi() * (b.i - a.i) / 15)) * sin(2 * pi() * f.k * (b.i - a.i) / 16)) AS im
  FROM x a JOIN x b ON a.session_id = b.session_id AND b.i BETWEEN a.i AND a.i + 15, range(8) AS f(k) WHERE a.i % 8 = 0 AND a.i + 16 <= a.n GROUP BY ALL)
SELECT session_id, start, CAST(k // 2 AS INT) AS bin, round(10 * log10(max(re * re + im * im) + 1E-12), 4) + 0.0E0 AS power_db FROM s GROUP BY ALL""")
def media_spectrogram(spark: SparkSession, sf: str) -> DataFrame:
    """Short spectra of each session's sigmas, dealt in blocks of twenty samples as sound is."""
    one = F.struct(F.col("epoch_ix").alias("i"), F.col("sd_n").alias("x"))
    blocks = track(spark, sf).groupBy(F.col("session_id").alias("file"), (F.floor(F.col("epoch_ix") / 20) * 20).alias("start")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]).alias("samples"))
    spectra = media.spectrogram(blocks, window=16, hop=8, bins=4)
    return rounded(spectra.select(F.col("file").alias("session_id"), "start", F.posexplode("power_db").alias("bin", "power_db")), 4)
