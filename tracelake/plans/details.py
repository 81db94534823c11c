"""Further sequence and report operators: adaptive smoothing, yaw, stops, nearest ranks, epoch features, clock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import quality, timefn
from tracelake.functions.angles import wrap_deg
from tracelake.operators import clocks, motion, satellites, smoothing
from tracelake.operators.motion import with_enu
from tracelake.plans.statistics import _ROBUST
from tracelake.plans.tracks import ENU, STAT, STEPS, TRACK, anchors, rounded, stat, track
from tracelake.registry import query

KEY = "session_id, epoch_ix"


@query(f"""WITH {TRACK}, s AS (SELECT *, 1 + least(greatest((10.0E0 - ns) / 7, 0), 1) AS sg, row_number() OVER (PARTITION BY session_id ORDER BY utc_s) AS ix FROM track)
SELECT a.session_id, a.epoch_ix, round(sum(exp(-0.5E0 * power((b.ix - a.ix) / a.sg, 2)) * b.h_m) / sum(exp(-0.5E0 * power((b.ix - a.ix) / a.sg, 2))), 4) AS h_smooth
FROM s a JOIN s b ON a.session_id = b.session_id AND abs(b.ix - a.ix) <= ceil(3 * a.sg) GROUP BY 1, 2""")
def smooth_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    """Bandwidth by the number of satellites of each row."""
    sigma = quality.smoothing_samples_from_ns(F.col("ns"), F.lit(1.0))
    return rounded(smoothing.gaussian_adaptive(track(spark, sf), "h_m", sigma, 2.0).select("session_id", "epoch_ix", F.col("h_m_s").alias("h_smooth")), 4)


@query(f"""WITH {ENU}, w AS (SELECT *, first_value(e_m) OVER f AS e0, last_value(e_m) OVER f AS e1, first_value(n_m) OVER f AS n0, last_value(n_m) OVER f AS n1, first_value(utc_s) OVER f AS t0, last_value(utc_s) OVER f AS t1
  FROM enu WINDOW f AS (PARTITION BY session_id ORDER BY utc_s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
y AS (SELECT *, CASE WHEN t0 < utc_s AND t1 > utc_s AND sqrt(power(e1 - e0, 2) + power(n1 - n0, 2)) >= 1 THEN degrees(atan2(e1 - e0, n1 - n0)) END AS yaw FROM w)
SELECT {KEY}, round(CASE WHEN yaw < 0 THEN yaw + 360 ELSE yaw END, 4) AS yaw_deg FROM y""")
def motion_trajectory_yaw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(motion.trajectory_yaw(with_enu(track(spark, sf))).select("session_id", "epoch_ix", "yaw_deg"), 4)


@query(f"""WITH {TRACK}, h AS (SELECT {KEY}, utc_s, (k * 47) % 360 AS d FROM track), l AS (SELECT *, lag(d) OVER w AS a, lead(d) OVER w AS b, lead(utc_s) OVER w - lag(utc_s) OVER w AS dt FROM h WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
s AS (SELECT *, (b - a + 180) - 360 * floor((b - a + 180) / 360.0E0) - 180 AS raw FROM l)
SELECT {KEY}, round(abs(CASE WHEN raw = -180 THEN 180 ELSE raw END) / dt, 4) AS rate_dps FROM s""")
def motion_heading_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the wrapped heading change around each row over its time."""
    w = Window.partitionBy("session_id").orderBy("utc_s")
    rows = track(spark, sf).withColumn("d", ((F.col("k") * 47) % 360).cast("double"))
    rate = F.abs(wrap_deg(F.lead("d").over(w) - F.lag("d").over(w))) / (F.lead("utc_s").over(w) - F.lag("utc_s").over(w))
    return rounded(rows.select("session_id", "epoch_ix", rate.alias("rate_dps")), 4)


@query(f"""WITH {STEPS}, s AS (SELECT *, lag(utc_s) OVER w AS before, coalesce(speed_mps < 11.33, false) AS slow, row_number() OVER w AS rn FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
c AS (SELECT *, CASE WHEN rn = 1 OR slow <> lag(slow) OVER (PARTITION BY session_id ORDER BY utc_s) THEN 1 ELSE 0 END AS chg FROM s), r AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT session_id, round(min(before), 4) AS start_s, round(max(utc_s), 4) AS end_s, count(*) AS n FROM r WHERE slow GROUP BY session_id, run HAVING max(utc_s) - min(before) >= 1.5""")
def island_step_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Slow stretches by steps, led by the row before."""
    return rounded(motion.step_stops(motion.steps(with_enu(track(spark, sf))), below=11.33), 4)


@query(f"""WITH {TRACK}, t AS (SELECT session_id, exp(-0.5E0 * power(sd_u / 0.5E0, 2)) AS trust FROM track), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY trust) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM t)
SELECT session_id, round(max(CASE WHEN i = least(n - 1, CAST(round(0.1E0 * (n - 1)) AS BIGINT)) THEN trust END), 6) AS p10, round(max(CASE WHEN i = least(n - 1, CAST(round(0.5E0 * (n - 1)) AS BIGINT)) THEN trust END), 6) AS p50,
  round(avg(CASE WHEN trust >= 0.5 THEN 1.0E0 ELSE 0 END), 6) AS high, round(avg(CASE WHEN trust <= 0.1 THEN 1.0E0 ELSE 0 END), 6) AS low FROM r GROUP BY session_id""")
def trust_nearest_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Trust exp(-d**2 / 2 sigma**2) of each epoch; tenth and half by the nearest rank, and shares above and below bars."""
    t = track(spark, sf).select("session_id", F.exp(-0.5 * (F.col("sd_u") / 0.5) ** 2).alias("trust"))
    w = Window.partitionBy("session_id")
    r = t.withColumns({"i": F.row_number().over(w.orderBy("trust")) - 1, "n": F.count(F.lit(1)).over(w)})
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.round(p * (F.col("n") - 1))), F.col("trust")))
    return rounded(r.groupBy("session_id").agg(at(0.1).alias("p10"), at(0.5).alias("p50"), F.avg((F.col("trust") >= 0.5).cast("double")).alias("high"), F.avg((F.col("trust") <= 0.1).cast("double")).alias("low")))


@query(f"""WITH {TRACK}, {STAT}, r AS (SELECT session_id, round(utc_s, 3) AS t, sqrt(avg(res_p * res_p)) AS rms, count(*) AS n FROM stat WHERE valid = 1 AND res_p <> 0 GROUP BY 1, 2)
SELECT t.session_id, t.epoch_ix, round(sqrt(sd_n * sd_n + 0.05E0 * coalesce(rms, 0) * coalesce(rms, 0) + 0.01E0), 6) AS eff_sigma, coalesce(r.n, 0) AS n_res,
  coalesce(sd_n < 0.5 AND rms < 6, false) AS good FROM track t LEFT JOIN r ON t.session_id = r.session_id AND round(t.utc_s, 3) = r.t""")
def epoch_features(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs with their residual statistics (time to the millisecond), effective sigma and gate."""
    r = satellites.residual_rms(stat(spark, sf)).select("session_id", "t", "rms", "n")
    rows = track(spark, sf).withColumn("t", F.round("utc_s", 3)).join(r, ["session_id", "t"], "left")
    good = F.coalesce((F.col("sd_n") < 0.5) & (F.col("rms") < 6), F.lit(False))
    return rounded(rows.select("session_id", "epoch_ix", quality.effective_sigma(F.col("sd_n"), F.col("rms")).alias("eff_sigma"), F.coalesce("n", F.lit(0)).alias("n_res"), good.alias("good")))


@query(f"""WITH {_ROBUST}, f AS (SELECT session_id, i / 2.0E0 AS pts FROM (SELECT DISTINCT session_id FROM anchors), range(0, 5) r(i))
SELECT f.session_id, f.pts, round(ymean + b * (CAST(f.pts * 1E9 AS BIGINT) + 5000000000 - xmean), 5) + 0.0E0 AS utc_s, CASE WHEN pts >= 1 THEN round(pts - 1, 6) END AS audio_s FROM f JOIN fit USING (session_id)""")
def frame_clock_table(spark: SparkSession, sf: str) -> DataFrame:
    """Frame times on the camera's clock, to UTC by the session's fit and to the sound's clock (none before it starts)."""
    a = anchors(spark, sf)
    fit = clocks.fit_anchors(a)
    frames = a.select("session_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("session_id", (F.col("i") / 2.0).alias("pts"))
    boot = (F.col("pts") * 1e9).cast("long") + 5000000000
    rows = frames.join(fit, "session_id")
    return rows.select("session_id", "pts", (F.round(timefn.anchor_utc(boot, F.col("slope"), F.col("xmean"), F.col("ymean")), 5) + 0.0).alias("utc_s"), F.when(F.col("pts") >= 1, F.round(F.col("pts") - 1, 6)).alias("audio_s"))


@query(f"""WITH {_ROBUST}, v AS (SELECT session_id, x_ns, x_ns / 1E9 + 0.25E0 + 0.5E0 AS video_s FROM anchors),
z AS (SELECT session_id, min(y_s) - 1 AS start_s FROM anchors WHERE session_id % 5 <> 0 GROUP BY 1),
u AS (SELECT v.*, start_s + video_s AS naive, ymean + b * (video_s * 1E9 - xmean) AS anch, rmse * sqrt(n / (n - 2.0E0)) * sqrt(1.0E0 / n + power(video_s * 1E9 - xmean, 2) / sxx) AS sigma FROM v JOIN fit USING (session_id) LEFT JOIN z USING (session_id))
SELECT session_id, x_ns, round(video_s, 6) AS video_s, round(anch, 4) AS anchored_utc_s, round(anch + 0, 4) AS anchored_gpst_s, round(naive + 0, 4) AS naive_gpst_s, round(anch - naive, 4) + 0.0E0 AS correction_s, round(sigma, 7) AS sigma_s FROM u""")
def clock_corrected_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times picked in a video, half a second late, by its start and by the session's anchors; every fifth session has no start."""
    a = anchors(spark, sf)
    fits = clocks.fit_anchors(a)
    starts = a.where("session_id % 5 <> 0").groupBy("session_id").agg((F.min("y_s") - 1).alias("start_utc_s"))
    got = clocks.corrected_times(a.select("session_id", "x_ns", (F.col("x_ns") / 1e9 + 0.25).alias("rel_s")), fits, starts, offset_s=0.5)
    digits = {"video_s": 6, "anchored_utc_s": 4, "anchored_gpst_s": 4, "naive_gpst_s": 4, "correction_s": 4, "sigma_s": 7}
    return got.select("session_id", "x_ns", *[(F.round(c, d) + 0.0).alias(c) for c, d in digits.items()])


@query(f"""WITH {TRACK}, c AS (SELECT session_id, round(utc_s, 3) AS t, lat_deg + 1E-6 AS la, h_m + 0.5E0 AS h FROM track)
SELECT a.session_id, count(*) AS n, round(avg(abs(c.la - a.lat_deg) * 111320), 5) AS mean_n_m, round(max(abs(c.h - a.h_m)), 5) AS max_v_m FROM track a JOIN c ON a.session_id = c.session_id AND round(a.utc_s, 3) = c.t GROUP BY a.session_id""")
def compare_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of two solutions at equal milliseconds."""
    t = track(spark, sf).withColumn("t", F.round("utc_s", 3))
    c = t.select("session_id", "t", (F.col("lat_deg") + 1e-6).alias("la"), (F.col("h_m") + 0.5).alias("h"))
    j = t.join(c, ["session_id", "t"])
    return rounded(j.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("la") - F.col("lat_deg")) * 111320).alias("mean_n_m"), F.max(F.abs(F.col("h") - F.col("h_m"))).alias("max_v_m")), 5)
