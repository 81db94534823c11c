"""Window functions along a session: smoothing, differences, headings, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import islands, motion, smoothing
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import ENU, FIXES, STEPS, TRACK, fixes, rounded, track
from tracelake.registry import query

KEY = "session_id, epoch_ix"


def _sql_gauss(col: str, sigma: float, src: str, weight: str = "1.0E0") -> str:
    """Gaussian over rows with repeated ends, as a join on clamped row numbers."""
    kernel = smoothing.gaussian_kernel(sigma)
    half = len(kernel) // 2
    values = ", ".join(f"({k - half}, {w!r})" for k, w in enumerate(kernel))
    return f"""g_n AS (SELECT *, {weight} AS gw, row_number() OVER (PARTITION BY session_id ORDER BY utc_s) AS g_ix, count(*) OVER (PARTITION BY session_id) AS g_cnt FROM {src}),
g_k(o, kw) AS (VALUES {values}),
g_s AS (SELECT a.session_id, a.epoch_ix, sum(CASE WHEN b.{col} IS NOT NULL THEN kw * b.gw * b.{col} END) / sum(CASE WHEN b.{col} IS NOT NULL THEN kw * b.gw END) AS s, any_value(a.{col}) AS raw
  FROM g_n a CROSS JOIN g_k JOIN g_n b ON a.session_id = b.session_id AND b.g_ix = least(greatest(a.g_ix + o, 1), a.g_cnt) GROUP BY a.session_id, a.epoch_ix)"""


@query(f"WITH {ENU}, {_sql_gauss('e_m', 2.0, 'enu')} SELECT {KEY}, round(s, 4) + 0.0E0 AS e_smooth FROM g_s")
def smooth_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian of two rows, ends repeated."""
    rows = smoothing.gaussian_rows(with_enu(track(spark, sf)), ["e_m"], 2.0)
    return rounded(rows.select("session_id", "epoch_ix", F.col("e_m_s").alias("e_smooth")), 4)


@query(f"WITH {TRACK}, {_sql_gauss('vu', 1.5, 'track')} SELECT {KEY}, round(CASE WHEN raw IS NOT NULL THEN s END, 6) + 0.0E0 AS vu_smooth FROM g_s")
def smooth_gaussian_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values have no weight and stay missing."""
    return rounded(smoothing.gaussian_rows(track(spark, sf), ["vu"], 1.5).select("session_id", "epoch_ix", F.col("vu_s").alias("vu_smooth")))


@query(f"WITH {TRACK}, {_sql_gauss('h_m', 2.0, 'track', '1 / (0.01E0 + sd_u * sd_u)')} SELECT {KEY}, round(s, 4) AS h_smooth FROM g_s")
def smooth_gaussian_weighted(spark: SparkSession, sf: str) -> DataFrame:
    rows = smoothing.gaussian_rows(track(spark, sf), ["h_m"], 2.0, weight=1.0 / (0.01 + F.col("sd_u") * F.col("sd_u")))
    return rounded(rows.select("session_id", "epoch_ix", F.col("h_m_s").alias("h_smooth")), 4)


@query(f"""WITH {TRACK}, a AS (SELECT *, sin(radians(k * 3.5E0)) AS sn, cos(radians(k * 3.5E0)) AS cs FROM track), {_sql_gauss('sn', 1.0, 'a')}, {_sql_gauss('cs', 1.0, 'a').replace('g_', 'h_')},
r AS (SELECT g_s.session_id, g_s.epoch_ix, degrees(atan2(g_s.s, h_s.s)) AS d FROM g_s JOIN h_s ON g_s.session_id = h_s.session_id AND g_s.epoch_ix = h_s.epoch_ix)
SELECT {KEY}, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS d_smooth FROM r""")
def smooth_circular(spark: SparkSession, sf: str) -> DataFrame:
    rows = smoothing.gaussian_circular(track(spark, sf).withColumn("d", F.col("k") * 3.5), "d", 1.0)
    return rows.select("session_id", "epoch_ix", F.round("d_s", 4).alias("d_smooth"))


@query(f"""WITH {TRACK}, d AS (SELECT *, utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s) AS dt FROM track),
m AS (SELECT session_id, greatest(5 * list_sort(list(dt) FILTER (dt > 0))[count(dt) FILTER (dt > 0) // 2 + 1], 4.0E0) AS gap FROM d GROUP BY 1),
s AS (SELECT d.*, sum(CASE WHEN dt > gap THEN 1 ELSE 0 END) OVER (PARTITION BY d.session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS seg FROM d JOIN m USING (session_id)),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, seg) AS cnt FROM s),
p AS (SELECT a.session_id, a.epoch_ix, any_value(a.h_m) AS h, any_value(a.cnt) AS cnt, sum(exp(-0.5E0 * power((b.utc_s - a.utc_s) / 2, 2)) * b.h_m) / sum(exp(-0.5E0 * power((b.utc_s - a.utc_s) / 2, 2))) AS v
  FROM n a JOIN n b ON a.session_id = b.session_id AND a.seg = b.seg AND abs(b.utc_s - a.utc_s) <= 8 GROUP BY 1, 2)
SELECT {KEY}, round(CASE WHEN cnt < 3 THEN h ELSE v END, 4) AS h_smooth_m FROM p""")
def smooth_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights weighted by time, within segments between long gaps."""
    return rounded(smoothing.smooth_heights(track(spark, sf)).select("session_id", "epoch_ix", "h_smooth_m"), 4)


@query(f"WITH {TRACK} SELECT {KEY}, round(avg(sd_n) OVER (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 8) AS sd_avg FROM track")
def smooth_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(track(spark, sf).select("session_id", "epoch_ix", smoothing.moving_average("sd_n", 5).alias("sd_avg")), 8)


@query(f"""WITH {ENU}, n AS (SELECT *, utc_s - lag(utc_s) OVER w AS b, lead(utc_s) OVER w - utc_s AS a, lag(e_m) OVER w AS ep, lead(e_m) OVER w AS en FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s))
SELECT {KEY}, round(CASE WHEN coalesce(b <= 10, false) AND coalesce(a <= 10, false) THEN (en - ep) / (a + b) WHEN coalesce(a <= 10, false) THEN (en - e_m) / a WHEN coalesce(b <= 10, false) THEN (e_m - ep) / b END, 4) + 0.0E0 AS cve FROM n""")
def motion_derived_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(motion.derived_velocity(with_enu(track(spark, sf))).select("session_id", "epoch_ix", "cve"), 4)


@query(f"WITH {STEPS} SELECT {KEY}, round(dt_s, 4) AS dt_s, round(step_m, 4) AS step_m, round(speed_mps, 4) AS speed_mps, round(climb_mps, 4) AS climb_mps FROM steps")
def motion_steps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(motion.steps(with_enu(track(spark, sf))).select("session_id", "epoch_ix", "dt_s", "step_m", "speed_mps", "climb_mps"), 4)


@query(f"""WITH {ENU}, r AS (SELECT *, utc_s - first_value(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s) AS t FROM enu),
s AS (SELECT session_id, epoch_ix, count(*) OVER w AS n, regr_sxx(e_m, t) OVER w AS sxx, regr_sxy(e_m, t) OVER w AS sxy FROM r WINDOW w AS (PARTITION BY session_id ORDER BY utc_s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT {KEY}, CASE WHEN n >= 3 AND sxx > 1E-12 THEN round(sxy / sxx, 4) + 0.0E0 END AS v_e, CASE WHEN n >= 3 AND sxx > 1E-12 THEN round(3 / sqrt(sxx), 4) END AS v_sigma FROM s""")
def motion_window_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity as the least-squares slope of position over four seconds."""
    rows = motion.windowed_slope_velocity(with_enu(track(spark, sf)), cols=("e_m",))
    return rounded(rows.select("session_id", "epoch_ix", "v_e", "v_sigma"), 4)


@query(f"""WITH {TRACK}, h AS (SELECT {KEY}, utc_s, (k * 47) % 360 AS d FROM track),
s AS (SELECT *, first_value(d) OVER w AS d0, coalesce(d - lag(d) OVER w, 0) AS step FROM h WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
u AS (SELECT *, CASE WHEN (step + 180) - 360 * floor((step + 180) / 360.0E0) = 0 THEN 180 ELSE (step + 180) - 360 * floor((step + 180) / 360.0E0) - 180 END AS wrapped FROM s)
SELECT {KEY}, d0 + sum(wrapped) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS unwrapped FROM u""")
def motion_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    rows = track(spark, sf).withColumn("d", ((F.col("k") * 47) % 360).cast("double"))
    return motion.unwrap_deg(rows, "d", "unwrapped").select("session_id", "epoch_ix", "unwrapped")


@query(f"""WITH {TRACK}, d AS (SELECT session_id, utc_s, utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s) AS dt FROM track)
SELECT session_id, round((count(*) - 1) / (max(utc_s) - min(utc_s)), 5) AS mean_rate_hz, round(1 / median(CASE WHEN dt > 0 THEN dt END), 5) AS median_rate_hz FROM d GROUP BY session_id""")
def motion_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(motion.rates(track(spark, sf)), 5)


@query(f"""WITH {TRACK}, d AS (SELECT *, CASE WHEN coalesce(utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s), 0) > 10 THEN 1 ELSE 0 END AS g FROM track),
s AS (SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS seg FROM d),
a AS (SELECT session_id, seg, min(utc_s) AS start_s, max(utc_s) AS end_s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT session_id, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s, n FROM a QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY end_s - start_s DESC, start_s) = 1""")
def island_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The longest stretch without a gap."""
    return rounded(islands.coverage(track(spark, sf)), 4)


@query(f"""WITH {TRACK}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR quality <> lag(quality) OVER w THEN 1 ELSE 0 END AS chg FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS run_id FROM c),
l AS (SELECT *, lead(run_id) OVER w AS nr, lead(quality) OVER w AS nq FROM r WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
u AS (SELECT session_id, run_id, quality, epoch_ix, false AS bridge FROM r UNION ALL SELECT session_id, nr, nq, epoch_ix, true FROM l WHERE nr > run_id)
SELECT session_id, CAST(run_id AS BIGINT) AS run_id, any_value(quality) AS quality, count(*) AS points, count(*) FILTER (bridge) AS bridges, string_agg(CAST(epoch_ix AS VARCHAR), ' ' ORDER BY epoch_ix) AS line FROM u GROUP BY session_id, run_id""")
def island_colored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by quality that meet in bridge points."""
    rows = islands.colored_segments(track(spark, sf))
    line = F.array_join(F.transform(F.array_sort(F.collect_list("epoch_ix")), lambda x: x.cast("string")), " ")
    return rows.groupBy("session_id", "run_id").agg(F.first("quality").alias("quality"), F.count(F.lit(1)).alias("points"), F.count_if("bridge").alias("bridges"), line.alias("line"))


@query(f"""WITH {TRACK}, {FIXES}, q AS (SELECT session_id, epoch_ix, utc_s FROM track WHERE provider = 'signup'), a AS (SELECT f.session_id, f.utc_s, (t.lat_deg - f.d_lat) * 1E6 AS r FROM fixes f JOIN track t ON f.session_id = t.session_id AND f.utc_s = t.utc_s)
SELECT q.session_id, q.epoch_ix, round(sum(exp(-0.5E0 * power((a.utc_s - q.utc_s) / 5, 2)) * a.r) / sum(exp(-0.5E0 * power((a.utc_s - q.utc_s) / 5, 2))), 3) AS bend, count(*) AS n
FROM q JOIN a ON q.session_id = a.session_id AND abs(a.utc_s - q.utc_s) <= 20 GROUP BY 1, 2""")
def bend_residual_field(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of anchors near each query, weighted by a Gaussian in time: a bucketed band join."""
    from tracelake.operators.ranges import band_join

    t = track(spark, sf)
    a = fixes(spark, sf).join(t.select("session_id", "utc_s", "lat_deg"), ["session_id", "utc_s"]).select("session_id", "utc_s", ((F.col("lat_deg") - F.col("d_lat")) * 1e6).alias("r"))
    q = t.where("provider = 'signup'").select("session_id", "epoch_ix", "utc_s")
    pairs = band_join(q, a, 20.0, strict=False)
    w = F.exp(-0.5 * ((F.col("utc_s_r") - F.col("utc_s")) / 5.0) ** 2)
    return rounded(pairs.groupBy("session_id", "epoch_ix").agg((F.sum(w * F.col("r_r")) / F.sum(w)).alias("bend"), F.count(F.lit(1)).alias("n")), 3)


@query(f"""WITH {TRACK}, v AS (SELECT *, lead(utc_s) OVER w - utc_s AS dt FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s))
SELECT {KEY}, round(coalesce(sum(CASE WHEN dt > 5 THEN 0 ELSE ve * dt END) OVER (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS path_e FROM v""")
def motion_integrated_path(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity summed over time, steps across holes left out."""
    w = Window.partitionBy("session_id").orderBy("utc_s")
    rows = track(spark, sf).withColumn("dt", F.lead("utc_s").over(w) - F.col("utc_s"))
    step = F.when(F.col("dt") > 5, 0.0).otherwise(F.col("ve") * F.col("dt"))
    return rounded(rows.select("session_id", "epoch_ix", F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("path_e")), 4)


@query(f"""WITH {TRACK}, x AS (SELECT {KEY}, utc_s, CASE WHEN k % 8 = 0 THEN NULL ELSE h_m END AS h FROM track), n AS (SELECT *, row_number() OVER w AS ix FROM x WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
near AS (SELECT *, last_value(CASE WHEN h IS NOT NULL THEN ix END IGNORE NULLS) OVER p AS li, last_value(h IGNORE NULLS) OVER p AS lh, first_value(CASE WHEN h IS NOT NULL THEN ix END IGNORE NULLS) OVER q AS hi, first_value(h IGNORE NULLS) OVER q AS hh
  FROM n WINDOW p AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {KEY}, round(CASE WHEN li IS NULL THEN hh WHEN hi IS NULL THEN lh WHEN hi = li THEN h ELSE lh + (hh - lh) * (ix - li) / (hi - li) END, 5) AS h_filled FROM near""")
def fill_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged values from their neighbours, linear in the row number; ends take the nearest."""
    w = Window.partitionBy("session_id").orderBy("utc_s")
    rows = track(spark, sf).withColumn("h", F.when(F.col("k") % 8 != 0, F.col("h_m"))).withColumn("ix", F.row_number().over(w))
    good = F.when(F.col("h").isNotNull(), F.struct("ix", "h"))
    back = Window.partitionBy("session_id").orderBy(F.desc("utc_s"))
    lo, hi = F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(good, True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"lo": lo, "hi": hi})
    line = F.col("lo.h") + (F.col("hi.h") - F.col("lo.h")) * (F.col("ix") - F.col("lo.ix")) / (F.col("hi.ix") - F.col("lo.ix"))
    value = F.when(F.col("lo").isNull(), F.col("hi.h")).when(F.col("hi").isNull(), F.col("lo.h")).when(F.col("hi.ix") == F.col("lo.ix"), F.col("h")).otherwise(line)
    return rounded(rows.select("session_id", "epoch_ix", value.alias("h_filled")), 5)


@query(f"""WITH {TRACK}, d AS (SELECT session_id, epoch_ix, utc_s, (k % 4) AS ctr FROM track), c AS (SELECT *, ctr <> lag(ctr) OVER w AS jump FROM d WINDOW w AS (PARTITION BY session_id ORDER BY utc_s))
SELECT session_id, count(*) FILTER (jump) AS jumps, list_sort(list(ctr))[count(*) // 2 + 1] AS upper_median, round(avg(ctr), 6) AS mean FROM c GROUP BY session_id""")
def clock_discontinuities(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of a counter along the session, and its upper median."""
    from tracelake.operators.stats import upper_median

    w = Window.partitionBy("session_id").orderBy("utc_s")
    rows = track(spark, sf).withColumn("ctr", F.col("k") % 4).withColumn("jump", F.col("ctr") != F.lag("ctr").over(w))
    return rounded(rows.groupBy("session_id").agg(F.count_if("jump").alias("jumps"), upper_median("ctr").cast("long").alias("upper_median"), F.avg("ctr").alias("mean")))


@query(f"""WITH {TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY utc_s) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM track)
SELECT {KEY} FROM n WHERE i % greatest(n // 20, 1) = 0 OR i = n - 1""")
def decimate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Evenly spaced rows of each session, ends included."""
    w = Window.partitionBy("session_id")
    rows = track(spark, sf).withColumns({"i": F.row_number().over(w.orderBy("utc_s")) - 1, "n": F.count(F.lit(1)).over(w)})
    stride = F.greatest(F.floor(F.col("n") / 20), F.lit(1))
    return rows.where((F.col("i") % stride == 0) | (F.col("i") == F.col("n") - 1)).select("session_id", "epoch_ix")


@query(f"""WITH {TRACK} SELECT session_id, count(*) AS n, round(min(lat_deg), 10) AS lat_min, round(max(lon_deg), 10) AS lon_max, max_by(epoch_ix, sd_u) AS worst_epoch, round(max(sd_u), 6) AS worst_sd FROM track GROUP BY session_id""")
def worst_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Where the largest sigma of a session is: the first of equals."""
    largest = F.when(F.col("sd_u").isNotNull(), F.struct("sd_u", -F.col("epoch_ix")))
    g = track(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("lat_deg").alias("lat_min"), F.max("lon_deg").alias("lon_max"), F.max_by("epoch_ix", largest).alias("worst_epoch"), F.max("sd_u").alias("worst_sd"))
    return g.select("session_id", "n", F.round("lat_min", 10).alias("lat_min"), F.round("lon_max", 10).alias("lon_max"), "worst_epoch", F.round("worst_sd", 6).alias("worst_sd"))
