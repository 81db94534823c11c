"""Aggregations, regressions and robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.quality import ns_bucket
from tracelake.operators import clocks, motion, satellites, stats
from tracelake.plans.tracks import ANCHORS, ENU, STAT, STEPS, TRACK, anchors, rounded, sql_rounded, stat, table, track
from tracelake.registry import query

R = sql_rounded


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return motion.steps(motion.with_enu(track(spark, sf)))


def _bands(x: str) -> str:
    return (
        f"count({x}) AS n, avg({x}) AS mean, avg(abs({x})) AS mean_abs, stddev_pop({x}) AS std, sqrt(avg({x} * {x})) AS rms, quantile_cont(abs({x}), 0.6827) AS p68, "
        f"quantile_cont(abs({x}), 0.9545) AS p95, quantile_cont(abs({x}), 0.9973) AS p997, max(abs({x})) AS max_abs"
    )


_BANDS = "mean, mean_abs, std, rms, p68, p95, p997, max_abs"


@query(f"WITH {STEPS}, s AS (SELECT session_id, {_bands('speed_mps')} FROM steps WHERE speed_mps IS NOT NULL GROUP BY session_id) SELECT session_id, n, {R(_BANDS, 4)} FROM s")
def speed_sigma_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of the step speed of each session."""
    return rounded(stats.sigma_bands(_steps(spark, sf), "speed_mps", ["session_id"]), 4)


@query(f"""WITH {STEPS}, u AS (SELECT session_id, unnest(['step_m', 'climb_mps', 'u_m']) AS metric, unnest([step_m, climb_mps, u_m]) AS v FROM steps),
s AS (SELECT session_id, metric, {_bands('v')} FROM u WHERE v IS NOT NULL GROUP BY 1, 2) SELECT session_id, metric, n, {R(_BANDS, 4)} FROM s""")
def metric_sigma_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.metric_bands(_steps(spark, sf), ["step_m", "climb_mps", "u_m"], ["session_id"]), 4)


@query(f"""WITH {STEPS}, a AS (SELECT session_id, speed_mps AS x, median(speed_mps) OVER s AS m, quantile_cont(speed_mps, 0.05) OVER s AS p5, quantile_cont(speed_mps, 0.95) OVER s AS p95
  FROM steps WHERE speed_mps IS NOT NULL WINDOW s AS (PARTITION BY session_id)), g AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY session_id) AS mad FROM a)
SELECT session_id, round(any_value(m), 4) AS median, round(any_value(mad), 4) AS mad, round(1.4826E0 * any_value(mad), 4) AS robust_sigma,
  round(sqrt(avg(CASE WHEN x BETWEEN p5 AND p95 THEN x * x END)), 4) AS trimmed_rms, round(100 * avg(CASE WHEN abs(x - m) > 3 * 1.4826E0 * mad THEN 1.0E0 ELSE 0 END), 4) AS beyond_pct FROM g GROUP BY session_id""")
def stats_robust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.robust(_steps(spark, sf), "speed_mps", "session_id"), 4)


@query("""WITH m AS (SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(avg(c * c * c) / power(avg(c * c), 1.5), 6) + 0.0E0 AS skew, round(avg(c * c * c * c) / (avg(c * c) * avg(c * c)) - 3, 6) + 0.0E0 AS kurtosis FROM m GROUP BY l_suppkey""")
def stats_shape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.shape(table(spark, sf, "lineitem"), "l_extendedprice", "l_suppkey"))


@query(f"""WITH {TRACK}, c AS (SELECT session_id, utc_s, sd_n - avg(sd_n) OVER (PARTITION BY session_id) AS c FROM track),
l AS (SELECT session_id, c, {", ".join(f"c * lead(c, {k}) OVER w AS l{k}" for k in range(1, 6))} FROM c WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
s AS (SELECT session_id, sum(c * c) AS v, {", ".join(f"sum(l{k}) AS s{k}" for k in range(1, 6))} FROM l GROUP BY 1)
SELECT session_id, unnest([0, 1, 2, 3, 4, 5]) AS lag, round(unnest([1.0E0, s1 / v, s2 / v, s3 / v, s4 / v, s5 / v]), 6) + 0.0E0 AS acf FROM s""")
def stats_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.autocorrelation(track(spark, sf), "sd_n", 5, "session_id", "utc_s"))


@query(f"""WITH {TRACK}, h AS (SELECT session_id, (k * 3.5E0) AS d FROM track), s AS (SELECT session_id, count(*) AS n, avg(cos(radians(d))) AS c, avg(sin(radians(d))) AS s FROM h GROUP BY 1),
r AS (SELECT *, sqrt(c * c + s * s) AS r, degrees(atan2(s, c)) AS a FROM s)
SELECT session_id, n, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 5) AS mean_deg, round(degrees(sqrt(-2 * ln(r))), 5) AS std_deg, round(r, 6) AS r, round(exp(-n * r * r), 6) AS rayleigh_p FROM r""")
def stats_circular(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.circular(track(spark, sf).withColumn("d", F.col("k") * 3.5), "d", "session_id")
    return out.select("session_id", "n", F.round("mean_deg", 5).alias("mean_deg"), F.round("std_deg", 5).alias("std_deg"), F.round("r", 6).alias("r"), F.round("rayleigh_p", 6).alias("rayleigh_p"))


@query(f"""WITH {TRACK}, m AS (SELECT session_id, var_samp(sd_e) AS a, var_samp(sd_u) AS c, covar_samp(sd_e, sd_u) AS b FROM (SELECT session_id, sd_e * 10 AS sd_e, sd_u * 10 + k * 0.01E0 AS sd_u FROM track) GROUP BY 1),
x AS (SELECT *, sqrt((a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b)) AS major, sqrt(greatest((a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b), 0)) AS minor FROM m)
SELECT session_id, round(major, 5) AS major, round(minor, 5) AS minor, round(degrees(atan2(2 * b, a - c) / 2), 4) AS angle_deg, round(5.991464547107979E0 * pi() * major * minor, 4) AS area95 FROM x""")
def stats_ellipse(spark: SparkSession, sf: str) -> DataFrame:
    rows = track(spark, sf).select("session_id", (F.col("sd_e") * 10).alias("e"), (F.col("sd_u") * 10 + F.col("k") * 0.01).alias("n"))
    out = stats.ellipse(rows, "e", "n", "session_id")
    return out.select("session_id", F.round("major", 5).alias("major"), F.round("minor", 5).alias("minor"), F.round("angle_deg", 4).alias("angle_deg"), F.round("area95", 4).alias("area95"))


@query("""SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_suppkey""")
def stats_line_fit(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.line_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_suppkey")
    return out.select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


@query(f"""WITH {TRACK}, l AS (SELECT session_id, sd_n, {", ".join(f"{'lead' if k >= 0 else 'lag'}(sd_e + k * 1E-3, {abs(k)}) OVER w AS b{k + 3}" for k in range(-3, 4))} FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
c AS (SELECT session_id, unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag, unnest([{", ".join(f"corr(sd_n, b{k})" for k in range(7))}]) AS r FROM l GROUP BY 1)
SELECT session_id, lag, round(r, 6) AS r FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY r DESC NULLS LAST, lag) = 1""")
def stats_lagged_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rows = track(spark, sf).withColumn("b", F.col("sd_e") + F.col("k") * 1e-3)
    return rounded(stats.lagged_correlation(rows, "sd_n", "b", 3, "session_id", "utc_s").select("session_id", "lag", "r"))


@query(f"WITH {TRACK} SELECT session_id, round(sd_n, 6) AS sd_n, round(row_number() OVER (PARTITION BY session_id ORDER BY sd_n) / CAST(count(*) OVER (PARTITION BY session_id) AS DOUBLE), 6) AS cdf FROM track")
def stats_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.empirical_cdf(track(spark, sf), "sd_n", "session_id"))


@query("""WITH m AS (SELECT l_shipmode_, l_extendedprice AS x, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice FROM lineitem) WINDOW w AS (PARTITION BY l_shipmode_))
SELECT l_shipmode_ AS l_returnflag, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 60), 59) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY 1, 2""")
def stats_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 60, "l_returnflag")


@query(f"""WITH {TRACK}, s AS (SELECT quality, CASE WHEN ns < 6 THEN 'lo' WHEN ns < 10 THEN 'mid' ELSE 'hi' END AS bucket, sd_n - 0.3E0 AS r FROM track),
m AS (SELECT quality, bucket, count(*) AS n, list_sort(list(r))[count(*) // 2 + 1] AS med FROM s GROUP BY 1, 2),
d AS (SELECT s.quality, s.bucket, m.n, list_sort(list(abs(r - med)))[count(*) // 2 + 1] * 1.4826E0 AS mad, sqrt(avg(r * r)) AS rms FROM s JOIN m ON s.quality = m.quality AND s.bucket = m.bucket GROUP BY 1, 2, 3)
SELECT quality, bucket, n, round(greatest(mad, rms, 1E-6), 6) AS sigma_m FROM d WHERE n >= 5""")
def error_model_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Sigma by quality and satellite bucket, by upper medians."""
    rows = track(spark, sf).select("quality", ns_bucket(F.col("ns")).alias("bucket"), (F.col("sd_n") - 0.3).alias("r"))
    return rounded(stats.error_model(rows, ["quality", "bucket"], "r"))


@query(f"""WITH {TRACK} SELECT session_id, count(*) AS n, round(100 * avg(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0 END), 5) AS fix_pct, round(100 * avg(CASE WHEN quality = 5 THEN 1.0E0 ELSE 0 END), 5) AS single_pct,
  round(avg(sqrt((sd_n * sd_n + sd_e * sd_e) / 2)), 6) AS sigma_m, round(1.96E0 * avg(sqrt((sd_n * sd_n + sd_e * sd_e) / 2)), 6) AS ci95_m, round(avg(ns), 5) AS mean_ns, round(avg(sqrt(ve * ve + vn * vn)), 5) AS speed_mps,
  round(max(utc_s) - min(utc_s), 4) AS duration_s, mode(quality) = 1 AS mostly_fix FROM track GROUP BY session_id""")
def report_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Solution shares, sigma and its interval, satellites, speed and duration."""
    sd = F.sqrt((F.col("sd_n") ** 2 + F.col("sd_e") ** 2) / 2)
    share = lambda q: 100 * F.avg((F.col("quality") == q).cast("double"))
    rows = track(spark, sf)
    shares = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(share(1), 5).alias("fix_pct"), F.round(share(5), 5).alias("single_pct"), F.round(F.avg(sd), 6).alias("sigma_m"), F.round(1.96 * F.avg(sd), 6).alias("ci95_m"),
        F.round(F.avg("ns"), 5).alias("mean_ns"), F.round(F.avg(F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2)), 5).alias("speed_mps"), F.round(F.max("utc_s") - F.min("utc_s"), 4).alias("duration_s"),
    )
    most = stats.first_mode(rows, "quality", "session_id", "epoch_ix").select(F.col("session_id").alias("__by"), "mode")
    return shares.join(most, F.col("session_id").eqNullSafe(F.col("__by")), "left").select(*shares.columns, (F.col("mode") == 1).alias("mostly_fix"))


@query(f"""WITH {TRACK} SELECT session_id, quality, CAST(grouping(quality) AS BIGINT) AS all_qualities, count(*) AS n, round(avg(sd_n), 6) AS sd_n, round(quantile_cont(sd_n, 0.95), 8) AS p95 FROM track GROUP BY GROUPING SETS ((session_id, quality), (session_id))""")
def report_by_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Each quality and all together, in one pass."""
    track(spark, sf).createOrReplaceTempView("tracelake_track")
    return spark.sql(
        """SELECT session_id, quality, CAST(grouping(quality) AS BIGINT) AS all_qualities, count(*) AS n, round(avg(sd_n), 6) AS sd_n, round(percentile(sd_n, 0.95), 8) AS p95
        FROM tracelake_track GROUP BY GROUPING SETS ((session_id, quality), (session_id))"""
    )


@query(f"""WITH {TRACK}, {STAT} SELECT session_id, round(utc_s, 3) AS t, round(sqrt(avg(res_p * res_p)), 6) AS rms, count(*) AS n, round(avg(snr), 6) AS snr FROM stat WHERE valid = 1 AND res_p <> 0 GROUP BY session_id, round(utc_s, 3)""")
def sat_residual_rms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(satellites.residual_rms(stat(spark, sf)))


_DOP = f"""{TRACK}, {STAT}, o AS (SELECT session_id, round(utc_s, 3) AS t, cos(radians(el)) * sin(radians(az)) AS e, cos(radians(el)) * cos(radians(az)) AS n, sin(radians(el)) AS u FROM stat WHERE freq = 1)"""


@query(f"""WITH {_DOP}, s AS (SELECT session_id, t, count(*) AS sats, count(DISTINCT round(e, 3)) AS dirs FROM o GROUP BY 1, 2) SELECT session_id, t, sats, sats >= 4 AS solvable, true AS consistent FROM s""")
def sat_dops(spark: SparkSession, sf: str) -> DataFrame:
    """Dilution of precision from the normal matrix; its parts agree with the whole: G2 = P2 + T2, P2 = H2 + V2."""
    d = satellites.dops(stat(spark, sf).where("freq = 1"))
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.abs(a)
    ok = near(F.col("gdop") ** 2, F.col("pdop") ** 2 + F.col("tdop") ** 2) & near(F.col("pdop") ** 2, F.col("hdop") ** 2 + F.col("vdop") ** 2)
    return d.select("session_id", "t", "sats", (F.col("sats") >= 4).alias("solvable"), F.coalesce(ok, F.lit(True)).alias("consistent"))


@query(f"""WITH {TRACK}, {STAT} SELECT session_id, CAST(floor(az / 5) AS BIGINT) AS az_bin, CAST(floor(el / 5) AS BIGINT) AS el_bin, count(*) AS n, CAST(sum(valid) AS BIGINT) AS solved, round(avg(snr), 6) AS snr, count(*) FILTER (abs(res_p) > 1.5) AS multipath FROM stat GROUP BY 1, 2, 3""")
def sat_skyline_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(satellites.sky_grid(stat(spark, sf)))


@query(f"""WITH {TRACK}, {STAT}, g AS (SELECT session_id, CAST(floor(az / 5) AS BIGINT) AS az_bin, min(el) AS lowest FROM stat WHERE valid = 1 GROUP BY 1, 2),
a AS (SELECT s.session_id, b AS az_bin, g.lowest FROM (SELECT DISTINCT session_id FROM g) s, range(0, 72) r(b) LEFT JOIN g ON g.session_id = s.session_id AND g.az_bin = r.b)
SELECT x.session_id, x.az_bin, round(x.lowest, 6) AS lowest, round(avg(y.lowest), 6) AS skyline FROM a x JOIN a y ON x.session_id = y.session_id AND ((y.az_bin - x.az_bin + 73) % 72) <= 2 GROUP BY 1, 2, x.lowest""")
def sat_skyline(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest solved elevation by azimuth, and its circular mean over three bins."""
    return rounded(satellites.skyline(stat(spark, sf)))


@query(f"""WITH {TRACK}, {STAT}, e AS (SELECT session_id, utc_s, avg(snr) AS snr FROM stat GROUP BY 1, 2), m AS (SELECT session_id, avg(snr) AS snr FROM e GROUP BY 1)
SELECT s.session_id, round(median(abs(res_p)), 6) AS median_abs, round(quantile_cont(abs(res_p), 0.95), 6) AS p95_abs, round(any_value(m.snr), 5) AS snr FROM stat s JOIN m USING (session_id) WHERE valid = 1 GROUP BY s.session_id""")
def sat_multipath(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(satellites.multipath(stat(spark, sf)).select("session_id", "median_abs", "p95_abs", F.round("snr", 5).alias("snr")))


_FIT = "SELECT session_id, regr_slope(y_s, x_ns - x0) AS b, avg(x_ns - x0) AS xm, avg(y_s) AS ym FROM {src} GROUP BY session_id"
_ROBUST = f"""{ANCHORS}, r0 AS (SELECT *, min(x_ns) OVER (PARTITION BY session_id) AS x0 FROM anchors)"""
for _k in range(3):
    _ROBUST += f""",
f{_k} AS ({_FIT.format(src=f"r{_k}")}),
q{_k} AS (SELECT r.*, r.y_s - f.ym - f.b * (r.x_ns - r.x0 - f.xm) AS res FROM r{_k} r JOIN f{_k} f USING (session_id)),
m{_k} AS (SELECT *, median(abs(res)) OVER (PARTITION BY session_id) AS mad FROM q{_k}),
k{_k} AS (SELECT *, count(*) FILTER (abs(res) <= 5 * mad) OVER (PARTITION BY session_id) AS nk FROM m{_k}),
r{_k + 1} AS (SELECT session_id, x_ns, y_s, x0 FROM k{_k} WHERE mad <= 0 OR nk < 2 OR abs(res) <= 5 * mad)"""
_ROBUST += f""",
f3 AS ({_FIT.format(src="r3")}),
fit AS (SELECT r.session_id, any_value(f.b) AS b, any_value(f.xm) + any_value(r.x0) AS xmean, any_value(f.ym) AS ymean, count(*) AS n, sqrt(avg(power(r.y_s - f.ym - f.b * (r.x_ns - r.x0 - f.xm), 2))) AS rmse,
  max(abs(r.y_s - f.ym - f.b * (r.x_ns - r.x0 - f.xm))) AS max_abs, sum(power(r.x_ns - r.x0 - f.xm, 2)) AS sxx FROM r3 r JOIN f3 f USING (session_id) GROUP BY r.session_id)"""


@query(f"""WITH {_ROBUST}, n0 AS (SELECT session_id, count(*) AS n0 FROM anchors GROUP BY 1)
SELECT session_id, round((b * 1E9 - 1) * 1E6, 4) AS drift_ppm, n, n0 - n AS n_rejected, round(rmse, 6) AS rmse_s, round(max_abs, 6) AS max_abs_s FROM fit JOIN n0 USING (session_id)""")
def clock_robust_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Line through clock anchors, with three rounds that leave out residuals above five times their median."""
    f = clocks.fit_anchors(anchors(spark, sf))
    return f.select("session_id", F.round((F.col("slope") * 1e9 - 1) * 1e6, 4).alias("drift_ppm"), "n", "n_rejected", F.round("rmse_s", 6).alias("rmse_s"), F.round("max_abs_s", 6).alias("max_abs_s"))


def _sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A recording that two of three sessions have, raw measurements that every second has, and fixes, 0.12 s early."""
    a = anchors(spark, sf)
    return {
        "recording": a.where("session_id % 3 <> 0"),
        "measurements": a.where("session_id % 2 = 0").withColumn("y_s", F.col("y_s") - 0.0001),
        "fixes": a.where("session_id % 9 <> 0").withColumn("y_s", F.col("y_s") - 0.12),
    }


@query(f"""WITH {ANCHORS}, s AS (SELECT session_id, 0 AS place, 'recording' AS source, x_ns, y_s FROM anchors WHERE session_id % 3 <> 0 UNION ALL SELECT session_id, 1, 'measurements', x_ns, y_s - 0.0001E0 FROM anchors WHERE session_id % 2 = 0
  UNION ALL SELECT session_id, 2, 'fixes', x_ns, y_s - 0.12E0 FROM anchors WHERE session_id % 9 <> 0),
f AS (SELECT session_id, place, source, count(*) AS n, (regr_slope(y_s, (x_ns - 0.0E0) / 1E9) - 1) * 1E6 AS ppm, avg(y_s) AS ymean FROM s GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT x_ns) > 1)
SELECT session_id, source, n, round(ppm, 3) + 0.0E0 AS drift_ppm, round(ymean, 4) AS ymean FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY place) = 1""")
def clock_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each session from the best source of anchors that it has, without rounds."""
    f = clocks.fit_with_fallback(_sources(spark, sf), rounds=0)
    return f.select("session_id", "source", "n", (F.round((F.col("slope") * 1e9 - 1) * 1e6, 3) + 0.0).alias("drift_ppm"), F.round("ymean", 4).alias("ymean"))


@query(f"""WITH {_ROBUST} SELECT a.session_id, a.x_ns, round(a.y_s - (ymean + b * (a.x_ns - xmean)), 5) + 0.0E0 AS residual_s,
  round(rmse * sqrt(n / (n - 2.0E0)) * sqrt(1.0E0 / n + power(a.x_ns - xmean, 2) / sxx), 7) AS sigma_s FROM anchors a JOIN fit USING (session_id)""")
def clock_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Residual of every anchor, and the fit's own uncertainty there."""
    a = anchors(spark, sf)
    rows = clocks.residuals(a, clocks.fit_anchors(a))
    return rows.select("session_id", "x_ns", (F.round("residual_s", 5) + 0.0).alias("residual_s"), F.round("sigma_s", 7).alias("sigma_s"))


@query(f"""WITH {ANCHORS}, r AS (SELECT session_id, x_ns, x_ns / 1E9 AS t, (y_s - x_ns / 1E9) AS res FROM anchors)
SELECT session_id, x_ns, round(sqrt(avg(res * res) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING)), 6) AS rmse_s FROM r""")
def clock_rolling_rmse(spark: SparkSession, sf: str) -> DataFrame:
    rows = anchors(spark, sf).withColumns({"t": F.col("x_ns") / 1e9, "res": F.col("y_s") - F.col("x_ns") / 1e9})
    return rounded(rows.select("session_id", "x_ns", F.sqrt(motion.over_range("avg(res * res)", 300.0, t="t")).alias("rmse_s")))


@query(f"""WITH {ANCHORS} SELECT session_id, min_by(y_s, x_ns) AS first_y, min(x_ns) AS first_x, CASE WHEN min(x_ns) >= 100000000000000 THEN 'boottime' ELSE 'video_ns' END AS kind, round(min_by(y_s, x_ns) - min(x_ns) / 1E9, 6) + 0.0E0 AS utc_at_zero FROM anchors GROUP BY session_id""")
def clock_first_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """The first anchor, what its x counts, and the time at x = 0."""
    g = anchors(spark, sf).groupBy("session_id").agg(F.min_by("y_s", "x_ns").alias("first_y"), F.min("x_ns").alias("first_x"))
    return g.select("session_id", "first_y", "first_x", F.when(F.col("first_x") >= 10**14, "boottime").otherwise("video_ns").alias("kind"), (F.round(F.col("first_y") - F.col("first_x") / 1e9, 6) + 0.0).alias("utc_at_zero"))


@query(f"""WITH {TRACK}, m AS (SELECT session_id, avg(sd_n) AS acc, avg(sd_u) AS mp, avg(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0 END) AS fix FROM track GROUP BY 1),
z AS (SELECT *, (acc - min(acc) OVER ()) / (max(acc) OVER () - min(acc) OVER ()) AS za, (mp - min(mp) OVER ()) / (max(mp) OVER () - min(mp) OVER ()) AS zm, (max(fix) OVER () - fix) / (max(fix) OVER () - min(fix) OVER ()) AS zf FROM m),
s AS (SELECT *, 0.7E0 * za + 0.2E0 * zm + 0.1E0 * zf AS score FROM z)
SELECT session_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, session_id) AS place FROM s""")
def rank_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted scores of variants (here: sessions), best first; equal data have equal scores, whatever order their rows came in."""
    m = track(spark, sf).groupBy("session_id").agg(stats.steady_avg("sd_n").alias("acc"), stats.steady_avg("sd_u").alias("mp"), F.avg((F.col("quality") == 1).cast("double")).alias("fix"))
    m = stats.min_max_scores(m, {"za": ("acc", False), "zm": ("mp", False), "zf": ("fix", True)})
    m = m.select("session_id", (0.7 * F.col("za") + 0.2 * F.col("zm") + 0.1 * F.col("zf")).alias("score"))
    return stats.places(m, [F.asc("score"), F.asc("session_id")]).select("session_id", F.round("score", 6).alias("score"), "place")


_LN = "ln(1 - power(2 * p - 1, 2))"
_AA = f"(2 / (3.141592653589793E0 * 0.147E0) + {_LN} / 2)"


@query(f"""WITH {TRACK}, p AS (SELECT session_id, sd_n, (row_number() OVER (PARTITION BY session_id ORDER BY sd_n) - 0.5E0) / count(*) OVER (PARTITION BY session_id) AS p FROM track)
SELECT session_id, round(sd_n, 6) AS sd_n, round(sqrt(2.0E0) * sign(2 * p - 1) * sqrt(greatest(sqrt({_AA} * {_AA} - {_LN} / 0.147E0) - {_AA}, 0)), 5) + 0.0E0 AS z FROM p""")
def stats_normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.normal_scores(track(spark, sf), "sd_n", "session_id")
    return out.select("session_id", F.round("sd_n", 6).alias("sd_n"), (F.round("z", 5) + 0.0).alias("z"))


@query(f"""WITH {TRACK}, c AS (SELECT session_id, sd_n, sd_u, median(sd_n - sd_u) OVER (PARTITION BY session_id) AS off FROM track), r AS (SELECT session_id, abs(sd_n - sd_u - off) AS err, sd_n AS sigma FROM c)
SELECT session_id, count(*) FILTER (err > 0.2 AND 2 * sigma > 0.2) AS tp, count(*) FILTER (err <= 0.2 AND 2 * sigma > 0.2) AS fp, count(*) FILTER (err > 0.2 AND 2 * sigma <= 0.2) AS fn,
  round(count(*) FILTER (err > 0.2 AND 2 * sigma > 0.2) / nullif(count(*) FILTER (err > 0.2), 0), 6) AS catch_rate FROM r GROUP BY session_id""")
def sigma_catch_rate(spark: SparkSession, sf: str) -> DataFrame:
    """How often twice the sigma warned of errors (about the session's median offset) above a bar."""
    off = F.median(F.col("sd_n") - F.col("sd_u")).over(Window.partitionBy("session_id"))
    r = track(spark, sf).select("session_id", F.abs(F.col("sd_n") - F.col("sd_u") - off).alias("err"), F.col("sd_n").alias("sigma"))
    bad, warned = F.col("err") > 0.2, 2 * F.col("sigma") > 0.2
    g = r.groupBy("session_id").agg(F.count_if(bad & warned).alias("tp"), F.count_if(~bad & warned).alias("fp"), F.count_if(bad & ~warned).alias("fn"))
    return rounded(g.withColumn("catch_rate", F.try_divide("tp", F.col("tp") + F.col("fn"))))


@query(f"""WITH {ENU}, f AS (SELECT session_id, e_m, n_m, u_m, k FROM enu), s AS (SELECT session_id, sqrt(power(0.001E0 * (k % 5), 2) + power(0.002E0 * (k % 3), 2)) AS h, 0.001E0 * (k % 5) AS dx, 0.002E0 * (k % 3) AS dy FROM f)
SELECT session_id, count(*) AS n, round(avg(h), 7) AS mean_h, round(median(h), 7) AS median_h, round(quantile_cont(h, 0.9545), 7) AS two_sigma_h, round(max(h), 7) AS max_h, round(sqrt(power(avg(dx), 2) + power(avg(dy), 2)), 7) AS offset_m,
  round(sqrt(var_pop(dx) + var_pop(dy)), 7) AS scatter_m FROM s GROUP BY session_id""")
def frames_delta_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Offset, scatter and empirical two sigma of frame deltas."""
    dx, dy = 0.001 * (F.col("k") % 5), 0.002 * (F.col("k") % 3)
    rows = track(spark, sf).select("session_id", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("h"))
    return rounded(
        rows.groupBy("session_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean_h"), F.median("h").alias("median_h"), F.percentile("h", F.lit(0.9545)).alias("two_sigma_h"), F.max("h").alias("max_h"),
            F.sqrt(F.avg("dx") ** 2 + F.avg("dy") ** 2).alias("offset_m"), F.sqrt(F.var_pop("dx") + F.var_pop("dy")).alias("scatter_m"),
        ), 7)
