"""Signals, places and clocks: trust signals, station specs, camera angles, weighted medians, cubic clocks, inertial gates, places on a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import angles, geo, quality
from tracelake.operators import clocks, gates, inertial, kernels, motion, stats
from tracelake.operators.motion import with_enu
from tracelake.plans import recursions
from tracelake.plans.sequences import _sql_gauss
from tracelake.plans.tracks import ANCHORS, ENU, TRACK, anchors, rounded, sql_ecef, sql_rounded, track
from tracelake.registry import query

KEY = "session_id, epoch_ix"
_BOUNDS = {"eff_sig": (0.1, 4.0), "disagree": (0.0, 5.0), "innovation_h": (0.0, 5.0), "sd_h": (0.0, 1.0), "ratio_inv": (0.0, 10.0)}
_WEIGHTS = {"eff_sig": 2.0, "disagree": 3.0, "q_penalty": 1.0, "ns_penalty": 1.0, "sd_h": 1.0, "slowness": 0.5, "ratio_inv": 0.5}


@query(f"""WITH {ENU}, p AS (SELECT *, avg(e_m) OVER w AS e_s, avg(n_m) OVER w AS n_s FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT *, least(greatest(sqrt(sd_n * sd_n + sd_e * sd_e + 0.01E0), 0.1), 8) AS eff, sqrt(power(e_m - e_s, 2) + power(n_m - n_s, 2)) AS dis, CASE quality WHEN 1 THEN 0.0E0 WHEN 2 THEN 0.3E0 WHEN 4 THEN 0.8E0 ELSE 1.0E0 END AS qp,
  greatest(0, 1 - ns / 20.0E0) AS nsp, sqrt(sd_n * sd_n + sd_e * sd_e) AS sdh, 1 - least(sqrt(vn * vn + ve * ve) / 40, 1) AS slow, 1 / greatest(coalesce(ratio, 0.1), 0.1) AS ri FROM p),
c AS (SELECT *, (2 * least(greatest((eff - 0.1E0) / 3.9E0, 0), 1) + 3 * least(greatest(dis / 5, 0), 1) + qp + nsp + least(sdh, 1) + 0.5E0 * slow + 0.5E0 * least(ri / 10, 1)) / 9 AS score FROM s)
SELECT {KEY}, {sql_rounded('eff, dis, qp, nsp, slow, ri, score')}, CASE WHEN score < 0.5 THEN 'high' ELSE 'low' END AS label FROM c""")
def trust_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of bad epochs, their weighted mean between bounds, and a label."""
    w = Window.partitionBy("session_id").orderBy("utc_s").rowsBetween(-2, 2)
    rows = with_enu(track(spark, sf)).withColumns({"e_s": F.avg("e_m").over(w), "n_s": F.avg("n_m").over(w)})
    disagree = F.sqrt((F.col("e_m") - F.col("e_s")) ** 2 + (F.col("n_m") - F.col("n_s")) ** 2)
    none = F.lit(None).cast("double")
    signals = quality.trust_signals(quality.effective_sigma(quality.sd_h(F.col("sd_n"), F.col("sd_e")), none), disagree, none, none, none)
    rows = rows.select("session_id", "epoch_ix", *[s.alias(n) for n, s in signals.items()])
    score = quality.composite(quality.normalized({n: F.col(n) for n in signals}, _BOUNDS), _WEIGHTS)
    rows = rows.withColumn("score", score).withColumn("label", quality.trust_labels(F.col("score"), F.col("score")))
    names = {"eff_sig": "eff", "disagree": "dis", "q_penalty": "qp", "ns_penalty": "nsp", "slowness": "slow", "ratio_inv": "ri"}
    return rounded(rows.select("session_id", "epoch_ix", *[F.col(a).alias(b) for a, b in names.items()], "score", "label"))


_X, _Y, _Z = sql_ecef("lat_deg", "lon_deg", "h_m")


@query(f"""WITH {TRACK} SELECT {KEY}, CASE WHEN epoch_ix % 5 < 4 THEN round({_X}, 4) + 0.0E0 END AS x, CASE WHEN epoch_ix % 5 < 4 THEN round({_Y}, 4) + 0.0E0 END AS y, CASE WHEN epoch_ix % 5 < 4 THEN round({_Z}, 4) + 0.0E0 END AS z FROM track""")
def geo_base_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Station places written in four ways, and one that is none."""
    x, y, z = geo.llh_to_ecef(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"))
    joined = lambda *c: F.concat_ws(", ", *[v.cast("string") for v in c])
    llh = joined(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"))
    way = F.col("epoch_ix") % 5
    text = F.when(way == 0, F.concat(F.lit("ECEF:"), joined(x, y, z))).when(way == 1, F.concat(F.lit("llh:"), llh)).when(way == 2, llh).when(way == 3, joined(x, y, z)).otherwise(F.concat(F.lit("rinex:"), llh, F.lit(",nan")))
    rows = track(spark, sf).select("session_id", "epoch_ix", geo.base_spec(text).alias("p"))
    return rounded(rows.select("session_id", "epoch_ix", "p.x", "p.y", "p.z"), 4)


@query(f"""WITH {TRACK}, a AS (SELECT *, radians(k * 3.0E0) AS h, radians(k - 20.0E0) AS r, radians(k - 30.0E0) AS mp FROM track)
SELECT {KEY}, round((degrees(h) * -1 + 3600) % 360, 5) + 0.0E0 AS yaw, 0.0E0 AS pitch, round(degrees(atan2(sin(r), cos(r))), 5) + 0.0E0 AS roll,
  CASE WHEN abs(sin(mp)) >= abs(cos(mp)) THEN CASE WHEN -sin(mp) < 0 THEN '-x' ELSE '+x' END ELSE CASE WHEN cos(mp) < 0 THEN '-z' ELSE '+z' END END AS up FROM a""")
def angle_camera(spark: SparkSession, sf: str) -> DataFrame:
    """A camera that looks north along the body, turned about the vertical and then rolled about its view; and the axis that points up in a pitched mounting."""
    h, r = F.radians(F.col("k") * 3.0) / 2, F.radians(F.col("k") - 20.0) / 2
    zero, one = F.lit(0.0), F.lit(1.0)
    turned = angles.qmul(angles.q(F.cos(h), zero, zero, F.sin(h)), angles.q(F.cos(r), zero, F.sin(r), zero))
    rows = track(spark, sf).withColumn("q", turned)
    yaw, pitch, roll = angles.camera_ypr(F.col("q"), (zero, one, zero), (zero, zero, one))
    up = angles.mount_up(F.col("k") - 30.0, F.lit(0.0))
    name = F.when(up[0] != 0, F.when(up[0] < 0, "-x").otherwise("+x")).otherwise(F.when(up[2] < 0, "-z").otherwise("+z"))
    rows = rows.select("session_id", "epoch_ix", yaw.alias("yaw"), pitch.alias("pitch"), roll.alias("roll"), name.alias("up"))
    return rounded(rows.withColumn("yaw", F.pmod(F.round("yaw", 5), F.lit(360.0))).withColumn("pitch", F.round("pitch", 5)), 5)


@query(f"""WITH {TRACK}, w AS (SELECT session_id, h_m AS v, CASE quality WHEN 1 THEN 1.0E0 WHEN 2 THEN 0.5E0 WHEN 4 THEN 0.25E0 ELSE 0.125E0 END AS w FROM track),
a AS (SELECT session_id, v, sum(w) OVER (PARTITION BY session_id) AS whole, sum(w) OVER (PARTITION BY session_id ORDER BY v) AS so_far FROM w)
SELECT session_id, round(min(v) FILTER (so_far >= whole / 2), 6) + 0.0E0 AS value FROM a GROUP BY 1""")
def stats_weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    """Heights at half of all weight, better solutions counting more."""
    weight = quality.by_quality(F.col("quality"), {1: 1.0, 2: 0.5, 4: 0.25}, 0.125)
    return rounded(stats.weighted_median(track(spark, sf), "h_m", weight))


_NEXT = """p{k} AS (SELECT *, (x - sum(x * q{j} * q{j}) OVER w / sum(q{j} * q{j}) OVER w) * q{j} - sum(q{j} * q{j}) OVER w / sum(q{i} * q{i}) OVER w * q{i} AS q{k} FROM r{j} WINDOW w AS (PARTITION BY session_id)),
r{k} AS (SELECT * EXCLUDE (r), r - coalesce(sum(r * q{k}) OVER w / nullif(sum(q{k} * q{k}) OVER w, 0), 0) * q{k} AS r FROM p{k} WINDOW w AS (PARTITION BY session_id))"""


@query(f"""WITH {ANCHORS}, x AS (SELECT session_id, (x_ns - min(x_ns) OVER w) * 1.0E0 AS x, y_s FROM anchors WINDOW w AS (PARTITION BY session_id)),
r0 AS (SELECT session_id, (x - avg(x) OVER w) / max(x) OVER w AS x, y_s - avg(y_s) OVER w AS r, 1.0E0 AS q0 FROM x WINDOW w AS (PARTITION BY session_id)),
p1 AS (SELECT *, x - avg(x) OVER (PARTITION BY session_id) AS q1 FROM r0), r1 AS (SELECT * EXCLUDE (r), r - coalesce(sum(r * q1) OVER w / nullif(sum(q1 * q1) OVER w, 0), 0) * q1 AS r FROM p1 WINDOW w AS (PARTITION BY session_id)),
l AS (SELECT *, r AS lin FROM r1), {_NEXT.format(k=2, j=1, i=0).replace("FROM r1", "FROM l")}, {_NEXT.format(k=3, j=2, i=1)}
SELECT session_id, count(*) AS n, round(sqrt(avg(lin * lin)), 5) AS linear_rmse_s, CASE WHEN count(*) >= 5 THEN round(sqrt(avg(r * r)), 5) END AS cubic_rmse_s FROM r3 GROUP BY 1""")
def clock_cubic_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a clock drifts along a curve: residuals of a line and of a cubic."""
    return rounded(clocks.cubic_gain(anchors(spark, sf)), 5)


_VEL = """v AS (SELECT *, ve + CASE WHEN k = 17 THEN 4.0E0 ELSE 0 END AS g_e, vn AS g_n, CASE WHEN k % 3 = 0 THEN 0.5E0 ELSE 0.05E0 END AS sd_v FROM track),
imu AS (SELECT session_id, utc_s + j * 0.05E0 AS utc_s, 0.01E0 * ((k + j) % 5 - 2) AS a_e, 0.02E0 * ((k + j) % 3 - 1) AS a_n FROM track, range(17) AS r(j)),
line AS (SELECT session_id, utc_s, 1 AS ep, NULL AS a_e, NULL AS a_n FROM v UNION ALL SELECT session_id, utc_s, 0, a_e, a_n FROM imu),
placed AS (SELECT *, sum(ep) OVER (PARTITION BY session_id ORDER BY utc_s, ep DESC ROWS UNBOUNDED PRECEDING) AS place FROM line),
stepped AS (SELECT *, lead(utc_s) OVER (PARTITION BY session_id, place ORDER BY utc_s) - utc_s AS dt FROM placed WHERE ep = 0),
sums AS (SELECT session_id, place + 1 AS place, count(*) AS n, sum(CASE WHEN dt > 0 AND dt <= 0.1 THEN a_e * dt ELSE 0 END) AS ie, sum(CASE WHEN dt > 0 AND dt <= 0.1 THEN a_n * dt ELSE 0 END) AS inn FROM stepped WHERE place >= 1 GROUP BY ALL),
d AS (SELECT v.session_id, v.epoch_ix, coalesce(s.n, 0) AS n, sd_v * sqrt(2.0E0) < 0.1 AND coalesce(s.n, 0) > 10 AS sure,
  coalesce(g_e - lag(g_e) OVER w, 0) - CASE WHEN s.n >= 2 THEN ie ELSE 0 END AS de, coalesce(g_n - lag(g_n) OVER w, 0) - CASE WHEN s.n >= 2 THEN inn ELSE 0 END AS dn
  FROM v LEFT JOIN sums s ON s.session_id = v.session_id AND s.place = v.epoch_ix + 1 WINDOW w AS (PARTITION BY v.session_id ORDER BY v.utc_s)),
f AS (SELECT *, median(CASE WHEN sure THEN de END) OVER w AS be, median(CASE WHEN sure THEN dn END) OVER w AS bn, stddev_pop(CASE WHEN sure THEN de END) OVER w AS se, stddev_pop(CASE WHEN sure THEN dn END) OVER w AS sn, count(*) FILTER (sure) OVER w AS c FROM d WINDOW w AS (PARTITION BY session_id)),
j AS (SELECT *, coalesce(c >= 10 AND se >= 1E-6 AND sn >= 1E-6 AND n >= 5, false) AS judged, abs(de - be) / se AS oe, abs(dn - bn) / sn AS onn FROM f)"""


@query(f"""WITH {TRACK}, {_VEL} SELECT {KEY}, CASE WHEN judged THEN round(sqrt(oe * oe + onn * onn), 4) + 0.0E0 ELSE 0.0E0 END AS imu_score, judged AND (oe > 3 OR onn > 3) AS imu_reject FROM j""")
def gate_inertial_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of Doppler velocity that inertial samples between the epochs don't explain."""
    t = track(spark, sf)
    sd = F.when(F.col("k") % 3 == 0, 0.5).otherwise(0.05)
    vel = t.select("session_id", "epoch_ix", "utc_s", (F.col("ve") + F.when(F.col("k") == 17, 4.0).otherwise(0.0)).alias("ve"), "vn", sd.alias("sd_ve"), sd.alias("sd_vn"))
    j = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("j")
    imu = t.select("session_id", "utc_s", "k", j).select("session_id", (F.col("utc_s") + F.col("j") * 0.05).alias("utc_s"), (0.01 * ((F.col("k") + F.col("j")) % 5 - 2)).alias("a_e"), (0.02 * ((F.col("k") + F.col("j")) % 3 - 1)).alias("a_n"))
    return rounded(gates.inertial_velocity(vel, imu, least=10).select("session_id", "epoch_ix", "imu_score", "imu_reject"), 4)


@query(f"""WITH RECURSIVE {ENU}, n AS MATERIALIZED (SELECT session_id, epoch_ix AS ix, utc_s AS t, e_m AS e, n_m AS n, u_m AS u, coalesce(ve, 0) AS ve, coalesce(vn, 0) AS vn, coalesce(vu, 0) AS vu,
  lead(utc_s) OVER w - utc_s AS dt, lead(e_m) OVER w AS e2, lead(n_m) OVER w AS n2, lead(u_m) OVER w AS u2, lead(coalesce(ve, 0)) OVER w AS ve2, lead(coalesce(vn, 0)) OVER w AS vn2, lead(coalesce(vu, 0)) OVER w AS vu2 FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
k AS (SELECT session_id, ix, false AS jump, t AS kt, e AS ke, n AS kn, u AS ku, ve AS kve, vn AS kvn, vu AS kvu FROM n WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, now, CASE WHEN now THEN kt ELSE t END, CASE WHEN now THEN ke ELSE e END, CASE WHEN now THEN kn ELSE n END, CASE WHEN now THEN ku ELSE u END, CASE WHEN now THEN kve ELSE ve END, CASE WHEN now THEN kvn ELSE vn END, CASE WHEN now THEN kvu ELSE vu END
  FROM (SELECT n.*, k.kt, k.ke, k.kn, k.ku, k.kve, k.kvn, k.kvu, coalesce(sqrt(power(n.e - k.ke - k.kve * (n.t - k.kt), 2) + power(n.n - k.kn - k.kvn * (n.t - k.kt), 2) + power(n.u - k.ku - k.kvu * (n.t - k.kt), 2)) >= 20
    AND sqrt(power(n.e - n.e2 + n.ve2 * n.dt, 2) + power(n.n - n.n2 + n.vn2 * n.dt, 2) + power(n.u - n.u2 + n.vu2 * n.dt, 2)) >= 20, false) AS now
    FROM k JOIN n ON n.session_id = k.session_id AND n.ix = k.ix + 1))
SELECT session_id, ix AS epoch_ix, jump FROM k""")
def kernel_extrapolated_jumps(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs that neither the last kept epoch nor the next one leads to."""
    rows = with_enu(track(spark, sf)).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu")
    return kernels.per_session(rows, lambda r: kernels.extrapolated_jumps(r, 20.0), {"jump": T.BooleanType()}).select("session_id", "epoch_ix", "jump")


@query(f"""WITH RECURSIVE {TRACK}, n AS MATERIALIZED (SELECT session_id, epoch_ix AS ix, sd_n AS x FROM track),
f AS (SELECT session_id, ix, x AS y FROM n WHERE ix = 0 UNION ALL SELECT n.session_id, n.ix, f.y + 0.02E0 * (n.x - f.y) FROM f JOIN n ON n.session_id = f.session_id AND n.ix = f.ix + 1)
SELECT session_id, ix AS epoch_ix, round(y, 6) + 0.0E0 AS low FROM f""")
def kernel_lowpass(spark: SparkSession, sf: str) -> DataFrame:
    rows = track(spark, sf).select("session_id", "epoch_ix", "utc_s", "sd_n")
    return rounded(kernels.per_session(rows, lambda r: {"low": kernels.lowpass(r["sd_n"].to_numpy(float))}, {"low": T.DoubleType()}).select("session_id", "epoch_ix", "low"))


@query(f"""WITH {ENU}, s AS (SELECT *, lag(e_m) OVER w AS e0, lag(n_m) OVER w AS n0, lag(utc_s) OVER w AS t0, lead(e_m) OVER w AS e1, lead(n_m) OVER w AS n1, lead(utc_s) OVER w AS t1 FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
f AS (SELECT session_id, epoch_ix AS frame, e_m + 3.0E0 + (k % 4) AS fe, n_m + 2.0E0 + CASE WHEN k % 11 = 0 THEN 400 ELSE 0 END AS fn FROM enu),
best AS (SELECT f.frame, f.fe, f.fn, s.*, power(s.e_m - f.fe, 2) + power(s.n_m - f.fn, 2) AS d2 FROM f JOIN s ON s.session_id = f.session_id QUALIFY row_number() OVER (PARTITION BY f.session_id, f.frame ORDER BY d2, s.utc_s) = 1),
u AS (SELECT *, greatest(0, least(1, ((fe - e0) * (e_m - e0) + (fn - n0) * (n_m - n0)) / nullif(power(e_m - e0, 2) + power(n_m - n0, 2), 0))) AS u0, greatest(0, least(1, ((fe - e_m) * (e1 - e_m) + (fn - n_m) * (n1 - n_m)) / nullif(power(e1 - e_m, 2) + power(n1 - n_m, 2), 0))) AS u1 FROM best),
d AS (SELECT *, sqrt(d2) AS d, CASE WHEN e0 IS NULL THEN 1E300 ELSE sqrt(power(fe - e0 - u0 * (e_m - e0), 2) + power(fn - n0 - u0 * (n_m - n0), 2)) END AS da, CASE WHEN e1 IS NULL THEN 1E300 ELSE sqrt(power(fe - e_m - u1 * (e1 - e_m), 2) + power(fn - n_m - u1 * (n1 - n_m), 2)) END AS db FROM u)
SELECT session_id, frame, round(CASE WHEN da < d AND da <= db THEN t0 + u0 * (utc_s - t0) WHEN db < d THEN utc_s + u1 * (t1 - utc_s) ELSE utc_s END, 1) AS utc_s, round(least(d, da, db), 4) + 0.0E0 AS off_m FROM d WHERE least(d, da, db) <= 25""")
def join_places_on_track(spark: SparkSession, sf: str) -> DataFrame:
    """When a track was nearest to each frame's place; far frames have no time."""
    enu = with_enu(track(spark, sf))
    frames = enu.select("session_id", F.col("epoch_ix").alias("frame"), (F.col("e_m") + 3.0 + F.col("k") % 4).alias("fe_m"), (F.col("n_m") + 2.0 + F.when(F.col("k") % 11 == 0, 400).otherwise(0)).alias("fn_m"))
    found = motion.places_on_track(frames, enu.select("session_id", "utc_s", "e_m", "n_m"))
    return rounded(found.withColumn("utc_s", F.round("utc_s", 1)), 4)


@query(f"""WITH {TRACK}, e AS (SELECT session_id, quantile_cont(sd_n, 0.9545) AS a1, quantile_cont(sd_e, 0.9545) AS b1, quantile_cont(sd_u, 0.9545) AS a2, quantile_cont(ratio, 0.9545) AS b2 FROM track GROUP BY 1)
SELECT session_id, CASE WHEN a1 IS NULL OR b1 IS NULL THEN 'n/a' WHEN a1 < b1 THEN 'camera' WHEN b1 < a1 THEN 'gps' ELSE 'tie' END AS horizontal, CASE WHEN a2 IS NULL OR b2 IS NULL THEN 'n/a' WHEN a2 < b2 THEN 'camera' WHEN b2 < a2 THEN 'gps' ELSE 'tie' END AS speed FROM e""")
def compare_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Which of two sources has the smaller two-sigma error in each metric."""
    two = lambda c: F.percentile(c, F.lit(0.9545))
    g = track(spark, sf).groupBy("session_id").agg(two("sd_n").alias("a1"), two("sd_e").alias("b1"), two("sd_u").alias("a2"), two("ratio").alias("b2"))
    names = ("camera", "gps")
    return g.select("session_id", stats.winner(F.col("a1"), F.col("b1"), names).alias("horizontal"), stats.winner(F.col("a2"), F.col("b2"), names).alias("speed"))


@query(f"""WITH {TRACK}, s AS (SELECT DISTINCT session_id FROM track), c AS (SELECT session_id, min(k) AS t0 FROM track WHERE provider = 'error' AND quality = 5 GROUP BY 1), m AS (SELECT DISTINCT session_id, 1000 + session_id AS t0 FROM track WHERE provider = 'purchase' AND quality = 4), f AS (SELECT session_id, min(epoch_ix + 5000) AS t0 FROM track WHERE quality = 1 GROUP BY 1)
SELECT s.session_id, coalesce(c.t0, m.t0, f.t0) AS t0_ns FROM s LEFT JOIN c USING (session_id) LEFT JOIN m USING (session_id) LEFT JOIN f USING (session_id)""")
def clock_video_zero(spark: SparkSession, sf: str) -> DataFrame:
    """The first sample of a video by clip, manifest or frames, in that order."""
    t = track(spark, sf)
    clips = t.where("provider = 'error' AND quality = 5").select("session_id", F.col("k").alias("boot_ns"))
    manifests = t.where("provider = 'purchase' AND quality = 4").select("session_id", (F.lit(1000) + F.col("session_id")).alias("video_t0_boottime_ns")).distinct()
    frames = t.where("quality = 1").select("session_id", (F.col("epoch_ix") + 5000).alias("boot_ns"))
    return clocks.video_zero(t, clips, manifests, frames)


@query(f"""WITH {ENU}, {_sql_gauss("e_m", 2.0, "enu")}, {_sql_gauss("n_m", 2.0, "enu").replace("g_", "h_")},
p AS (SELECT enu.*, g_s.s AS es, h_s.s AS ns_ FROM enu JOIN g_s USING (session_id, epoch_ix) JOIN h_s USING (session_id, epoch_ix)),
c AS (SELECT *, coalesce(lead(es) OVER w, last_value(es) OVER a) - coalesce(lag(es) OVER w, first_value(es) OVER a) AS de, coalesce(lead(ns_) OVER w, last_value(ns_) OVER a) - coalesce(lag(ns_) OVER w, first_value(ns_) OVER a) AS dn
  FROM p WINDOW w AS (PARTITION BY session_id ORDER BY utc_s), a AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, CASE WHEN sqrt(vn * vn + ve * ve) >= 2 THEN ((e_m - es) * dn - (n_m - ns_) * de) / sqrt(de * de + dn * dn) END AS side FROM c)
SELECT {KEY}, round(side, 4) + 0.0E0 AS side_m, round(CASE WHEN side IS NULL THEN 1 ELSE exp(-side * side / 2) END, 4) + 0.0E0 AS side_weight FROM l""")
def motion_sideways_weight(spark: SparkSession, sf: str) -> DataFrame:
    """How far epochs lie beside their smoothed path."""
    rows = motion.sideways_weight(with_enu(track(spark, sf)), 1.0, 2.0, 2.0)
    return rounded(rows.select("session_id", "epoch_ix", "side_m", "side_weight"), 4)


@query(recursions.POSITION_FILTER.format(enu=ENU))
def kernel_position_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Accelerations between the epochs drive the filter, epochs correct it."""
    enu = with_enu(track(spark, sf))
    j = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")
    imu = enu.select("session_id", "utc_s", "k", j).select("session_id", (F.col("utc_s") + 0.1 + 0.2 * F.col("j")).alias("utc_s"), (0.1 * ((F.col("k") + F.col("j")) % 5 - 2)).alias("a_e"), F.lit(0.0).alias("a_n"), F.lit(0.0).alias("a_u"))
    rows = inertial.position_filter(enu, imu).where("epoch = 1")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("utc_s")) - 1
    return rounded(rows.select("session_id", place.cast("long").alias("epoch_ix"), "e_s", "ve_s"), 4)


@query()
def kernel_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Noise of inertial axes within standing periods: epochs 5 to 9 of every twenty."""
    t = track(spark, sf)
    slow = F.col("epoch_ix") % 20
    still = t.withColumns({c: F.when(slow.between(5, 9), 0.0).otherwise(F.col(c)) for c in ("ve", "vn")})
    j = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")
    sample = (F.col("k") * 7 + F.col("j") * 13) % 11 / 100.0
    imu = t.select("session_id", "utc_s", "k", j).select("session_id", (F.col("utc_s") + F.col("j") / 12.0).alias("utc_s"), *[(sample + n).alias(c) for n, c in enumerate(("ax", "ay", "az"))], *[(sample / (n + 2)).alias(c) for n, c in enumerate(("gx", "gy", "gz"))])
    return rounded(inertial.calibrate(imu, still), 6)


@query(f"""WITH {ENU}, g AS (SELECT session_id, count(*) AS n, avg(e_m) AS mx, avg(n_m) AS my, var_samp(e_m) AS a, covar_samp(e_m, n_m) AS b2, var_samp(n_m) AS c FROM enu GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT *, sqrt(greatest((a + c) / 2 + sqrt(power((a - c) / 2, 2) + b2 * b2), 0)) AS big, sqrt(greatest((a + c) / 2 - sqrt(power((a - c) / 2, 2) + b2 * b2), 0)) AS small, atan2(2 * b2, a - c) / 2 AS turn FROM g),
p AS (SELECT *, 2 * pi() * i / 8 AS at_ FROM h, range(9) AS r(i))
SELECT session_id, CAST(i AS INT) AS i, round(mx + 2 * big * cos(at_) * cos(turn) - 2 * small * sin(at_) * sin(turn), 2) + 0.0E0 AS x, round(my + 2 * big * cos(at_) * sin(turn) + 2 * small * sin(at_) * cos(turn), 2) + 0.0E0 AS y FROM p""")
def stats_ellipse_points(spark: SparkSession, sf: str) -> DataFrame:
    """The two-sigma ellipse of a session's places as points."""
    return rounded(stats.ellipse_points(with_enu(track(spark, sf)), "e_m", "n_m", 2.0, points=9), 2)


@query(f"""WITH {TRACK}, imu AS (SELECT session_id, utc_s + j * 0.04E0 AS t, epoch_ix, 0.1E0 + ((k + j) % 5) / 50.0E0 AS ax, 0.02E0 * j AS ay, 9.9E0 AS az, 0.05E0 AS gx, 0.01E0 * (k % 3) AS gy FROM track, range(10) AS r(j)),
p AS (SELECT session_id, epoch_ix // 20 AS no, min(utc_s) AS start_s, max(utc_s) AS end_s FROM track WHERE epoch_ix % 20 BETWEEN 5 AND 9 GROUP BY ALL),
s AS (SELECT i.*, p.start_s, row_number() OVER w AS rn, count(*) OVER (PARTITION BY i.session_id, p.start_s) AS n FROM imu i JOIN p ON i.session_id = p.session_id AND i.t >= p.start_s AND i.t < p.end_s WINDOW w AS (PARTITION BY i.session_id, p.start_s ORDER BY i.t)),
m AS (SELECT session_id, start_s, avg(ax) - max(gx) FILTER (rn = n // 2 + 1) AS x, avg(ay) - max(gy) FILTER (rn = n // 2 + 1) AS y, avg(az) - 9.80665E0 AS z FROM s WHERE n >= 20 GROUP BY 1, 2)
SELECT session_id, round(greatest(-0.1E0, least(0.1E0, arg_min(x, start_s))), 6) + 0.0E0 AS bias_x, round(greatest(-0.1E0, least(0.1E0, arg_min(y, start_s))), 6) + 0.0E0 AS bias_y, round(greatest(-0.1E0, least(0.1E0, arg_min(z, start_s))), 6) + 0.0E0 AS bias_z FROM m GROUP BY 1""")
def interval_static_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Bias of an accelerometer from the first standing period of each session."""
    t = track(spark, sf)
    j = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")
    k, n = F.col("k"), F.col("j")
    imu = t.select("session_id", "utc_s", "k", j).select("session_id", (F.col("utc_s") + n * 0.04).alias("utc_s"), (0.1 + (k + n) % 5 / 50.0).alias("ax"), (0.02 * n).alias("ay"), F.lit(9.9).alias("az"), F.lit(0.05).alias("gx_m"), (0.01 * (k % 3)).alias("gy_m"), F.lit(9.80665).alias("gz_m"))
    periods = t.where("epoch_ix % 20 BETWEEN 5 AND 9").groupBy("session_id", F.floor(F.col("epoch_ix") / 20).alias("no")).agg(F.min("utc_s").alias("start_s"), F.max("utc_s").alias("end_s")).drop("no")
    return rounded(inertial.static_bias(imu, periods, clip=0.1))


@query(f"""WITH {TRACK} SELECT {KEY}, CASE WHEN quality = 1 THEN 0.25E0 WHEN quality = 2 THEN 1.0E0 WHEN quality = 4 THEN 4.0E0 WHEN quality = 5 THEN 9.0E0 END AS scale, round(greatest(0.05E0, least(0.1E0, sd_n)), 6) AS sigma,
  CASE WHEN k % 7 = 0 THEN 'failed rc=' || (k % 7 + 2) || ': ' || provider WHEN k % 3 = 0 THEN 'no output rc=0: ' || provider END AS status, array_to_string(list_transform(range(9), lambda i: CASE WHEN k % 2 = 0 THEN CAST(30 + k % 5 AS VARCHAR) ELSE CAST(30 + k % 5 AS VARCHAR) || '.5' END), ',') AS mask FROM track""")
def quality_run_options(spark: SparkSession, sf: str) -> DataFrame:
    """Variance factors, bounded sigmas, a run's status and the text of a mask."""
    k = F.col("k")
    code = F.when(k % 7 == 0, 2).otherwise(0)
    size = F.when(k % 3 != 0, 10)
    threshold = 30.0 + k % 5 + F.when(k % 2 == 0, 0.0).otherwise(0.5)
    rows = track(spark, sf).select("session_id", "epoch_ix", quality.noise_scale(F.col("quality")).alias("scale"), quality.bounded_sigma(F.col("sd_n"), 0.05, 0.1).alias("sigma"), quality.run_status(code, size, F.col("provider")).alias("status"), quality.mask_text(threshold).alias("mask"))
    return rounded(rows)
