"""Attitude by gyros, gravity and Doppler, angles of frames and video velocity over the event tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import attitude, islands, motion, video
from tracelake.operators.motion import with_enu
from tracelake.plans.alignment import _SUMS as CAMERA
from tracelake.plans.alignment import directions
from tracelake.plans.georeference import attitudes, epochs, frames
from tracelake.plans.tracks import ENU, TRACK, rounded, track
from tracelake.registry import query

KEY = "session_id, epoch_ix"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Ten samples from each epoch on, 0.1 s apart, of a body that lies askew and turns slowly."""
    t = track(spark, sf).select("session_id", "epoch_ix", "utc_s", "k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    k, j = F.col("k"), F.col("j")
    return t.select(
        "session_id", "epoch_ix", "j", (F.col("utc_s") + j / 10.0).alias("utc_s"), (((k + j) % 7 - 3) / 20.0 + 0.8).alias("ax"), (((k * j) % 5 - 2) / 20.0 - 0.5).alias("ay"), (9.75 + (k % 3) / 50.0).alias("az"),
        ((k % 5 - 2) / 200.0).alias("gx"), ((j % 3 - 1) / 200.0).alias("gy"), F.lit(0.01).alias("gz"),
    )


_STOPS = f"""{TRACK}, o AS (SELECT session_id, epoch_ix, utc_s, k, coalesce(sqrt(ve * ve + vn * vn) < 0.4, false) AS slow, ve, vn FROM (SELECT * REPLACE (CASE WHEN epoch_ix % 20 >= 10 THEN 0.1E0 ELSE ve END AS ve, CASE WHEN epoch_ix % 20 >= 10 THEN 0 ELSE vn END AS vn) FROM track)),
c AS (SELECT *, CASE WHEN slow AND NOT coalesce(lag(slow) OVER w, false) THEN 1 ELSE 0 END AS new, coalesce(lead(utc_s) OVER w, utc_s) AS nxt FROM o WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY utc_s) AS no FROM c),
stops AS (SELECT session_id, min(utc_s) AS start_s, max(nxt) AS end_s FROM r WHERE slow GROUP BY session_id, no HAVING max(nxt) - min(utc_s) >= 1.5),
imu AS (SELECT session_id, epoch_ix, j, utc_s + j / 10.0E0 AS utc_s, ((k + j) % 7 - 3) / 20.0E0 + 0.8E0 AS ax, ((k * j) % 5 - 2) / 20.0E0 - 0.5E0 AS ay, 9.75E0 + (k % 3) / 50.0E0 AS az, (k % 5 - 2) / 200.0E0 AS gx, (j % 3 - 1) / 200.0E0 AS gy, 0.01E0 AS gz FROM track, range(10) r(j)),
g AS (SELECT s.session_id, start_s, end_s, count(*) AS n, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM stops s JOIN imu i ON i.session_id = s.session_id AND i.utc_s >= start_s AND i.utc_s < end_s GROUP BY ALL HAVING count(*) >= 20),
gravity AS (SELECT session_id, start_s, end_s, n, degrees(-atan2(x, sqrt(y * y + z * z))) AS pitch_deg, degrees(atan2(y, z)) AS roll_deg FROM g WHERE sqrt(x * x + y * y + z * z) >= 5)"""


def _gravity(spark: SparkSession, sf: str) -> DataFrame:
    return attitude.stop_gravity(samples(spark, sf), islands.static_periods(epochs(track(spark, sf))))


@query(f"WITH {_STOPS} SELECT session_id, round(start_s - 1704067200, 4) AS start_s, round(end_s - 1704067200, 4) AS end_s, n, round(pitch_deg, 5) AS pitch_deg, round(roll_deg, 5) AS roll_deg FROM gravity")
def attitude_stop_gravity(spark: SparkSession, sf: str) -> DataFrame:
    """Pitch and roll from the mean force of each stop."""
    got = _gravity(spark, sf)
    at = {c: (F.col(c) - 1704067200).alias(c) for c in ("start_s", "end_s")}
    return got.select("session_id", *[F.round(c, 4).alias(n) for n, c in at.items()], "n", *[F.round(c, 5).alias(c) for c in ("pitch_deg", "roll_deg")])


_NEAR = lambda c: f"sum(b.{c} * exp(-0.5E0 * power((b.utc_s - a.utc_s) / 0.5E0, 2))) / sum(CASE WHEN b.{c} IS NOT NULL THEN exp(-0.5E0 * power((b.utc_s - a.utc_s) / 0.5E0, 2)) END)"
_MOD = lambda x: f"({x}) - 360 * floor(({x}) / 360)"


@query(f"""WITH {_STOPS}, a0 AS (SELECT session_id, utc_s + 0.21E0 AS utc_s, (k * 47) % 360 AS yaw, k % 21 - 10.0E0 AS pitch, (k * 31) % 360 - 180.0E0 AS roll FROM track WHERE k % 3 <> 0),
a1 AS (SELECT *, floor((utc_s - first_value(utc_s) OVER w) * 0.8E0) AS slot FROM a0 WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
a2 AS (SELECT * FROM (SELECT *, lag(slot) OVER (PARTITION BY session_id ORDER BY utc_s) AS ls FROM a1) WHERE ls IS DISTINCT FROM slot),
a3 AS (SELECT session_id, utc_s, pitch, sin(radians(yaw)) AS sy, cos(radians(yaw)) AS cy, sin(radians(roll)) AS sr, cos(radians(roll)) AS cr FROM a2),
a4 AS (SELECT a.session_id, a.utc_s, {", ".join(f"{_NEAR(c)} AS {c}" for c in ("pitch", "sy", "cy", "sr", "cr"))} FROM a3 a JOIN a3 b ON a.session_id = b.session_id AND b.utc_s BETWEEN a.utc_s - 2 AND a.utc_s + 2 GROUP BY 1, 2),
a5 AS (SELECT session_id, utc_s, pitch, {_MOD("degrees(atan2(sy, cy))")} AS yaw, {_MOD("degrees(atan2(sr, cr))")} AS roll FROM a4),
q AS (SELECT session_id, epoch_ix AS frame_id, utc_s + 0.37E0 AS utc_s FROM track),
j AS (SELECT q.*, CASE WHEN h.utc_s = q.utc_s THEN 1 WHEN h.utc_s - l.utc_s <= 2 THEN (q.utc_s - l.utc_s) / (h.utc_s - l.utc_s) END AS f, l.pitch AS lp, h.pitch AS hp, l.yaw AS ly, {_MOD("h.yaw - l.yaw + 540")} - 180 AS dy, l.roll AS lr, {_MOD("h.roll - l.roll + 540")} - 180 AS dr
  FROM q ASOF LEFT JOIN a5 l ON q.session_id = l.session_id AND q.utc_s > l.utc_s ASOF LEFT JOIN a5 h ON q.session_id = h.session_id AND q.utc_s <= h.utc_s),
v AS (SELECT session_id, frame_id, utc_s, lp + (hp - lp) * f AS p, {_MOD("ly + dy * f")} AS y, {_MOD("lr + dr * f + 180")} - 180 AS r FROM j),
s AS (SELECT v.*, coalesce(v.utc_s <= g.end_s, false) AS still, pitch_deg, roll_deg FROM v ASOF LEFT JOIN gravity g ON v.session_id = g.session_id AND v.utc_s >= g.start_s)
SELECT session_id, frame_id, CASE WHEN still THEN 'gravity' WHEN p IS NOT NULL THEN 'orientation' END AS tilt_source, round(y, 3) + 0.0E0 AS yaw_deg, round(CASE WHEN still THEN pitch_deg ELSE p END, 4) + 0.0E0 AS pitch_deg, round(CASE WHEN still THEN roll_deg ELSE r END, 3) + 0.0E0 AS roll_deg FROM s""")
def attitude_frame_tilts(spark: SparkSession, sf: str) -> DataFrame:
    """Device angles thinned, smoothed and read at the frames; gravity's in stops."""
    t = track(spark, sf)
    got = attitude.frame_tilts(frames(t), attitudes(t), _gravity(spark, sf), hz=0.8)
    return got.select("session_id", "frame_id", "tilt_source", (F.round("att_yaw", 3) + 0.0).alias("yaw_deg"), (F.round("att_pitch", 4) + 0.0).alias("pitch_deg"), (F.round("att_roll", 3) + 0.0).alias("roll_deg"))


@query(f"""WITH {ENU}, m AS (SELECT *, CASE WHEN epoch_ix % 20 >= 10 THEN 0.1E0 ELSE ve END AS e, CASE WHEN epoch_ix % 20 >= 10 THEN 0 ELSE vn END AS n FROM enu),
w AS (SELECT m.*, first_value(e_m) OVER w AS ae, first_value(n_m) OVER w AS an, last_value(e_m) OVER w AS be, last_value(n_m) OVER w AS bn, first_value(utc_s) OVER w AS a_t, last_value(utc_s) OVER w AS b_t FROM m WINDOW w AS (PARTITION BY session_id ORDER BY utc_s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
y AS (SELECT *, CASE WHEN sqrt(e * e + n * n) >= 0.5 THEN degrees(atan2(e, n)) END AS v, CASE WHEN a_t < utc_s AND b_t > utc_s AND sqrt(power(be - ae, 2) + power(bn - an, 2)) >= 1 THEN degrees(atan2(be - ae, bn - an)) END AS p FROM w)
SELECT {KEY}, CASE WHEN v IS NOT NULL THEN 'velocity' WHEN p IS NOT NULL THEN 'path' END AS yaw_source, round({_MOD("coalesce(v, p)")}, 4) + 0.0E0 AS yaw_deg FROM y""")
def attitude_merged_yaw(spark: SparkSession, sf: str) -> DataFrame:
    """Doppler's heading, else that of the way over four seconds."""
    t = track(spark, sf)
    slow = F.col("epoch_ix") % 20 >= 10
    rows = motion.trajectory_yaw(with_enu(t).withColumns({"ve": F.when(slow, 0.1).otherwise(F.col("ve")), "vn": F.when(slow, 0.0).otherwise(F.col("vn"))}))
    v = F.when(F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2) >= 0.5, F.pmod(F.degrees(F.atan2("ve", "vn")), F.lit(360.0)))
    source = F.when(v.isNotNull(), "velocity").when(F.col("yaw_deg").isNotNull(), "path")
    return rows.select("session_id", "epoch_ix", source.alias("yaw_source"), (F.round(attitude.merged_yaw(v, F.col("yaw_deg")), 4) + 0.0).alias("yaw_deg"))


@query()
def attitude_headed(spark: SparkSession, sf: str) -> DataFrame:
    """Attitude at every sample: tilt from gravity, yaw from Doppler while driving and from the gyros in stops."""
    got = attitude.headed(samples(spark, sf), epochs(track(spark, sf)))
    return rounded(got.select("session_id", "epoch_ix", "j", "att_yaw", "att_pitch", "att_roll"), 5)


_VIDEO = f"""{CAMERA.removeprefix("WITH ")}, med AS (SELECT session_id, utc_s, ve, vn, median(sqrt(ve * ve + vn * vn)) OVER (PARTITION BY session_id ORDER BY utc_s RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM track),
z AS (SELECT c.session_id, c.utc_s, x / sqrt(x * x + y * y + z * z) AS a, y / sqrt(x * x + y * y + z * z) AS b, z / sqrt(x * x + y * y + z * z) AS d FROM c),
i AS (SELECT z.*, CASE WHEN h.utc_s = z.utc_s THEN 1 ELSE (z.utc_s - l.utc_s) / (h.utc_s - l.utc_s) END AS f, l.ve AS le, h.ve AS he, l.vn AS ln, h.vn AS hn, l.v AS lv, h.v AS hv
  FROM z ASOF JOIN med l ON z.session_id = l.session_id AND z.utc_s > l.utc_s ASOF JOIN med h ON z.session_id = h.session_id AND z.utc_s <= h.utc_s),
k AS (SELECT *, lv + (hv - lv) * f AS v, atan2(le + (he - le) * f, ln + (hn - ln) * f) AS hd FROM i),
video AS (SELECT session_id, utc_s, v * (sin(hd) * d + cos(hd) * a) AS v_e, v * (cos(hd) * d - sin(hd) * a) AS v_n, -v * b AS v_u FROM k WHERE v >= 0.3)"""


def _video(spark: SparkSession, sf: str) -> DataFrame:
    """Velocities of a camera that is taken to look ahead."""
    d = directions(spark, sf)
    size = F.sqrt(sum(F.col(c) ** 2 for c in ("c_x", "c_y", "c_z")))
    return video.velocities(d.withColumns({c: F.col(c) / size for c in ("c_x", "c_y", "c_z")}), track(spark, sf))


@query(f"WITH {_VIDEO} SELECT session_id, round(utc_s - 1704067200, 4) AS at_s, round(v_e, 5) + 0.0E0 AS v_e, round(v_n, 5) + 0.0E0 AS v_n, round(v_u, 5) + 0.0E0 AS v_u FROM video")
def video_velocities(spark: SparkSession, sf: str) -> DataFrame:
    """Directions of travel at Doppler's speed, turned by its heading."""
    return rounded(_video(spark, sf).select("session_id", F.round(F.col("utc_s") - 1704067200, 4).alias("at_s"), "v_e", "v_n", "v_u"), 5)


@query(f"""WITH {_VIDEO.replace(TRACK, ENU, 1)}, p AS (SELECT {KEY}, utc_s AS t1, lag(utc_s) OVER w AS t0, e_m, n_m, lag(e_m) OVER w AS e0, lag(n_m) OVER w AS n0 FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
s AS (SELECT p.session_id, t1, t0, v.utc_s, v_e, v_n, lag(v.utc_s) OVER w AS lt, lag(v_e) OVER w AS le, lag(v_n) OVER w AS ln, lead(v.utc_s) OVER w AS nt FROM p JOIN video v ON p.session_id = v.session_id AND v.utc_s > t0 AND v.utc_s <= t1 WINDOW w AS (PARTITION BY p.session_id, t1 ORDER BY v.utc_s)),
x AS (SELECT session_id, t1, count(*) AS used, {", ".join(f"sum((utc_s - coalesce(lt, t0)) * (v_{c} + coalesce(l{c}, v_{c})) / 2 + CASE WHEN nt IS NULL THEN (t1 - utc_s) * v_{c} ELSE 0 END) AS {c}" for c in "en")} FROM s GROUP BY 1, 2)
SELECT p.session_id, p.epoch_ix, coalesce(used, 0) AS n_video, round(coalesce(e0 + x.e, e_m), 4) + 0.0E0 AS e_m, round(coalesce(n0 + x.n, n_m), 4) + 0.0E0 AS n_m FROM p LEFT JOIN x ON p.session_id = x.session_id AND p.t1 = x.t1""")
def video_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Every epoch from the one before by the camera's velocities."""
    got = video.blend(with_enu(track(spark, sf)).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m"), _video(spark, sf))
    return rounded(got.select("session_id", "epoch_ix", "n_video", "e_m", "n_m"), 4)
