"""The georeferencing join over the event tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import georef
from tracelake.plans.tracks import TRACK, sql_ecef, track
from tracelake.registry import query


def frames(t: DataFrame) -> DataFrame:
    """A frame 0.37 s after each epoch."""
    return t.select("session_id", F.col("epoch_ix").alias("frame_id"), (F.col("utc_s") + 0.37).alias("utc_s"))


def epochs(t: DataFrame) -> DataFrame:
    """The track, standing still (Doppler, and for a part the place) in the second half of every twenty epochs."""
    still = F.col("epoch_ix") % 20 >= 10
    place = F.when(F.col("epoch_ix") % 20 >= 15, 34.8 + 1.2e-4 * 15).otherwise(F.col("lon_deg"))
    return t.withColumns({"ve": F.when(still, 0.1).otherwise(F.col("ve")), "vn": F.when(still, 0.0).otherwise(F.col("vn")), "lon_deg": place, "lat_deg": F.when(F.col("epoch_ix") % 20 >= 15, 32.0).otherwise(F.col("lat_deg"))})


def attitudes(t: DataFrame) -> DataFrame:
    k = F.col("k")
    return t.where("k % 3 <> 0").select("session_id", (F.col("utc_s") + 0.21).alias("utc_s"), ((k * 47) % 360).cast("double").alias("att_yaw"), (k % 21 - 10.0).alias("att_pitch"), ((k * 31) % 360 - 180.0).alias("att_roll"))


def trusts(t: DataFrame) -> DataFrame:
    return t.where("k % 7 <> 0").select("session_id", (F.col("utc_s") + 0.05).alias("utc_s"), F.exp(-0.5 * (F.col("sd_u") / 0.5) ** 2).alias("trust"))


_E, _N = (
    "(-sin(radians(olon)) * (x - ox) + cos(radians(olon)) * (y - oy))",
    "(-sin(radians(olat)) * cos(radians(olon)) * (x - ox) - sin(radians(olat)) * sin(radians(olon)) * (y - oy) + cos(radians(olat)) * (z - oz))",
)
_OK = "CASE WHEN h.utc_s = q.utc_s THEN 1 WHEN h.utc_s - l.utc_s <= 2 THEN 2 END"
_LINE = lambda c: f"CASE ok WHEN 1 THEN hi_{c} WHEN 2 THEN lo_{c} + (hi_{c} - lo_{c}) * f END"
_ARC = lambda c: f"CASE ok WHEN 1 THEN hi_{c} - 360 * floor(hi_{c} / 360) WHEN 2 THEN (lo_{c} + d_{c} * f) - 360 * floor((lo_{c} + d_{c} * f) / 360) END"
_SHORT = lambda c: f"(h.{c} - l.{c} + 540) - 360 * floor((h.{c} - l.{c} + 540) / 360) - 180 AS d_{c}"
_COLS = ("lat_deg", "lon_deg", "h_m", "ve", "vn", "vu", "sd_e", "sd_n", "sd_u")
SQL = f"""WITH {TRACK},
q AS (SELECT session_id, epoch_ix AS frame_id, utc_s + 0.37E0 AS utc_s FROM track),
p AS (SELECT * REPLACE (CASE WHEN epoch_ix % 20 >= 10 THEN 0.1E0 ELSE ve END AS ve, CASE WHEN epoch_ix % 20 >= 10 THEN 0 ELSE vn END AS vn,
  CASE WHEN epoch_ix % 20 >= 15 THEN 34.8E0 + 1.2E-4 * 15 ELSE lon_deg END AS lon_deg, CASE WHEN epoch_ix % 20 >= 15 THEN 32.0E0 ELSE lat_deg END AS lat_deg) FROM track),
a AS (SELECT session_id, utc_s + 0.21E0 AS utc_s, CAST((k * 47) % 360 AS DOUBLE) AS yaw, k % 21 - 10.0E0 AS pitch, (k * 31) % 360 - 180.0E0 AS roll FROM track WHERE k % 3 <> 0),
s AS (SELECT session_id, utc_s + 0.05E0 AS utc_s, exp(-0.5E0 * power(sd_u / 0.5E0, 2)) AS trust FROM track WHERE k % 7 <> 0),
j1 AS (SELECT q.*, {_OK} AS ok, (q.utc_s - l.utc_s) / (h.utc_s - l.utc_s) AS f, q.utc_s - l.utc_s AS before, h.utc_s - q.utc_s AS after,
    {", ".join(f"l.{c} AS lo_{c}, h.{c} AS hi_{c}" for c in _COLS)}
  FROM q ASOF LEFT JOIN p l ON q.session_id = l.session_id AND q.utc_s > l.utc_s ASOF LEFT JOIN p h ON q.session_id = h.session_id AND q.utc_s <= h.utc_s),
r1 AS (SELECT session_id, frame_id, utc_s, {", ".join(f"{_LINE(c)} AS {c}" for c in _COLS[:6])},
    {", ".join(f"CASE WHEN before IS NOT NULL AND (after IS NULL OR before <= after) THEN CASE WHEN before <= 2 THEN lo_{c} END WHEN after <= 2 THEN hi_{c} END AS accuracy_{x}" for c, x in (("sd_e", "x"), ("sd_n", "y"), ("sd_u", "z")))} FROM j1),
j2 AS (SELECT q.session_id, q.frame_id, {_OK} AS ok, (q.utc_s - l.utc_s) / (h.utc_s - l.utc_s) AS f, l.yaw AS lo_yaw, h.yaw AS hi_yaw, {_SHORT("yaw")}, l.roll AS lo_roll, h.roll AS hi_roll, {_SHORT("roll")}, l.pitch AS lo_pitch, h.pitch AS hi_pitch
  FROM q ASOF LEFT JOIN a l ON q.session_id = l.session_id AND q.utc_s > l.utc_s ASOF LEFT JOIN a h ON q.session_id = h.session_id AND q.utc_s <= h.utc_s),
r2 AS (SELECT session_id, frame_id, {_ARC("yaw")} AS yaw, {_ARC("roll")} AS roll, {_LINE("pitch")} AS pitch FROM j2),
r3 AS (SELECT q.session_id, q.frame_id, CASE WHEN l.utc_s IS NOT NULL AND (h.utc_s IS NULL OR q.utc_s - l.utc_s <= h.utc_s - q.utc_s) THEN CASE WHEN q.utc_s - l.utc_s <= 0.8 THEN l.trust END WHEN h.utc_s - q.utc_s <= 0.8 THEN h.trust END AS trust
  FROM q ASOF LEFT JOIN s l ON q.session_id = l.session_id AND q.utc_s > l.utc_s ASOF LEFT JOIN s h ON q.session_id = h.session_id AND q.utc_s <= h.utc_s),
m AS (SELECT *, {", ".join(f"{c} AS {n}" for c, n in zip(sql_ecef("lat_deg", "lon_deg", "h_m"), "xyz", strict=True))} FROM r1 JOIN r2 USING (session_id, frame_id) JOIN r3 USING (session_id, frame_id)),
o AS (SELECT *, {", ".join(f"first_value({c} IGNORE NULLS) OVER w AS o{n}" for c, n in (("lat_deg", "lat"), ("lon_deg", "lon"), ("x", "x"), ("y", "y"), ("z", "z")))}
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, CASE WHEN lat_deg IS NOT NULL THEN struct_pack(t := utc_s, e := {_E}, n := {_N}) END AS pt FROM o),
d AS (SELECT *, coalesce(lag(pt) OVER w, pt) AS pa, coalesce(lead(pt) OVER w, pt) AS pb FROM e WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
g AS (SELECT *, CASE WHEN pt IS NOT NULL THEN pb.e - pa.e END AS de, CASE WHEN pt IS NOT NULL THEN pb.n - pa.n END AS dn, pb.t - pa.t AS dt, sqrt(ve * ve + vn * vn) AS v FROM d),
k AS (SELECT *, CASE WHEN v >= 0.5 THEN 'velocity' WHEN sqrt(de * de + dn * dn) >= 0.5 THEN 'path' WHEN yaw IS NOT NULL THEN 'attitude' END AS yaw_source FROM g),
y AS (SELECT *, CASE yaw_source WHEN 'velocity' THEN degrees(atan2(ve, vn)) WHEN 'path' THEN degrees(atan2(de, dn)) ELSE yaw + 90 END AS w, roll + 180 - 360 * floor((roll + 180) / 360) - 180 AS wr FROM k)
SELECT session_id, frame_id, yaw_source, round(lat_deg, 9) AS lat_deg, round(lon_deg, 9) AS lon_deg, round(h_m, 5) AS h_m, round(ve, 5) AS ve, round(vn, 5) AS vn, round(vu, 5) AS vu,
  round(accuracy_x, 6) AS accuracy_x, round(accuracy_y, 6) AS accuracy_y, round(accuracy_z, 6) AS accuracy_z, round(w - 360 * floor(w / 360), 4) + 0.0E0 AS yaw_deg, round(pitch - 1.5, 5) + 0.0E0 AS pitch_deg,
  round(CASE WHEN wr = -180 THEN 180 ELSE wr END, 5) + 0.0E0 AS roll_deg, round(v, 5) AS doppler_speed_mps, round(CASE WHEN dt > 0 THEN sqrt(de * de + dn * dn) / dt END, 4) + 0.0E0 AS coords_speed_mps, round(trust, 6) AS trust FROM y"""


@query(SQL)
def georeference_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with place, accuracy, velocity, yaw, pitch, roll and trust from three streams, in one shuffle."""
    t = track(spark, sf)
    g = georef.georeference(frames(t), epochs(t), attitudes(t), trusts(t), mount=(90.0, -1.5, 0.0))
    digits = {"lat_deg": 9, "lon_deg": 9, "yaw_deg": 4, "coords_speed_mps": 4, "accuracy_x": 6, "accuracy_y": 6, "accuracy_z": 6, "trust": 6}
    return g.select("session_id", "frame_id", "yaw_source", *[(F.round(c, digits.get(c, 5)) + 0.0).alias(c) for c in g.columns if c not in ("session_id", "utc_s", "frame_id", "yaw_source")])
