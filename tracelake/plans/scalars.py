"""Scalar functions: geodesy, clocks, angles, names, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import angles, geo, quality, timefn
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import ENU, TRACK, rounded, sql_ecef, sql_rounded, table, track
from tracelake.registry import query

R = sql_rounded
_X, _Y, _Z = sql_ecef("lat_deg", "lon_deg", "h_m")
KEY = "session_id, epoch_ix"


def _same(df: DataFrame) -> DataFrame:
    """Whether p holds the row's own coordinates, to 1e-9 degrees and 1e-6 m."""
    near = {f"same_{n}": F.abs(F.col(f"p.{c}") - F.col(c)) < e for n, c, e in (("lat", "lat_deg", 1e-9), ("lon", "lon_deg", 1e-9), ("h", "h_m", 1e-6))}
    return df.select("session_id", "epoch_ix", *[c.alias(n) for n, c in near.items()])


@query(f"WITH {TRACK}, e AS (SELECT {KEY}, {_X} AS x, {_Y} AS y, {_Z} AS z FROM track) SELECT {KEY}, {R('x, y, z', 4)} FROM e")
def geo_ecef(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = geo.llh_to_ecef(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"))
    return rounded(track(spark, sf).select("session_id", "epoch_ix", x.alias("x"), y.alias("y"), z.alias("z")), 4)


@query(f"WITH {TRACK} SELECT {KEY}, true AS same_lat, true AS same_lon, true AS same_h FROM track")
def geo_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """LLH to ECEF and back gives what went in."""
    p = geo.ecef_to_llh_struct(*geo.llh_to_ecef(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m")))
    return _same(track(spark, sf).withColumn("p", p))


@query(f"WITH {ENU} SELECT {KEY}, {R('e_m, n_m, u_m', 4)} FROM enu")
def geo_enu(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(with_enu(track(spark, sf)).select("session_id", "epoch_ix", "e_m", "n_m", "u_m"), 4)


@query(f"WITH {TRACK} SELECT {KEY}, true AS same_lat, true AS same_lon, true AS same_h FROM track")
def geo_enu_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """LLH to ENU about a fixed point and back."""
    ref = (F.lit(32.0), F.lit(34.8), F.lit(50.0))
    p = geo.enu_to_llh(*geo.llh_to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"), ref), ref)
    return _same(track(spark, sf).withColumn("p", p))


@query(f"""WITH {ENU}, v AS (SELECT {KEY}, ve, vn, coalesce(vu, 0.0E0) AS vu, radians(lat_deg) AS la, radians(lon_deg) AS lo FROM track)
SELECT {KEY}, round(-sin(lo) * ve - sin(la) * cos(lo) * vn + cos(la) * cos(lo) * vu, 6) + 0.0E0 AS vx,
  round(cos(lo) * ve - sin(la) * sin(lo) * vn + cos(la) * sin(lo) * vu, 6) + 0.0E0 AS vy, round(cos(la) * vn + sin(la) * vu, 6) + 0.0E0 AS vz,
  round(ve, 6) AS ve, round(vn, 6) AS vn FROM v""")
def geo_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Velocities to earth-centred axes, and back."""
    t = track(spark, sf)
    x, y, z = geo.enu_vec_to_ecef(F.col("ve"), F.col("vn"), F.coalesce("vu", F.lit(0.0)), F.col("lat_deg"), F.col("lon_deg"))
    rows = t.withColumns({"vx": x, "vy": y, "vz": z})
    e, n, _ = geo.ecef_vec_to_enu(F.col("vx"), F.col("vy"), F.col("vz"), F.col("lat_deg"), F.col("lon_deg"))
    return rounded(rows.withColumns({"ve": e, "vn": n}).select("session_id", "epoch_ix", "vx", "vy", "vz", "ve", "vn"))


@query(f"""WITH {TRACK}, d AS (
  SELECT {KEY}, radians(lat_deg) AS a, radians(lead(lat_deg) OVER w) AS b, radians(lead(lon_deg) OVER w - lon_deg) AS dl, ve, vn
  FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
h AS (SELECT *, degrees(atan2(sin(dl) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(dl))) AS raw, degrees(atan2(ve, vn)) AS dop FROM d)
SELECT {KEY}, round(CASE WHEN raw < 0 THEN raw + 360 ELSE raw END, 5) AS bearing_deg, round(CASE WHEN dop < 0 THEN dop + 360 ELSE dop END, 5) AS heading_deg FROM h""")
def geo_headings(spark: SparkSession, sf: str) -> DataFrame:
    from tracelake.operators.motion import ordered

    w = ordered()
    b = geo.heading_from_latlon(F.col("lat_deg"), F.col("lon_deg"), F.lead("lat_deg").over(w), F.lead("lon_deg").over(w))
    return track(spark, sf).select("session_id", "epoch_ix", F.round(b, 5).alias("bearing_deg"), F.round(geo.heading_from_enu(F.col("ve"), F.col("vn")), 5).alias("heading_deg"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey % 361) - 180.0E0 AS lon, (c_custkey % 161) - 80.0E0 AS lat FROM customer)
SELECT c_custkey, CAST(CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS INTEGER) AS zone,
  CAST(least(60, floor((lon + 180) / 6) + 1) AS INTEGER) AS zone_clamped,
  CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS INTEGER) AS epsg FROM p""")
def geo_utm_zones(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 361) - 180.0).alias("lon"), ((F.col("c_custkey") % 161) - 80.0).alias("lat"))
    zone = geo.utm_zone(F.col("lon"))
    return p.select("c_custkey", zone.alias("zone"), geo.utm_zone_clamped(F.col("lon")).alias("zone_clamped"), geo.utm_epsg(F.col("lat"), zone).alias("epsg"))


@query(f"WITH {TRACK} SELECT {KEY}, true AS in_zone, true AS same_lat, true AS same_lon FROM track")
def geo_utm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """To UTM zone 36 and back; near the zone's false easting."""
    e, n = geo.utm_forward(F.col("lat_deg"), F.col("lon_deg"), F.lit(36))
    rows = track(spark, sf).withColumns({"e": e, "n": n})
    lat, lon = geo.utm_inverse(F.col("e"), F.col("n"), F.lit(36), F.lit(False))
    near = F.col("e").between(600000.0, 720000.0)
    return rows.select("session_id", "epoch_ix", near.alias("in_zone"), (F.abs(lat - F.col("lat_deg")) < 1e-9).alias("same_lat"), (F.abs(lon - F.col("lon_deg")) < 1e-9).alias("same_lon"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 90 AS d, o_orderkey % 60 AS m, (o_orderkey % 600) / 10.0E0 AS s, ['N', 'S', 'E', 'W'][o_orderkey % 4 + 1] AS c FROM orders)
SELECT o_orderkey, round((d + m / 60.0E0 + s / 3600.0E0) * CASE WHEN c IN ('S', 'W') THEN -1 ELSE 1 END, 8) + 0.0E0 AS dms,
  CAST(o_orderkey % 90 AS DOUBLE) AS lat, round(m + 0.5E0, 6) AS lon, CAST(s AS DOUBLE) AS h,
  CAST(CASE WHEN c = 'N' THEN 32600 WHEN c = 'S' THEN 32700 WHEN c = 'W' THEN 32600 ELSE 32700 END + d % 60 + 1 AS INTEGER) AS epsg FROM t""")
def geo_text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees-minutes-seconds, plain triples and zone names as text, parsed."""
    k = F.col("o_orderkey")
    c = F.element_at(F.array(*map(F.lit, "NSEW")), (k % 4 + 1).cast("int"))
    s = ((k % 600) / 10.0).cast("string")
    text = F.concat_ws(" ", (k % 90).cast("string"), (k % 60).cast("string"), s, c)
    triple = F.concat((k % 90).cast("string"), F.lit(", "), ((k % 60) + 0.5).cast("string"), F.lit(" "), s)
    lat, lon, h = geo.parse_dd(triple)
    zone = F.concat(((k % 90) % 60 + 1).cast("string"), c)
    return table(spark, sf, "orders").select("o_orderkey", (F.round(geo.parse_dms(text), 8) + 0.0).alias("dms"), lat.alias("lat"), lon.alias("lon"), h.alias("h"), geo.zone_epsg(zone).alias("epsg"))


_LEAPS = " ".join(f"WHEN t >= {s} THEN {n}" for s, n in reversed(timefn.LEAP_TABLE))


@query(f"""WITH t AS (SELECT o_orderkey, epoch(o_orderdate) - 86400.0E0 * 365 * (o_orderkey % 25) AS t FROM orders)
SELECT o_orderkey, CAST(CASE {_LEAPS} ELSE 0 END AS DOUBLE) AS leap, t - CASE {_LEAPS} ELSE 0 END AS utc_s FROM t""")
def time_leap_seconds(spark: SparkSession, sf: str) -> DataFrame:
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 - 86400.0 * 365 * (F.col("o_orderkey") % 25)
    return table(spark, sf, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", timefn.leap_seconds(F.col("t")).alias("leap"), timefn.gpst_to_utc(F.col("t")).alias("utc_s"))


@query(f"""WITH {TRACK} SELECT {KEY}, strftime(make_timestamp(CAST(floor(utc_s * 1000 + 0.5E0) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
  lpad(CAST(CAST(round((utc_s - 1704067200) * 1000) AS BIGINT) // 1000 AS VARCHAR), 6, '0') || '.' || lpad(CAST(CAST(round((utc_s - 1704067200) * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS name FROM track""")
def time_texts(spark: SparkSession, sf: str) -> DataFrame:
    """ISO text with half-up milliseconds, and the frame name of the time since a fixed start."""
    return track(spark, sf).select("session_id", "epoch_ix", timefn.iso_utc_ms(F.col("utc_s")).alias("iso"), timefn.frame_name(F.col("utc_s") - 1704067200).alias("name"))


@query("""SELECT page_id, regexp_replace(list_extract(string_split_regex(url, '[/\\\\]'), -1), '\\.[^.]+$', '') AS image_key,
  CAST(page_id AS DOUBLE) + 0.25E0 AS stem_s, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id / CAST(page_id % 3 AS DOUBLE) END AS rate FROM pages""")
def time_names(spark: SparkSession, sf: str) -> DataFrame:
    """File stems, times embedded in names, and rates written as fractions."""
    k = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        timefn.image_key(F.col("url")).alias("image_key"),
        timefn.stem_time(F.concat(F.lit("cam_"), k, F.lit(".25_"), F.lpad(k, 6, "0"))).alias("stem_s"),
        timefn.fraction(F.concat(k, F.lit("/"), (F.col("page_id") % 3).cast("string"))).alias("rate"),
    )


@query("""WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS DOUBLE) AS v0, CAST(o_orderkey % 50 + 20 + o_orderkey % 7 AS DOUBLE) AS v1, 15.0E0 AS c0, 60.0E0 AS c1 FROM orders)
SELECT o_orderkey, greatest(0, least(v1, c0) - v0) AS head_s, greatest(0, v1 - greatest(v0, c1)) AS tail_s,
  v1 - v0 - greatest(0, least(v1, c1) - greatest(v0, c0)) AS total_s, round(100 * greatest(0, least(v1, c1) - greatest(v0, c0)) / (v1 - v0), 6) AS kept_pct FROM v""")
def time_trim(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    v0, v1 = (k % 50).cast("double"), (k % 50 + 20 + k % 7).cast("double")
    trim = timefn.trim_window(v0, v1, F.lit(15.0), F.lit(60.0))
    return rounded(table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in trim.items()]))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 720 - 360 AS d, l_partkey % 360 AS p, l_suppkey * 3.7E0 % 360 AS q FROM lineitem),
w AS (SELECT *, (d + 180) - 360 * floor((d + 180) / 360) - 180 AS raw, (q - p + 540) - 360 * floor((q - p + 540) / 360) - 180 AS turn FROM a)
SELECT l_orderkey, l_linenumber, round(CASE WHEN raw = -180 THEN 180 ELSE raw END, 6) + 0.0E0 AS wrapped,
  round(p + turn * 0.25E0 - 360 * floor((p + turn * 0.25E0) / 360), 6) + 0.0E0 AS turned FROM w""")
def angle_wrap(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    turned = angles.lerp_deg((F.col("l_partkey") % 360).cast("double"), F.col("l_suppkey") * 3.7 % 360, F.lit(0.25))
    return rounded(li.select("l_orderkey", "l_linenumber", angles.wrap_deg(F.col("l_extendedprice") % 720 - 360).alias("wrapped"), turned.alias("turned")))


_QA = "cos(y / 2) AS aw, 0.0E0 AS ax, 0.0E0 AS ay, sin(y / 2) AS az, cos(r / 2) AS bw, sin(r / 2) AS bx, 0.0E0 AS by_, 0.0E0 AS bz"


@query(f"""WITH t AS (SELECT o_orderkey, radians(o_orderkey % 170 - 85) AS y, radians(o_orderkey % 80 - 40) AS r FROM orders), a AS (SELECT *, {_QA} FROM t),
m AS (SELECT *, aw * bw AS w, aw * bx AS x, az * bx AS yy, az * bw AS z FROM a)
SELECT o_orderkey, round(degrees(atan2(2 * (w * z + x * yy), 1 - 2 * (yy * yy + z * z))), 5) + 0.0E0 AS yaw,
  round(degrees(atan2(2 * (w * x + yy * z), 1 - 2 * (x * x + yy * yy))), 5) + 0.0E0 AS roll,
  round(1 - 2 * (yy * yy + z * z), 6) + 0.0E0 AS forward_e, round(2 * (x * yy + z * w), 6) + 0.0E0 AS forward_n,
  round(-(1 - 2 * (yy * yy + z * z)), 6) + 0.0E0 AS centre_x, round(degrees(y) / 2, 5) + 0.0E0 AS half_yaw FROM m""")
def angle_quaternions(spark: SparkSession, sf: str) -> DataFrame:
    """Products, rotations, camera centres, angles and half-way turns of quaternions."""
    k = F.col("o_orderkey")
    y, r, zero = F.radians((k % 170 - 85).cast("double")), F.radians((k % 80 - 40).cast("double")), F.lit(0.0)
    rows = table(spark, sf, "orders").select("o_orderkey", angles.q(F.cos(y / 2), zero, zero, F.sin(y / 2)).alias("a"), angles.q(F.cos(r / 2), F.sin(r / 2), zero, zero).alias("b"))
    rows = rows.withColumn("m", angles.qmul(F.col("a"), F.col("b"))).withColumn("half", angles.slerp(F.array(F.lit(1.0), zero, zero, zero), F.col("a"), F.lit(0.5)))
    yaw, _, roll = angles.quat_to_ypr(F.col("m"))
    e, n, _ = angles.rotate(F.col("m"), (F.lit(1.0), zero, zero))
    cx, _, _ = angles.camera_center(F.col("m"), (F.lit(1.0), zero, zero))
    hy, _, _ = angles.quat_to_ypr(F.col("half"))
    return rows.select("o_orderkey", *[(F.round(c, d) + 0.0).alias(x) for c, x, d in ((yaw, "yaw", 5), (roll, "roll", 5), (e, "forward_e", 6), (n, "forward_n", 6), (cx, "centre_x", 6), (hy, "half_yaw", 5))])


_SIG = "(0.1E0 + 5.96E0 / (1 + exp((ns - 10.23E0) / 4.18E0)))"


@query(f"""WITH {TRACK} SELECT {KEY}, round({_SIG}, 6) AS sigma_h, round(2.5E0 * {_SIG}, 6) AS sigma_v, round(1 / ({_SIG} * {_SIG}), 6) AS weight,
  round(2.0E0 * (1.0E0 + least(greatest((10.0E0 - ns) / 7.0E0, 0), 1)), 6) AS samples,
  CASE quality WHEN 1 THEN 0.2E0 WHEN 2 THEN 1.0E0 WHEN 4 THEN 2.0E0 WHEN 5 THEN 3.0E0 ELSE 1.0E0 END AS floor_m,
  CASE WHEN ns < 6 THEN 'lo' WHEN ns < 10 THEN 'mid' ELSE 'hi' END AS bucket FROM track""")
def quality_sigmas(spark: SparkSession, sf: str) -> DataFrame:
    ns = F.col("ns")
    return rounded(
        track(spark, sf).select(
            "session_id", "epoch_ix", quality.sigma_h_from_ns(ns).alias("sigma_h"), quality.sigma_v_from_ns(ns).alias("sigma_v"), quality.weights_from_ns(ns).alias("weight"),
            quality.smoothing_samples_from_ns(ns, F.lit(2.0)).alias("samples"), quality.quality_floor(F.col("quality")).alias("floor_m"), quality.ns_bucket(ns).alias("bucket"),
        )
    )


@query(f"""WITH {TRACK}, s AS (SELECT *, sqrt((sd_n * sd_n + sd_e * sd_e) / 2) * 3 AS eff FROM track)
SELECT {KEY}, round(eff, 6) AS eff_sd,
  round(0.4E0 * CASE quality WHEN 1 THEN 1.0E0 WHEN 2 THEN 0.5E0 WHEN 4 THEN 0.2E0 WHEN 5 THEN 0.05E0 ELSE 0 END + 0.4E0 * least(greatest(1 - eff / 5, 0), 1)
    + 0.1E0 * least(greatest(ns / 20.0E0, 0), 1) + 0.1E0 * coalesce(least(greatest(ratio / 3, 0), 1), 0), 6) AS score,
  round(sqrt(sd_n * sd_n + 0.05E0 * coalesce(ratio, 0) * coalesce(ratio, 0) + 0.01E0), 6) AS eff_sigma FROM s""")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    eff = quality.sd_h(F.col("sd_n"), F.col("sd_e")) / F.sqrt(F.lit(2.0)) * 3.0
    score = quality.quality_score(F.col("quality"), F.col("ns"), F.col("ratio"), F.col("eff_sd"))
    return rounded(track(spark, sf).withColumn("eff_sd", eff).select("session_id", "epoch_ix", "eff_sd", score.alias("score"), quality.effective_sigma(F.col("sd_n"), F.col("ratio")).alias("eff_sigma")))


@query(f"""WITH {TRACK}, s AS (SELECT *, sd_n * 8 AS e, sd_u * 20 AS d FROM track)
SELECT {KEY}, CASE WHEN e < 0.85E0 AND d < 4 THEN 'high' WHEN e < 0.85E0 THEN 'pos_only' WHEN d < 4 THEN 'vel_only' ELSE 'low' END AS trust_v1,
  CASE WHEN d < 0.55E0 THEN 'high' WHEN d < 5 THEN 'pos_only' ELSE 'low' END AS trust_v2,
  round(sqrt((ve - 11) * (ve - 11) + (vn - 1) * (vn - 1) + CASE WHEN vu IS NULL THEN 0 ELSE (0.5E0 - vu) * (0.5E0 - vu) END), 6) AS vel_m FROM s""")
def quality_trust(spark: SparkSession, sf: str) -> DataFrame:
    e, d = F.col("sd_n") * 8, F.col("sd_u") * 20
    vel = quality.velocity_disagreement(F.lit(11.0), F.lit(1.0), F.lit(0.5), F.col("ve"), F.col("vn"), F.col("vu"))
    return rounded(track(spark, sf).select("session_id", "epoch_ix", quality.trust_v1(e, d).alias("trust_v1"), quality.trust_v2(d).alias("trust_v2"), vel.alias("vel_m")))
