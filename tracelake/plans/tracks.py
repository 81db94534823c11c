"""Trajectories derived from the events table, as DataFrames and as SQL for the oracle.

Every user is a session; the order of their events is the epoch number. The
track has holes, spikes in place and height, mixed quality and missing values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.kernels import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events"), "user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    ix = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    b = ev.select(F.col("user_id").alias("session_id"), "event_id", F.col("event_type").alias("provider"), "value", us.alias("us"), k.alias("k"), ix.cast("long").alias("epoch_ix"))
    s5, ixd = F.col("session_id") % 5, F.col("epoch_ix")
    return b.select(
        "session_id",
        "epoch_ix",
        "provider",
        (1704067200.0 + ixd + 15.0 * F.floor(ixd / 20.0) + (F.col("us") % 1000) / 1.0e4).alias("utc_s"),
        (32.0 + 1.0e-5 * s5 * ixd + 1.0e-8 * F.col("value") + F.when(F.col("k") == 7, 1.0e-3).otherwise(0.0)).alias("lat_deg"),
        (34.8 + 1.2e-4 * ixd + 1.0e-8 * F.col("k")).alias("lon_deg"),
        (50.0 + 0.01 * F.col("k") + F.when(F.col("k") == 13, 120.0).otherwise(0.0)).alias("h_m"),
        F.when(F.col("k") % 10 < 5, 1).when(F.col("k") % 10 < 8, 2).when(F.col("k") % 10 == 8, 4).otherwise(5).alias("quality"),
        (4 + F.col("k") % 16).alias("ns"),
        (1.1132 * s5 + 0.001 * (F.col("k") % 7)).alias("vn"),
        (11.3 + 0.001 * (F.col("k") % 11)).alias("ve"),
        F.when(F.col("k") % 9 != 0, 0.0).alias("vu"),
        (0.01 + F.col("value") / 1000.0).alias("sd_n"),
        (0.02 + F.col("value") / 1200.0).alias("sd_e"),
        (0.05 + F.col("value") / 500.0).alias("sd_u"),
        F.when(F.col("k") % 6 != 0, 1.0 + (F.col("k") % 40) / 8.0).alias("ratio"),
        "k",
    )


TRACK = """
b AS (
  SELECT user_id AS session_id, event_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS ix
  FROM events),
track AS (
  SELECT session_id, CAST(ix AS BIGINT) AS epoch_ix, event_type AS provider,
    1704067200.0E0 + ix + 15.0E0 * floor(ix / 20.0E0) + (us % 1000) / 1.0E4 AS utc_s,
    32.0E0 + 1.0E-5 * (session_id % 5) * ix + 1.0E-8 * value + CASE WHEN k = 7 THEN 1.0E-3 ELSE 0.0E0 END AS lat_deg,
    34.8E0 + 1.2E-4 * ix + 1.0E-8 * k AS lon_deg,
    50.0E0 + 0.01E0 * k + CASE WHEN k = 13 THEN 120.0E0 ELSE 0.0E0 END AS h_m,
    CASE WHEN k % 10 < 5 THEN 1 WHEN k % 10 < 8 THEN 2 WHEN k % 10 = 8 THEN 4 ELSE 5 END AS quality,
    4 + k % 16 AS ns,
    1.1132E0 * (session_id % 5) + 0.001E0 * (k % 7) AS vn,
    11.3E0 + 0.001E0 * (k % 11) AS ve,
    CASE WHEN k % 9 = 0 THEN NULL ELSE 0.0E0 END AS vu,
    0.01E0 + value / 1000.0E0 AS sd_n, 0.02E0 + value / 1200.0E0 AS sd_e, 0.05E0 + value / 500.0E0 AS sd_u,
    CASE WHEN k % 6 = 0 THEN NULL ELSE 1.0E0 + (k % 40) / 8.0E0 END AS ratio, k
  FROM b)"""

_A, _F = 6378137.0, 1.0 / 298.257223563
_E2 = _F * (2.0 - _F)


def sql_n(lat: str) -> str:
    return f"({_A!r}E0 / sqrt(1.0E0 - {_E2!r}E0 * sin(radians({lat})) * sin(radians({lat}))))"


def sql_ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = sql_n(lat)
    return (
        f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1.0E0 - {_E2!r}E0) + {h}) * sin(radians({lat})))",
    )


#: track with x, y, z and e_m, n_m, u_m about the first row of the session.
ENU = f"""{TRACK},
ecef AS (
  SELECT *, {", ".join(f"{c} AS {n}" for c, n in zip(sql_ecef("lat_deg", "lon_deg", "h_m"), "xyz", strict=True))} FROM track),
refs AS (
  SELECT *, first_value(x) OVER w AS rx, first_value(y) OVER w AS ry, first_value(z) OVER w AS rz,
         radians(first_value(lat_deg) OVER w) AS rla, radians(first_value(lon_deg) OVER w) AS rlo
  FROM ecef WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
enu AS (
  SELECT * EXCLUDE (rx, ry, rz, rla, rlo),
    -sin(rlo) * (x - rx) + cos(rlo) * (y - ry) AS e_m,
    -sin(rla) * cos(rlo) * (x - rx) - sin(rla) * sin(rlo) * (y - ry) + cos(rla) * (z - rz) AS n_m,
    cos(rla) * cos(rlo) * (x - rx) + cos(rla) * sin(rlo) * (y - ry) + sin(rla) * (z - rz) AS u_m
  FROM refs)"""

#: enu with dt_s, step_m, speed_mps, climb_mps.
STEPS = f"""{ENU},
d AS (
  SELECT *, utc_s - lag(utc_s) OVER w AS dt_s,
    sqrt((e_m - lag(e_m) OVER w) * (e_m - lag(e_m) OVER w) + (n_m - lag(n_m) OVER w) * (n_m - lag(n_m) OVER w)) AS step_m,
    abs(h_m - lag(h_m) OVER w) AS dh
  FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
steps AS (
  SELECT *, CASE WHEN dt_s > 0 THEN step_m / dt_s END AS speed_mps, CASE WHEN dt_s > 0 THEN dh / dt_s END AS climb_mps FROM d)"""


def queries_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query times: 0.37 s after each click."""
    t = track(spark, sf_dir)
    return t.where("provider = 'click'").select("session_id", F.col("epoch_ix").alias("query_id"), (F.col("utc_s") + 0.37).alias("utc_s"))


QUERIES_T = "queries_t AS (SELECT session_id, epoch_ix AS query_id, utc_s + 0.37E0 AS utc_s FROM track WHERE provider = 'click')"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device fixes: views and purchases, shifted."""
    t = track(spark, sf_dir)
    return t.where("provider IN ('view', 'purchase')").select("session_id", "utc_s", (F.col("lat_deg") + 1e-5).alias("d_lat"), (F.col("lon_deg") - 2e-5).alias("d_lon"), F.col("provider"))


FIXES = "fixes AS (SELECT session_id, utc_s, lat_deg + 1E-5 AS d_lat, lon_deg - 2E-5 AS d_lon, provider FROM track WHERE provider IN ('view', 'purchase'))"


def stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual rows: eight satellites on two frequencies for each epoch."""
    t = track(spark, sf_dir).withColumn("sat", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("freq", F.explode(F.array(F.lit(1), F.lit(2))))
    m = F.col("k") + F.col("sat") * 7
    return t.select(
        "session_id", "utc_s", F.concat(F.when(F.col("sat") < 5, "G").when(F.col("sat") < 7, "E").otherwise("R"), F.lpad(F.col("sat").cast("string"), 2, "0")).alias("prn"), "freq",
        ((m * 37 + F.col("sat") * 45) % 360).cast("double").alias("az"), (10.0 + (m * 13) % 75).alias("el"), ((m % 21) / 4.0 - 2.0).alias("res_p"),
        (20.0 + (m + F.col("freq")) % 28).alias("snr"), (m % 10 != 0).cast("int").alias("valid"),
    )


STAT = """stat AS (
  SELECT session_id, utc_s, CASE WHEN sat < 5 THEN 'G' WHEN sat < 7 THEN 'E' ELSE 'R' END || lpad(CAST(sat AS VARCHAR), 2, '0') AS prn, freq,
    CAST(((k + sat * 7) * 37 + sat * 45) % 360 AS DOUBLE) AS az, 10.0E0 + ((k + sat * 7) * 13) % 75 AS el, ((k + sat * 7) % 21) / 4.0E0 - 2.0E0 AS res_p,
    20.0E0 + (k + sat * 7 + freq) % 28 AS snr, CASE WHEN (k + sat * 7) % 10 <> 0 THEN 1 ELSE 0 END AS valid
  FROM track, range(1, 9) s(sat), range(1, 3) f(freq))"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions for four elevation masks, each a little off; one of them misses some epochs."""
    from tracelake.operators.motion import with_enu

    t = with_enu(track(spark, sf_dir)).withColumn("mask", F.explode(F.array(*[F.lit(m) for m in (5, 10, 15, 20)])))
    off = ((F.col("k") * F.col("mask")) % 17) / 16.0 - 0.5
    return t.where("NOT (mask = 20 AND k % 19 = 0)").select("session_id", "utc_s", "mask", (F.col("e_m") + off).alias("e_m"), (F.col("n_m") - off / 2).alias("n_m"), "u_m", "quality", "ns", "ratio", (0.1 + F.col("mask") / 50.0).alias("sd_h"))


MASKS = """masks AS (
  SELECT session_id, utc_s, mask, e_m + ((k * mask) % 17) / 16.0E0 - 0.5E0 AS e_m, n_m - (((k * mask) % 17) / 16.0E0 - 0.5E0) / 2 AS n_m, u_m, quality, ns, ratio, 0.1E0 + mask / 50.0E0 AS sd_h
  FROM enu, (SELECT unnest([5, 10, 15, 20]) AS mask) WHERE NOT (mask = 20 AND k % 19 = 0))"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock anchors x (ns) and y (s), with outliers."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    y = F.col("event_id") * 1.0000031 + (k % 11) * 0.001 + F.when(k == 3, 0.5).otherwise(0.0)
    return ev.select(F.col("user_id").alias("session_id"), (F.col("event_id") * 1000000000).alias("x_ns"), y.alias("y_s"))


ANCHORS = """anchors AS (
  SELECT user_id AS session_id, event_id * 1000000000 AS x_ns,
    event_id * 1.0000031E0 + (CAST(json_extract_string(props, '$.k') AS BIGINT) % 11) * 0.001E0
      + CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 3 THEN 0.5E0 ELSE 0.0E0 END AS y_s
  FROM events)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def sql_rounded(names: str, digits: int = 6) -> str:
    """'a, b' to the same rounding in SQL."""
    return ", ".join(f"round({n}, {digits}) + 0.0E0 AS {n}" for n in map(str.strip, names.split(",")))
