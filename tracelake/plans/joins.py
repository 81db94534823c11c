"""As-of, band and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import geo
from tracelake.operators import asof, gates, islands, ranges
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import ENU, FIXES, MASKS, QUERIES_T, STAT, TRACK, fixes, masks, queries_t, rounded, stat, table, track
from tracelake.registry import query

_BRACKET = f"""{TRACK}, {QUERIES_T},
u AS (SELECT session_id, utc_s, 0 AS side, query_id, NULL AS st, NULL AS lat, NULL AS lon, NULL AS h, NULL AS sns, NULL AS sve FROM queries_t
  UNION ALL SELECT session_id, utc_s, 1, NULL, utc_s, lat_deg, lon_deg, h_m, ns, ve FROM track),
n AS (SELECT *, {", ".join(f"last_value({c} IGNORE NULLS) OVER p AS lo_{c}, first_value({c} IGNORE NULLS) OVER q AS hi_{c}" for c in ("st", "lat", "lon", "h", "sns", "sve"))}
  FROM u WINDOW p AS (PARTITION BY session_id ORDER BY utc_s, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY session_id ORDER BY utc_s, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, CASE WHEN lo_st IS NOT NULL AND hi_st IS NOT NULL THEN hi_st - lo_st <= 2 ELSE coalesce(hi_st = utc_s, false) END AS ok, (utc_s - lo_st) / (hi_st - lo_st) AS f FROM n WHERE side = 0)"""


def _bracketed(spark: SparkSession, sf: str) -> DataFrame:
    t = track(spark, sf)
    return asof.bracket(queries_t(spark, sf), t, ["lat_deg", "lon_deg", "h_m", "ns", "ve"])


@query(f"""WITH {_BRACKET} SELECT session_id, query_id, {", ".join(f"round(CASE WHEN ok THEN lo_{c} + (hi_{c} - lo_{c}) * f END, 9) AS {n}" for c, n in (("lat", "lat_deg"), ("lon", "lon_deg")))},
  round(CASE WHEN ok THEN lo_h + (hi_h - lo_h) * f END, 5) AS h_m, round(CASE WHEN ok THEN lo_sve + (hi_sve - lo_sve) * f END, 6) AS ve FROM k""")
def asof_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    """Position and velocity at query times; null in gaps and outside the track."""
    rows = asof.interpolated(_bracketed(spark, sf), ["lat_deg", "lon_deg", "h_m", "ve"])
    return rows.select("session_id", "query_id", F.round("lat_deg", 9).alias("lat_deg"), F.round("lon_deg", 9).alias("lon_deg"), F.round("h_m", 5).alias("h_m"), F.round("ve", 6).alias("ve"))


@query(f"""WITH {_BRACKET} SELECT session_id, query_id, CASE WHEN lo_st IS NULL THEN hi_sns WHEN hi_st IS NULL OR utc_s - lo_st <= hi_st - utc_s THEN lo_sns ELSE hi_sns END AS ns,
  round(CASE WHEN lo_st IS NULL THEN hi_st - utc_s WHEN hi_st IS NULL OR utc_s - lo_st <= hi_st - utc_s THEN lo_st - utc_s ELSE hi_st - utc_s END, 6) AS dt_s FROM k""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = asof.nearest(_bracketed(spark, sf), ["ns"])
    return rows.select("session_id", "query_id", "ns", F.round("dt_s", 6).alias("dt_s"))


@query(f"""WITH {_BRACKET}, d AS (SELECT *, CASE WHEN lo_st IS NULL OR hi_st - utc_s <= utc_s - lo_st THEN hi_st - utc_s ELSE utc_s - lo_st END AS gap,
  CASE WHEN lo_st IS NULL OR hi_st - utc_s <= utc_s - lo_st THEN hi_sns ELSE lo_sns END AS pick FROM k)
SELECT session_id, query_id, CASE WHEN gap <= 0.4 THEN pick END AS ns FROM d""")
def asof_nearest_within(spark: SparkSession, sf: str) -> DataFrame:
    """Within 0.4 s; ties to the later sample."""
    return asof.nearest(_bracketed(spark, sf), ["ns"], tolerance=0.4, tie="later").select("session_id", "query_id", "ns")


@query(f"""WITH {TRACK}, {QUERIES_T} SELECT q.session_id, q.query_id, t.ns, t.ve FROM queries_t q ASOF LEFT JOIN track t ON q.session_id = t.session_id AND q.utc_s >= t.utc_s""")
def asof_step(spark: SparkSession, sf: str) -> DataFrame:
    """The latest sample at or before each query."""
    return asof.step(queries_t(spark, sf), track(spark, sf), ["ns", "ve"]).select("session_id", "query_id", "ns", "ve")


@query(f"""WITH {TRACK}, {FIXES}, e AS (SELECT session_id, epoch_ix, utc_s, lat_deg, lon_deg FROM track),
u AS (SELECT session_id, utc_s, 0 AS side, epoch_ix, lat_deg, lon_deg, NULL AS st, NULL AS la, NULL AS lo FROM e UNION ALL SELECT session_id, utc_s, 1, NULL, NULL, NULL, utc_s, d_lat, d_lon FROM fixes),
n AS (SELECT *, {", ".join(f"last_value({c} IGNORE NULLS) OVER p AS lo_{c}, first_value({c} IGNORE NULLS) OVER q AS hi_{c}" for c in ("st", "la", "lo"))}
  FROM u WINDOW p AS (PARTITION BY session_id ORDER BY utc_s, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY session_id ORDER BY utc_s, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, CASE WHEN lo_st IS NOT NULL AND hi_st IS NOT NULL THEN hi_st - lo_st <= 5 ELSE coalesce(hi_st = utc_s, false) END AS ok, CASE WHEN lo_st IS NULL OR hi_st = lo_st THEN 1 ELSE (utc_s - lo_st) / (hi_st - lo_st) END AS f FROM n WHERE side = 0),
g AS (SELECT *, CASE WHEN ok THEN CASE WHEN lo_st IS NULL THEN hi_la ELSE lo_la + (hi_la - lo_la) * f END END AS dla, CASE WHEN ok THEN CASE WHEN lo_st IS NULL THEN hi_lo ELSE lo_lo + (hi_lo - lo_lo) * f END END AS dlo FROM k),
m AS (SELECT *, sqrt(power((lat_deg - dla) * 111320, 2) + power((lon_deg - dlo) * 111320 * cos(radians(lat_deg)), 2)) AS far FROM g)
SELECT session_id, epoch_ix, round(far, 4) AS disagree_m, coalesce(far <= 10, true) AS keep FROM m""")
def asof_device_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs against the interpolated device track."""
    t = track(spark, sf).select("session_id", "epoch_ix", "utc_s", "lat_deg", "lon_deg")
    rows = asof.interpolated(asof.bracket(t, fixes(spark, sf), ["d_lat", "d_lon"], key="epoch_ix"), ["d_lat", "d_lon"], max_gap=5.0)
    return rounded(gates.device_track_gate(rows).select("session_id", "epoch_ix", "disagree_m", "keep"), 4)


@query(f"""WITH {TRACK}, {STAT}, s AS (SELECT session_id, utc_s + 0.2E0 AS t, prn, freq, el, snr FROM stat),
p AS (SELECT t.session_id, t.epoch_ix, s.prn, s.freq, s.el, s.snr, row_number() OVER (PARTITION BY t.session_id, t.epoch_ix, s.prn ORDER BY s.freq, abs(t.utc_s - s.t), s.t) AS rn
  FROM track t JOIN s ON t.session_id = s.session_id AND abs(t.utc_s - s.t) < 0.5)
SELECT session_id, epoch_ix, count(*) AS n_sat, count(*) FILTER (prn LIKE 'G%') AS n_gps, count(*) FILTER (prn LIKE 'E%') AS n_gal, round(avg(snr), 5) AS snr, round(max(el), 5) AS el_max FROM p WHERE rn = 1 GROUP BY 1, 2""")
def band_epoch_satellites(spark: SparkSession, sf: str) -> DataFrame:
    """Satellites within half a second of each epoch, one row for each (its lowest frequency)."""
    from pyspark.sql import Window

    s = stat(spark, sf).select("session_id", (F.col("utc_s") + 0.2).alias("utc_s"), "prn", "freq", "el", "snr")
    pairs = ranges.band_join(track(spark, sf).select("session_id", "epoch_ix", "utc_s"), s, 0.5)
    first = Window.partitionBy("session_id", "epoch_ix", "prn_r").orderBy("freq_r", F.abs(F.col("utc_s") - F.col("utc_s_r")), "utc_s_r")
    one = pairs.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return one.groupBy("session_id", "epoch_ix").agg(
        F.count(F.lit(1)).alias("n_sat"), F.count_if(F.col("prn_r").startswith("G")).alias("n_gps"), F.count_if(F.col("prn_r").startswith("E")).alias("n_gal"), F.round(F.avg("snr_r"), 5).alias("snr"), F.round(F.max("el_r"), 5).alias("el_max")
    )


_STATIC = f"""{TRACK}, m AS (SELECT *, epoch_ix % 20 BETWEEN 5 AND 9 AS slow, lead(utc_s) OVER w AS nx, row_number() OVER w AS rn FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
c AS (SELECT *, CASE WHEN rn = 1 OR slow <> lag(slow) OVER (PARTITION BY session_id ORDER BY utc_s) THEN 1 ELSE 0 END AS chg FROM m),
r AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS run FROM c),
stops AS (SELECT session_id, min(utc_s) AS start_s, max(coalesce(nx, utc_s)) AS end_s, count(*) AS n FROM r WHERE slow GROUP BY session_id, run HAVING max(coalesce(nx, utc_s)) - min(utc_s) >= 1.5)"""


def stops(spark: SparkSession, sf: str) -> DataFrame:
    t = track(spark, sf)
    still = F.when((F.col("epoch_ix") % 20).between(5, 9), 0.0)
    return islands.static_periods(t.withColumns({"vn": F.coalesce(still, F.col("vn")), "ve": F.coalesce(still, F.col("ve"))}))


@query(f"WITH {_STATIC} SELECT session_id, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s, n FROM stops")
def island_static_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Stops (epochs 5 to 9 of every twenty stand still): the end is the first moving epoch."""
    return rounded(stops(spark, sf), 4)


@query(f"""WITH {_STATIC}, i AS (SELECT session_id, utc_s + j / 10.0E0 AS utc_s, 9.8E0 + (k + j) % 5 / 100.0E0 AS az, (k * j) % 7 / 50.0E0 AS ax, j FROM track, range(0, 10) t(j))
SELECT s.session_id, round(s.start_s, 4) AS start_s, count(*) AS n, round(degrees(atan2(-avg(ax), sqrt(avg(az) * avg(az)))), 4) + 0.0E0 AS pitch_deg
FROM stops s JOIN i ON s.session_id = i.session_id AND i.utc_s BETWEEN s.start_s AND s.end_s GROUP BY s.session_id, s.start_s HAVING count(*) >= 20""")
def interval_gravity(spark: SparkSession, sf: str) -> DataFrame:
    """Inertial samples inside stops, at least 20, to a mean pitch."""
    j = F.explode(F.sequence(F.lit(0), F.lit(9)))
    imu = track(spark, sf).select("session_id", "utc_s", "k", j.alias("j")).select("session_id", (F.col("utc_s") + F.col("j") / 10.0).alias("utc_s"), (9.8 + (F.col("k") + F.col("j")) % 5 / 100.0).alias("az"), ((F.col("k") * F.col("j")) % 7 / 50.0).alias("ax"))
    rows = ranges.interval_join(imu, stops(spark, sf).select("session_id", "start_s", "end_s"))
    out = rows.groupBy("session_id", "start_s").agg(F.count(F.lit(1)).alias("n"), F.degrees(F.atan2(-F.avg("ax"), F.sqrt(F.avg("az") * F.avg("az")))).alias("pitch_deg")).where("n >= 20")
    return rounded(out, 4)


_FULL = f"""{ENU}, {MASKS}, c AS (SELECT session_id, utc_s FROM masks GROUP BY 1, 2 HAVING count(DISTINCT mask) = 4), f AS (SELECT m.* FROM masks m SEMI JOIN c ON m.session_id = c.session_id AND m.utc_s = c.utc_s)"""


@query(f"WITH {_FULL} SELECT session_id, count(*) AS n, count(DISTINCT utc_s) AS epochs FROM f GROUP BY session_id")
def masks_common_times(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs that every mask has."""
    rows = ranges.common_times(masks(spark, sf), "mask")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("utc_s").alias("epochs"))


@query(f"""WITH {_FULL} SELECT a.session_id, round(a.utc_s, 4) AS utc_s, round(max(sqrt(power(a.e_m - b.e_m, 2) + power(a.n_m - b.n_m, 2))), 5) AS spread_m
FROM f a JOIN f b ON a.session_id = b.session_id AND a.utc_s = b.utc_s AND a.mask < b.mask GROUP BY 1, a.utc_s""")
def masks_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Largest horizontal distance between two masks at each epoch: a few masks, compared inside one array."""
    from tracelake.operators.masks import spread

    return spread(ranges.common_times(masks(spark, sf), "mask")).select("session_id", F.round("utc_s", 4).alias("utc_s"), F.round("spread_m", 5).alias("spread_m"))


@query(f"""WITH {_FULL} PIVOT (SELECT session_id, round(utc_s, 4) AS utc_s, 'm' || mask AS mk, round(e_m, 4) + 0.0E0 AS e FROM f) ON mk IN ('m5', 'm10', 'm15', 'm20') USING first(e) GROUP BY session_id, utc_s""")
def masks_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One column for each mask."""
    rows = ranges.common_times(masks(spark, sf), "mask").select("session_id", F.round("utc_s", 4).alias("utc_s"), F.concat(F.lit("m"), "mask").alias("mk"), (F.round("e_m", 4) + 0.0).alias("e"))
    return rows.groupBy("session_id", "utc_s").pivot("mk", ["m5", "m10", "m15", "m20"]).agg(F.first("e"))


@query(f"""WITH {TRACK}, o AS (SELECT session_id, 'img_' || epoch_ix AS stem, lat_deg + 1E-6 * (k % 5) AS lat, lon_deg - 1E-6 AS lon, h_m + 1 AS h FROM track),
j AS (SELECT t.session_id, 'img_' || t.epoch_ix AS stem, (o.lat - t.lat_deg) * 110000 AS dn, o.h - t.h_m AS du FROM track t JOIN o ON t.session_id = o.session_id AND 'img_' || t.epoch_ix = o.stem)
SELECT session_id, stem, round(du, 3) AS du, round(dn / 0.5E0) * 0.5E0 + 0.0E0 AS dn_half FROM j""")
def join_frame_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Two coordinate sets of the same frames, joined by stem: offset of one about the other, in local metres."""
    t = track(spark, sf).withColumn("stem", F.concat(F.lit("img_"), "epoch_ix"))
    o = t.select("session_id", "stem", (F.col("lat_deg") + 1e-6 * (F.col("k") % 5)).alias("lat"), (F.col("lon_deg") - 1e-6).alias("lon"), (F.col("h_m") + 1).alias("h"))
    _, n, u = geo.llh_to_enu(F.col("lat"), F.col("lon"), F.col("h"), (F.col("lat_deg"), F.col("lon_deg"), F.col("h_m")))
    return t.join(o, ["session_id", "stem"]).select("session_id", "stem", F.round(u, 3).alias("du"), (F.round(n / 0.5) * 0.5 + 0.0).alias("dn_half"))


@query(f"""WITH {TRACK}, a1 AS (SELECT session_id, round(utc_s) AS s, min_by(h_m, utc_s) AS h FROM track GROUP BY 1, 2), b1 AS (SELECT session_id, round(utc_s + 0.3E0) AS s, min_by(h_m + 0.1E0 * (k % 4), utc_s) AS h FROM track GROUP BY 1, 2)
SELECT a1.session_id, a1.s, round(a1.h - b1.h, 6) + 0.0E0 AS dh FROM a1 JOIN b1 ON a1.session_id = b1.session_id AND a1.s = b1.s""")
def join_by_second(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams matched on the whole second, the first row of each."""
    t = track(spark, sf).withColumn("s", F.round("utc_s"))
    a = t.groupBy("session_id", "s").agg(F.min_by("h_m", "utc_s").alias("h"))
    later = t.select("session_id", "utc_s", F.round(F.col("utc_s") + 0.3).alias("s"), (F.col("h_m") + 0.1 * (F.col("k") % 4)).alias("hb"))
    b = later.groupBy("session_id", "s").agg(F.min_by("hb", "utc_s").alias("hb"))
    return rounded(a.join(b, ["session_id", "s"]).select("session_id", "s", (F.col("h") - F.col("hb")).alias("dh")))


@query("""SELECT n_name, count(*) AS n, bool_or(c_acctbal < 0) AS any_negative FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY n_name""")
def join_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Equality, semi and anti joins by key."""
    c, n, o, s = (table(spark, sf, x) for x in ("customer", "nation", "orders", "supplier"))
    rows = c.join(o, c.c_custkey == o.o_custkey, "left_semi").join(s, c.c_custkey == s.s_suppkey, "left_anti").join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("c_acctbal") < 0).alias("any_negative"))
