"""Mountings, clock offsets against truth, and warped clocks over the event tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import rotations, warps
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import ENU, TRACK, rounded, track
from tracelake.registry import query


def directions(spark: SparkSession, sf: str) -> DataFrame:
    """A camera's direction of travel 0.3 s after each epoch, mounted askew, with noise; a few look elsewhere."""
    t = track(spark, sf)
    k, s = F.col("k"), F.col("session_id") % 7 / 10.0
    # Forward in the camera, turned about its vertical by s and nodded by 0.2.
    x, y, z = F.cos(s) * F.cos(F.lit(0.2)), F.sin(s) * F.cos(F.lit(0.2)), F.sin(F.lit(0.2)) + 0.0 * s
    away = k % 23 == 5
    return t.select("session_id", (F.col("utc_s") + 0.3).alias("utc_s"), F.when(away, -y).otherwise(x + (k % 5 - 2) / 100.0).alias("c_x"), F.when(away, x).otherwise(y + (k % 7 - 3) / 100.0).alias("c_y"), (z + (k % 3 - 1) / 100.0).alias("c_z"))


_SUMS = f"""WITH {TRACK}, d AS (SELECT session_id, utc_s + 0.3E0 AS utc_s, k % 23 = 5 AS away, k, cos((session_id % 7) / 10.0E0) * cos(0.2E0) AS x, sin((session_id % 7) / 10.0E0) * cos(0.2E0) AS y, sin(0.2E0) AS z FROM track),
c AS (SELECT session_id, utc_s, CASE WHEN away THEN -y ELSE x + (k % 5 - 2) / 100.0E0 END AS x, CASE WHEN away THEN x ELSE y + (k % 7 - 3) / 100.0E0 END AS y, z + (k % 3 - 1) / 100.0E0 AS z FROM d),
j AS (SELECT c.*, l.ve + (h.ve - l.ve) * (c.utc_s - l.utc_s) / (h.utc_s - l.utc_s) AS ve, l.vn + (h.vn - l.vn) * (c.utc_s - l.utc_s) / (h.utc_s - l.utc_s) AS vn
  FROM c ASOF JOIN track l ON c.session_id = l.session_id AND c.utc_s > l.utc_s ASOF JOIN track h ON c.session_id = h.session_id AND c.utc_s <= h.utc_s WHERE h.utc_s - l.utc_s <= 1.5 AND h.utc_s > c.utc_s),
m AS (SELECT session_id, count(*) AS n, sum(x / sqrt(x * x + y * y + z * z)) AS x, sum(y / sqrt(x * x + y * y + z * z)) AS y, sum(z / sqrt(x * x + y * y + z * z)) AS z FROM j WHERE sqrt(ve * ve + vn * vn) >= 3 GROUP BY session_id HAVING count(*) >= 3)"""


@query(f"{_SUMS} SELECT session_id, n, {', '.join(f'round({c} / sqrt(x * x + y * y + z * z), 6) + 0.0E0 AS {c}' for c in 'xyz')} FROM m")
def camera_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The camera's direction that is forward in the body: with one target direction, the first row of the solved rotation."""
    got = rotations.camera_mounting(directions(spark, sf), track(spark, sf), rounds=0)
    return rounded(got.select("session_id", "n", *[F.col(f"r0{j}").alias(c) for j, c in enumerate("xyz")]))


def _cut(n: int) -> str:
    """The mean direction of the pairs within 20 degrees of the one before."""
    near = f"SELECT u.* FROM u JOIN f{n} f USING (session_id) WHERE degrees(acos(greatest(-1, least(1, u.x * f.x + u.y * f.y + u.z * f.z)))) <= 20"
    return f"f{n + 1} AS (SELECT session_id, n, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM (SELECT session_id, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM ({near}) GROUP BY session_id HAVING count(*) >= 3))"


@query(f"""{_SUMS}, u AS (SELECT session_id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM j WHERE sqrt(ve * ve + vn * vn) >= 3),
f0 AS (SELECT session_id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM m), {_cut(0)}, {_cut(1)},
a AS (SELECT u.session_id, degrees(acos(greatest(-1, least(1, u.x * f.x + u.y * f.y + u.z * f.z)))) AS a, row_number() OVER (PARTITION BY u.session_id ORDER BY u.x * f.x + u.y * f.y + u.z * f.z DESC) - 1 AS i, count(*) OVER (PARTITION BY u.session_id) AS c FROM u JOIN f2 f USING (session_id))
SELECT session_id, n, {", ".join(f"round({c}, 6) + 0.0E0 AS {c}" for c in "xyz")}, round((SELECT max(a.a) FROM a WHERE a.session_id = f2.session_id AND a.i = a.c // 2), 3) AS median_deg FROM f2""")
def camera_mountings(spark: SparkSession, sf: str) -> DataFrame:
    """The same with stray directions cut, twice, and the angle that is left. The turn about one target direction stays open, so no more than this row of the rotation is told."""
    got = rotations.camera_mounting(directions(spark, sf), track(spark, sf))
    return got.select("session_id", "n", *[(F.round(f"r0{j}", 6) + 0.0).alias(c) for j, c in enumerate("xyz")], F.round("median_deg", 3).alias("median_deg"))


def _lags(t: DataFrame) -> DataFrame:
    return t.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("g")).select("session_id", (F.col("g") / 10.0).alias("lag_s"))


def _late(spark: SparkSession, sf: str) -> DataFrame:
    """The track, its clock ahead of truth by 0.23 s."""
    return with_enu(track(spark, sf)).select("session_id", (F.col("utc_s") + 0.23).alias("utc_s"), "e_m", "n_m")


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return with_enu(track(spark, sf)).select("session_id", "utc_s", F.col("e_m").alias("gt_e"), F.col("n_m").alias("gt_n"))


def _curve(c: str) -> str:
    slope = f"(({c}1 - {c}0) / (t1 - t0))"
    return f"{c}0 + s * (m{c} + s * ((3 * {slope} - 2 * m{c} - k{c}) / (t1 - t0) + s * ((m{c} + k{c} - 2 * {slope}) / ((t1 - t0) * (t1 - t0)))))"


_M = lambda c: f"coalesce(((({c} - lag({c}) OVER w) / (t - lag(t) OVER w)) * (lead(t) OVER w - t) + ((lead({c}) OVER w - {c}) / (lead(t) OVER w - t)) * (t - lag(t) OVER w)) / (lead(t) OVER w - lag(t) OVER w), (lead({c}) OVER w - {c}) / (lead(t) OVER w - t), ({c} - lag({c}) OVER w) / (t - lag(t) OVER w))"


def _costs(lags: str) -> str:
    """Costs of the lags (in seconds, an expression of g from a range)."""
    value, span = lags.split("; ")
    return f"""WITH {ENU}, g AS (SELECT session_id, utc_s AS t, e_m AS e, n_m AS n FROM enu), m AS (SELECT *, {_M("e")} AS me, {_M("n")} AS mn FROM g WINDOW w AS (PARTITION BY session_id ORDER BY t)),
c AS (SELECT session_id, t AS t0, lead(t) OVER w AS t1, e AS e0, lead(e) OVER w AS e1, me, lead(me) OVER w AS ke, n AS n0, lead(n) OVER w AS n1, mn, lead(mn) OVER w AS kn FROM m WINDOW w AS (PARTITION BY session_id ORDER BY t)),
q AS (SELECT session_id, utc_s + 0.23E0 + {value} AS t, {value} AS lag_s, e_m, n_m FROM enu, {span} r(g)),
j AS (SELECT q.*, c.* EXCLUDE (session_id), q.t - c.t0 AS s FROM q ASOF JOIN (SELECT * FROM c WHERE t1 IS NOT NULL) c ON q.session_id = c.session_id AND q.t >= c.t0),
k AS (SELECT session_id, lag_s, count(*) AS n, sqrt(avg(power(e_m - ({_curve("e")}), 2) + power(n_m - ({_curve("n")}), 2))) AS cost_m FROM j WHERE t <= t1 AND t1 - t0 <= 2 GROUP BY 1, 2)"""


@query(f"{_costs('g / 10.0E0; range(-5, 6)')} SELECT session_id, lag_s, n, round(cost_m, 3) AS cost_m FROM k")
def offset_lag_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What each of eleven clock offsets costs against a cubic through truth."""
    late = _late(spark, sf)
    return rounded(warps.lag_costs(late, _truth(spark, sf), _lags(late)), 3)


@query(f"{_costs('g / 100.0E0; range(-50, 51)')} SELECT session_id, round(arg_min(lag_s, cost_m), 3) AS lag_s, round(min(cost_m), 3) AS cost_m, arg_min(n, cost_m) AS n FROM k GROUP BY session_id")
def offset_search(spark: SparkSession, sf: str) -> DataFrame:
    """The offset that brings each session nearest to truth, from a coarse to a fine grid; truth is 0.23 s earlier for all. The SQL tries every lag of the fine one."""
    return rounded(warps.time_offset(_late(spark, sf), _truth(spark, sf), reach=0.5, steps=(0.1, 0.01)), 3)


@query(f"""WITH {TRACK}, p AS (SELECT session_id, utc_s AS a, utc_s + 0.5E0 + (k % 10) / 4.0E0 AS b FROM track WHERE epoch_ix % 6 = 0 AND k % 5 <> 0), m AS (SELECT *, max(b) OVER (PARTITION BY session_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM p),
f AS (SELECT session_id, a, b FROM m WHERE ahead IS NULL OR b > ahead), r AS (SELECT *, coalesce((lead(b) OVER w - b) / (lead(a) OVER w - a), (b - lag(b) OVER w) / (a - lag(a) OVER w), 1) AS rise, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY session_id ORDER BY a)),
q AS (SELECT session_id, epoch_ix AS query_id, utc_s + 0.37E0 AS utc_s FROM track)
SELECT q.session_id, query_id, round(CASE WHEN r.a IS NOT NULL THEN r.b + (q.utc_s - r.a) * r.rise ELSE z.b + (q.utc_s - z.a) * z.rise END - 1704067200, 4) AS warped_s
FROM q ASOF LEFT JOIN r ON q.session_id = r.session_id AND q.utc_s >= r.a LEFT JOIN (SELECT * FROM r WHERE i = 1) z ON q.session_id = z.session_id""")
def clock_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """Times mapped by control points that must not run backwards."""
    t = track(spark, sf)
    points = t.where("epoch_ix % 6 = 0 AND k % 5 <> 0").select("session_id", F.col("utc_s").alias("from_s"), (F.col("utc_s") + 0.5 + F.col("k") % 10 / 4.0).alias("to_s"))
    asked = t.select("session_id", F.col("epoch_ix").alias("query_id"), (F.col("utc_s") + 0.37).alias("utc_s"))
    got = warps.stretch(asked, points)
    return got.select("session_id", "query_id", F.round(F.col("warped_s") - 1704067200, 4).alias("warped_s"))
