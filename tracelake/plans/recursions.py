"""SQL for the oracle: sequential filters as recursive queries, a row of state carried from epoch to epoch."""

from __future__ import annotations

from tracelake.plans.tracks import ENU


def two_state(source: str, start: str, sigma_a: str, restart: str = "false") -> str:
    """Tables fw (filtered) and bw (smoothed: sx, sv, sa, sc) of source (session_id, axis, ix from 0, z, r, dt, and what restart needs).

    start gives x, v, a, c (position, velocity and their variances) from a row with ix 0.
    """
    key = "s.session_id = f.session_id AND s.axis = f.axis"
    grow = f"CASE WHEN {restart} THEN {{}} ELSE {{}} END"
    return f"""
fw AS (
  SELECT session_id, axis, CAST(-1 AS BIGINT) AS ix, {start}, 0.0E0 AS b, 0.0E0 AS px, 0.0E0 AS pv, 0.0E0 AS pa, 0.0E0 AS pb, 0.0E0 AS pc, 0.0E0 AS dt, false AS rst FROM {source} WHERE ix = 0
  UNION ALL
  SELECT session_id, axis, ix, px + g0 * (z - px), pv + g1 * (z - px), (1 - g0) * pa, pc - g1 * pb, (1 - g0) * pb, px, pv, pa, pb, pc, dt, rst
  FROM (SELECT *, pa / (pa + r) AS g0, pb / (pa + r) AS g1 FROM (
    SELECT s.session_id, s.axis, s.ix, s.z, s.r, s.dt, {restart} AS rst,
      {grow.format("f.x", "f.x + s.dt * f.v")} AS px, {grow.format("0.0E0", "f.v")} AS pv,
      {grow.format("f.a + 100", f"f.a + 2 * s.dt * f.b + s.dt * s.dt * f.c + power({sigma_a} * s.dt * s.dt, 2) / 4")} AS pa,
      {grow.format("0.0E0", f"f.b + s.dt * f.c + power({sigma_a}, 2) * power(s.dt, 3) / 2")} AS pb,
      {grow.format("100.0E0", f"f.c + power({sigma_a} * s.dt, 2)")} AS pc
    FROM fw f JOIN {source} s ON {key} AND s.ix = f.ix + 1))),
bw AS (
  SELECT session_id, axis, ix, x AS sx, v AS sv, a AS sa, b AS sb, c AS sc, px, pv, pa, pb, pc, dt, rst
  FROM fw WHERE (session_id, axis, ix) IN (SELECT session_id, axis, max(ix) FROM {source} GROUP BY ALL)
  UNION ALL
  SELECT session_id, axis, ix, x + c00 * dx + c01 * dv, v + c10 * dx + c11 * dv,
    a + c00 * c00 * da + 2 * c00 * c01 * db + c01 * c01 * dc, b + c00 * c10 * da + (c00 * c11 + c01 * c10) * db + c01 * c11 * dc,
    c + c10 * c10 * da + 2 * c10 * c11 * db + c11 * c11 * dc, px, pv, pa, pb, pc, dt, rst
  FROM (SELECT *, (m00 * npc - m01 * npb) / det AS c00, (m01 * npa - m00 * npb) / det AS c01, (m10 * npc - m11 * npb) / det AS c10, (m11 * npa - m10 * npb) / det AS c11 FROM (
    SELECT f.*, s.sx - s.px AS dx, s.sv - s.pv AS dv, s.sa - s.pa AS da, s.sb - s.pb AS db, s.sc - s.pc AS dc, s.pa AS npa, s.pb AS npb, s.pc AS npc, s.pa * s.pc - s.pb * s.pb AS det,
      CASE WHEN s.rst THEN f.a ELSE f.a + s.dt * f.b END AS m00, CASE WHEN s.rst THEN 0 ELSE f.b END AS m01, CASE WHEN s.rst THEN f.b ELSE f.b + s.dt * f.c END AS m10, CASE WHEN s.rst THEN 0 ELSE f.c END AS m11
    FROM bw s JOIN fw f ON {key} AND f.ix = s.ix - 1 AND f.ix >= 0)))"""


def axes(value: dict[str, str], rest: str) -> str:
    """One row for each epoch and axis: value gives z by axis."""
    return " UNION ALL ".join(f"SELECT session_id, epoch_ix AS ix, utc_s, '{a}' AS axis, {z} AS z, {rest.format(axis=a)} FROM enu" for a, z in value.items())


_STEP = "SELECT session_id, coalesce(median(d), 1) AS dt FROM (SELECT session_id, utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s) AS d FROM enu) WHERE d > 0 GROUP BY 1"
_ENU = {"e": "e_m", "n": "n_m", "u": "u_m"}

CV_RTS = f"""WITH RECURSIVE {ENU}, step AS ({_STEP}),
src AS MATERIALIZED (SELECT a.*, CASE WHEN axis = 'u' THEN 16.0E0 ELSE 4.0E0 END AS r, coalesce(step.dt, 1.0E0) AS dt FROM ({axes(_ENU, "0 AS none")}) a LEFT JOIN step USING (session_id)),
{two_state("src", "z AS x, 0.0E0 AS v, r AS a, 1.0E0 AS c", "0.5E0")}
SELECT session_id, ix AS epoch_ix, {", ".join(f"round(max(sx) FILTER (axis = '{a}'), 4) + 0.0E0 AS {a}_s" for a in "enu")} FROM bw GROUP BY 1, 2"""

RTS_IRREGULAR = f"""WITH RECURSIVE {ENU}, d AS (SELECT session_id, epoch_ix AS ix, e_m AS z, utc_s - lag(utc_s) OVER w AS gap, e_m - lag(e_m) OVER w AS dz FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
noise AS (SELECT session_id, CASE WHEN count(*) > 2 THEN greatest(var_pop(dz) / 2, 1E-12) ELSE 1.0E0 END AS r FROM d GROUP BY 1),
src AS MATERIALIZED (SELECT d.session_id, d.ix, 'e' AS axis, d.z, noise.r, greatest(coalesce(d.gap, 0), 0) AS dt FROM d JOIN noise USING (session_id)),
{two_state("src", "z AS x, 0.0E0 AS v, greatest(r, 1E-9) AS a, 100.0E0 AS c", "0.5E0")}
SELECT session_id, ix AS epoch_ix, round(sx, 4) + 0.0E0 AS e_s, round(sv, 4) + 0.0E0 AS ve_s FROM bw"""

KALMAN_SIGMA = f"""WITH RECURSIVE {ENU}, d AS (SELECT *, coalesce(utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s), 0) AS gap FROM enu),
src AS MATERIALIZED (SELECT session_id, ix, axis, z, power(greatest(sd, 0.05E0), 2) AS r, gap AS dt, ix > 0 AND (gap <= 0 OR gap > 5) AS hole FROM (
  {" UNION ALL ".join(f"SELECT session_id, epoch_ix AS ix, '{a}' AS axis, {z} AS z, sd_{a} AS sd, gap FROM d" for a, z in _ENU.items())})),
{two_state("src", "z AS x, 0.0E0 AS v, r AS a, 100.0E0 AS c", "0.5E0", "s.hole")}
SELECT session_id, ix AS epoch_ix, {", ".join(f"round(max(sx) FILTER (axis = '{a}'), 4) + 0.0E0 AS {a}_s, round(max(sv) FILTER (axis = '{a}'), 4) + 0.0E0 AS v{a}_s" for a in "enu")},
  round(sqrt(max(sa) FILTER (axis = 'e') + max(sa) FILTER (axis = 'n')), 4) + 0.0E0 AS sigma_h FROM bw GROUP BY 1, 2"""

#: Median of the last five kept positions; rows that an earlier gate stopped have no part.
JUMP_GATE = """WITH RECURSIVE {track},
g AS MATERIALIZED (SELECT session_id, epoch_ix AS ix, {x} AS x, {y} AS y, {z} AS z, {reason} AS reason FROM track),
k AS (
  SELECT session_id, ix, CASE WHEN reason IS NULL THEN [x] ELSE [] END AS xs, CASE WHEN reason IS NULL THEN [y] ELSE [] END AS ys, CASE WHEN reason IS NULL THEN [z] ELSE [] END AS zs, reason FROM g WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, CASE WHEN now IS NULL THEN list_append(xs, x)[-5:] ELSE xs END, CASE WHEN now IS NULL THEN list_append(ys, y)[-5:] ELSE ys END, CASE WHEN now IS NULL THEN list_append(zs, z)[-5:] ELSE zs END, now
  FROM (SELECT *, CASE WHEN reason IS NULL AND len(xs) >= 5 AND sqrt(power(x - list_median(xs), 2) + power(y - list_median(ys), 2) + power(z - list_median(zs), 2)) > 100 THEN 'position_jump' ELSE reason END AS now
    FROM (SELECT g.*, k.xs, k.ys, k.zs FROM k JOIN g ON g.session_id = k.session_id AND g.ix = k.ix + 1)))
SELECT session_id, ix AS epoch_ix, reason FROM k"""

KEEP_BY_MOTION = """WITH RECURSIVE {track}, n AS MATERIALIZED (SELECT session_id, epoch_ix AS ix, utc_s, sqrt(ve * ve + vn * vn) AS speed, k % 12 AS turn FROM track),
keep AS (
  SELECT session_id, ix, utc_s, speed, true AS keep, utc_s AS last, 0.0E0 AS path FROM n WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, utc_s, speed, now, CASE WHEN now THEN utc_s ELSE last END, CASE WHEN now THEN 0 ELSE path END
  FROM (SELECT *, utc_s - last >= 30 OR (utc_s - last >= 0.1 AND path >= CASE WHEN turn >= 5 THEN 0.5 ELSE 20 END) AS now
    FROM (SELECT n.*, k.last, k.path + (n.speed + k.speed) / 2 * (n.utc_s - k.utc_s) AS path FROM keep k JOIN n ON n.session_id = k.session_id AND n.ix = k.ix + 1)))
SELECT session_id, ix AS epoch_ix FROM keep WHERE keep"""

#: Speeds first, then headings; each against the last step that held.
ENVELOPE = """WITH RECURSIVE {clean},
s AS MATERIALIZED (SELECT session_id, epoch_ix AS ix, utc_s AS t, fine, utc_s - lag(utc_s) OVER w AS dt, e_m - lag(e_m) OVER w AS de, n_m - lag(n_m) OVER w AS dn FROM clean WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
sp AS (
  SELECT session_id, ix, false AS jump, NULL::DOUBLE AS vx, NULL::DOUBLE AS vy, NULL::DOUBLE AS held_at FROM s WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, now, CASE WHEN hold THEN de / dt ELSE vx END, CASE WHEN hold THEN dn / dt ELSE vy END, CASE WHEN hold THEN t ELSE held_at END
  FROM (SELECT *, fine AND NOT now AND dt > 0 AS hold FROM (
    SELECT s.*, p.vx, p.vy, p.held_at, coalesce(s.dt > 0 AND sqrt(power(s.de / s.dt - p.vx, 2) + power(s.dn / s.dt - p.vy, 2)) > sqrt(128.0E0) * greatest(s.t - p.held_at, s.dt) + 3 / s.dt, false) AS now
    FROM sp p JOIN s ON s.session_id = p.session_id AND s.ix = p.ix + 1))),
h AS MATERIALIZED (SELECT s.*, sp.jump, sqrt(de * de + dn * dn) AS step, dt >= 0.5 AND sqrt(de * de + dn * dn) >= 2 AND sqrt(de * de + dn * dn) / dt >= 5 AS far FROM s JOIN sp USING (session_id, ix)),
tr AS (
  SELECT session_id, ix, false AS turn, NULL::DOUBLE AS hx, NULL::DOUBLE AS hy, NULL::DOUBLE AS held_at, NULL::DOUBLE AS pace FROM h WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, now, CASE WHEN hold THEN de ELSE hx END, CASE WHEN hold THEN dn ELSE hy END, CASE WHEN hold THEN t ELSE held_at END, CASE WHEN hold THEN step / dt ELSE pace END
  FROM (SELECT *, coalesce(far AND fine AND NOT jump AND NOT now, false) AS hold FROM (
    SELECT h.*, p.hx, p.hy, p.held_at, p.pace,
      coalesce(h.far AND abs(atan2(p.hy * h.de - p.hx * h.dn, p.hx * h.de + p.hy * h.dn)) / greatest(h.t - p.held_at, h.dt) > 2.5 * 8 / greatest(least(h.step / h.dt, p.pace), 5), false) AS now
    FROM tr p JOIN h ON h.session_id = p.session_id AND h.ix = p.ix + 1)))
SELECT session_id, ix AS epoch_ix, sp.jump AS speed_jump, tr.turn AS turn_rate FROM sp JOIN tr USING (session_id, ix)"""

ALLAN = """WITH {track}, th AS MATERIALIZED (
  SELECT session_id, epoch_ix + 1 AS i, sum(sd_n) OVER (PARTITION BY session_id ORDER BY utc_s) AS th, count(*) OVER (PARTITION BY session_id) AS n FROM track
  UNION ALL SELECT session_id, 0, 0.0E0, count(*) FROM track GROUP BY 1),
lags AS (SELECT DISTINCT session_id, CAST(floor(power(10, j / 49.0E0 * log10(greatest((n - 1) // 2, 1))) + 1E-9) AS BIGINT) AS m FROM (SELECT session_id, any_value(n) AS n FROM th GROUP BY 1), range(50) AS r(j))
SELECT session_id, CAST(m AS DOUBLE) AS tau_s, round(sqrt(avg(power(c.th - 2 * b.th + a.th, 2)) / (2.0E0 * m * m)), 8) AS adev
FROM lags JOIN th a USING (session_id) JOIN th b ON b.session_id = a.session_id AND b.i = a.i + m JOIN th c ON c.session_id = a.session_id AND c.i = a.i + 2 * m GROUP BY session_id, m"""

MAHONY = """WITH RECURSIVE {track}, n AS MATERIALIZED (SELECT session_id, epoch_ix AS ix, utc_s, (k % 7) / 50.0E0 AS ax, coalesce(utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s), 0) AS dt FROM track),
q AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS ix, 1.0E0 AS w, 0.0E0 AS x, 0.0E0 AS y, 0.0E0 AS z, 0.0E0 AS b1, 0.0E0 AS b2, 0.0E0 AS b3 FROM n WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, nw / s, nx / s, ny / s, nz / s, b1, b2, b3 FROM (SELECT *, sqrt(nw * nw + nx * nx + ny * ny + nz * nz) AS s FROM (
    SELECT *, w + 0.5E0 * dt * (-x * rx - y * ry - z * rz) AS nw, x + 0.5E0 * dt * (w * rx + y * rz - z * ry) AS nx, y + 0.5E0 * dt * (w * ry - x * rz + z * rx) AS ny, z + 0.5E0 * dt * (w * rz + x * ry - y * rx) AS nz FROM (
      SELECT * EXCLUDE (b1, b2, b3), b1 + 0.05E0 * ex * dt AS b1, b2 + 0.05E0 * ey * dt AS b2, b3 + 0.05E0 * ez * dt AS b3, ex + b1 + 0.05E0 * ex * dt AS rx, ey + b2 + 0.05E0 * ey * dt AS ry, 0.01E0 + ez + b3 + 0.05E0 * ez * dt AS rz FROM (
        SELECT *, 0 * dz - az * dy AS ex, az * dx - a1 * dz AS ey, a1 * dy - 0 * dx AS ez FROM (
          SELECT n.session_id, n.ix, n.dt, q.w, q.x, q.y, q.z, q.b1, q.b2, q.b3, n.ax / sqrt(n.ax * n.ax + 9.80665E0 * 9.80665E0) AS a1, 9.80665E0 / sqrt(n.ax * n.ax + 9.80665E0 * 9.80665E0) AS az,
            2 * (q.x * q.z - q.w * q.y) AS dx, 2 * (q.w * q.x + q.y * q.z) AS dy, q.w * q.w - q.x * q.x - q.y * q.y + q.z * q.z AS dz
          FROM q JOIN n ON n.session_id = q.session_id AND n.ix = q.ix + 1))))))
SELECT session_id, ix AS epoch_ix, round(w, 5) + 0.0E0 AS qw, round(x, 5) + 0.0E0 AS qx, round(y, 5) + 0.0E0 AS qy, round(z, 5) + 0.0E0 AS qz FROM q WHERE ix >= 0"""

#: Samples drive the filter, epochs (z, with velocity w where known) correct it; forwards only.
POSITION_FILTER = """WITH RECURSIVE {enu},
line AS (SELECT session_id, utc_s, 1 AS epoch, e_m, ve, NULL::DOUBLE AS a_e FROM enu UNION ALL SELECT session_id, utc_s + 0.1E0 + 0.2E0 * j, 0, NULL::DOUBLE, NULL::DOUBLE, 0.1E0 * ((k + j) % 5 - 2) FROM enu, range(4) AS r(j)),
src AS MATERIALIZED (SELECT session_id, row_number() OVER w - 1 AS ix, utc_s, epoch, e_m AS z, ve AS w, coalesce(utc_s - lag(utc_s) OVER w, 0) AS dt,
  coalesce(last_value(a_e IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY utc_s, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM line WINDOW w AS (PARTITION BY session_id ORDER BY utc_s, epoch)),
fw AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS ix, z AS x, coalesce(w, 0) AS v, 9.0E0 AS a, 0.0E0 AS b, 4.0E0 AS c, 0 AS epoch, utc_s FROM src WHERE ix = 0
  UNION ALL
  SELECT session_id, ix, CASE WHEN w IS NULL THEN x1 ELSE x1 + b1 / (c1 + 0.25E0) * (w - v1) END, CASE WHEN w IS NULL THEN v1 ELSE v1 + c1 / (c1 + 0.25E0) * (w - v1) END,
    CASE WHEN w IS NULL THEN a1 ELSE a1 - b1 * b1 / (c1 + 0.25E0) END, CASE WHEN w IS NULL THEN b1 ELSE b1 - b1 * c1 / (c1 + 0.25E0) END, CASE WHEN w IS NULL THEN c1 ELSE c1 - c1 * c1 / (c1 + 0.25E0) END, epoch, utc_s
  FROM (SELECT *, CASE WHEN z IS NULL THEN px ELSE px + pa / (pa + 9) * (z - px) END AS x1, CASE WHEN z IS NULL THEN pv ELSE pv + pb / (pa + 9) * (z - px) END AS v1,
      CASE WHEN z IS NULL THEN pa ELSE pa - pa * pa / (pa + 9) END AS a1, CASE WHEN z IS NULL THEN pb ELSE pb - pa * pb / (pa + 9) END AS b1, CASE WHEN z IS NULL THEN pc ELSE pc - pb * pb / (pa + 9) END AS c1
    FROM (SELECT s.*, f.x + s.dt * f.v + s.dt * s.dt / 2 * s.u AS px, f.v + s.dt * s.u AS pv, f.a + 2 * s.dt * f.b + s.dt * s.dt * f.c + 0.25E0 * power(s.dt, 4) / 4 AS pa,
        f.b + s.dt * f.c + 0.25E0 * power(s.dt, 3) / 2 AS pb, f.c + 0.25E0 * s.dt * s.dt AS pc
      FROM fw f JOIN src s ON s.session_id = f.session_id AND s.ix = f.ix + 1)))
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY utc_s) - 1 AS BIGINT) AS epoch_ix, round(x, 4) + 0.0E0 AS e_s, round(v, 4) + 0.0E0 AS ve_s FROM fw WHERE epoch = 1"""
