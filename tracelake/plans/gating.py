"""Gates, repair and trust of epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import quality
from tracelake.operators import gates, islands, sessions
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import ENU, STEPS, TRACK, rounded, track
from tracelake.registry import query

KEY = "session_id, epoch_ix"

_STATIC = """CASE WHEN quality IN (5, 6) THEN 'drop_q' WHEN quality > 2 THEN 'quality' WHEN ns < 5 THEN 'ns' WHEN sqrt(sd_n * sd_n + sd_e * sd_e) > 0.5 THEN 'sigma_h'
  WHEN sd_u IS NULL OR sd_u > 10 THEN 'sigma_v' WHEN ratio > 30 THEN 'age' WHEN sqrt(vn * vn + ve * ve) > 50 THEN 'speed' END"""


@query(f"WITH {TRACK} SELECT {KEY}, {_STATIC} AS reason FROM track")
def gate_static_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return track(spark, sf).withColumn("age_s", F.col("ratio")).select("session_id", "epoch_ix", gates.static_reasons(sigma_h=0.5).alias("reason"))


@query(f"WITH {TRACK} SELECT coalesce({_STATIC}, 'kept') AS reason, count(*) AS n FROM track GROUP BY 1")
def gate_static_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = track(spark, sf).withColumn("age_s", F.col("ratio")).select(F.coalesce(gates.static_reasons(sigma_h=0.5), F.lit("kept")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRACK} SELECT session_id, count(*) AS n, CAST(avg(CASE WHEN ns > 6 THEN 1.0E0 ELSE 0.0E0 END) >= 0.1 AS BOOLEAN) AS ns_informative FROM track WHERE quality BETWEEN 1 AND 2 GROUP BY session_id")
def gate_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.quality_gate(track(spark, sf))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("ns") > 6).cast("double")) >= 0.1).alias("ns_informative"))


@query(f"""WITH {TRACK}, d AS (SELECT *, utc_s - lag(utc_s) OVER w AS dt, sqrt(power(ve - lag(ve) OVER w, 2) + power(vn - lag(vn) OVER w, 2)) AS dv
  FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s))
SELECT {KEY}, vu IS NULL OR sqrt(ve * ve + vn * vn) > 11.9 OR coalesce(dt > 0 AND dt <= 5 AND dv / dt > 0.008, false) AS bad_doppler FROM d""")
def gate_bad_doppler(spark: SparkSession, sf: str) -> DataFrame:
    return gates.bad_doppler(track(spark, sf), max_speed=11.9, max_accel=0.008).select("session_id", "epoch_ix", "bad_doppler")


_GRAD = """CASE WHEN hs IS NULL THEN ({c}_n - {c}) / hd WHEN hd IS NULL THEN ({c} - {c}_p) / hs
  ELSE (hs * hs * {c}_n + (hd * hd - hs * hs) * {c} - hd * hd * {c}_p) / (hs * hd * (hd + hs)) END"""


@query(f"""WITH {ENU}, g AS (
  SELECT *, lead(utc_s) OVER w - utc_s AS hd, utc_s - lag(utc_s) OVER w AS hs, lead(e_m) OVER w AS e_m_n, lag(e_m) OVER w AS e_m_p, lead(n_m) OVER w AS n_m_n, lag(n_m) OVER w AS n_m_p
  FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
d AS (SELECT {KEY}, sqrt(power({_GRAD.format(c='e_m')} - ve, 2) + power({_GRAD.format(c='n_m')} - vn, 2)) AS d FROM g),
m AS (SELECT *, median(d) OVER (PARTITION BY session_id) AS med FROM d),
a AS (SELECT *, median(abs(d - med)) OVER (PARTITION BY session_id) AS mad FROM m)
SELECT {KEY}, round(d, 5) AS disagree_mps, coalesce(mad >= 1E-9 AND d > med + 5 * 1.4826E0 * mad, false) AS doppler_reject FROM a""")
def gate_doppler(spark: SparkSession, sf: str) -> DataFrame:
    """Second-order position gradient against Doppler, by a scaled MAD about the session's median."""
    return rounded(gates.doppler_gate(with_enu(track(spark, sf))).select("session_id", "epoch_ix", "disagree_mps", "doppler_reject"), 5)


_PLAUSIBLE = f"""{STEPS},
m AS (SELECT *, median(h_m) OVER s AS hmed, median(step_m) OVER s AS smed, count(*) OVER s AS cnt FROM steps WINDOW s AS (PARTITION BY session_id)),
a AS (SELECT *, median(abs(step_m - smed)) OVER (PARTITION BY session_id) AS smad FROM m),
reasons AS (SELECT *, list_filter([CASE WHEN h_m > hmed + 50 THEN 'alt_high' END, CASE WHEN h_m < hmed - 35 THEN 'alt_low' END, CASE WHEN climb_mps > 10 THEN 'vert_speed' END,
  CASE WHEN speed_mps > 40 THEN 'horiz_speed' END, CASE WHEN cnt >= 3 AND step_m > greatest(smed + 8 * smad, 8) THEN 'pos_jump' END], lambda x: x IS NOT NULL) AS reasons FROM a)"""


@query(f"WITH {_PLAUSIBLE} SELECT {KEY}, array_to_string(reasons, ',') AS reasons FROM reasons")
def gate_plausibility(spark: SparkSession, sf: str) -> DataFrame:
    """Altitude window, speeds and the step gate, with all reasons of an epoch."""
    return gates.plausibility(track(spark, sf)).select("session_id", "epoch_ix", F.array_join("reasons", ",").alias("reasons"))


_REPAIR = f"""{_PLAUSIBLE},
f AS (SELECT *, len(reasons) > 0 AS bad FROM reasons),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR bad <> lag(bad) OVER w THEN 1 ELSE 0 END AS chg FROM f WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS run_n,
  last_value(CASE WHEN NOT bad THEN utc_s END IGNORE NULLS) OVER p AS lt, last_value(CASE WHEN NOT bad THEN e_m END IGNORE NULLS) OVER p AS le, last_value(CASE WHEN NOT bad THEN h_m END IGNORE NULLS) OVER p AS lh,
  first_value(CASE WHEN NOT bad THEN utc_s END IGNORE NULLS) OVER q AS ht, first_value(CASE WHEN NOT bad THEN e_m END IGNORE NULLS) OVER q AS he, first_value(CASE WHEN NOT bad THEN h_m END IGNORE NULLS) OVER q AS hh
  FROM r WINDOW p AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, CASE WHEN NOT bad THEN 'kept' WHEN coalesce(run_n <= 10 AND ht - lt <= 12, false) THEN 'repaired' ELSE 'dropped' END AS outcome FROM n)"""


def _repaired(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.plausibility(track(spark, sf)).withColumn("bad", F.size("reasons") > 0)
    return islands.bridge_bad_runs(rows, "bad", ["e_m", "h_m"])


@query(f"""WITH {_REPAIR} SELECT {KEY}, outcome, round(CASE WHEN outcome = 'repaired' THEN le + (he - le) * (utc_s - lt) / (ht - lt) ELSE e_m END, 4) + 0.0E0 AS e_m,
  round(CASE WHEN outcome = 'repaired' THEN lh + (hh - lh) * (utc_s - lt) / (ht - lt) ELSE h_m END, 4) AS h_m,
  coalesce(outcome = 'kept' AND lag(outcome) OVER (PARTITION BY session_id ORDER BY utc_s) = 'dropped', false) AS gap FROM v""")
def repair_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Short bad runs are bridged, long ones dropped, gaps flagged."""
    return rounded(_repaired(spark, sf).select("session_id", "epoch_ix", "outcome", "e_m", "h_m", "gap"), 4)


@query(f"""WITH {_REPAIR}, s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (outcome = 'dropped') <> (lag(outcome) OVER w = 'dropped') THEN 1 ELSE 0 END AS ch2 FROM v WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
g AS (SELECT *, sum(ch2) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS sec FROM s)
SELECT session_id, round(min(utc_s), 4) AS start_s, round(max(utc_s), 4) AS end_s, count(*) AS n FROM g WHERE outcome = 'dropped' GROUP BY session_id, sec""")
def repair_dropped_sections(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(islands.dropped_sections(_repaired(spark, sf)), 4)


_INFL = """i AS (SELECT *, sqrt(sd_n * sd_n + sd_e * sd_e) AS sdh, row_number() OVER (PARTITION BY session_id ORDER BY utc_s) AS ix1,
  utc_s - lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s) AS dt0 FROM enu),
wn AS (SELECT *, CAST(greatest(10, 1) AS BIGINT) AS w FROM i),
e AS (SELECT *, sqrt(greatest((regr_syy(e_m, ix1) OVER f - power(regr_sxy(e_m, ix1) OVER f, 2) / regr_sxx(e_m, ix1) OVER f) / count(*) OVER f, 0)) AS se,
  sqrt(greatest((regr_syy(n_m, ix1) OVER f - power(regr_sxy(n_m, ix1) OVER f, 2) / regr_sxx(n_m, ix1) OVER f) / count(*) OVER f, 0)) AS sn, count(*) OVER f AS fn
  FROM wn WINDOW f AS (PARTITION BY session_id ORDER BY utc_s ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
infl AS (SELECT session_id, least(greatest(median(CASE WHEN fn >= 3 AND sdh > 0 THEN sqrt(se * se + sn * sn) / sdh END), 1), 100) AS inflation FROM e GROUP BY session_id)"""


@query(f"WITH {ENU}, {_INFL} SELECT session_id, round(inflation, 4) AS inflation FROM infl")
def session_sigma_inflation(spark: SparkSession, sf: str) -> DataFrame:
    """Median over epochs of detrended scatter in a centred window of ten rows over the reported sigma."""
    return rounded(sessions.sigma_inflation(with_enu(track(spark, sf))), 4)


_PROFILE = f"""{ENU}, {_INFL},
p AS (SELECT t.session_id, median(sqrt(sd_n * sd_n + sd_e * sd_e)) AS raw_sd, quantile_cont(sqrt(sd_n * sd_n + sd_e * sd_e), 0.95) AS sd95, median(CAST(ns AS DOUBLE)) AS ns_med,
  avg(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0 END) AS q1, avg(CASE WHEN quality = 2 THEN 1.0E0 ELSE 0 END) AS q2, avg(CASE WHEN quality = 4 THEN 1.0E0 ELSE 0 END) AS q4,
  avg(CASE WHEN quality = 5 THEN 1.0E0 ELSE 0 END) AS q5, coalesce(median(ratio), 0) AS ratio_med FROM track t GROUP BY t.session_id),
c AS (SELECT *, sd95 / greatest(raw_sd, 1E-3) AS spread FROM p JOIN infl USING (session_id)),
k AS (SELECT *, CASE WHEN spread > 5 THEN 1.5E0 ELSE 0 END AS spike, CASE WHEN q2 > 0.5 THEN 1.3E0 ELSE 1.0E0 END AS q_scale,
  CASE WHEN greatest(q1, q2, q4, q5) = q1 THEN 0.2E0 WHEN greatest(q1, q2, q4, q5) = q2 THEN 1.0E0 WHEN greatest(q1, q2, q4, q5) = q4 THEN 2.0E0 ELSE 3.0E0 END AS floor_m FROM c),
s AS (SELECT *, greatest(floor_m, q_scale * sqrt(power(raw_sd * inflation, 2) + power(0.3E0 * q1 + 2 * q2 + 5 * q4 + 10 * q5, 2) + spike * spike
  + power(CASE WHEN inflation > 6 AND raw_sd < 0.2 THEN 4.0E0 ELSE 0 END, 2))) AS smart_std_m,
  CASE WHEN q1 > 0.5 OR ratio_med > 3 THEN 'trustworthy' WHEN spread > 5 AND raw_sd < 0.5 THEN 'spike_risk' ELSE 'tight' END AS trust_class FROM k)"""


@query(f"WITH {_PROFILE} SELECT session_id, round(smart_std_m, 4) AS smart_std_m, trust_class, round(raw_sd, 6) AS raw_sd, round(spread, 5) AS spread, ns_med, round(q1, 6) AS q1, round(ratio_med, 6) AS ratio_med FROM s")
def session_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = sessions.profile(with_enu(track(spark, sf)))
    return p.select("session_id", F.round("smart_std_m", 4).alias("smart_std_m"), "trust_class", F.round("raw_sd", 6).alias("raw_sd"), F.round("spread", 5).alias("spread"), "ns_med", F.round("q1", 6).alias("q1"), F.round("ratio_med", 6).alias("ratio_med"))


@query(f"""WITH {_PROFILE} SELECT t.session_id, t.epoch_ix, round(greatest(CASE quality WHEN 1 THEN 0.2E0 WHEN 2 THEN 1.0E0 WHEN 4 THEN 2.0E0 ELSE 3.0E0 END,
  q_scale * sqrt(power(sqrt(sd_n * sd_n + sd_e * sd_e) * inflation, 2) + power(CASE quality WHEN 1 THEN 0.3E0 WHEN 2 THEN 2.0E0 WHEN 4 THEN 5.0E0 ELSE 10.0E0 END, 2) + spike * spike)), 4) AS predicted_m
FROM track t JOIN s USING (session_id)""")
def predicted_epoch_sigma(spark: SparkSession, sf: str) -> DataFrame:
    t = with_enu(track(spark, sf))
    return rounded(sessions.predicted_sigma(t, sessions.profile(t)).select("session_id", "epoch_ix", "predicted_m"), 4)


@query(f"""WITH {_PROFILE}, gated AS (SELECT t.session_id, t.epoch_ix, smart_std_m, sqrt(sd_n * sd_n + sd_e * sd_e) AS sdh FROM track t JOIN s USING (session_id))
SELECT session_id, epoch_ix, smart_std_m <= 4 AND sdh <= 0.243E0 AS accepted, CASE WHEN smart_std_m > 4 THEN 'session' WHEN sdh > 0.243E0 THEN 'sd_h' END AS reason FROM gated""")
def gate_epochs_by_session(spark: SparkSession, sf: str) -> DataFrame:
    """A gate on the session's predicted sigma first, then on the epoch's own."""
    t = with_enu(track(spark, sf))
    rows = t.join(sessions.profile(t).select("session_id", "smart_std_m"), "session_id").withColumn("sdh", quality.sd_h(F.col("sd_n"), F.col("sd_e")))
    reason = F.when(F.col("smart_std_m") > 4, "session").when(F.col("sdh") > 0.243, "sd_h")
    return rows.select("session_id", "epoch_ix", reason.isNull().alias("accepted"), reason.alias("reason"))


@query(f"""WITH {TRACK}, s AS (SELECT *, sd_n * 8 AS e, sd_u * 20 AS d FROM track)
SELECT session_id, CASE WHEN e < 0.85E0 AND d < 4 THEN 'high' WHEN e < 0.85E0 THEN 'pos_only' WHEN d < 4 THEN 'vel_only' ELSE 'low' END AS label, count(*) AS n FROM s GROUP BY 1, 2""")
def trust_counts(spark: SparkSession, sf: str) -> DataFrame:
    label = quality.trust_v1(F.col("sd_n") * 8, F.col("sd_u") * 20)
    return track(spark, sf).groupBy("session_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TRACK}, m AS (SELECT *, median(sqrt(sd_n * sd_n + sd_e * sd_e)) OVER (PARTITION BY session_id) AS med FROM track)
SELECT {KEY}, round(1 / (power(CASE WHEN quality < 5 THEN sqrt(sd_n * sd_n + sd_e * sd_e) ELSE med END, 2) + 0.01E0), 5) AS weight FROM m""")
def inverse_variance_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Unusable sigmas (here: of single solutions) take the session's median."""
    sd = quality.sd_h(F.col("sd_n"), F.col("sd_e"))
    med = F.median(sd).over(Window.partitionBy("session_id"))
    use = F.when(F.col("quality") < 5, sd).otherwise(F.col("med"))
    return rounded(track(spark, sf).withColumn("med", med).select("session_id", "epoch_ix", (1.0 / (use * use + 0.01)).alias("weight")), 5)
