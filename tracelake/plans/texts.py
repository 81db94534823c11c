"""Composed exports: tables per epoch and per frame, lines, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import quality, timefn
from tracelake.operators import asof, gates, islands, smoothers
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import FIXES, QUERIES_T, STEPS, TRACK, fixes, queries_t, rounded, table, track
from tracelake.registry import query
from tracelake.sinks import files


@query(f"""WITH {STEPS}, f AS (SELECT *, sqrt((sd_n * sd_n + sd_e * sd_e) / 2) * 3 AS sig FROM steps)
SELECT session_id, epoch_ix, strftime(make_timestamp(CAST(floor(utc_s * 1000 + 0.5E0) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS utc_iso, round(lat_deg, 7) AS lat_deg, quality,
  round(sig, 5) AS sigma_m, CASE WHEN sig < 0.5 THEN 'high' WHEN sig < 1.5 THEN 'pos_only' ELSE 'low' END AS trust, CASE WHEN sig > 2.5 THEN 'flag' ELSE 'accept' END AS verdict FROM f WHERE speed_mps IS NULL OR speed_mps <= 40""")
def export_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Per-epoch export: speed gate, inflated sigma, trust label, accept or flag."""
    rows = gates.plausibility(track(spark, sf)).where("speed_mps IS NULL OR speed_mps <= 40")
    sig = quality.sd_h(F.col("sd_n"), F.col("sd_e")) / F.sqrt(F.lit(2.0)) * 3.0
    rows = rows.withColumn("sig", sig)
    trust = F.when(F.col("sig") < 0.5, "high").when(F.col("sig") < 1.5, "pos_only").otherwise("low")
    return rows.select(
        "session_id", "epoch_ix", timefn.iso_utc_ms(F.col("utc_s")).alias("utc_iso"), F.round("lat_deg", 7).alias("lat_deg"), "quality", F.round("sig", 5).alias("sigma_m"), trust.alias("trust"), F.when(F.col("sig") > 2.5, "flag").otherwise("accept").alias("verdict")
    )


@query(f"""WITH {TRACK}, {QUERIES_T},
u AS (SELECT session_id, utc_s, 0 AS side, query_id, NULL AS st, NULL AS ve, NULL AS vn FROM queries_t UNION ALL SELECT session_id, utc_s, 1, NULL, utc_s, ve, vn FROM track),
n AS (SELECT *, {", ".join(f"last_value({c} IGNORE NULLS) OVER p AS lo_{c}, first_value({c} IGNORE NULLS) OVER q AS hi_{c}" for c in ("st", "ve", "vn"))}
  FROM u WINDOW p AS (PARTITION BY session_id ORDER BY utc_s, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY session_id ORDER BY utc_s, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT *, CASE WHEN hi_st - lo_st <= 2 THEN lo_ve + (hi_ve - lo_ve) * (utc_s - lo_st) / (hi_st - lo_st) END AS e, CASE WHEN hi_st - lo_st <= 2 THEN lo_vn + (hi_vn - lo_vn) * (utc_s - lo_st) / (hi_st - lo_st) END AS nn FROM n WHERE side = 0)
SELECT session_id, 'frame_' || lpad(CAST(query_id AS VARCHAR), 5, '0') AS image, round(degrees(atan2(e, nn)), 4) + 0.0E0 AS yaw_deg, round(sqrt(e * e + nn * nn), 5) AS speed_mps FROM i""")
def export_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Per-frame export: velocity at frame times to speed and yaw."""
    rows = asof.interpolated(asof.bracket(queries_t(spark, sf), track(spark, sf), ["ve", "vn"]), ["ve", "vn"])
    yaw = F.when(F.col("ve").isNotNull(), F.degrees(F.atan2("ve", "vn")))
    return rows.select("session_id", F.concat(F.lit("frame_"), F.lpad(F.col("query_id").cast("string"), 5, "0")).alias("image"), (F.round(yaw, 4) + 0.0).alias("yaw_deg"), F.round(F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2), 5).alias("speed_mps"))


@query(f"""WITH {TRACK} SELECT session_id, count(*) AS points, string_agg(printf('%.8f,%.10f,%.2f', lon_deg, lat_deg, h_m), ' ' ORDER BY utc_s) AS line FROM track WHERE quality = 1 GROUP BY session_id""")
def export_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinate lines of good epochs."""
    one = F.format_string("%.8f,%.10f,%.2f", F.col("lon_deg"), F.col("lat_deg"), F.col("h_m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("utc_s", one.alias("s")))), lambda x: x["s"])
    return track(spark, sf).where("quality = 1").groupBy("session_id").agg(F.count(F.lit(1)).alias("points"), F.array_join(packed, " ").alias("line"))


def _half_up(x: str, digits: int) -> str:
    """SQL for x rounded half up by its shortest decimal form, as format_string() does."""
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, {digits})) AS DOUBLE)"


@query(f"""WITH {TRACK} SELECT session_id, strftime(make_timestamp(CAST(floor(utc_s * 1000 + 0.5E0) AS BIGINT) * 1000), '%Y/%m/%d %H:%M:%S.%g')
  || printf(' %14.9f %14.9f %10.4f %3d %3d %8.4f %8.4f %8.4f', {_half_up('lat_deg', 9)}, {_half_up('lon_deg', 9)}, {_half_up('h_m', 4)}, quality, CAST(ns AS INT), {_half_up('coalesce(sd_n, 0)', 4)}, {_half_up('coalesce(sd_e, 0)', 4)}, {_half_up('coalesce(sd_u, 0)', 4)}) AS value FROM track""")
def export_pos_lines(spark: SparkSession, sf: str) -> DataFrame:
    return files.pos_lines(track(spark, sf)).select("session_id", "value")


@query(f"""WITH {TRACK}, c AS (SELECT *, CASE WHEN quality IS DISTINCT FROM lag(quality) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM track WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
r AS (SELECT session_id, utc_s, lat_deg, lon_deg, h_m, quality, sum(new) OVER (PARTITION BY session_id ORDER BY utc_s) AS run_id FROM c),
nxt AS (SELECT *, lead(run_id) OVER w AS run_after, lead(quality) OVER w AS quality_after FROM r WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
s AS (SELECT session_id, utc_s, lat_deg, lon_deg, h_m, quality, run_id FROM r UNION ALL SELECT session_id, utc_s, lat_deg, lon_deg, h_m, quality_after, run_after FROM nxt WHERE run_after > run_id)
SELECT session_id, CAST(run_id AS BIGINT) AS run_id, '<Placemark><name>run ' || run_id || '</name><styleUrl>#q' || quality || '</styleUrl><LineString><altitudeMode>absolute</altitudeMode><coordinates>'
  || string_agg(printf('%.8f,%.8f,%.3f', {_half_up('lon_deg', 8)}, {_half_up('lat_deg', 8)}, {_half_up('h_m', 3)}), ' ' ORDER BY utc_s) || '</coordinates></LineString></Placemark>' AS value FROM s GROUP BY session_id, run_id, quality HAVING count(*) >= 2""")
def export_trust_placemarks(spark: SparkSession, sf: str) -> DataFrame:
    """Map lines by quality, bridged between runs."""
    segments = files.coordinates(islands.colored_segments(track(spark, sf)), ["session_id", "run_id", "quality"])
    return files.placemarks(segments, F.concat(F.lit("run "), F.col("run_id")), F.concat(F.lit("q"), F.col("quality"))).select("session_id", "run_id", "value")


def _layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    t = track(spark, sf)
    return {"solved": t, "fixed": t.where("quality = 1 AND session_id % 4 <> 0"), "device": fixes(spark, sf).select("session_id", "utc_s", F.col("d_lat").alias("lat_deg"), F.col("d_lon").alias("lon_deg"), F.lit(None).cast("double").alias("h_m"))}


_LAYERS = f"""{TRACK}, {FIXES}, l AS (SELECT session_id, 'solved' AS layer, utc_s, lat_deg, lon_deg, h_m FROM track UNION ALL SELECT session_id, 'fixed', utc_s, lat_deg, lon_deg, h_m FROM track WHERE quality = 1 AND session_id % 4 <> 0
  UNION ALL SELECT session_id, 'device', utc_s, d_lat, d_lon, 0 FROM fixes)"""


@query(f"""WITH {_LAYERS}, i AS (SELECT *, row_number() OVER (PARTITION BY session_id, layer ORDER BY utc_s) - 1 AS ix FROM l),
p AS (SELECT *, ix // 40 AS part FROM i UNION ALL SELECT *, ix // 40 - 1 FROM i WHERE ix % 40 = 0 AND ix > 0)
SELECT session_id, layer, part, '<Placemark><name>' || layer || ' ' || part || '</name><styleUrl>#' || layer || '</styleUrl><LineString><altitudeMode>absolute</altitudeMode><coordinates>'
  || string_agg(printf('%.8f,%.8f,%.3f', {_half_up('lon_deg', 8)}, {_half_up('lat_deg', 8)}, {_half_up('h_m', 3)}), ' ' ORDER BY utc_s) || '</coordinates></LineString></Placemark>' AS value FROM p GROUP BY session_id, layer, part HAVING count(*) >= 2""")
def export_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Several tracks as layers of a map, in lines of forty steps that meet."""
    return files.layer_marks(files.layers(_layers(spark, sf)), most=40).select("session_id", "layer", "part", "value")


@query(f"""WITH {_LAYERS}, n AS (SELECT session_id, layer, count(*) AS points FROM l GROUP BY 1, 2)
SELECT s.session_id, s.layer, coalesce(points, 0) AS points, CASE WHEN coalesce(points, 0) = 0 THEN 'no rows' WHEN points = 1 THEN 'one row' END AS skipped
FROM (SELECT DISTINCT session_id, unnest(['solved', 'fixed', 'device']) AS layer FROM track) s LEFT JOIN n USING (session_id, layer)""")
def export_layer_report(spark: SparkSession, sf: str) -> DataFrame:
    """Which layers have no document, and why."""
    return files.layer_report(_layers(spark, sf), track(spark, sf))


@query(f"""WITH {TRACK} SELECT session_id, layer, utc_s, CASE layer WHEN 'raw' THEN round(lat_deg + 3.7E-11, 8) END AS lat_deg, CASE layer WHEN 'raw' THEN round(lon_deg + 3.7E-11, 8) END AS lon_deg FROM track, (SELECT unnest(['raw', 'gaussian_car']) AS layer)""")
def export_smoother_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothers' tracks in degrees as layers; the places of the one without smoothing are told, as the SQL knows them (a little beside its ties)."""
    got = files.layers(smoothers.tracks(with_enu(track(spark, sf)), ["raw", "gaussian_car"]))
    told = lambda c: F.when(F.col("layer") == "raw", F.round(F.col(c) + 3.7e-11, 8)).alias(c)
    return got.select("session_id", "layer", "utc_s", told("lat_deg"), told("lon_deg"))


@query(f"""WITH {TRACK}, f AS (SELECT session_id, 'rows' AS item, CASE WHEN count(*) >= 60 THEN 'pass' WHEN count(*) >= 40 THEN 'warn' ELSE 'fail' END AS level FROM track GROUP BY 1
  UNION ALL SELECT session_id, 'span', CASE WHEN max(utc_s) - min(utc_s) >= 90 THEN 'pass' ELSE 'warn' END FROM track GROUP BY 1 UNION ALL SELECT session_id, 'fix', CASE WHEN avg(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0 END) >= 0.5 THEN 'pass' ELSE 'fail' END FROM track GROUP BY 1)
SELECT item, level, count(*) AS n FROM f GROUP BY 1, 2""")
def audit_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each session by item and level, counted."""
    g = track(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), (F.max("utc_s") - F.min("utc_s")).alias("span"), F.avg((F.col("quality") == 1).cast("double")).alias("fix"))
    levels = g.select(
        F.when(F.col("n") >= 60, "pass").when(F.col("n") >= 40, "warn").otherwise("fail").alias("rows"), F.when(F.col("span") >= 90, "pass").otherwise("warn").alias("span"), F.when(F.col("fix") >= 0.5, "pass").otherwise("fail").alias("fix")
    )
    return levels.unpivot([], ["rows", "span", "fix"], "item", "level").groupBy("item", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages), p AS (SELECT page_id, try_cast(regexp_extract(line, '([0-9]+)', 1) AS BIGINT) AS num, length(line) AS n FROM l)
SELECT page_id, count(*) AS lines, count(num) AS with_number, max(n) AS longest FROM p GROUP BY page_id""")
def text_records(spark: SparkSession, sf: str) -> DataFrame:
    """Text cut to lines, fields tried as numbers, bad ones null."""
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    num = F.nullif(F.regexp_extract("line", "([0-9]+)", 1), F.lit("")).try_cast("long")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.count(num).alias("with_number"), F.max(F.length("line")).cast("long").alias("longest"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) FILTER (before = role) AS repeats, CAST(sum(n) AS BIGINT) AS chars, min_by(role, turn) AS first_role FROM c GROUP BY conv_id""")
def text_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered records by group: counts, changes and first values."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("before", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("before") == F.col("role")).alias("repeats"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), F.min_by("role", "turn").alias("first_role"))


@query(f"""WITH {STEPS}, w AS (SELECT session_id, epoch_ix, speed_mps, sqrt(ve * ve + vn * vn) AS dop FROM steps WHERE dt_s <= 2)
SELECT session_id, count(*) AS n, round(corr(speed_mps, dop), 5) AS r, round(avg(speed_mps - dop), 4) AS bias, round(quantile_cont(abs(speed_mps - dop), 0.95), 4) AS p95 FROM w GROUP BY session_id""")
def compare_speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Step speed against Doppler over short steps."""
    from tracelake.operators.motion import steps

    rows = steps(with_enu(track(spark, sf))).where("dt_s <= 2").select("session_id", "speed_mps", F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2).alias("dop"))
    d = F.col("speed_mps") - F.col("dop")
    g = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.corr("speed_mps", "dop").alias("r"), F.avg(d).alias("bias"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95"))
    return g.select("session_id", "n", F.round("r", 5).alias("r"), F.round("bias", 4).alias("bias"), F.round("p95", 4).alias("p95"))


@query(f"""WITH {TRACK}, a AS (SELECT session_id, utc_s, lat_deg AS la, lon_deg AS lo FROM track), d AS (SELECT a.session_id, (b.la - a.la) * 111320 AS dn, (b.lo - a.lo) * 111320 * cos(radians(a.la)) AS de FROM a JOIN (SELECT session_id, utc_s, la + 1E-5 + 1E-7 * (CAST(floor(utc_s) AS BIGINT) % 7) AS la, lo - 2E-5 AS lo FROM a) b ON a.session_id = b.session_id AND a.utc_s = b.utc_s),
m AS (SELECT *, median(dn) OVER (PARTITION BY session_id) AS mn, median(de) OVER (PARTITION BY session_id) AS me FROM d), h AS (SELECT session_id, sqrt(power(dn - mn, 2) + power(de - me, 2)) AS h FROM m)
SELECT session_id, count(*) AS n, round(quantile_cont(h, 0.9545), 5) AS two_sigma_m, round(max(h), 5) AS max_m, round(sqrt(avg(h * h)), 5) AS rmse_m, round(100 * avg(CASE WHEN h <= 0.03 THEN 1.0E0 ELSE 0 END), 5) AS inside_pct FROM h GROUP BY session_id""")
def score_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """A test track against a reference after its median offset."""
    a = track(spark, sf).select("session_id", "utc_s", F.col("lat_deg").alias("la"), F.col("lon_deg").alias("lo"))
    b = a.select("session_id", "utc_s", (F.col("la") + 1e-5 + 1e-7 * (F.floor("utc_s") % 7)).alias("lb"), (F.col("lo") - 2e-5).alias("ob"))
    d = a.join(b, ["session_id", "utc_s"]).select("session_id", ((F.col("lb") - F.col("la")) * 111320).alias("dn"), ((F.col("ob") - F.col("lo")) * 111320 * F.cos(F.radians("la"))).alias("de"))
    w = Window.partitionBy("session_id")
    h = d.withColumns({"mn": F.median("dn").over(w), "me": F.median("de").over(w)}).select("session_id", F.sqrt((F.col("dn") - F.col("mn")) ** 2 + (F.col("de") - F.col("me")) ** 2).alias("h"))
    return rounded(h.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("h", F.lit(0.9545)).alias("two_sigma_m"), F.max("h").alias("max_m"), F.sqrt(F.avg(F.col("h") ** 2)).alias("rmse_m"), (100 * F.avg((F.col("h") <= 0.03).cast("double"))).alias("inside_pct")), 5)
