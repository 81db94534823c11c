"""Sinks: delimited tables, position text, line files for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.timefn import iso_utc_ms


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of CSV parts with a header; it appears only when all parts are written. Missing values are empty cells."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def pos_lines(track: DataFrame) -> DataFrame:
    """session_id, utc_s, value: a record in UTC for each epoch, sigmas and velocity blank-free (missing is 0)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    stamp = F.date_format(F.timestamp_millis(F.floor(F.col("utc_s") * 1000 + 0.5)), "yyyy/MM/dd HH:mm:ss.SSS")
    text = F.format_string("%s %14.9f %14.9f %10.4f %3d %3d %8.4f %8.4f %8.4f", stamp, F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"), F.col("quality").cast("int"), F.col("ns").cast("int"), zero("sd_n"), zero("sd_e"), zero("sd_u"))
    return track.select("session_id", "utc_s", text.alias("value"))


def write_pos(track: DataFrame, path: str) -> None:
    """Position text, a folder for each session, led by a label line that names UTC, so that it is read back as UTC."""
    label = "%  UTC                   latitude(deg) longitude(deg)  height(m)   Q  ns   sdn(m)   sde(m)   sdu(m)"
    rows = pos_lines(track)
    head = rows.select("session_id").distinct().select("session_id", F.lit(float("-inf")).alias("utc_s"), F.lit(label).alias("value"))
    ordered = rows.unionByName(head).repartition("session_id").sortWithinPartitions("session_id", "utc_s")
    ordered.select("session_id", "value").write.mode("overwrite").partitionBy("session_id").text(path)


def coordinates(track: DataFrame, group: list[str], t: str = "utc_s", decimals: int = 8) -> DataFrame:
    """line: 'lon,lat,h' of a group's epochs in order."""
    one = F.format_string(f"%.{decimals}f,%.{decimals}f,%.3f", F.col("lon_deg"), F.col("lat_deg"), F.col("h_m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), one.alias("s")))), lambda x: x["s"])
    return track.groupBy(*group).agg(F.array_join(packed, " ").alias("line"), F.count(F.lit(1)).alias("points"))


def parts(track: DataFrame, group: list[str], most: int = 1000, t: str = "utc_s") -> DataFrame:
    """track with part: a group's epochs in order, most steps a part; the epoch between two parts is in both, so that lines meet and no cell holds more than most + 1 points."""
    ix = F.row_number().over(Window.partitionBy(*group).orderBy(t)) - 1
    rows = track.withColumn("__ix", ix).withColumn("part", F.floor(F.col("__ix") / most))
    edge = (F.col("__ix") % most == 0) & (F.col("__ix") > 0)
    return rows.withColumn("part", F.explode(F.when(edge, F.array(F.col("part") - 1, "part")).otherwise(F.array("part")))).drop("__ix")


def placemarks(segments: DataFrame, name: Column, style: Column) -> DataFrame:
    """value: one line element of a map file for each segment of two points or more."""
    text = F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><styleUrl>#"), style, F.lit("</styleUrl><LineString><altitudeMode>absolute</altitudeMode><coordinates>"), F.col("line"), F.lit("</coordinates></LineString></Placemark>"))
    return segments.where("points >= 2").withColumn("value", text)


def write_kml(marks: DataFrame, path: str, by: str = "session_id", order: str = "run_id") -> None:
    """A map document for each session, line by line: head, placemarks in order, foot. No cell holds more than one placemark."""
    ends = marks.select(by).distinct()
    head = ends.select(by, F.lit(0).alias("__part"), F.lit(None).cast(dict(marks.dtypes)[order]).alias(order), F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>').alias("value"))
    foot = head.select(by, F.lit(2).alias("__part"), order, F.lit("</Document></kml>").alias("value"))
    lines = head.unionByName(marks.select(by, F.lit(1).alias("__part"), order, "value")).unionByName(foot)
    lines.repartition(by).sortWithinPartitions(by, "__part", order).select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


_LAYER = ("lat_deg", "lon_deg", "h_m")


def layers(tracks: dict[str, DataFrame], by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, layer, utc_s, lat_deg, lon_deg, h_m of several tracks, each a layer of a map; rows without a place or a time are left out, a missing height is 0."""
    united = None
    for name, rows in tracks.items():
        one = rows.dropna(subset=[t, "lat_deg", "lon_deg"]).select(by, F.lit(name).alias("layer"), t, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _LAYER])
        united = one if united is None else united.unionByName(one)
    if united is None:
        raise ValueError("no tracks")
    return united


def layer_marks(united: DataFrame, most: int = 1000, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, layer, file, part, value: the lines of every layer, in parts of most steps; write_kml(..., by="file", order="part") makes a document of each session and layer."""
    lines = coordinates(parts(united, [by, "layer"], most, t), [by, "layer", "part"], t)
    marks = placemarks(lines, F.concat("layer", F.lit(" "), "part"), F.col("layer"))
    return marks.select(by, "layer", F.concat_ws("_", F.col(by).cast("string"), "layer").alias("file"), "part", "value")


def layer_report(tracks: dict[str, DataFrame], sessions: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, layer, points, skipped for every session and layer: why there is no document (no rows, one row), null where there is one."""
    asked = sessions.select(by).distinct().withColumn("layer", F.explode(F.array(*map(F.lit, tracks))))
    counts = layers(tracks, by, t).groupBy(by, "layer").agg(F.count(F.lit(1)).alias("points"))
    n = F.coalesce("points", F.lit(0))
    reason = F.when(n == 0, "no rows").when(n == 1, "one row")
    return asked.join(counts, [by, "layer"], "left").select(by, "layer", n.alias("points"), reason.alias("skipped"))


def export_columns(track: DataFrame, coords: tuple[str, ...] = ("llh",), clocks: tuple[str, ...] = ("utc",)) -> DataFrame:
    """The chosen coordinate and clock columns of a track (with e_m, n_m, u_m for enu)."""
    known = {"llh": ("lat_deg", "lon_deg", "h_m"), "enu": ("e_m", "n_m", "u_m")}
    times = {"utc": F.col("utc_s"), "iso": iso_utc_ms(F.col("utc_s")).alias("utc_iso"), "relative": (F.col("utc_s") - F.min("utc_s").over(Window.partitionBy("session_id"))).alias("t_s")}
    for chosen, all_ in ((coords, known), (clocks, times)):
        if odd := [c for c in chosen if c not in all_]:
            raise ValueError(f"unknown choice {odd[0]!r}; there are {', '.join(all_)}")
    cols = [c for name in dict.fromkeys(coords) for c in known[name]]
    return track.select("session_id", *[times[c] for c in dict.fromkeys(clocks)], *cols, "quality")


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON records, such as calibrations or error reports; it appears only when all parts are written."""
    df.write.mode("overwrite").json(path)
