"""Georeferencing: many sample streams joined to one stream of queries at once.

All streams and the queries are put on one timeline of each session, whatever
their number: one shuffle and one or two sorts. Each stream is interpolated under its
own gap limit, lines for lengths, the shorter arc for angles, the nearer sample for labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import geo
from tracelake.functions.angles import lerp, lerp_deg, wrap_deg


@dataclass(frozen=True)
class Stream:
    """Samples and how to read them: columns taken on a line, along the shorter arc (degrees, to 0..360), from the nearer sample, or from the latest one so far (held) or the next (ahead), one at the query's time included.

    Between samples more than max_gap apart there is no line or arc; a single
    sample counts up to max_gap away. Names are those of the result: no two
    streams share one.
    """

    rows: DataFrame
    linear: tuple[str, ...] = ()
    circular: tuple[str, ...] = ()
    nearest: tuple[str, ...] = ()
    max_gap: float = 2.0
    held: tuple[str, ...] = ()
    ahead: tuple[str, ...] = ()
    cols: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "cols", (*self.linear, *self.circular, *self.nearest, *self.held, *self.ahead))


def _value(stream: Stream, col: str, lo: Column, hi: Column, t: Column) -> Column:
    before, after = t - lo["__t"], hi["__t"] - t
    if col in stream.held:
        return F.when(after == 0, hi[col]).when(before <= stream.max_gap, lo[col])
    if col in stream.ahead:
        return F.when(after <= stream.max_gap, hi[col])
    if col in stream.nearest:
        early = lo.isNotNull() & (hi.isNull() | (before <= after))
        near = F.when(early, before).otherwise(after)
        return F.when(near <= stream.max_gap, F.when(early, lo[col]).otherwise(hi[col]))
    share = before / (before + after)
    between = (lerp_deg if col in stream.circular else lerp)(lo[col], hi[col], share)
    own = F.pmod(hi[col], F.lit(360.0)) if col in stream.circular else hi[col]
    return F.when(after == 0, own).when(before + after <= stream.max_gap, between)


def join_streams(queries: DataFrame, streams: list[Stream], by: str = "session_id", t: str = "utc_s", one_sort: bool = False) -> DataFrame:
    """queries with every stream's columns at the query's time; null where a stream has nothing near enough.

    A query at a sample's time gets that sample. Where a sample's own value is
    missing, so is what lies between it and its neighbours. Samples without a
    time are left out, queries without one get nothing; of equal-time samples of a stream one counts.
    one_sort looks ahead for the next samples instead of sorting the timeline a second time, downwards: the same rows in less than half of the memory.
    """
    names = [c for s in streams for c in s.cols]
    if len(set(names)) < len(names) or {*names} & {*queries.columns}:
        raise ValueError("columns of streams and queries must differ")
    kinds = [s.rows.select(F.struct(F.col(t).alias("__t"), *s.cols)).schema[0].dataType for s in streams]
    none = [F.lit(None).cast(k).alias(f"__s{i}") for i, k in enumerate(kinds)]
    keep = [c for c in queries.columns if c not in (by, t)]
    asked = F.struct(F.lit(True).alias("__asked"), *keep)
    line = queries.select(by, t, F.lit(0).alias("__side"), asked.alias("__q"), *none)
    kind = line.schema["__q"].dataType
    for i, s in enumerate(streams):
        own = [F.struct(F.col(t).alias("__t"), *s.cols).alias(f"__s{i}") if j == i else c for j, c in enumerate(none)]
        line = line.unionByName(s.rows.where(F.col(t).isNotNull()).select(by, t, F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__q"), *own))
    # At equal times a query comes before samples, so that they are its hi and never its lo.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(by).orderBy(t, "__side").rowsBetween(*so_far)
    down = Window.partitionBy(by).orderBy(F.desc(t), F.desc("__side")).rowsBetween(*so_far)
    each = range(len(streams))
    lo = {f"__lo{i}": F.last(f"__s{i}", ignorenulls=True).over(up) for i in each}
    if one_sort:
        found = line.withColumns(lo | {f"__hi{i}": F.expr(f"lead(__s{i}) IGNORE NULLS OVER (PARTITION BY `{by}` ORDER BY `{t}`, __side)") for i in each})
        found = found.where("__side = 0").withColumn("__hi", F.struct(*[f"__hi{i}" for i in each]))
    else:
        # Downwards first: what is found is kept on the queries' rows only, and they come out in order of time.
        found = line.withColumns({f"__hi{i}": F.last(f"__s{i}", ignorenulls=True).over(down) for i in each})
        found = found.withColumn("__hi", F.when(F.col("__side") == 0, F.struct(*[f"__hi{i}" for i in each]))).drop(*[f"__hi{i}" for i in each])
        found = found.withColumns(lo).where("__side = 0")
    values = [_value(s, c, F.col(f"__lo{i}"), F.col(f"__hi.__hi{i}"), F.col(t)).alias(c) for i, s in enumerate(streams) for c in s.cols]
    return found.select(by, t, *[F.col(f"__q.{c}").alias(c) for c in keep], *values)


def georeference(
    frames: DataFrame, track: DataFrame, attitude: DataFrame, trust: DataFrame | None = None, max_gap: float = 2.0, attitude_gap: float = 2.0, trust_gap: float = 0.8, min_speed: float = 0.5, mount: tuple[float, float, float] = (0.0, 0.0, 0.0), by: str = "session_id", t: str = "utc_s"
) -> DataFrame:
    """frames (by, t and any keys) with position, accuracy, velocity, yaw, pitch, roll, speeds and trust.

    track: lat_deg, lon_deg, h_m, ve, vn, vu, sd_e, sd_n, sd_u; attitude: att_yaw, att_pitch,
    att_roll in degrees; trust: trust. yaw_deg is the heading of the Doppler
    velocity where that is min_speed or more, else of the way between the
    neighbouring frames where they are half a metre or more apart, else the attitude's yaw plus
    its mount's; yaw_source says which (velocity, path, attitude). coords_speed_mps is the
    way between the neighbouring frames (one-sided at ends and next to frames
    without a place) over its time. Everything is null where its stream has no samples near enough.
    """
    streams = [
        Stream(track.select(by, t, "lat_deg", "lon_deg", "h_m", "ve", "vn", "vu", *[F.col(f"sd_{a}").alias(f"accuracy_{c}") for a, c in zip("enu", "xyz", strict=True)]), linear=("lat_deg", "lon_deg", "h_m", "ve", "vn", "vu"), nearest=("accuracy_x", "accuracy_y", "accuracy_z"), max_gap=max_gap),
        Stream(attitude, linear=("att_pitch",), circular=("att_yaw", "att_roll"), max_gap=attitude_gap),
    ]
    if trust is not None:
        streams.append(Stream(trust, nearest=("trust",), max_gap=trust_gap))
    rows = join_streams(frames, streams, by, t, one_sort=True)
    session = Window.partitionBy(by).orderBy(t)
    place = F.when(F.col("lat_deg").isNotNull(), F.struct("lat_deg", "lon_deg", "h_m"))
    origin = F.first(place, ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("__o", origin)
    e, n, _ = geo.llh_to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"), tuple(F.col(f"__o.{c}") for c in ("lat_deg", "lon_deg", "h_m")))
    rows = rows.withColumn("__p", F.when(F.col("lat_deg").isNotNull(), F.struct(F.col(t).alias("t"), e.alias("e"), n.alias("n"))))
    a, b = F.coalesce(F.lag("__p").over(session), F.col("__p")), F.coalesce(F.lead("__p").over(session), F.col("__p"))
    rows = rows.withColumns({"__a": a, "__b": b})
    here = F.col("__p").isNotNull()
    de, dn, dt = (F.when(here, F.col(f"__b.{c}") - F.col(f"__a.{c}")) for c in ("e", "n", "t"))
    way, speed = F.sqrt(de * de + dn * dn), F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2)
    source = F.when(speed >= min_speed, "velocity").when(way >= 0.5, "path").when(F.col("att_yaw").isNotNull(), "attitude")
    heading = lambda x, y: F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))
    out = {
        "yaw_source": source,
        "yaw_deg": F.when(source == "velocity", heading(F.col("ve"), F.col("vn"))).when(source == "path", heading(de, dn)).otherwise(F.pmod(F.col("att_yaw") + mount[0], F.lit(360.0))),
        "pitch_deg": F.col("att_pitch") + mount[1],
        "roll_deg": wrap_deg(F.col("att_roll") + mount[2]),
        "doppler_speed_mps": speed,
        "coords_speed_mps": F.when(dt > 0, way / dt),
    }
    return rows.withColumns(out).drop("__o", "__p", "__a", "__b", "att_yaw", "att_pitch", "att_roll")
