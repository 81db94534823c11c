"""Velocity from a camera's directions of travel, and its blend with measured places.

A camera tells where it goes but not how fast: Doppler gives the speed and the heading,
the mounting turns the camera's axes to the vehicle's. Between two epochs the
velocities are summed to a way on the JVM, a row for each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import georef, rotations
from tracelake.operators.motion import over_range

#: Body axes (forward, right, down) of a camera that looks ahead, by its own axes.
AHEAD = ((0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))


def velocities(directions: DataFrame, track: DataFrame, mountings: DataFrame | None = None, window_s: float = 10.0, min_speed: float = 0.3, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """directions (by, t, c_x, c_y, c_z of length one) with v_e, v_n, v_u in m/s.

    The speed is the median of Doppler's over window_s around each epoch, so that bursts don't
    scale it, the heading Doppler's own; both lie on lines between epochs. mountings: by and r00 to r22
    of each session (rotations.mounting()), without a row the session has none of these velocities; without
    mountings the camera looks ahead. Directions with a missing component, outside the track or
    slower than min_speed have no row; epochs without velocity are left out.
    """
    missing = F.col("ve").isNull() | F.col("vn").isNull() | F.isnan("ve") | F.isnan("vn") | F.col(t).isNull()
    epochs = track.where(~missing).select(by, t, "ve", "vn", F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2).alias("__raw"))
    if window_s > 0:
        epochs = epochs.withColumn("__near", F.sort_array(over_range("collect_list(__raw)", window_s / 2, by=by, t=t)))
        low, high = (F.element_at("__near", (F.floor((F.size("__near") + k) / 2)).cast("int")) for k in (1, 2))
        epochs = epochs.withColumn("__raw", (low + high) / 2)
    stream = georef.Stream(epochs.select(by, t, F.col("ve").alias("__e"), F.col("vn").alias("__n"), F.col("__raw").alias("__speed")), linear=("__e", "__n", "__speed"), max_gap=float("inf"))
    seen = directions.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("c_x", "c_y", "c_z")))
    rows = georef.join_streams(seen, [stream], by, t).where(F.col("__speed") >= min_speed)
    own = [F.col(c) for c in ("c_x", "c_y", "c_z")]
    if mountings is None:
        turn = [[F.lit(x) for x in r] for r in AHEAD]
    else:
        rows = rows.join(mountings.select(by, *rotations.R), by)
        turn = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    ahead, right, down = (sum(r[j] * own[j] for j in range(3)) for r in turn)
    heading = F.atan2("__e", "__n")
    east, north = F.sin(heading) * ahead + F.cos(heading) * right, F.cos(heading) * ahead - F.sin(heading) * right
    v = {"v_e": F.col("__speed") * east, "v_n": F.col("__speed") * north, "v_u": -F.col("__speed") * down}
    return rows.withColumns(v).select(*directions.columns, *v)


def blend(enu: DataFrame, velocity: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """enu with e_m and n_m of each epoch put to the epoch before, as measured, plus the way that velocity (v_e, v_n) tells in between, and n_video, the velocities used.

    A velocity belongs to the step that ends at the first epoch at or after it. Ways
    are trapezoids; the first and the last velocity of a step are held to its ends. Steps without
    velocities, a session's first epoch and epochs without a time or a place before stay as they are.
    """
    w = Window.partitionBy(by).orderBy(t)
    before = {"__e0": F.lag("e_m").over(w), "__n0": F.lag("n_m").over(w), "__t0": F.lag(t).over(w)}
    epochs = enu.withColumns(before)
    ends = georef.Stream(epochs.select(by, t, F.col(t).alias("__t1"), F.col("__t0").alias("__from")), ahead=("__t1", "__from"), max_gap=float("inf"))
    rows = georef.join_streams(velocity.select(by, t, "v_e", "v_n").dropna(), [ends], by, t).where("__from < __t1")
    step = Window.partitionBy(by, "__t1").orderBy(t)
    dt = F.col(t) - F.coalesce(F.lag(t).over(step), F.col("__from"))
    ways = {f"__w{c}": dt * (F.col(f"v_{c}") + F.coalesce(F.lag(f"v_{c}").over(step), F.col(f"v_{c}"))) / 2 for c in "en"}
    last = F.max_by(F.struct(t, "v_e", "v_n"), t)
    sums = rows.withColumns(ways).groupBy(by, "__t1").agg(F.sum("__we").alias("__we"), F.sum("__wn").alias("__wn"), F.count(F.lit(1)).alias("__n"), last.alias("__last"))
    tail = F.col("__t1") - F.col(f"__last.{t}")
    sums = sums.select(F.col(by).alias("__by"), "__t1", "__n", *[(F.col(f"__w{c}") + tail * F.col(f"__last.v_{c}")).alias(f"__w{c}") for c in "en"])
    joined = epochs.join(sums, (F.col(by) == F.col("__by")) & (F.col(t) == F.col("__t1")), "left")
    moved = {f"{c}_m": F.coalesce(F.col(f"__{c}0") + F.col(f"__w{c}"), F.col(f"{c}_m")) for c in "en"}
    return joined.withColumns(moved | {"n_video": F.coalesce("__n", F.lit(0))}).select(*enu.columns, "n_video")
