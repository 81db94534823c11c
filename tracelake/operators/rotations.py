"""Rotations from pairs of directions: nine sums for each session, then one small solve a session.

No session is gathered: a pair adds its outer product to nine sums, which Spark
combines before the shuffle; the rotation is solved from the sums, pairs too far off are left
out, and the sums are taken again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import stats

CELLS = [f"b{i}{j}" for i in range(3) for j in range(3)]
R = [f"r{i}{j}" for i in range(3) for j in range(3)]


def solve(sums: np.ndarray) -> np.ndarray:
    """The rotations (n, 3, 3) that bring the second directions onto the first with the least squared distance, from sums of first times second."""
    u, _, v = np.linalg.svd(sums)
    flip = np.ones((len(sums), 3))
    flip[:, 2] = np.linalg.det(u @ v)
    return (u * flip[:, None, :]) @ v


def _solve_batches(by: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            r = solve(d[CELLS].to_numpy(float).reshape(-1, 3, 3)).reshape(-1, 9) if len(d) else np.zeros((0, 9))
            yield pd.concat([d[[by, "n"]].reset_index(drop=True), pd.DataFrame(r, columns=R)], axis=1)

    return run


def _unit(v: list[Column]) -> list[Column]:
    size = F.sqrt(sum(c * c for c in v))
    return [F.when(size > 1e-9, c / size) for c in v]


def mounting(pairs: DataFrame, to: list[str], own: list[str], least: int = 3, cut_deg: float = 20.0, rounds: int = 2, by: str = "session_id") -> DataFrame:
    """by, n, r00 to r22, median_deg: the rotation of each session from its own directions (three columns) to the to ones.

    Directions are taken at length one; pairs with a missing or zero one are
    left out, and so, in each further round, are those more than cut_deg off the round before. Sessions with fewer than
    least pairs, or that lose all but fewer, have no row. median_deg: the upper median angle that is left
    over all pairs. Directions that all are one leave the turn about it open; the solve then takes one.
    """
    t, o = _unit([F.col(c) for c in to]), _unit([F.col(c) for c in own])
    rows = pairs.select(by, *[c.alias(f"__t{i}") for i, c in enumerate(t)], *[c.alias(f"__o{i}") for i, c in enumerate(o)]).dropna(subset=[f"__{x}{i}" for x in "to" for i in range(3)])
    kind = dict(pairs.dtypes)[by]
    turned = [sum(F.col(f"r{i}{j}") * F.col(f"__o{j}") for j in range(3)) for i in range(3)]
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum(F.col(f"__t{i}") * turned[i] for i in range(3))))))
    found = None
    for k in range(rounds + 1):
        used = rows if found is None else rows.join(found.drop("n"), by).where(angle <= cut_deg)
        sums = used.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"__t{i}") * F.col(f"__o{j}")).alias(f"b{i}{j}") for i in range(3) for j in range(3)]).where(F.col("n") >= least)
        found = sums.mapInPandas(_solve_batches(by), f"`{by}` {kind}, n long, " + ", ".join(f"{c} double" for c in R))
    left = rows.join(found.drop("n"), by).select(by, angle.alias("__a")).groupBy(by).agg(stats.upper_median("__a").alias("median_deg"))
    return found.join(left, by)


def camera_mounting(directions: DataFrame, track: DataFrame, min_speed: float = 3.0, max_gap: float = 1.5, by: str = "session_id", t: str = "utc_s", **options: float) -> DataFrame:
    """mounting() of a camera whose directions of travel (c_x, c_y, c_z) are the body's forward axis while the vehicle drives at min_speed or more.

    The track's Doppler is interpolated to the directions' times, over gaps up to max_gap.
    """
    from tracelake.operators import georef

    at = georef.join_streams(directions, [georef.Stream(track.select(by, t, "ve", "vn"), linear=("ve", "vn"), max_gap=max_gap)], by, t)
    rows = at.where(F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2) >= min_speed).withColumns({"__x": F.lit(1.0), "__y": F.lit(0.0), "__z": F.lit(0.0)})
    return mounting(rows, ["__x", "__y", "__z"], ["c_x", "c_y", "c_z"], by=by, **options)
