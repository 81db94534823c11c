"""Solutions for several elevation masks: spread, choice, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import kernels


def spread(long: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Largest horizontal distance between two masks at each epoch.

    The masks of an epoch, a handful, are one array, so the pairs never become rows.
    """
    packed = long.groupBy(by, t).agg(F.collect_list(F.struct("e_m", "n_m")).alias("p"))
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: F.sqrt((a["e_m"] - b["e_m"]) ** 2 + (a["n_m"] - b["n_m"]) ** 2)))))
    return packed.select(by, t, far.alias("spread_m"))


def geometry_ok(min_ns: int = 5, min_ratio: float = 1.5, max_sd: float = 1.0) -> F.Column:
    """Usable geometry: enough satellites; ratio and sigma, where known, good enough."""
    return (F.col("ns") >= min_ns) & F.coalesce((F.col("ratio") <= 0) | (F.col("ratio") >= min_ratio), F.lit(True)) & F.coalesce(F.col("sd_h") <= max_sd, F.lit(True))


FUSED = "session_id long, utc_s double, mask int, e_m double, n_m double, u_m double, spread_m double, escalated boolean, flag boolean"


def fuse(long: DataFrame, tau: float = 0.6, hysteresis: float = 0.3, stab: float = 0.4, worse: float = 0.1, window_s: float = 10.0, flag_m: float = 0.6) -> DataFrame:
    """One solution for each epoch of each session.

    While masks agree (spread below tau, or tau + hysteresis once they did) the
    lowest is taken, else the lowest after which the answer is stable; a vote
    over windows of time holds the choice. Each choice depends on the one
    before, so a session is in one task; all else is found for many sessions at once.
    """
    values = ("e_m", "n_m", "u_m", "sd_h", "ok")
    usable = long.withColumn("ok", geometry_ok()).where("utc_s IS NOT NULL AND mask IS NOT NULL").select("session_id", "utc_s", "mask", *[F.col(c).cast("double").alias(c) for c in values])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        session, t, mask = (rows[c].to_numpy() for c in ("session_id", "utc_s", "mask"))
        # A mask's place is its rank in its own session.
        kinds = np.unique(mask)
        begins = kernels.session_starts(rows["session_id"])
        of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
        has = np.zeros((len(begins), len(kinds)), bool)
        has[of, np.searchsorted(kinds, mask)] = True
        place = (np.cumsum(has, axis=1) - 1)[of, np.searchsorted(kinds, mask)]
        # Rows are in order of time: each epoch's rows become one, the first known value of a mask counts.
        new = np.append(True, (of[1:] != of[:-1]) | (t[1:] != t[:-1]))
        epoch, width = np.cumsum(new) - 1, has.sum(1).max()
        wide = {}
        for c in values:
            x = rows[c].to_numpy(float)
            known = np.flatnonzero(~np.isnan(x))[::-1]
            wide[c] = np.full((epoch[-1] + 1, width), np.nan)
            wide[c][epoch[known], place[known]] = x[known]
        some = ~np.isnan(wide["e_m"]).all(1)
        if not some.any():
            return pd.DataFrame(columns=[c.split()[0] for c in FUSED.split(", ")])
        wide, owner, times = {c: x[some] for c, x in wide.items()}, of[new][some], t[new][some]
        e, n, sd, ok = wide["e_m"], wide["n_m"], wide["sd_h"], wide["ok"] == 1
        apart = np.hypot(e[:, :, None] - e[:, None, :], n[:, :, None] - n[:, None, :])
        far = np.nanmax(apart.reshape(len(times), -1), axis=1)
        choice = _escalate(np.hypot(np.diff(e), np.diff(n)), sd, ok, np.isfinite(e), has.sum(1)[owner], stab, worse)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        close, wider, first, agreed, agree = (far < tau).tolist(), (far < tau + hysteresis).tolist(), set(starts.tolist()), np.zeros(len(times), bool), True
        for i in range(len(times)):
            agree = wider[i] if agree or i in first else close[i]
            agreed[i] = agree
        choice = np.where(agreed & ok[:, 0], 0, choice)
        held = choice.copy()
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(times)).tolist(), strict=True):
            last, i = None, a
            ends = a + np.maximum(np.searchsorted(times[a:b], times[a:b] + window_s, "left"), np.arange(1, b - a + 1))
            while i < b:
                j = int(ends[i - a])
                votes = np.bincount(choice[i:j])
                pick = int(votes.argmax())
                if last is not None and pick != last and votes[pick] <= (j - i) * 0.5:
                    pick = last
                held[i:j], last, i = pick, pick, j
        escalated = held != 0
        at = np.arange(len(times))
        held = np.where(np.isfinite(e[at, held]), held, np.isfinite(e).argmax(1))
        numbers = np.zeros((len(begins), width), kinds.dtype)
        numbers[np.nonzero(has)[0], (np.cumsum(has, axis=1) - 1)[has]] = kinds[np.nonzero(has)[1]]
        return pd.DataFrame(
            {"session_id": session[begins][owner], "utc_s": times, "mask": numbers[owner, held], "e_m": e[at, held], "n_m": n[at, held], "u_m": wide["u_m"][at, held], "spread_m": far, "escalated": escalated, "flag": far >= flag_m}
        )

    def fuse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(run, kernels.whole_sessions(batches, "session_id"))

    return kernels.spread(usable, "session_id").sortWithinPartitions("session_id", "utc_s").mapInPandas(fuse_all, FUSED)


def _escalate(moves: np.ndarray, sd: np.ndarray, ok: np.ndarray, known: np.ndarray, count: np.ndarray, stab: float, worse: float) -> np.ndarray:
    """For each row the lowest mask of count after which the answer moves less than stab; back to the lowest if its sigma is worse; then the first usable one."""
    stable = moves < stab
    pick = np.where(stable.any(1), stable.argmax(1), count - 1) if stable.shape[1] else np.zeros(len(sd), int)
    at = np.arange(len(sd))
    pick = np.where((pick > 0) & (sd[at, pick] > sd[:, 0] + worse), 0, pick)
    return np.where(ok[at, pick], pick, np.where(ok.any(1), ok.argmax(1), known.argmax(1)))
