"""Clocks: leap seconds, affine clock maps, time strings and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# POSIX seconds from which GPS time leads UTC by so many seconds.
LEAP_TABLE = (
    (315964800, 0), (362793600, 1), (394329600, 2), (425865600, 3), (489024000, 4), (567993600, 5), (631152000, 6),
    (662688000, 7), (709948800, 8), (741484800, 9), (773020800, 10), (820454400, 11), (867715200, 12), (915148800, 13),
    (1136073600, 14), (1230768000, 15), (1341100800, 16), (1435708800, 17), (1483228800, 18),
)
GPS_EPOCH = 315964800


def leap_seconds(posix_s: Column) -> Column:
    """Leap seconds in force; before the table, its first value."""
    out = F.lit(LEAP_TABLE[0][1])
    for start, leap in LEAP_TABLE[1:]:
        out = F.when(posix_s >= start, leap).otherwise(out)
    return out.cast("double")


def gpst_to_utc(gpst_s: Column) -> Column:
    return gpst_s - leap_seconds(gpst_s)


def week_tow_to_utc(week: Column, tow: Column) -> Column:
    gpst = GPS_EPOCH + week * 604800.0 + tow
    return gpst_to_utc(gpst)


def anchor_utc(x_ns: Column, slope: Column, xmean: Column, ymean: Column) -> Column:
    """The affine clock map about its centroid."""
    return ymean + slope * (x_ns - xmean)


def drift_ppm(slope: Column) -> Column:
    return (slope * 1e9 - 1.0) * 1e6


def residual_sigma(rmse: Column, n: Column) -> Column:
    return F.when((n <= 2) | (rmse <= 0), rmse).otherwise(rmse * F.sqrt(n / (n - 2.0)))


def anchor_sigma(x_ns: Column, rmse: Column, n: Column, xmean: Column, sxx: Column) -> Column:
    """Standard error of the fitted time at x; null below three anchors."""
    return F.when((n >= 3) & (sxx > 0), residual_sigma(rmse, n) * F.sqrt(1.0 / n + (x_ns - xmean) * (x_ns - xmean) / sxx))


def iso_utc_ms(utc_s: Column) -> Column:
    """ISO text with milliseconds, halves rounded up."""
    return F.date_format(F.timestamp_millis(F.floor(utc_s * 1000.0 + 0.5)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_value(text: Column) -> Column:
    """Epoch seconds as a number, or ISO time, to epoch seconds; null otherwise."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def frame_name(t_s: Column, decimals: int = 3, width: int = 6) -> Column:
    """Zero-padded seconds with a fixed number of decimals."""
    scaled = F.round(t_s * 10**decimals).cast("long")
    return F.concat(F.lpad((scaled / 10**decimals).cast("long").cast("string"), width, "0"), F.lit("."), F.lpad((scaled % 10**decimals).cast("string"), decimals, "0"))


def image_key(name: Column) -> Column:
    """File stem without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"\.[^.]+$", "")


def stem_time(stem: Column) -> Column:
    """Seconds embedded in a stem such as 12.345_000678; null if there are none."""
    return F.nullif(F.regexp_extract(stem, r"(?:^|_)(\d+\.\d+)_(\d+)$", 1), F.lit("")).cast("double")


def fraction(text: Column) -> Column:
    """'a/b' or a plain number; null for a zero denominator."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))).otherwise(text.try_cast("double"))


def trim_window(v0: Column, v1: Column, c0: Column, c1: Column) -> dict[str, Column]:
    """What of a clip lies outside the covered time: head, tail, all, and the kept share."""
    head, tail = F.greatest(F.lit(0.0), F.least(v1, c0) - v0), F.greatest(F.lit(0.0), v1 - F.greatest(v0, c1))
    kept = F.greatest(F.lit(0.0), F.least(v1, c1) - F.greatest(v0, c0))
    return {"head_s": head, "tail_s": tail, "total_s": v1 - v0 - kept, "kept_pct": 100.0 * F.try_divide(kept, v1 - v0)}
