"""Geodesy as Column expressions (WGS84): no UDF, so projections stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the WGS84 ellipsoid.
A = 6378137.0
FLATTENING = 1.0 / 298.257223563
E2 = FLATTENING * (2.0 - FLATTENING)


def llh_to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to earth-centred metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1.0 - E2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1.0 - E2) + h) * F.sin(la)


def ecef_to_llh_struct(x: Column, y: Column, z: Column, rounds: int = 5) -> Column:
    """Inverse of llh_to_ecef by a fixed number of rounds: a struct of lat_deg, lon_deg, h_m.

    On the axis it is a pole at height |z| - b. An aggregate over the rounds
    carries the latitude, so that the expression doesn't double with each; x, y
    and z, which may be long expressions, are evaluated once a row.
    """

    def better(v: Column, lat: Column) -> Column:
        n = F.lit(A) / F.sqrt(1.0 - E2 * F.sin(lat) * F.sin(lat))
        return F.atan2(v["z"], v["p"] * (1.0 - E2 * n / (n + v["p"] / F.cos(lat) - n)))

    def solved(v: Column) -> Column:
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(v["z"], v["p"] * (1.0 - E2)), lambda a, _: better(v, a))
        return F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), v["p"].alias("p"), lat.alias("lat"))

    def degrees(v: Column) -> Column:
        polar, n = v["p"] < 1e-9, F.lit(A) / F.sqrt(1.0 - E2 * F.sin(v["lat"]) * F.sin(v["lat"]))
        return F.struct(
            F.when(polar, F.when(v["z"] >= 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(v["lat"])).alias("lat_deg"),
            F.when(polar, 0.0).otherwise(F.degrees(F.atan2(v["y"], v["x"]))).alias("lon_deg"),
            F.when(polar, F.abs(v["z"]) - A * math.sqrt(1.0 - E2)).otherwise(v["p"] / F.cos(v["lat"]) - n).alias("h_m"),
        )

    # Arrays of one element bind what the next step uses more than once.
    axis = lambda v: F.greatest(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]), F.lit(1e-12))
    given = F.array(F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    with_p = F.transform(given, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), axis(v).alias("p")))
    return F.transform(F.transform(with_p, solved), degrees)[0]


def ecef_vec_to_enu(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Rotates a free vector to east, north, up at a point."""
    la, lo = F.radians(lat), F.radians(lon)
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    up = F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz
    return east, north, up


def enu_vec_to_ecef(e: Column, n: Column, u: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Inverse rotation of ecef_vec_to_enu."""
    la, lo = F.radians(lat), F.radians(lon)
    x = -F.sin(lo) * e - F.sin(la) * F.cos(lo) * n + F.cos(la) * F.cos(lo) * u
    y = F.cos(lo) * e - F.sin(la) * F.sin(lo) * n + F.cos(la) * F.sin(lo) * u
    return x, y, F.cos(la) * n + F.sin(la) * u


def ecef_to_enu(x: Column, y: Column, z: Column, ref: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    rx, ry, rz = llh_to_ecef(*ref)
    return ecef_vec_to_enu(x - rx, y - ry, z - rz, ref[0], ref[1])


def llh_to_enu(lat: Column, lon: Column, h: Column, ref: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return ecef_to_enu(*llh_to_ecef(lat, lon, h), ref)


def enu_to_llh(e: Column, n: Column, u: Column, ref: tuple[Column, Column, Column]) -> Column:
    """Struct of lat_deg, lon_deg, h_m."""
    rx, ry, rz = llh_to_ecef(*ref)
    dx, dy, dz = enu_vec_to_ecef(e, n, u, ref[0], ref[1])
    return ecef_to_llh_struct(rx + dx, ry + dy, rz + dz)


def heading_from_enu(de: Column, dn: Column) -> Column:
    """Compass heading in [0, 360); null for a step shorter than about 3e-5 m."""
    return F.when(de * de + dn * dn >= 1e-9, F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0)))


def heading_from_latlon(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [0, 360); null for the same point."""
    a, b, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    return F.when(~((F.abs(x) < 1e-15) & (F.abs(y) < 1e-15)), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; 180 degrees wraps to zone 1."""
    return (F.floor((lon + 180.0) / 6.0) % 60 + 1).cast("int")


def utm_zone_clamped(lon: Column) -> Column:
    """Zone 1 to 60; 180 degrees stays in zone 60."""
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180.0) / 6.0) + 1).cast("int")))


def utm_epsg(lat: Column, zone: Column) -> Column:
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


# Coefficients of the transverse Mercator series in the third flattening, to its fourth power.
_N = FLATTENING / (2.0 - FLATTENING)
RADIUS = A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
ALPHA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 5.0 * _N**3 / 16.0 + 41.0 * _N**4 / 180.0,
    13.0 * _N**2 / 48.0 - 3.0 * _N**3 / 5.0 + 557.0 * _N**4 / 1440.0,
    61.0 * _N**3 / 240.0 - 103.0 * _N**4 / 140.0,
    49561.0 * _N**4 / 161280.0,
)
BETA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 37.0 * _N**3 / 96.0 - _N**4 / 360.0,
    _N**2 / 48.0 + _N**3 / 15.0 - 437.0 * _N**4 / 1440.0,
    17.0 * _N**3 / 480.0 - 37.0 * _N**4 / 840.0,
    4397.0 * _N**4 / 161280.0,
)
DELTA = (
    2.0 * _N - 2.0 * _N**2 / 3.0 - 2.0 * _N**3 + 116.0 * _N**4 / 45.0,
    7.0 * _N**2 / 3.0 - 8.0 * _N**3 / 5.0 - 227.0 * _N**4 / 45.0,
    56.0 * _N**3 / 15.0 - 136.0 * _N**4 / 35.0,
    4279.0 * _N**4 / 630.0,
)
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0
_ROOT = 2.0 * math.sqrt(_N) / (1.0 + _N)


def _atanh(x: Column) -> Column:
    return F.log((1.0 + x) / (1.0 - x)) / 2.0


def utm_forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone, by the Krueger series."""
    la, dl = F.radians(lat), F.radians(lon - (zone * 6.0 - 183.0))
    t = F.sinh(_atanh(F.sin(la)) - _ROOT * _atanh(_ROOT * F.sin(la)))
    xi, eta = F.atan2(t, F.cos(dl)), _atanh(F.sin(dl) / F.sqrt(1.0 + t * t))
    east, north = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2.0 * k * xi) * F.sinh(2.0 * k * eta)
        north = north + a * F.sin(2.0 * k * xi) * F.cosh(2.0 * k * eta)
    south = F.when(lat < 0, FALSE_NORTH).otherwise(0.0)
    return FALSE_EAST + SCALE * RADIUS * east, south + SCALE * RADIUS * north


def utm_inverse(east: Column, north: Column, zone: Column, southern: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a UTM point."""
    xi = (north - F.when(southern, FALSE_NORTH).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (east - FALSE_EAST) / (SCALE * RADIUS)
    x, e = xi, eta
    for k, b in enumerate(BETA, 1):
        x = x - b * F.sin(2.0 * k * xi) * F.cosh(2.0 * k * eta)
        e = e - b * F.cos(2.0 * k * xi) * F.sinh(2.0 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for k, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2.0 * k * chi)
    return F.degrees(lat), zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(e), F.cos(x)))


def parse_dms(text: Column) -> Column:
    """'32 4 5.5 N', '32°04'05.5"S' and the like to signed degrees; null if it doesn't parse."""
    number = r"[-+]?\d+(?:\.\d+)?"
    d, m, s = (F.regexp_extract(text, rf"^\s*({number})(?:[\s°d:]+(\d+(?:\.\d+)?))?(?:[\s'm:]+(\d+(?:\.\d+)?))?", k) for k in (1, 2, 3))
    value = F.abs(d.try_cast("double")) + F.coalesce(m.try_cast("double"), F.lit(0.0)) / 60.0 + F.coalesce(s.try_cast("double"), F.lit(0.0)) / 3600.0
    negative = d.startswith("-") | F.upper(F.regexp_extract(text, r"([NSEWnsew])\s*$", 1)).isin("S", "W")
    return F.when(negative, -value).otherwise(value)


def parse_dd(text: Column) -> tuple[Column, Column, Column]:
    """'lat lon h' (blanks or commas) to three numbers, null where missing."""
    parts = F.split(F.trim(text), r"[,\s]+")
    return tuple(F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2, 3))


def zone_epsg(zone: Column) -> Column:
    """'36N', '36S' or a band letter ('36R': N to X are north) to an EPSG code; null otherwise."""
    number = F.regexp_extract(zone, r"^\s*(\d{1,2})\s*([A-Za-z])\s*$", 1).try_cast("int")
    band = F.upper(F.regexp_extract(zone, r"^\s*(\d{1,2})\s*([A-Za-z])\s*$", 2))
    base = F.when(band == "S", 32700).when(band >= "N", 32600).otherwise(32700)
    return F.when(number.between(1, 60), base + number).cast("int")


def base_spec(text: Column) -> Column:
    """A station's place as struct x, y, z: 'ecef:x,y,z', 'llh:lat,lon,h', or three bare numbers of either kind; else null.

    Bare numbers are Cartesian if all exceed 100 km, geodetic if the first two
    can be latitude and longitude.
    """
    s = F.trim(text)
    kind = F.lower(F.regexp_extract(s, r"^([A-Za-z]+):", 1))
    numbers = F.transform(F.split(F.regexp_replace(s, r"^[A-Za-z]+:", ""), ","), lambda p: F.trim(p).try_cast("double"))
    point = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def place(v: Column) -> Column:
        kind, n = v["kind"], v["n"]
        a, b, c = (F.try_element_at(n, F.lit(k)) for k in (1, 2, 3))
        fine = (F.size(n) == 3) & F.forall(n, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        far = F.forall(n, lambda x: F.abs(x) > 1.0e5)
        cartesian = (kind == "ecef") | ((kind == "") & far)
        geodetic = (kind == "llh") | ((kind == "") & ~far & (F.abs(a) <= 90.0) & (F.abs(b) <= 180.0))
        return F.when(fine & cartesian, point(a, b, c)).when(fine & geodetic, point(*llh_to_ecef(a, b, c)))

    # Through an array of one, so that the text is parsed once.
    return F.get(F.transform(F.array(F.struct(kind.alias("kind"), numbers.alias("n"))), place), 0)


def on_surface(x: Column, y: Column, z: Column) -> Column:
    """Whether Cartesian metres can be a place on Earth."""
    return F.sqrt(x * x + y * y + z * z).between(6.0e6, 7.0e6)
