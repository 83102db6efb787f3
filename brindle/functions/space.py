"""Vectors, geography and addresses, as columns."""

from __future__ import annotations

import ipaddress
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Refused

EARTH_M = 6371008.7714


def distance(vector: Column, query: list[float], metric: str) -> Column:
    """l2 (rooted), cosine (1 - similarity), dot (minus the product) or hamming; sums in double precision, in the vector's order."""
    fixed = F.array(*(F.lit(float(x)) for x in query))

    def fold(each):
        return F.aggregate(F.zip_with(vector, fixed, each), F.lit(0.0), lambda a, x: a + x)

    v = lambda x: x.cast("double")
    if metric == "l2":
        return F.sqrt(fold(lambda a, b: (v(a) - b) * (v(a) - b)))
    if metric == "dot":
        return -fold(lambda a, b: v(a) * b)
    if metric == "cosine":
        norm = math.sqrt(sum(x * x for x in query))
        own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + v(x) * v(x)))
        return F.lit(1.0) - F.try_divide(fold(lambda a, b: v(a) * b), own * F.lit(norm))
    if metric == "hamming":
        return fold(lambda a, b: F.when(v(a) != b, 1.0).otherwise(0.0))
    raise Refused(f"metric [{metric}] isn't served")


def haversine(point: Column, lat: float, lon: float) -> Column:
    """Metres between a {lat, lon} and a fixed point."""
    a, b = F.radians(point["lat"]), F.lit(math.radians(lat))
    dlat, dlon = (F.radians(point["lat"]) - math.radians(lat)) / 2, (F.radians(point["lon"]) - math.radians(lon)) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(a) * F.cos(b) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def metres(text) -> float:
    if isinstance(text, (int, float)):
        return float(text)
    for unit, size in (("km", 1000.0), ("mi", 1609.344), ("cm", 0.01), ("mm", 0.001), ("ft", 0.3048), ("yd", 0.9144), ("nmi", 1852.0), ("m", 1.0)):
        if text.endswith(unit):
            return float(text[: -len(unit)]) * size
    return float(text)


def point(value) -> tuple[float, float]:
    """(lat, lon) of {lat, lon}, [lon, lat] or "lat,lon"."""
    if isinstance(value, dict):
        return float(value["lat"]), float(value["lon"])
    if isinstance(value, str):
        lat, lon = value.split(",")
        return float(lat), float(lon)
    return float(value[1]), float(value[0])


def in_polygon(p: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of the polygon's sides cross the parallel east of the point."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(points, points[1:] + points[:1]):
        if y1 == y2:
            continue
        across = (F.lit(y1) > p["lat"]) != (F.lit(y2) > p["lat"])
        crossings = crossings + F.when(across & (p["lon"] < (p["lat"] - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    return p.isNotNull() & (crossings % 2 == 1)


def tile(p: Column, zoom: int) -> Column:
    """zoom/x/y of the Web Mercator tile."""
    n = 1 << zoom
    lat = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), p["lat"])))
    x = F.floor((p["lon"] + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n)
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("string")
    return F.when(p.isNotNull(), F.concat_ws("/", F.lit(str(zoom)), clip(x), clip(y)))


def geohash(p: Column, precision: int) -> Column:
    """Bits of longitude and latitude in turn, five a character."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.floor((v - low) / span * (1 << n)), F.lit((1 << n) - 1))
    x, y = cell(p["lon"], -180.0, 360.0, lon_bits), cell(p["lat"], -90.0, 180.0, lat_bits)
    alphabet = F.lit("0123456789bcdefghjkmnpqrstuvwxyz")
    out = []
    for k in range(precision):
        value = F.lit(0)
        for j in range(5):
            at = 5 * k + j
            source, n, i = (x, lon_bits, at // 2) if at % 2 == 0 else (y, lat_bits, at // 2)
            value = value * 2 + F.shiftright(source.cast("bigint"), n - 1 - i).bitwiseAND(F.lit(1))
        out.append(F.substring(alphabet, (value + 1).cast("int"), F.lit(1)))
    return F.when(p.isNotNull(), F.concat(*out))


def ipv4(text: Column) -> Column:
    """The number of a dotted IPv4 address; null for anything else."""
    parts = F.split(text, r"\.")
    good = text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    value = F.lit(0).cast("bigint")
    for k in range(4):
        value = value * 256 + F.try_element_at(parts, F.lit(k + 1)).try_cast("bigint")
    return F.when(good, value)


def ip_block(value: str) -> tuple[int, int]:
    """First and last number of an IPv4 address or CIDR block."""
    try:
        net = ipaddress.ip_network(value, strict=False)
    except ValueError as e:
        raise Refused(f"[{value}] is not an address") from e
    if net.version != 4:
        raise Refused(f"[{value}]: only IPv4 is served")
    return int(net.network_address), int(net.broadcast_address)
