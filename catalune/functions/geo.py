"""Planar and spherical expressions over columns. Points are structs (x, y) or (lon, lat) columns; rings are arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.8  # mean radius in metres


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def compass(deg: Column) -> Column:
    """The nearest of eight directions, halves upwards."""
    names = F.array(*map(F.lit, ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")))
    return F.element_at(names, (F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def floor_label(floor: Column, ground: Column) -> Column:
    """'' for an unknown floor; the site's name of its ground floor; 1M for the mezzanine at 1.5; else the number."""
    number = F.when(floor == F.floor(floor), F.floor(floor).cast("string")).otherwise(floor.cast("string"))
    return F.when(floor.isNull(), "").when(floor == 0, ground).when(floor == 1.5, "1M").otherwise(number)


def _pairs(ring: Column) -> Column:
    """Consecutive points, the last joined to the first."""
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))


def _fold(ring: Column, f) -> Column:  # noqa: ANN001
    return F.aggregate(F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), f), F.lit(0.0), lambda acc, x: acc + x)


def signed_area(ring: Column) -> Column:
    return _fold(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def area(rings: Column, holes: bool = True) -> Column:
    """Of the first ring, less the others if ``holes``."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    first = F.element_at(sizes, 1)
    return first - F.aggregate(F.slice(sizes, F.lit(2), F.size(sizes)), F.lit(0.0), lambda acc, x: acc + x) if holes else first


def centroid(ring: Column) -> Column:
    """Area centroid; the first vertex of a degenerate ring."""
    a = signed_area(ring)
    cx = _fold(ring, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    cy = _fold(ring, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    flat = F.abs(a) < 1e-12
    start = F.element_at(ring, 1)
    return F.struct(F.when(flat, start["x"]).otherwise(cx / (6 * a)).alias("x"), F.when(flat, start["y"]).otherwise(cy / (6 * a)).alias("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    crossed = _fold(ring, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1.0).otherwise(0.0))
    return crossed % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in none of the holes."""
    return in_ring(x, y, F.element_at(rings, 1)) & ~F.exists(F.slice(rings, F.lit(2), F.size(rings)), lambda r: in_ring(x, y, r))


def box_distance(lat: Column, lon: Column, s: Column, w: Column, n: Column, e: Column) -> Column:
    """Metres to a bounding box, 0 inside."""
    return haversine(lat, lon, F.least(F.greatest(lat, s), n), F.least(F.greatest(lon, w), e))


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-Mercator tile (x, y)."""
    n = float(1 << zoom)
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2
    return F.struct(F.floor((lon + 180) / 360 * n).alias("x"), F.floor(y * n).alias("y"))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Local metres about an origin, equirectangular."""
    return F.struct(((lon - lon0) * 111320.0 * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * 110540.0).alias("y"))


def levels(raw: Column) -> Column:
    """'-1;-0.5;0' or '0-2' as sorted distinct numbers."""
    span = F.regexp_extract(raw, r"^(-?\d+)-(-?\d+)$", 1)
    upto = F.regexp_extract(raw, r"^(-?\d+)-(-?\d+)$", 2)
    parts = F.filter(F.transform(F.split(raw, ";"), lambda s: F.trim(s).try_cast("double")), lambda v: v.isNotNull())
    run = F.transform(F.sequence(span.try_cast("int"), upto.try_cast("int")), lambda v: v.cast("double"))
    return F.array_sort(F.array_distinct(F.when(span != "", run).otherwise(parts)))
