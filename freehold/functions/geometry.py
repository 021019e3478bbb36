"""Points, multipolygons and GeoJSON as column expressions.

A multipolygon is array<polygon>, a polygon array<ring> with ring 0 its outside,
a ring array<struct<lon, lat>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M

RING = "array<struct<lon:double,lat:double>>"
MULTIPOLYGON = f"array<array<{RING}>>"


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the sphere in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metres: float) -> Column:
    return haversine_m(lon1, lat1, lon2, lat2) <= metres


def _crossings(ring: Column, lon: Column, lat: Column) -> Column:
    """How many edges of the ring a ray to the east from the point crosses."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        return F.when(spans & (lon < at), 1).otherwise(0)

    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), edge), F.lit(0), lambda s, x: s + x)).otherwise(0)


def point_in_multipolygon(shape: Column, lon: Column, lat: Column) -> Column:
    """Even-odd over all rings, so holes are outside; a null shape holds nothing."""
    total = F.aggregate(F.transform(F.flatten(shape), lambda ring: _crossings(ring, lon, lat)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(total % 2 == 1, F.lit(False))


def bbox(shape: Column) -> Column:
    """Struct min_lon, max_lon, min_lat, max_lat."""
    points = F.flatten(F.flatten(shape))
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "lon").alias("min_lon"), of(F.array_max, "lon").alias("max_lon"), of(F.array_min, "lat").alias("min_lat"), of(F.array_max, "lat").alias("max_lat"))


def _shape(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))))


def geojson_to_multipolygon(text: Column) -> Column:
    """A Polygon or MultiPolygon as a multipolygon; anything else is null."""
    kind = F.get_json_object(text, "$.type")
    raw = F.get_json_object(text, "$.coordinates")
    one = F.from_json(raw, "array<array<array<double>>>")
    many = F.from_json(raw, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", _shape(F.array(one))).when(kind == "MultiPolygon", _shape(many))


def to_wkt(shape: Column) -> Column:
    """MULTIPOLYGON text."""
    point = lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    polygon = lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, ring), ", "), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(shape, polygon), ", "), F.lit(")"))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))


def shape_geojson(shape: Column) -> Column:
    coordinates = F.transform(shape, lambda g: F.transform(g, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"]))))
    return F.when(shape.isNotNull(), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))))
