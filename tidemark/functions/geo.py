"""Geography: distances, boxes, grid cells and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; equal points are exactly 0."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_bbox(lat: Column | str, lon: Column | str, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box, edges included; a box whose west exceeds its east wraps the antimeridian."""
    lat, lon = _col(lat), _col(lon)
    span = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce(lat.between(south, north) & span, F.lit(False))


def check_bbox(south: float, west: float, north: float, east: float) -> None:
    if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
        raise ValueError("a box needs -90 <= south <= north <= 90 and longitudes within 180 degrees")


def extent_boxes(extent: dict) -> list[tuple[float, float, float, float]]:
    """A scope's extent as no box (world), one, or two at the antimeridian."""
    if extent.get("world"):
        return []
    south, west, north, east = (extent[k] for k in ("south", "west", "north", "east"))
    check_bbox(south, west, north, east)
    return [(south, west, north, east)] if west <= east else [(south, west, north, 180.0), (south, -180.0, north, east)]


def in_extent(lat: Column | str, lon: Column | str, extent: dict) -> Column:
    boxes = extent_boxes(extent)
    if not boxes:
        return _col(lat).isNotNull() & _col(lon).isNotNull()
    out = F.lit(False)
    for box in boxes:
        out = out | in_bbox(lat, lon, *box)
    return out


def cell(lat: Column | str, lon: Column | str, degrees: float) -> Column:
    """Index of the grid cell as (row, column)."""
    return F.struct(F.floor(_col(lat) / degrees).alias("row"), F.floor(_col(lon) / degrees).alias("column"))


def two_decimals(value: Column | str) -> Column:
    """The number of two decimals next to the binary value; an exact tie goes to the even one (0.125 to 0.12).

    Spark rounds the shortest decimal that reads back as the value, so that 2.675, which lies below the tie as a
    binary value, would count as one. Such values are told apart by the exact sign of their distance to the tie:
    split into two halves of 26 bits, both products with 1000 are exact. All this is for values next to a tie alone."""
    value = _col(value)
    ties = F.rint(value * 1000)
    scaled = value * 134217729.0
    high = scaled - (scaled - value)
    beside = (high * 1000 - ties) + (value - high) * 1000
    looks_tied = (ties / 1000 == value) & (F.abs(ties) % 10 == 5)
    return _away_from_ties(value, 2, F.when(looks_tied & (beside != 0), (ties + F.signum(beside) * 5) / 1000).otherwise(F.bround(value, 2)))


def _away_from_ties(value: Column, places: int, beside: Column) -> Column:
    """The nearest number of that many decimals, or ``beside`` where a tie is close, the value is large or no number:
    only there does the kind of rounding matter, and rounding by decimals takes a microsecond."""
    scaled = value * 10.0**places
    plain = (F.abs(value) < 1e6) & (F.abs(scaled - F.rint(scaled)) < 0.499999)
    return F.when(plain, F.rint(scaled) / 10.0**places + 0.0).otherwise(beside)


def rounded(value: Column | str, places: int) -> Column:
    """The value of ``round``, which works in decimals, without them where no tie is close."""
    return _away_from_ties(_col(value), places, F.round(value, places))


def correlation_strength(distance_km: Column, days: Column, high: Column, confident: Column, boosted: Column, reach_km: float = 50.0) -> Column:
    """Linear in the distance, half on other days, plus bonuses."""
    base = F.greatest(1 - distance_km / reach_km, F.lit(0.0)) * F.when(days == 0, 1.0).otherwise(0.5)
    bonus = F.when(high, 0.3).otherwise(0.0) + F.when(boosted, 0.2).otherwise(0.0) + F.when(confident, 0.1).otherwise(0.0)
    return base + bonus


def correlation_score(distance_km: Column, days: Column, high: Column, confident: Column, boosted: Column, reach_km: float = 50.0) -> Column:
    """The strength in two decimals, at most 1."""
    return F.least(two_decimals(correlation_strength(distance_km, days, high, confident, boosted, reach_km)), F.lit(1.0))


def concern_score(magnitude: Column, depth_km: Column, distance_km: Column) -> Column:
    """0 to 95: 45 for the magnitude (of 9), 35 for the nearness within 40 km, 15 for a depth below 10 km; two decimals."""
    size = F.least(magnitude, F.lit(9.0)) / 9.0 * 0.45
    near = F.greatest((40.0 - F.least(distance_km, F.lit(40.0))) / 40.0, F.lit(0.0)) * 0.35
    shallow = F.greatest(1.0 - depth_km / 10.0, F.lit(0.0)) * 0.15
    return two_decimals((size + near + shallow) * 100.0)


def concern_level(score: Column) -> Column:
    """Null below 25."""
    return F.when(score >= 75, "critical").when(score >= 50, "elevated").when(score >= 25, "moderate")


def wkt_point(text: Column | str) -> Column:
    """Point(lon lat) as a struct of lat and lon."""
    number = r"(-?\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(_col(text), rf"(?i)point\s*\(\s*{number}\s+{number}\s*\)", i).try_cast("double")
    return F.struct(part(2).alias("lat"), part(1).alias("lon"))


def map_url_point(url: Column | str) -> Column:
    """lat and lon of a map link that gives them as lon,lat after an @."""
    number = r"(-?\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(_col(url), rf"@{number},{number}", i).try_cast("double")
    return F.struct(part(2).alias("lat"), part(1).alias("lon"))


def dms(value: Column | str, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds with a hemisphere letter."""
    value = _col(value)
    total = F.round(F.abs(value) * 3600).cast("long")
    text = F.format_string("%d°%02d'%02d\"", (total / 3600).cast("long"), ((total % 3600) / 60).cast("long"), total % 60)
    return F.concat(text, F.when(value < 0, negative).otherwise(positive))


def orbit_period_minutes(mean_motion: Column | str) -> Column:
    return F.lit(1440.0) / _col(mean_motion)


def plausible_capital(lat: Column | str, lon: Column | str, country_lat: Column | str, country_lon: Column | str, most_km: float = 5000.0) -> Column:
    """Whether a capital has a valid place that isn't too far from its country's."""
    valid = _col(lat).between(-90, 90) & _col(lon).between(-180, 180)
    return F.coalesce(valid & (haversine_km(lat, lon, country_lat, country_lon) <= most_km), F.lit(False))


def unwrapped(ring: Column) -> Column:
    """A ring, an array of (x, y), with longitudes shifted by whole turns so that no step is longer than half a turn."""
    step = lambda held, p: F.array_append(held, F.struct((p["x"] - F.rint((p["x"] - F.element_at(held, -1)["x"]) / 360.0) * 360.0).alias("x"), p["y"].alias("y")))
    return F.when(F.size(ring) > 0, F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1), step)).otherwise(ring)


def signed_area(ring: Column) -> Column:
    """Planar area of a closed ring in square degrees; positive is counter-clockwise."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
    return 0.5 * F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))
