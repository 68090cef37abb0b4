"""Distances, geo scores and geohash cells as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in km that distances count with, and the alphabet of geohashes.
RADIUS_KM = 6367
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0) * F.asin(F.sqrt(a)) * F.lit(float(RADIUS_KM))


def km_to_score(km: Column) -> Column:
    return F.when(km > 100, F.lit(0.0)).otherwise(F.exp(-F.pow(km / 50, 2)))


def bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude in a geohash."""
    n = 5 * precision
    return n - n // 2, n // 2


def x_bin(lon: Column, precision: int) -> Column:
    n = 1 << bits(precision)[0]
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def y_bin(lat: Column, precision: int) -> Column:
    n = 1 << bits(precision)[1]
    return F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def geohash_of_bins(x: Column, y: Column, precision: int) -> Column:
    bx, by = bits(precision)
    letters = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            i = 5 * c + b  # even bits are of longitude
            source, at = (x, bx - 1 - i // 2) if i % 2 == 0 else (y, by - 1 - i // 2)
            value = value + F.shiftright(source, at).bitwiseAND(1) * (1 << (4 - b))
        letters.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    return geohash_of_bins(x_bin(lon, precision), y_bin(lat, precision), precision)


def expand_bins(x: Column, y: Column, precision: int, ring: int = 1) -> Column:
    """The cell and its neighbours up to `ring` cells away: array of x and y. x wraps around, y ends at the poles."""
    nx, ny = 1 << bits(precision)[0], 1 << bits(precision)[1]
    offsets = [(dx, dy) for dy in range(-ring, ring + 1) for dx in range(-ring, ring + 1)]
    cells = F.array(*[F.struct(F.pmod(x + dx, F.lit(nx)).alias("x"), (y + dy).alias("y")) for dx, dy in offsets])
    return F.array_distinct(F.filter(cells, lambda c: (c["y"] >= 0) & (c["y"] < ny)))


def expand_geohash(lat: Column, lon: Column, precision: int = 7, ring: int = 1) -> Column:
    return F.transform(expand_bins(x_bin(lon, precision), y_bin(lat, precision), precision, ring), lambda c: geohash_of_bins(c["x"], c["y"], precision))


def cell_bbox(x: Column, y: Column, precision: int = 7) -> Column:
    """south, west, north, east of a cell."""
    nx, ny = 1 << bits(precision)[0], 1 << bits(precision)[1]
    return F.struct((y * (180.0 / ny) - 90).alias("south"), (x * (360.0 / nx) - 180).alias("west"), ((y + 1) * (180.0 / ny) - 90).alias("north"), ((x + 1) * (360.0 / nx) - 180).alias("east"))
