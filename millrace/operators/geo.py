"""Rings and points in arrays, without geometry libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_closed(ring: Column) -> Column:
    return (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1))


def in_bounds(ring: Column) -> Column:
    """All points are WGS84 (longitude, latitude)."""
    return F.forall(ring, lambda p: p[0].between(-180, 180) & p[1].between(-90, 90))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, in square degrees."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / 2


def valid_ring(ring: Column) -> Column:
    return ring_closed(ring) & in_bounds(ring) & (F.abs(signed_area(ring)) > 0)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment in the plane."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))
