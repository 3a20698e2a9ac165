"""Distances, tiles and grid clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_METERS, EARTH_MILES, METERS_PER_DEGREE = 6_371_008.8, 3958.8, 111_320.0
SWEEP_CELL, SWEEP_MAX_CALLS, SWEEP_PRICE, SWEEP_GROUPS, CALL_CAP = 1_000.0, 1_500, 0.035, 2, 20
MARKER_ZOOM = 13


def _half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))


def meters(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = _half_chord(lat1, lng1, lat2, lng2)
    return F.lit(EARTH_METERS * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.lit(EARTH_MILES * 2) * F.asin(F.least(F.lit(1.0), F.sqrt(_half_chord(lat1, lng1, lat2, lng2))))


def in_view(lat: Column, lng: Column, south: float, west: float, north: float, east: float, zoom: float) -> Column:
    """Inside the viewport, which is a quarter larger on each side from the marker zoom on; plain range
    predicates, so that they reach the scan."""
    pad = 0.25 if zoom >= MARKER_ZOOM else 0.0
    dy, dx = (north - south) * pad, (east - west) * pad
    return lat.between(south - dy, north + dy) & lng.between(west - dx, east + dx)


def cell_size(zoom: float) -> float:
    return 360 / 2 ** max(1.0, zoom) * 0.28


def grid_clusters(items: DataFrame, zoom: float, id_col: str = "id", priority=None) -> DataFrame:
    """(cell, n, lat, lng, first_id): a row a grid cell below the marker zoom, else a row an item.  The
    priority item has a row of its own; items without a place are in no cell."""
    placed = items.where("lat IS NOT NULL AND lng IS NOT NULL")
    alone = F.lit(zoom >= MARKER_ZOOM) | F.coalesce(F.col(id_col).cast("string") == F.lit(None if priority is None else str(priority)), F.lit(False))
    size = cell_size(zoom)
    cell = F.when(alone, F.concat(F.lit("item:"), F.col(id_col).cast("string"))).otherwise(F.concat_ws(":", F.floor(F.col("lat") / size).cast("string"), F.floor(F.col("lng") / size).cast("string")))
    return placed.withColumn("cell", cell).groupBy("cell").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min(id_col).alias("first_id"))


def tile_centres(spark: SparkSession, lat: float, lng: float, radius: float, cell: float = SWEEP_CELL) -> DataFrame:
    """(lat, lng) of the overlapping cells that cover a circle."""
    if radius <= cell:
        return spark.range(1).select(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"))
    n = max(1, math.ceil(radius / cell))
    dlat, dlng = cell / METERS_PER_DEGREE, cell / (METERS_PER_DEGREE * max(0.01, math.cos(math.radians(lat))))
    steps = F.sequence(F.lit(-n), F.lit(n))
    grid = spark.range(1).select(F.explode(steps).alias("i")).select("i", F.explode(steps).alias("j")).select((F.lit(lat) + F.col("i") * F.lit(dlat)).alias("lat"), (F.lit(lng) + F.col("j") * F.lit(dlng)).alias("lng"))
    return grid.where(meters(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= radius + cell)


def sweep_estimate(spark: SparkSession, lat: float, lng: float, radius: float, cell: float = SWEEP_CELL) -> dict:
    """Cells, calls and list cost of a sweep, before any call."""
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError("the centre is not on the globe")
    if not 250 <= radius <= 50_000:
        raise ValueError("the radius must be from 250 m to 50 km")
    cells = tile_centres(spark, lat, lng, radius, cell).count()
    calls = cells * SWEEP_GROUPS
    return {"cells": cells, "base_calls": calls, "call_budget": min(SWEEP_MAX_CALLS, calls), "estimated_list_cost": round(calls * SWEEP_PRICE, 2), "within_call_limit": calls <= SWEEP_MAX_CALLS}


def sweep(found: DataFrame, lat: float, lng: float, radius: float) -> DataFrame:
    """Rows of all calls (arrival, place_id, name, lat, lng): the first of each place, inside the exact
    circle, by distance and name."""
    near = found.withColumn("distance", meters(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).where(F.col("distance") <= radius)
    first = near.groupBy("place_id").agg(F.min_by(F.struct("name", "lat", "lng", "distance"), "arrival").alias("x")).select("place_id", "x.*")
    return first.orderBy("distance", F.lower("name"), "place_id")


def tiles(circles: DataFrame, keep: tuple[str, ...], lat: str = "lat", lng: str = "lng", radius: str = "radius", cell: float = SWEEP_CELL) -> DataFrame:
    """(keep..., lat, lng) of the overlapping cells that cover each circle; a circle of no more than a cell is
    its own centre."""
    n = F.when(F.col(radius) <= cell, 0).otherwise(F.ceil(F.col(radius) / cell)).cast("int")
    dlat, dlng = F.lit(cell / METERS_PER_DEGREE), F.lit(cell) / (F.lit(METERS_PER_DEGREE) * F.greatest(F.lit(0.01), F.cos(F.radians(F.col(lat)))))
    grid = circles.select(*keep, F.col(lat).alias("lat0"), F.col(lng).alias("lng0"), F.col(radius).alias("r"), dlng.alias("dlng"), F.explode(F.sequence(-n, n)).alias("i"), n.alias("n"))
    grid = grid.select(*keep, "lat0", "lng0", "r", "dlng", "i", F.explode(F.sequence(-F.col("n"), F.col("n"))).alias("j"))
    centres = grid.select(*keep, "lat0", "lng0", "r", (F.col("lat0") + F.col("i") * dlat).alias("lat"), (F.col("lng0") + F.col("j") * F.col("dlng")).alias("lng"))
    return centres.where(meters(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")) <= F.col("r") + cell).select(*keep, "lat", "lng")


def estimates(circles: DataFrame, key: str, cell: float = SWEEP_CELL) -> DataFrame:
    """(key, cells, base_calls, call_budget, cost, within) of a sweep of each circle, before any call."""
    cells = tiles(circles, (key,), cell=cell).groupBy(key).agg(F.count("*").alias("cells"))
    calls = F.col("cells") * SWEEP_GROUPS
    budget = F.least(calls, F.lit(SWEEP_MAX_CALLS))
    return cells.select(key, "cells", calls.alias("base_calls"), budget.alias("call_budget"), F.round(budget * SWEEP_PRICE, 2).alias("cost"), (calls <= SWEEP_MAX_CALLS).alias("within"))
