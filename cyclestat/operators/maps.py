"""Map-ready data: projected stations and paths, viewport, path geometry.

The source analysis did this on the driver for the first ``n`` rows; here
it is ordinary Column arithmetic on executors.  Interpolation multiplies
rows by ``points``, so it is applied only to an already bounded (top-k)
path table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions.geo import LONG_ISLAND_FEET, VIEWPORT_X, VIEWPORT_Y, LambertConformalConic, in_viewport, interpolate
from cyclestat.plans.topk import ranked_top_k


def with_projection(df: DataFrame, lon: str, lat: str, x: str, y: str,
                    proj: LambertConformalConic = LONG_ISLAND_FEET, decimals: int | None = None) -> DataFrame:
    """Add planar ``x``/``y`` (projection units) for (``lon``, ``lat``) degrees.
    The degree columns are kept."""
    px, py = proj.x(lon, lat), proj.y(lon, lat)
    if decimals is not None:
        px, py = F.round(px, decimals), F.round(py, decimals)
    return df.withColumns({x: px, y: py})


def project_stations(stations: DataFrame, name_prefix: str = "station",
                     decimals: int | None = None) -> DataFrame:
    """``x_ft``/``y_ft`` for a station table with ``<prefix>_longitude``/``_latitude``."""
    return with_projection(stations, f"{name_prefix}_longitude", f"{name_prefix}_latitude",
                           "x_ft", "y_ft", decimals=decimals)


def project_path_coordinates(coords: DataFrame, decimals: int | None = None) -> DataFrame:
    """``x_1_ft, y_1_ft, x_2_ft, y_2_ft`` for an undirected path-coordinate table."""
    out = with_projection(coords, "lon_1", "lat_1", "x_1_ft", "y_1_ft", decimals=decimals)
    return with_projection(out, "lon_2", "lat_2", "x_2_ft", "y_2_ft", decimals=decimals)


def project_paths(paths: DataFrame, decimals: int | None = None) -> DataFrame:
    """``start_x_ft, start_y_ft, end_x_ft, end_y_ft`` for a directed path table."""
    out = with_projection(paths, S.START_LON, S.START_LAT, "start_x_ft", "start_y_ft", decimals=decimals)
    return with_projection(out, S.END_LON, S.END_LAT, "end_x_ft", "end_y_ft", decimals=decimals)


def trips_in_viewport(trips: DataFrame, lon: str = S.START_LON, lat: str = S.START_LAT,
                      x_range=VIEWPORT_X, y_range=VIEWPORT_Y, proj: LambertConformalConic = LONG_ISLAND_FEET) -> DataFrame:
    """Rows whose point (``lon``, ``lat``) lies in the map window, by default trips by their start.

    The window is a rectangle of projected feet.  A box of degrees that holds it goes before the exact
    test: plain comparisons of the two columns, which a scan can use to skip files and row groups.
    """
    (lon_least, lon_most), (lat_least, lat_most) = proj.degree_box(x_range, y_range)
    near = F.col(lon).between(lon_least, lon_most) & F.col(lat).between(lat_least, lat_most)
    return trips.where(near).where(in_viewport(proj.x(lon, lat), proj.y(lon, lat), x_range, y_range))


def stations_in_viewport(stations: DataFrame, x: str = "x_ft", y: str = "y_ft") -> DataFrame:
    """Rows whose projected point lies in the map window (closed box)."""
    return stations.where(in_viewport(x, y))


def path_kind(a: str = S.START_NAME, b: str = S.END_NAME):
    """``loop`` when both ends are the same station, ``segment`` when they
    differ, NULL when a name is unknown."""
    return F.when(F.col(a) == F.col(b), F.lit("loop")).when(F.col(a) != F.col(b), F.lit("segment"))


def rank_paths(paths: DataFrame, k: int, keys, rank_col: str = "path_rank") -> DataFrame:
    """First ``k`` paths by ``count`` desc (ties by ``keys``) with a 1-based rank."""
    return ranked_top_k(paths, k, "count", keys, rank_col=rank_col)


def path_segments(ranked: DataFrame, points: int = S.POINTS_PER_PATH,
                  start_name: str = S.START_NAME, end_name: str = S.END_NAME,
                  coords=("start_x_ft", "start_y_ft", "end_x_ft", "end_y_ft"),
                  rank_col: str = "path_rank", carry=()) -> DataFrame:
    """Line geometry of ranked paths: (``carry...``, ``rank``, ``position``,
    ``x_ft``, ``y_ft``, ``count``).  A segment gets ``points`` evenly spaced
    points from start (position 1) to end (position ``points``); a loop gets
    one point."""
    sx, sy, ex, ey = coords
    n = F.when(path_kind(start_name, end_name) == "loop", F.lit(1)).otherwise(F.lit(points))
    exploded = ranked.select(*carry, rank_col, "count", sx, sy, ex, ey,
                             F.explode(F.sequence(F.lit(1), n)).alias("position"))
    return exploded.select(
        *carry, rank_col, "position",
        interpolate(sx, ex, "position", points).alias("x_ft"),
        interpolate(sy, ey, "position", points).alias("y_ft"),
        "count",
    )


def scale_limit(period_counts: DataFrame, step: int = S.SCALE_STEP) -> DataFrame:
    """One row: the largest ``count`` and that count rounded up to ``step``."""
    mx = F.max("count")
    return period_counts.agg(mx.alias("max_count"),
                             (F.ceil(mx / step) * step).cast("bigint").alias("max_limit"))
