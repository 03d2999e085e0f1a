"""Planar map geometry as Column arithmetic.

The map layer of the trip reports is the New York Long Island State Plane
system (NAD83, US survey feet), a Lambert conformal conic projection with
two standard parallels.  The projection is evaluated with built-in math
functions (``sin``, ``tan``, ``pow`` ...) so it runs inside whole-stage
codegen on every executor; only the handful of projection constants are
derived on the driver, from the parameters alone.

Formulas: J. P. Snyder, *Map Projections -- A Working Manual*, USGS
Professional Paper 1395 (1987), eqs. 15-1 .. 15-9 (ellipsoidal form).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclestat.functions._util import as_col


@dataclass(frozen=True)
class LambertConformalConic:
    """Parameters of a two-parallel Lambert conformal conic projection."""

    semi_major_m: float
    inverse_flattening: float
    standard_parallel_1: float
    standard_parallel_2: float
    latitude_of_origin: float
    central_meridian: float
    false_easting: float  # in output units
    false_northing: float  # in output units
    unit_m: float  # metres per output unit

    @cached_property
    def constants(self) -> dict[str, float]:
        f = 1.0 / self.inverse_flattening
        e2 = 2 * f - f * f
        e = math.sqrt(e2)

        def m(phi: float) -> float:
            return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

        def t(phi: float) -> float:
            es = e * math.sin(phi)
            return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (e / 2)

        p1, p2, p0 = (math.radians(v) for v in (self.standard_parallel_1,
                                                self.standard_parallel_2,
                                                self.latitude_of_origin))
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        big_f = m(p1) / (n * t(p1) ** n)
        a_f = self.semi_major_m * big_f / self.unit_m  # in output units
        return {
            "e": e,
            "n": n,
            "aF": a_f,
            "rho0": a_f * t(p0) ** n,
            "lon0_rad": math.radians(self.central_meridian),
            "fe": self.false_easting,
            "fn": self.false_northing,
        }

    def project_point(self, lon: float, lat: float) -> tuple[float, float]:
        """Driver-side reference of the same formula, for tests and checks."""
        c = self.constants
        phi = math.radians(lat)
        es = c["e"] * math.sin(phi)
        t = math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (c["e"] / 2)
        rho = c["aF"] * t ** c["n"]
        theta = c["n"] * (math.radians(lon) - c["lon0_rad"])
        return (rho * math.sin(theta) + c["fe"], c["rho0"] - rho * math.cos(theta) + c["fn"])

    def unproject_point(self, x: float, y: float) -> tuple[float, float]:
        """Longitude and latitude of a projected point (Snyder's eqs. 15-11, 7-9 by iteration)."""
        c = self.constants
        east, north = x - c["fe"], c["rho0"] - (y - c["fn"])
        t = (math.hypot(east, north) / c["aF"]) ** (1 / c["n"])
        phi = math.pi / 2 - 2 * math.atan(t)
        for _ in range(12):
            es = c["e"] * math.sin(phi)
            phi = math.pi / 2 - 2 * math.atan(t * ((1 - es) / (1 + es)) ** (c["e"] / 2))
        return math.degrees(math.atan2(east, north) / c["n"] + c["lon0_rad"]), math.degrees(phi)

    def degree_box(self, x_range: tuple[float, float], y_range: tuple[float, float],
                   margin: float = 1e-6) -> tuple[tuple[float, float], tuple[float, float]]:
        """The least ranges of longitude and latitude that hold a projected rectangle, and ``margin`` degrees more.

        Longitude follows the angle at the cone's point, which is extreme in corners; latitude
        falls with the distance from that point, which is extreme in corners or, where the
        central meridian crosses the rectangle, on it.
        """
        xs = [*x_range, min(max(self.false_easting, x_range[0]), x_range[1])]
        points = [self.unproject_point(x, y) for x in xs for y in y_range]
        lons, lats = zip(*points)
        return (min(lons) - margin, max(lons) + margin), (min(lats) - margin, max(lats) + margin)

    def _rho_theta(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        c = self.constants
        phi = F.radians(lat)
        es = F.lit(c["e"]) * F.sin(phi)
        t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(c["e"] / 2))
        rho = F.lit(c["aF"]) * F.pow(t, F.lit(c["n"]))
        theta = F.lit(c["n"]) * (F.radians(lon) - F.lit(c["lon0_rad"]))
        return rho, theta

    def x(self, lon: str | Column, lat: str | Column) -> Column:
        rho, theta = self._rho_theta(as_col(lon), as_col(lat))
        return rho * F.sin(theta) + F.lit(self.constants["fe"])

    def y(self, lon: str | Column, lat: str | Column) -> Column:
        rho, theta = self._rho_theta(as_col(lon), as_col(lat))
        c = self.constants
        return F.lit(c["rho0"]) - rho * F.cos(theta) + F.lit(c["fn"])


# --- fixed values (the map layer's coordinate system, NAD83 / New York Long
# Island State Plane, FIPS 3104, US feet) --------------------------------------
LONG_ISLAND_FEET = LambertConformalConic(
    semi_major_m=6378137.0,
    inverse_flattening=298.257222101,
    standard_parallel_1=40.66666666666666,
    standard_parallel_2=41.03333333333333,
    latitude_of_origin=40.16666666666666,
    central_meridian=-74.0,
    false_easting=984250.0,
    false_northing=0.0,
    unit_m=0.3048006096012192,
)
# Map viewport of the station and path maps, in projected feet.
VIEWPORT_X = (975000.0, 1025000.0)
VIEWPORT_Y = (175000.0, 232000.0)
# -----------------------------------------------------------------------------


def in_viewport(x: str | Column, y: str | Column,
                x_range=VIEWPORT_X, y_range=VIEWPORT_Y) -> Column:
    """Point lies in the closed map window."""
    return (as_col(x).between(*x_range)) & (as_col(y).between(*y_range))


def interpolate(a: str | Column, b: str | Column, position: str | Column, count: int) -> Column:
    """Point ``position`` (1-based) of ``count`` evenly spaced from ``a`` to ``b``.

    Position 1 is exactly ``a`` and position ``count`` exactly ``b``.
    """
    a, b, i = as_col(a), as_col(b), as_col(position)
    if count < 2:
        return a
    step = (b - a) / (count - 1)
    return F.when(i == count, b).otherwise(a + (i - 1) * step)
