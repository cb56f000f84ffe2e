"""Detector networks on the sky: antenna patterns and arrival delays as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Fixed value: the speed of light, m/s.
LIGHT = 299792458.0


@dataclass(frozen=True)
class Detector:
    """A place on the Earth (m, Earth-fixed axes) and its arms' unit vectors."""

    name: str
    place: tuple[float, float, float]
    x_arm: tuple[float, float, float]
    y_arm: tuple[float, float, float]

    def response(self) -> list[list[float]]:
        """Half the difference of the arms' outer products."""
        x, y = self.x_arm, self.y_arm
        return [[(x[i] * x[j] - y[i] * y[j]) / 2 for j in range(3)] for i in range(3)]


def _wave_frame(longitude: Column, colatitude: Column, psi: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Two axes across the line of sight, turned by the polarisation angle, and the line itself."""
    st, ct, sp, cp = F.sin(colatitude), F.cos(colatitude), F.sin(longitude), F.cos(longitude)
    theta, phi, line = [ct * cp, ct * sp, -st], [-sp, cp, F.lit(0.0)], [st * cp, st * sp, ct]
    c, s = F.cos(psi), F.sin(psi)
    return [-p * c - t * s for t, p in zip(theta, phi, strict=True)], [p * s - t * c for t, p in zip(theta, phi, strict=True)], line


def _bilinear(d: list[list[float]], u: list[Column], v: list[Column]) -> Column:
    return sum((F.lit(d[i][j]) * u[i] * v[j] for i in range(3) for j in range(3)), F.lit(0.0))


def antenna(detector: Detector, ra: Column, dec: Column, psi: Column, gps: Column) -> tuple[Column, Column]:
    """F+ and Fx of a source at (ra, dec) radians at a GPS time."""
    x, y, _ = _wave_frame(ra - geo.sidereal_radians(gps), F.lit(math.pi / 2) - dec, psi)
    d = detector.response()
    return _bilinear(d, x, x) - _bilinear(d, y, y), _bilinear(d, x, y) + _bilinear(d, y, x)


def delay(detector: Detector, reference: Detector, longitude: Column, colatitude: Column) -> Column:
    """Arrival at a detector less that at the reference, seconds, for a source in an Earth-fixed direction."""
    line = _wave_frame(longitude, colatitude, F.lit(0.0))[2]
    return -sum((F.lit(a - b) * n for a, b, n in zip(detector.place, reference.place, line, strict=True)), F.lit(0.0)) / LIGHT


def sky_table(grid: DataFrame, detectors: Sequence[Detector], reference: Detector, rate: float) -> DataFrame:
    """Per direction (sky_idx, theta, phi in radians) the delays in samples and both patterns of each detector, as arrays."""
    theta, phi, zero = F.col("theta"), F.col("phi"), F.lit(0.0)
    plus, cross = [], []
    for one in detectors:
        x, y, _ = _wave_frame(phi, theta, zero)
        d = one.response()
        plus.append(_bilinear(d, x, x) - _bilinear(d, y, y))
        cross.append(_bilinear(d, x, y) + _bilinear(d, y, x))
    delays = [F.round(delay(one, reference, phi, theta) * rate).cast("int") for one in detectors]
    return grid.select("sky_idx", "theta", "phi", F.array(*delays).alias("delays"), F.array(*plus).alias("f_plus"), F.array(*cross).alias("f_cross"))


def to_icrs(system: str, first: Column, second: Column, gps: Column) -> tuple[Column, Column]:
    """(ra, dec) in radians from ``icrs`` (as it is), ``geo`` (longitude, latitude) or ``colatitude`` (longitude, co-latitude)."""
    if system == "icrs":
        return first, second
    if system not in ("geo", "colatitude"):
        raise ValueError(f"unknown coordinates: {system}")
    ra = F.pmod(first + geo.sidereal_radians(gps), F.lit(2 * math.pi))
    return ra, second if system == "geo" else F.lit(math.pi / 2) - second
