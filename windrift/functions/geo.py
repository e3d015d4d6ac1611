"""Column functions for coordinates, winds and units. All are plain expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis and first eccentricity squared, UTM scale and false origins.
A, E2, K0, FALSE_EAST, FALSE_NORTH = 6378137.0, 0.00669437999014, 0.9996, 500000.0, 10000000.0
EP2 = E2 / (1 - E2)


def half_even(x: Column) -> Column:
    return F.rint(x)


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def half_up_floor(x: Column) -> Column:
    return F.floor(x + 0.5)


def axis(origin, spacing, index: Column) -> Column:
    return origin + index * spacing


def rotate(x: Column, y: Column, radians: Column | float, px=0.0, py=0.0) -> tuple[Column, Column]:
    """(x, y) turned counter-clockwise about (px, py)."""
    a = F.lit(radians) if isinstance(radians, (int, float)) else radians
    dx, dy = x - px, y - py
    return px + dx * F.cos(a) - dy * F.sin(a), py + dx * F.sin(a) + dy * F.cos(a)


def utm_zone(lon: Column, clamped: bool = True) -> Column:
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.least(F.greatest(zone, F.lit(1)), F.lit(60)) if clamped else zone


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def epsg_zone(epsg: Column) -> Column:
    return F.when(epsg.between(32601, 32660) | epsg.between(32701, 32760), epsg % 100)


def epsg_is_north(epsg: Column) -> Column:
    return F.when(epsg.between(32601, 32660), F.lit(True)).when(epsg.between(32701, 32760), F.lit(False))


def lonlat_to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Transverse Mercator by the usual series in longitude difference; southern northings get the false origin."""
    phi, middle = F.radians(lat), F.radians(zone * 6 - 183)
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    n = A / F.sqrt(1 - E2 * s * s)
    cc, a = EP2 * c * c, (F.radians(lon) - middle) * c
    m = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - (35 * E2**3 / 3072) * F.sin(6 * phi))
    east = K0 * n * (a + (1 - t + cc) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * EP2) * F.pow(a, 5) / 120) + FALSE_EAST
    north = K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * EP2) * F.pow(a, 6) / 720))
    return east, F.when(lat < 0, north + FALSE_NORTH).otherwise(north)


def utm_to_lonlat(east: Column, north: Column, zone: Column, is_north: Column) -> tuple[Column, Column]:
    """The inverse series, by the footpoint latitude."""
    y = F.when(is_north, north).otherwise(north - FALSE_NORTH)
    mu = y / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(foot), F.cos(foot), F.pow(F.tan(foot), 2)
    c1, n1 = EP2 * c * c, A / F.sqrt(1 - E2 * s * s)
    r1 = A * (1 - E2) / F.pow(1 - E2 * s * s, 1.5)
    d = (east - FALSE_EAST) / (n1 * K0)
    lat = foot - (n1 * F.tan(foot) / r1) * (d * d / 2 - (5 + 3 * t + 10 * c1 - 4 * c1 * c1 - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c1 + 45 * t * t - 252 * EP2 - 3 * c1 * c1) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t - 3 * c1 * c1 + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120) / c
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def local_to_lonlat(x: Column, y: Column, angle: float, px: float, py: float, x0: float, y0: float, zone: int, north: bool) -> tuple[Column, Column]:
    """Local metres (shifted to start at 0 and turned by -angle about the pivot) back to degrees."""
    e, n = rotate(x + x0, y + y0, angle, px, py)
    return utm_to_lonlat(e, n, F.lit(zone), F.lit(north))


def speed(u: Column, v: Column, w: Column | None = None) -> Column:
    return F.sqrt(u * u + v * v + (w * w if w is not None else 0))


def wind_from(speed_: Column, degrees_from: Column) -> tuple[Column, Column]:
    """Components of a wind given as the direction it blows from."""
    return -speed_ * F.sin(F.radians(degrees_from)), -speed_ * F.cos(F.radians(degrees_from))


def to_east_north(u: Column, v: Column, radians: float) -> tuple[Column, Column]:
    """Local components turned to east and north."""
    return rotate(u, v, radians)


def kelvin(celsius: Column) -> Column:
    return celsius + 273.15


def hectopascal(pascal: Column) -> Column:
    return pascal / 100


def to_lattice(value: Column, si_length: float, si_time: float) -> Column:
    """A velocity in m/s in cells a step."""
    return value * (si_time / si_length)


def height_above_ground(ph: Column, phb: Column, terrain: Column) -> Column:
    return (ph + phb) / 9.81 - terrain


def snapped(x: Column, spacing, n: Column | int) -> Column:
    """Nearest cell, held to 0..n-1."""
    last = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.least(F.greatest(half_away(x / spacing).cast("int"), F.lit(0)), last.cast("int"))


def pressure_of_density(rho: Column) -> Column:
    return (rho - 1) / 3


def compensated(k: Column, energy: Column) -> Column:
    return F.pow(k, 5 / 3) * energy


def coriolis(latitude: Column) -> Column:
    """f = 2 * omega * sin(latitude), with the earth's rate of rotation."""
    return 2 * 7.2921e-5 * F.sin(F.radians(latitude))


def downstream_face(u: Column, v: Column) -> Column:
    """The face that a mean flow leaves by."""
    return F.when(F.abs(u) >= F.abs(v), F.when(u >= 0, F.lit("east")).otherwise("west")).otherwise(F.when(v >= 0, F.lit("north")).otherwise("south"))


def yaw(u: Column, v: Column) -> Column:
    return F.degrees(F.atan2(v, u))


def boundary_patch(x: Column, y: Column, z: Column, nx: int, ny: int, nz: int) -> Column:
    """Face of a boundary cell (top first, then bottom and sides), -1 inside."""
    return F.when(z == nz - 1, 1).when(z == 0, 0).when(y == 0, 2).when(y == ny - 1, 3).when(x == 0, 4).when(x == nx - 1, 5).otherwise(-1)
