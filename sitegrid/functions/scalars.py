"""Column expressions: rounding to millimetres, projection, return distance, combinatorics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 ellipsoid, UTM scale and false easting.
SEMI_MAJOR, FLATTENING, UTM_SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
SAFE_INTEGER = 9007199254740991


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def to_mm(metres: Column) -> Column:
    return half_up(metres.cast("double") * 1000)


def demand(population: Column, per: int = 10) -> Column:
    """Parcels of one cell: a tenth of its people, rounded up cell by cell."""
    return F.ceil(population / F.lit(per)).cast("long")


def return_mm(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """There and back in a straight line."""
    dx, dy = (ax - bx).cast("double"), (ay - by).cast("double")
    return half_up(F.sqrt(dx * dx + dy * dy) * 2)


def straight_mm(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = (ax - bx).cast("double"), (ay - by).cast("double")
    return half_up(F.sqrt(dx * dx + dy * dy))


def is_safe_integer(x: Column) -> Column:
    return (x == F.floor(x)) & (F.abs(x) <= SAFE_INTEGER)


def krueger() -> tuple[float, list[float], float]:
    """Meridian radius, series coefficients and eccentricity of the transverse Mercator series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return radius, alpha, math.sqrt(FLATTENING * (2 - FLATTENING))


def utm(lon: Column, lat: Column, zone: int = 35) -> tuple[Column, Column]:
    """(easting, northing) in metres by Krueger's series; a plain column expression."""
    radius, alpha, e = krueger()
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return east * (UTM_SCALE * radius) + FALSE_EASTING, north * (UTM_SCALE * radius)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a long; exact below 2**63. Zero if k is outside 0 .. n."""
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))
    exact = F.aggregate(steps, F.lit(1).cast("long"), lambda acc, i: F.when(i <= k, F.call_function("div", acc * (n - i + 1), i)).otherwise(acc))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(exact)


#: Letters of the longest label of a bigint.
MOST_LETTERS = 14


def letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, 702 -> ZZ, 703 -> AAA, in the order of selection."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("label"))

    def step(acc, _):
        left = acc["n"] - 1
        longer = F.concat(F.char(F.lit(65) + left % 26), acc["label"])
        return F.struct(F.when(acc["n"] > 0, F.call_function("div", left, F.lit(26).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n"), F.when(acc["n"] > 0, longer).otherwise(acc["label"]).alias("label"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LETTERS)), start, step)["label"]
