"""Distances on the ellipsoid, as column expressions that converge for every pair of points.

The azimuth at the first point is found by halving an interval: the longitude that
a geodesic of that azimuth has covered when it reaches the other's latitude grows
with the azimuth, antipodal points included, where the usual iteration of the
longitude doesn't converge.  The longitude and the length follow Vincenty's series.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: WGS 84, metres in a mile.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
MILE = 1609.344
#: Halvings of the azimuth's interval: 2 ** -52 of a half turn.
HALVINGS = 52
#: Under this latitude (radians) a point is on the equator, for the distance of a quarter of a millimetre.
EQUATOR = 4e-11


def _triangle(azimuth: Column, s: Column) -> Column:
    """The geodesic of an azimuth from the first point to the other's latitude: ``sigma`` (arc), ``twice`` (both arcs from the node), ``equator`` (sine of its azimuth there), ``longitude``."""
    def arcs(a: Column) -> Column:
        e = F.sin(a) * s.cos1
        c1 = F.cos(a) * s.cos1
        c2 = F.sqrt(F.greatest(F.lit(0.0), c1 * c1 + (s.cos2 - s.cos1) * (s.cos2 + s.cos1)))
        return F.struct(e.alias("e"), F.atan2(s.sin1, c1).alias("s1"), F.atan2(s.sin2, c2).alias("s2"), F.atan2(e * s.sin1, c1).alias("w1"), F.atan2(e * s.sin2, c2).alias("w2"))

    def longitude(t: Column) -> Column:
        turn = t.w2 - t.w1
        w = F.when(turn < 0, turn + 2 * F.pi()).otherwise(turn)
        sigma, twice, rest = t.s2 - t.s1, t.s1 + t.s2, 1 - t.e * t.e
        k = F.lit(FLATTENING / 16) * rest * (F.lit(4 + 4 * FLATTENING) - F.lit(3 * FLATTENING) * rest)
        m = F.cos(twice)
        slip = (1 - k) * FLATTENING * t.e * (sigma + k * F.sin(sigma) * (m + k * F.cos(sigma) * (2 * m * m - 1)))
        return F.struct(sigma.alias("sigma"), twice.alias("twice"), t.e.alias("equator"), (w - slip).alias("longitude"))

    return let(let(azimuth, arcs), longitude)


def _length(t: Column) -> Column:
    """Metres of a geodesic by its arc."""
    axis = AXIS * (1 - FLATTENING)
    stretch = (AXIS**2 - axis**2) / axis**2

    def metres(u: Column) -> Column:
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m, sin, cos = F.cos(t.twice), F.sin(t.sigma), F.cos(t.sigma)
        slip = b * sin * (m + b / 4 * (cos * (2 * m * m - 1) - b / 6 * m * (4 * sin * sin - 3) * (4 * m * m - 3)))
        return axis * a * (t.sigma - slip)

    return let((1 - t.equator * t.equator) * stretch, metres)


def geodesic_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the shortest way on the ellipsoid, from degrees.  A null coordinate, or a latitude beyond a pole, gives null."""
    p, q = F.radians(lat1), F.radians(lat2)
    # The point farther from the equator comes first, south of it: so the azimuth settles everything.
    far, near = F.when(F.abs(p) >= F.abs(q), p).otherwise(q), F.when(F.abs(p) >= F.abs(q), q).otherwise(p)
    first, second = -F.abs(far), F.when(far > 0, -near).otherwise(near)
    apart = F.pmod(lon2 - lon1, F.lit(360.0))
    reduced = lambda x: F.atan(F.lit(1 - FLATTENING) * F.tan(x))

    def sides(b: Column) -> Column:
        one = F.least(b.b1, F.lit(-1e-300))
        return F.struct(F.sin(one).alias("sin1"), F.cos(one).alias("cos1"), F.sin(b.b2).alias("sin2"), F.cos(b.b2).alias("cos2"), b.far.alias("far"), F.radians(F.least(b.apart, 360.0 - b.apart)).alias("apart"))

    def solved(s: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("lo"), F.pi().cast("double").alias("hi"))

        def halve(at: Column, _: Column) -> Column:
            def half(mid: Column) -> Column:
                short = _triangle(mid, s).longitude < s.apart
                return F.struct(F.when(short, mid).otherwise(at.lo).alias("lo"), F.when(short, at.hi).otherwise(mid).alias("hi"))

            return let((at.lo + at.hi) / 2, half)

        found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda at: (at.lo + at.hi) / 2)
        along = (s.far < EQUATOR) & (s.apart <= F.pi() * (1 - FLATTENING))
        return F.when(along, s.apart * AXIS).otherwise(let(_triangle(found, s), _length))

    bases = F.struct(reduced(first).alias("b1"), reduced(second).alias("b2"), F.abs(far).alias("far"), apart.alias("apart"))
    known = (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90) & lon1.isNotNull() & lon2.isNotNull()
    return F.when(known, let(let(bases, sides), solved))


def geodesic_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return geodesic_metres(lat1, lon1, lat2, lon2) / MILE
