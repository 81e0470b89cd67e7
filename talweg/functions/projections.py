"""Reference systems: map projections forward and back, as column expressions and for numbers.

Transverse Mercator by the series of Krueger in the form of Karney (2011), to the sixth
order of the third flattening, which is far below a millimetre within some 3,000 km of the
meridian; Lambert's conformal conic, Albers' equal-area conic and the spherical web map on
the ellipsoid's closed forms. Angles are degrees, lengths metres.

The datum is fixed: systems convert into one another only within one datum, as shifts
between datums need parameters or grids that are not here. ``assume_same_datum`` takes
coordinates over unchanged, for users who know that some metres do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.sources.grid import TerrainError

# Semi-major axis and inverse flattening: fixed values.
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)

# Coefficients of n, n**2, ... of each term, from the first power that occurs on: fixed values.
_ALPHA = (
    (1, (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800)),
    (2, (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360)),
    (3, (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440)),
    (4, (49561 / 161280, -179 / 168, 6601661 / 7257600)),
    (5, (34729 / 80640, -3418889 / 1995840)),
    (6, (212378941 / 319334400,)),
)
_BETA = (
    (1, (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800)),
    (2, (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720)),
    (3, (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720)),
    (4, (4397 / 161280, -11 / 504, -830251 / 7257600)),
    (5, (4583 / 161280, -108847 / 3991680)),
    (6, (20648693 / 638668800,)),
)
# Latitude from the conformal one.
_DELTA = (
    (1, (2.0, -2 / 3, -2.0, 116 / 45, 26 / 45, -2854 / 675)),
    (2, (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945)),
    (3, (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835)),
    (4, (4279 / 630, -332 / 35, -399572 / 14175)),
    (5, (4174 / 315, -144838 / 6237)),
    (6, (601676 / 22275,)),
)


class _Numbers:
    """The functions of columns, for numbers."""

    sin, cos, tan, atan, atan2, asin, sinh, cosh, asinh, atanh, hypot, exp, log, sqrt, pow = (getattr(math, x) for x in "sin cos tan atan atan2 asin sinh cosh asinh atanh hypot exp log sqrt pow".split())

    @staticmethod
    def again(n: int, start, step):
        for _ in range(n):
            start = step(start)
        return start


class _Columns:
    sin, cos, tan, atan, atan2, asin, sinh, cosh, asinh, atanh, hypot, exp, log, sqrt, pow = (staticmethod(getattr(F, x)) for x in "sin cos tan atan atan2 asin sinh cosh asinh atanh hypot exp log sqrt pow".split())

    @staticmethod
    def again(n: int, start, step):
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda a, _: step(a))


def _kit(x) -> type:
    return _Columns if isinstance(x, Column) else _Numbers


def _terms(n: float, table) -> list[float]:
    return [sum(c * n ** (first + i) for i, c in enumerate(row)) for first, row in table]


@dataclass(frozen=True)
class System:
    """A geographic system; angles in degrees, as (longitude, latitude)."""

    datum: str
    ellipsoid: tuple[float, float] = GRS80

    @property
    def flattening(self) -> float:
        return 1 / self.ellipsoid[1]

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    def forward(self, lon, lat):
        return lon, lat

    def inverse(self, x, y):
        return x, y

    def _conformal_sinh(self, m, phi):
        """Tangent of the conformal latitude."""
        e = math.sqrt(self.e2)
        return m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * e) * e)

    def _from_conformal(self, m, chi):
        out = chi
        for k, d in enumerate(_terms(self.n, _DELTA), 1):
            out = out + m.sin(chi * (2 * k)) * d
        return out


@dataclass(frozen=True)
class TransverseMercator(System):
    lon0: float = 0.0
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0

    @property
    def radius(self) -> float:
        """Of the rectifying circle, scaled."""
        n = self.n
        return self.scale * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    def _raw(self, m, phi, lam):
        t = self._conformal_sinh(m, phi)
        xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.hypot(t, m.cos(lam)))
        x, y = eta, xi
        for k, a in enumerate(_terms(self.n, _ALPHA), 1):
            y = y + m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * a
            x = x + m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * a
        return x * self.radius, y * self.radius

    def _origin(self) -> float:
        return self._raw(_Numbers, math.radians(self.lat0), 0.0)[1] if self.lat0 else 0.0

    def forward(self, lon, lat):
        x, y = self._raw(_kit(lat), lat * (math.pi / 180), (lon - self.lon0) * (math.pi / 180))
        return x + self.east, y + (self.north - self._origin())

    def inverse(self, x, y):
        m = _kit(x)
        eta, xi = (x - self.east) / self.radius, (y - (self.north - self._origin())) / self.radius
        p, q = xi, eta
        for k, b in enumerate(_terms(self.n, _BETA), 1):
            p = p - m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * b
            q = q - m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * b
        chi = m.asin(m.sin(p) / m.cosh(q))
        return m.atan2(m.sinh(q), m.cos(p)) * (180 / math.pi) + self.lon0, self._from_conformal(m, chi) * (180 / math.pi)


def _around(m, lam):
    """An angle within half a turn."""
    return m.atan2(m.sin(lam), m.cos(lam))


@dataclass(frozen=True)
class LambertConic(System):
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    east: float = 0.0
    north: float = 0.0

    def _parts(self, m, phi):
        """Radius over its constant, and the width of a parallel over the axis."""
        psi = m.asinh(self._conformal_sinh(m, phi))  # isometric latitude
        return psi, m.cos(phi) / m.sqrt(1 - m.pow(m.sin(phi), 2) * self.e2)

    def _cone(self) -> tuple[float, float, float]:
        p1, w1 = self._parts(_Numbers, math.radians(self.lat1))
        p2, w2 = self._parts(_Numbers, math.radians(self.lat2))
        c = math.sin(math.radians(self.lat1)) if abs(self.lat1 - self.lat2) < 1e-10 else (math.log(w1) - math.log(w2)) / (p2 - p1)
        k = self.ellipsoid[0] * w1 / c * math.exp(c * p1)
        return c, k, k * math.exp(-c * self._parts(_Numbers, math.radians(self.lat0))[0])

    def forward(self, lon, lat):
        m = _kit(lat)
        c, k, r0 = self._cone()
        r = m.exp(self._parts(m, lat * (math.pi / 180))[0] * -c) * k
        a = _around(m, (lon - self.lon0) * (math.pi / 180)) * c
        return r * m.sin(a) + self.east, r * m.cos(a) * -1.0 + (self.north + r0)

    def inverse(self, x, y):
        m = _kit(x)
        c, k, r0 = self._cone()
        sign = math.copysign(1.0, c)
        dx, dy = (x - self.east) * sign, ((y - self.north) * -1.0 + r0) * sign
        psi = m.log(m.hypot(dx, dy) / abs(k)) * (-1 / c)
        chi = m.atan(m.sinh(psi))
        return m.atan2(dx, dy) * (180 / math.pi / c) + self.lon0, self._from_conformal(m, chi) * (180 / math.pi)


@dataclass(frozen=True)
class AlbersConic(LambertConic):
    def _q(self, m, phi):
        """Area between the equator and a parallel, in units of the axis squared and half a turn."""
        e, s = math.sqrt(self.e2), m.sin(phi)
        return (s / (1 - m.pow(s, 2) * self.e2) + m.atanh(s * e) * (1 / e)) * (1 - self.e2)

    def _cone(self) -> tuple[float, float, float]:
        a = self.ellipsoid[0]
        q1, q2 = (self._q(_Numbers, math.radians(x)) for x in (self.lat1, self.lat2))
        w1, w2 = (self._parts(_Numbers, math.radians(x))[1] for x in (self.lat1, self.lat2))
        c = math.sin(math.radians(self.lat1)) if abs(self.lat1 - self.lat2) < 1e-10 else (w1**2 - w2**2) / (q2 - q1)
        k = w1**2 + c * q1
        return c, k, a * math.sqrt(k - c * self._q(_Numbers, math.radians(self.lat0))) / c

    def forward(self, lon, lat):
        m = _kit(lat)
        c, k, r0 = self._cone()
        r = m.sqrt(self._q(m, lat * (math.pi / 180)) * -c + k) * (self.ellipsoid[0] / c)
        t = _around(m, (lon - self.lon0) * (math.pi / 180)) * c
        return r * m.sin(t) + self.east, r * m.cos(t) * -1.0 + (self.north + r0)

    def inverse(self, x, y):
        m = _kit(x)
        c, k, r0 = self._cone()
        sign = math.copysign(1.0, c)
        dx, dy = (x - self.east) * sign, ((y - self.north) * -1.0 + r0) * sign
        q = (m.pow(m.hypot(dx, dy) * (c / self.ellipsoid[0]), 2) * -1.0 + k) / c
        pole = self._q(_Numbers, math.pi / 2)

        def nearer(phi):
            s = m.sin(phi)
            w = 1 - m.pow(s, 2) * self.e2
            return phi + (q - self._q(m, phi)) * m.pow(w, 2) / (m.cos(phi) * (2 * (1 - self.e2)))

        phi = m.again(6, m.asin(q / pole), nearer)
        return m.atan2(dx, dy) * (180 / math.pi / c) + self.lon0, phi * (180 / math.pi)


@dataclass(frozen=True)
class WebMercator(System):
    def forward(self, lon, lat):
        m, a = _kit(lat), self.ellipsoid[0]
        return lon * (math.pi / 180 * a), m.asinh(m.tan(lat * (math.pi / 180))) * a

    def inverse(self, x, y):
        m, a = _kit(x), self.ellipsoid[0]
        return x * (180 / math.pi / a), m.atan(m.sinh(y / a)) * (180 / math.pi)


# EPSG codes of single systems: fixed values.
_SINGLE = {
    4326: System("WGS84", WGS84),
    4258: System("ETRS89"),
    4269: System("NAD83"),
    4283: System("GDA94"),
    7844: System("GDA2020"),
    3857: WebMercator("WGS84", WGS84),
    2154: LambertConic("ETRS89", GRS80, 3.0, 46.5, 49.0, 44.0, 700_000.0, 6_600_000.0),
    3034: LambertConic("ETRS89", GRS80, 10.0, 52.0, 35.0, 65.0, 4_000_000.0, 2_800_000.0),
    3112: LambertConic("GDA94", GRS80, 134.0, 0.0, -18.0, -36.0, 0.0, 0.0),
    7845: LambertConic("GDA2020", GRS80, 134.0, 0.0, -18.0, -36.0, 0.0, 0.0),
    3577: AlbersConic("GDA94", GRS80, 132.0, 0.0, -18.0, -36.0, 0.0, 0.0),
    9473: AlbersConic("GDA2020", GRS80, 132.0, 0.0, -18.0, -36.0, 0.0, 0.0),
    5070: AlbersConic("NAD83", GRS80, -96.0, 23.0, 29.5, 45.5, 0.0, 0.0),
}
# Blocks of zones of six degrees: first code, last code, number before zone 1, datum, ellipsoid, false northing.
_ZONES = (
    (32601, 32660, 32600, "WGS84", WGS84, 0.0),
    (32701, 32760, 32700, "WGS84", WGS84, 10_000_000.0),
    (25828, 25838, 25800, "ETRS89", GRS80, 0.0),
    (26901, 26923, 26900, "NAD83", GRS80, 0.0),
    (28348, 28358, 28300, "GDA94", GRS80, 10_000_000.0),
    (7846, 7859, 7800, "GDA2020", GRS80, 10_000_000.0),
)


def system(crs: str) -> System:
    """The system of a name ``EPSG:n``."""
    digits = crs.strip().upper().removeprefix("EPSG:")
    code = int(digits) if digits.isdigit() else 0
    if code in _SINGLE:
        return _SINGLE[code]
    for first, last, base, datum, ellipsoid, north in _ZONES:
        if first <= code <= last:
            return TransverseMercator(datum, ellipsoid, (code - base) * 6.0 - 183.0, north=north)
    raise TerrainError(f"reference system {crs or '(none)'} is not known here: convert the coordinates first")


@dataclass(frozen=True)
class Transform:
    """From one system to another: of numbers or of columns."""

    source: System
    target: System
    same: bool = field(default=False)

    def __call__(self, x, y):
        return (x, y) if self.same else self.target.forward(*self.source.inverse(x, y))


def transform(source: str, target: str, assume_same_datum: bool = False) -> Transform:
    a, b = source.strip().upper(), target.strip().upper()
    if a == b:
        return Transform(System(""), System(""), True)
    out = Transform(system(a), system(b))
    if out.source.datum != out.target.datum and not assume_same_datum:
        raise TerrainError(f"{source} is on {out.source.datum} and {target} on {out.target.datum}: shifts between datums are not made here")
    return out


def reproject(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y", assume_same_datum: bool = False) -> DataFrame:
    """df with the columns x and y converted; what cannot be converted becomes null."""
    change = transform(source, target, assume_same_datum)
    new = change(F.col(x).cast("double"), F.col(y).cast("double"))
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.withColumns({x: finite(new[0]), y: finite(new[1])})


def reproject_points(df: DataFrame, source: str, target: str, points: str = "points", assume_same_datum: bool = False) -> DataFrame:
    """df with a column of arrays of points (x, y) converted."""
    change = transform(source, target, assume_same_datum)

    def point(p: Column) -> Column:
        new = change(p["x"], p["y"])
        return F.struct(new[0].alias("x"), new[1].alias("y"))

    return df.withColumn(points, F.transform(points, point))
