"""Families of projections, from their parameters, for numpy arrays and for Spark columns alike.

Formulas are those of Snyder, "Map Projections: A Working Manual" (1987), and for the transverse
Mercator and conformal latitudes Krüger's series to the sixth order in the third flattening.
A kernel is written once against ``m``, which holds the functions of one of the two.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np

_NUMPY = {"atanh": "arctanh", "asinh": "arcsinh", "atan": "arctan", "atan2": "arctan2", "asin": "arcsin"}
_NAMES = ("sin", "cos", "tan", "sinh", "cosh", "sqrt", "exp", "log", "hypot", "atanh", "asinh", "atan", "atan2", "asin")
NUMPY = SimpleNamespace(**{n: getattr(np, _NUMPY.get(n, n)) for n in _NAMES}, power=np.power)


def columns() -> SimpleNamespace:
    """The functions for Spark columns."""
    from pyspark.sql import functions as F

    return SimpleNamespace(**{n: getattr(F, n) for n in _NAMES}, power=F.pow)


#: Coefficients of Krüger's series, by powers of n from the first on: to the sphere's plane, back, and
#: from conformal latitudes.
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
DELTA = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175),
    (0, 0, 0, 0, 4174 / 315, -144838 / 6237),
    (0, 0, 0, 0, 0, 601676 / 22275),
)


@dataclass(frozen=True)
class Projection:
    """A projection's kind and parameters: angles in degrees, lengths in metres.

    ``lat1`` and ``lat2`` are standard parallels; of a polar stereographic one, ``lat1`` is the parallel of true scale, or the
    pole where ``k0`` holds.
    """

    kind: str
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    def series(self, table: tuple) -> list[float]:
        return [sum(c * self.n ** (k + 1) for k, c in enumerate(row)) for row in table]

    def forward(self, lon, lat, m=NUMPY):
        """(x, y) of degrees."""
        return FORWARD[self.kind](self, (lon - self.lon0) * (math.pi / 180), lat * (math.pi / 180), m)

    def inverse(self, x, y, m=NUMPY):
        """Degrees of (x, y)."""
        lam, phi = INVERSE[self.kind](self, x, y, m)
        return lam * (180 / math.pi) + self.lon0, phi * (180 / math.pi)


# -------------------------------------------------------------------- latitudes
def _scale(p: Projection, phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (p.e * math.sin(phi)) ** 2)


def _log_t(p: Projection, phi, m):
    """Logarithm of Snyder's t: the isometric latitude, negative."""
    sin = m.sin(phi)
    return m.atanh(sin * p.e) * p.e - m.atanh(sin)


def _from_conformal(p: Projection, chi, m):
    return chi + sum(d * m.sin(chi * (2 * j)) for j, d in enumerate(p.series(DELTA), 1))


def _q(p: Projection, phi, m):
    sin = m.sin(phi)
    return (1 - p.e**2) * (sin / (1 - (sin * p.e) * (sin * p.e)) + m.atanh(sin * p.e) / p.e)


def _from_q(p: Projection, q, m):
    """Latitude of an authalic q, by steps that double the right digits; numpy only."""
    phi = np.arcsin(np.clip(np.asarray(q, float) / _q(p, math.pi / 2, NUMPY), -1, 1))
    for _ in range(8):
        sin, cos = np.sin(phi), np.maximum(np.cos(phi), 1e-12)
        phi = np.clip(phi + (1 - (p.e * sin) ** 2) ** 2 / (2 * (1 - p.e**2) * cos) * (q - _q(p, phi, NUMPY)), -math.pi / 2, math.pi / 2)
    return phi


# ----------------------------------------------------------- transverse Mercator
def _rectifying_radius(p: Projection) -> float:
    n2 = p.n**2
    return p.a / (1 + p.n) * (1 + n2 / 4 + n2**2 / 64 + n2**3 / 256)


def _meridian(p: Projection) -> float:
    """Northing of the parallel of origin on the central meridian."""
    return float(_tm_plane(p, np.float64(0.0), np.float64(math.radians(p.lat0)), NUMPY)[1]) if p.lat0 else 0.0


def _tm_plane(p: Projection, lam, phi, m):
    isometric = -_log_t(p, phi, m)
    xi0, eta0 = m.atan2(m.sinh(isometric), m.cos(lam)), m.asinh(m.sin(lam) / m.hypot(m.sinh(isometric), m.cos(lam)))
    terms = list(enumerate(p.series(ALPHA), 1))
    xi = xi0 + sum(c * m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j)) for j, c in terms)
    eta = eta0 + sum(c * m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j)) for j, c in terms)
    return eta * (p.k0 * _rectifying_radius(p)), xi * (p.k0 * _rectifying_radius(p))


def _tm_forward(p: Projection, lam, phi, m):
    x, y = _tm_plane(p, lam, phi, m)
    return x + p.east, y + (p.north - _meridian(p))


def _tm_inverse(p: Projection, x, y, m):
    radius = p.k0 * _rectifying_radius(p)
    xi, eta = (y - (p.north - _meridian(p))) / radius, (x - p.east) / radius
    terms = list(enumerate(p.series(BETA), 1))
    xi0 = xi - sum(c * m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) for j, c in terms)
    eta0 = eta - sum(c * m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) for j, c in terms)
    return m.atan2(m.sinh(eta0), m.cos(xi0)), _from_conformal(p, m.atan2(m.sin(xi0), m.hypot(m.sinh(eta0), m.cos(xi0))), m)


# ------------------------------------------------------------------------ cones
def _cone(p: Projection) -> tuple[float, float, float]:
    """Lambert: the cone's constant, its radius's factor, and the radius of the parallel of origin."""
    phi1, phi2 = math.radians(p.lat1), math.radians(p.lat2)
    lt = lambda v: float(_log_t(p, np.float64(v), NUMPY))
    n = math.sin(phi1) if abs(phi1 - phi2) < 1e-12 else (math.log(_scale(p, phi1)) - math.log(_scale(p, phi2))) / (lt(phi1) - lt(phi2))
    factor = p.a * p.k0 * _scale(p, phi1) / n * math.exp(-n * lt(phi1))
    return n, factor, factor * math.exp(n * lt(math.radians(p.lat0)))


def _lcc_forward(p: Projection, lam, phi, m):
    n, factor, rho0 = _cone(p)
    rho, theta = m.exp(_log_t(p, phi, m) * n) * factor, lam * n
    return rho * m.sin(theta) + p.east, (rho0 + p.north) - rho * m.cos(theta)


def _lcc_inverse(p: Projection, x, y, m):
    n, factor, rho0 = _cone(p)
    sign = math.copysign(1.0, n)
    dx, dy = (x - p.east) * sign, (rho0 + p.north - y) * sign
    t = m.power(m.hypot(dx, dy) / (factor * sign), 1 / n)
    return m.atan2(dx, dy) / n, _from_conformal(p, math.pi / 2 - m.atan(t) * 2, m)


def _equal_area_cone(p: Projection) -> tuple[float, float, float]:
    phi1, phi2 = math.radians(p.lat1), math.radians(p.lat2)
    m1, m2, q1, q2 = _scale(p, phi1), _scale(p, phi2), _q(p, np.float64(phi1), NUMPY), _q(p, np.float64(phi2), NUMPY)
    n = math.sin(phi1) if abs(phi1 - phi2) < 1e-12 else (m1**2 - m2**2) / (q2 - q1)
    c = m1**2 + n * q1
    return float(n), float(c), float(p.a * math.sqrt(c - n * _q(p, np.float64(math.radians(p.lat0)), NUMPY)) / n)


def _albers_forward(p: Projection, lam, phi, m):
    n, c, rho0 = _equal_area_cone(p)
    rho, theta = m.sqrt(c - _q(p, phi, m) * n) * (p.a / n), lam * n
    return rho * m.sin(theta) + p.east, (rho0 + p.north) - rho * m.cos(theta)


def _albers_inverse(p: Projection, x, y, m):
    n, c, rho0 = _equal_area_cone(p)
    sign = math.copysign(1.0, n)
    dx, dy = (x - p.east) * sign, (rho0 + p.north - y) * sign
    rho = m.hypot(dx, dy)
    return m.atan2(dx, dy) / n, _from_q(p, (c - (rho * n / p.a) * (rho * n / p.a)) / n, m)


# --------------------------------------------------------- polar stereographic
def _polar(p: Projection) -> tuple[float, float]:
    """Which pole (1 or -1), and the radius's factor."""
    sign = -1.0 if p.lat0 < 0 or p.lat0 == 0 and p.lat1 < 0 else 1.0
    true = abs(math.radians(p.lat1))
    if true and true < math.pi / 2 - 1e-12:
        return sign, p.a * _scale(p, true) / math.exp(float(_log_t(p, np.float64(true), NUMPY)))
    return sign, 2 * p.a * p.k0 / math.sqrt((1 + p.e) ** (1 + p.e) * (1 - p.e) ** (1 - p.e))


def _polar_forward(p: Projection, lam, phi, m):
    sign, factor = _polar(p)
    rho = m.exp(_log_t(p, phi * sign, m)) * factor
    return rho * m.sin(lam) + p.east, rho * m.cos(lam) * -sign + p.north


def _polar_inverse(p: Projection, x, y, m):
    sign, factor = _polar(p)
    dx, dy = x - p.east, (y - p.north) * -sign
    return m.atan2(dx, dy), _from_conformal(p, math.pi / 2 - m.atan(m.hypot(dx, dy) / factor) * 2, m) * sign


FORWARD = {"tm": _tm_forward, "lcc": _lcc_forward, "albers": _albers_forward, "polar": _polar_forward}
INVERSE = {"tm": _tm_inverse, "lcc": _lcc_inverse, "albers": _albers_inverse, "polar": _polar_inverse}

# ---------------------------------------------------------------------- systems
_GRS80 = {"f": 1 / 298.257222101}
#: Systems of these families that have no rule, as their registry gives them.
SYSTEMS = {
    "EPSG:2154": Projection("lcc", 3.0, 46.5, 49.0, 44.0, east=700000.0, north=6600000.0, **_GRS80),
    "EPSG:3031": Projection("polar", 0.0, -90.0, -71.0),
    "EPSG:3034": Projection("lcc", 10.0, 52.0, 35.0, 65.0, east=4000000.0, north=2800000.0, **_GRS80),
    "EPSG:3413": Projection("polar", -45.0, 90.0, 70.0),
    "EPSG:3577": Projection("albers", 132.0, 0.0, -18.0, -36.0, **_GRS80),
    "EPSG:5070": Projection("albers", -96.0, 23.0, 29.5, 45.5, **_GRS80),
}


def by_code(name: str) -> Projection | None:
    """The projection of a system's code: those listed, and the zones of UTM by rule."""
    if name in SYSTEMS:
        return SYSTEMS[name]
    found = re.fullmatch(r"EPSG:(326|327|258)(\d\d)", name)
    zone = int(found[2]) if found else 0
    if not 1 <= zone <= 60 or found[1] == "258" and not 28 <= zone <= 38:
        return None
    return Projection("tm", 6.0 * zone - 183.0, k0=0.9996, east=500000.0, north=1e7 if found[1] == "327" else 0.0, **(_GRS80 if found[1] == "258" else {}))


# -------------------------------------------------------------- well-known text
#: Names of methods and parameters in well-known text, without case, blanks and underscores.
METHODS = {
    "transversemercator": "tm", "gausskruger": "tm", "lambertconformalconic2sp": "lcc", "lambertconicconformal(2sp)": "lcc", "lambertconformalconic": "lcc", "lambertconformalconic1sp": "lcc", "lambertconicconformal(1sp)": "lcc",
    "albersconicequalarea": "albers", "albersequalarea": "albers", "albers": "albers", "polarstereographic": "polar", "polarstereographic(varianta)": "polar", "polarstereographic(variantb)": "polar", "stereographicnorthpole": "polar", "stereographicsouthpole": "polar",
}
PARAMETERS = {
    "centralmeridian": "lon0", "longitudeofcenter": "lon0", "longitudeoffalseorigin": "lon0", "longitudeofnaturalorigin": "lon0", "longitudeoforigin": "lon0", "straightverticallongitudefrompole": "lon0",
    "latitudeoforigin": "lat0", "latitudeofcenter": "lat0", "latitudeoffalseorigin": "lat0", "latitudeofnaturalorigin": "lat0", "standardparallel1": "lat1", "latitudeof1ststandardparallel": "lat1", "latitudeofstandardparallel": "lat1",
    "standardparallel2": "lat2", "latitudeof2ndstandardparallel": "lat2", "scalefactor": "k0", "scalefactoratnaturalorigin": "k0",
    "falseeasting": "east", "eastingatfalseorigin": "east", "falsenorthing": "north", "northingatfalseorigin": "north",
}
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][\w]*)|([-+]?[\d.]+(?:[eE][-+]?\d+)?)|([\[\](),]))')


def parse_wkt(text: str) -> list:
    """A node of well-known text: its keyword, then its values and inner nodes."""
    at, stack, root = 0, [], None
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"well-known text can't be read at {text[at : at + 20]!r}.")
        at = m.end()
        if m[4] in ("[", "("):
            name = stack[-1].pop() if stack and stack[-1] else root
            node = [str(name)]
            if stack:
                stack[-1].append(node)
            stack.append(node)
        elif m[4] in ("]", ")"):
            root = stack.pop()
            if not stack:
                return root
        elif m[4] is None:
            value = m[1].replace('""', '"') if m[1] is not None else float(m[3]) if m[3] else m[2]
            if stack:
                stack[-1].append(value)
            else:
                root = value
    raise ValueError("well-known text breaks off.")


def _find(node: list, *names: str) -> list | None:
    for child in node[1:]:
        if isinstance(child, list):
            if child[0].upper() in names:
                return child
            if (deep := _find(child, *names)) is not None:
                return deep
    return None


def _plain(name: object) -> str:
    return re.sub(r"[\s_]", "", str(name)).lower()


def from_wkt(text: str) -> tuple[str, Projection | None]:
    """(name, projection) of a system in well-known text, 1 or 2; geographic ones have no projection.

    The name is the authority's code where the system's own node has one. Lengths other than metres, angles other
    than degrees, prime meridians other than Greenwich and other methods are refused.
    """
    node = parse_wkt(text)
    own = next((c for c in node[1:] if isinstance(c, list) and c[0].upper() in ("AUTHORITY", "ID")), None)
    code = own and (str(int(own[2])) if isinstance(own[2], float) else str(own[2]))
    name = f"{own[1]}:{code}".upper() if own else str(node[1])
    if node[0].upper() in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS"):
        return name, None
    method, spheroid = _find(node, "PROJECTION", "METHOD"), _find(node, "SPHEROID", "ELLIPSOID")
    if not method or not spheroid or _plain(method[1]) not in METHODS:
        raise ValueError(f"the projection of {name!r} isn't known.")
    meridian = _find(node, "PRIMEM")
    units = [c for c in node[1:] if isinstance(c, list) and c[0].upper() in ("UNIT", "LENGTHUNIT")]
    if meridian and meridian[2] != 0 or any(u[2] != 1 for u in units):
        raise ValueError(f"{name!r} isn't in metres from Greenwich.")
    kind, values = METHODS[_plain(method[1])], {}

    def collect(n: list) -> None:
        for child in n[1:]:
            if isinstance(child, list):
                if child[0].upper() == "PARAMETER":
                    key = PARAMETERS.get(_plain(child[1]))
                    if key is None:
                        raise ValueError(f"{name!r} has an unknown parameter {child[1]!r}.")
                    values[key] = child[2]
                collect(child)

    collect(node)
    flat = spheroid[3]
    if kind == "lcc" and "lat1" not in values:
        values["lat1"] = values.get("lat0", 0.0)
    if kind in ("lcc", "albers"):
        values.setdefault("lat2", values.get("lat1", 0.0))
    if kind == "polar" and "lat1" not in values and abs(values.get("lat0", 90.0)) < 90:
        values["lat1"] = values["lat0"]  # the first well-known text gives the true parallel so
    if kind == "polar" and abs(values.get("lat0", 0.0)) < 90:
        values["lat0"] = math.copysign(90.0, values.get("lat1", 90.0))
    return name, Projection(kind, a=spheroid[2], f=1 / flat if flat else 0.0, **values)
