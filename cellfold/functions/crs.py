"""A small registry of coordinate systems, and their projections in numpy.

Formulas are those of Snyder, "Map Projections: A Working Manual" (1987), on the
WGS84 and GRS80 ellipsoids; ``projections`` has the families that parameters tell apart. Systems outside
the registry are refused by name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

from cellfold.errors import CrsMismatchError
from cellfold.functions.projections import SYSTEMS, Projection, by_code, from_wkt

#: WGS84: semi-major axis and flattening. GRS80 differs in the flattening only.
WGS84_A, WGS84_F, GRS80_F = 6378137.0, 1 / 298.257223563, 1 / 298.257222101


@dataclass(frozen=True)
class Crs:
    """A coordinate system: its name and, if geographic, half a turn in its unit."""

    name: str
    kind: str
    half_turn: float | None = None
    projection: Projection | None = None

    @property
    def geographic(self) -> bool:
        return self.half_turn is not None


#: The systems this engine knows.
KNOWN = {
    "EPSG:4326": Crs("EPSG:4326", "degrees", 180.0),
    "EPSG:4807": Crs("EPSG:4807", "grads", 200.0),
    "EPSG:3857": Crs("EPSG:3857", "mercator"),
    "ESRI:54009": Crs("ESRI:54009", "mollweide"),
    "EPSG:3035": Crs("EPSG:3035", "laea"),
    "EPSG:6933": Crs("EPSG:6933", "cea"),
}
#: Other names of the same systems.
ALIASES = {"OGC:CRS84": "EPSG:4326", "CRS84": "EPSG:4326", "WGS84": "EPSG:4326", "EPSG:900913": "EPSG:3857", "EPSG:54009": "ESRI:54009"}


def as_crs(value: object, parameter: str = "input") -> Crs:
    """The known system that ``value`` (a Crs, a name, a URN or a number) names."""
    if value is None:
        raise ValueError(f"{parameter} must define a CRS.")
    if isinstance(value, Crs):
        return value
    text = f"EPSG:{value}" if isinstance(value, int) else str(value).strip().upper()
    if found := re.fullmatch(r"URN:OGC:DEF:CRS:(\w+):[^:]*:(\w+)", text):
        text = f"{found[1]}:{found[2]}"
    text = ALIASES.get(text, text)
    if re.match(r"(PROJ|GEOG|GEOD)[A-Z]*\s*[\[(]", text):
        return _from_text(str(value).strip(), parameter)
    if text not in KNOWN and (found := by_code(text)):
        return Crs(text, found.kind, projection=found)
    if text not in KNOWN:
        raise ValueError(f"{parameter} CRS could not be read: {value!r}. Known systems: {', '.join(sorted({*KNOWN, *SYSTEMS}))}, zones of UTM, and well-known text.")
    return KNOWN[text]


def _from_text(text: str, parameter: str) -> Crs:
    """A system from well-known text: a known one by its code, else by its parameters."""
    try:
        name, projection = from_wkt(text)
    except (ValueError, IndexError, TypeError) as error:
        raise ValueError(f"{parameter} CRS could not be read: {error}") from error
    name = ALIASES.get(name, name)
    if name in KNOWN:
        return KNOWN[name]
    if projection is None:
        raise ValueError(f"{parameter} CRS could not be read: {name!r} is another geographic system than EPSG:4326.")
    return Crs(name, projection.kind, projection=projection)


def match(hazard: object, population: object, allow_reprojection: bool) -> bool:
    """Whether to reproject; refuses different systems unless that is allowed."""
    left, right = as_crs(hazard, "hazard"), as_crs(population, "population")
    if left == right:
        return False
    if not allow_reprojection:
        raise CrsMismatchError(f"The hazard uses {left.name} and the population uses {right.name}. Bring both to one system, or pass allow_reprojection=True.")
    return True


# ----------------------------------------------------------------- projections
def _qs(sin: np.ndarray, e: float) -> np.ndarray:
    return (1 - e * e) * (sin / (1 - (e * sin) ** 2) + np.arctanh(e * sin) / e)


def _authalic(beta: np.ndarray, e: float) -> np.ndarray:
    """Latitude of an authalic latitude, by Newton steps on q."""
    q = _qs(np.array(1.0), e) * np.sin(beta)
    phi = beta.copy() if isinstance(beta, np.ndarray) else np.array(beta)
    for _ in range(12):
        sin, cos = np.sin(phi), np.maximum(np.cos(phi), 1e-12)
        phi = phi + (1 - (e * sin) ** 2) ** 2 / (2 * (1 - e * e) * cos) * (q - _qs(sin, e)) * 1.0
        phi = np.clip(phi, -math.pi / 2, math.pi / 2)
    return phi


def _ellipsoid(f: float) -> float:
    return math.sqrt(f * (2 - f))


def _mollweide_theta(phi: np.ndarray) -> np.ndarray:
    """The auxiliary angle: 2θ + sin 2θ = π sin φ, by Newton steps and exact at the poles."""
    target, theta = math.pi * np.sin(phi), np.array(phi, float)
    for _ in range(60):
        slope = 2 + 2 * np.cos(2 * theta)
        step = np.where(slope > 1e-14, (2 * theta + np.sin(2 * theta) - target) / np.maximum(slope, 1e-14), 0)
        theta = np.clip(theta - step, -math.pi / 2, math.pi / 2)
    return np.where(np.abs(phi) >= math.pi / 2 - 1e-12, np.sign(phi) * math.pi / 2, theta)


def _laea():
    e = _ellipsoid(GRS80_F)
    phi0, lam0, fe, fn = math.radians(52), math.radians(10), 4321000.0, 3210000.0
    qp = float(_qs(np.array(1.0), e))
    beta0 = math.asin(float(_qs(np.array(math.sin(phi0)), e)) / qp)
    rq = WGS84_A * math.sqrt(qp / 2)
    d = WGS84_A * math.cos(phi0) / math.sqrt(1 - (e * math.sin(phi0)) ** 2) / (rq * math.cos(beta0))
    return e, lam0, fe, fn, qp, beta0, rq, d


def forward(crs: Crs, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of WGS84 degrees; not finite where the system can't represent them."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    lam, phi = np.radians(lon), np.radians(lat)
    with np.errstate(all="ignore"):
        outside = (np.abs(lat) > 90 + 1e-9) | ~np.isfinite(lon) | ~np.isfinite(lat)
        if crs.projection:
            x, y = crs.projection.forward(lon, lat)
        elif crs.kind == "degrees":
            x, y = lon, lat
        elif crs.kind == "mercator":
            x, y = WGS84_A * lam, WGS84_A * np.arctanh(np.sin(phi))
            outside = outside | (np.abs(lat) >= 90)
        elif crs.kind == "mollweide":
            theta = _mollweide_theta(phi)
            wrapped = (lam + math.pi) % (2 * math.pi) - math.pi
            lam = np.where(np.abs(lam) <= math.pi, lam, wrapped)
            x, y = WGS84_A * 2 * math.sqrt(2) / math.pi * lam * np.cos(theta), WGS84_A * math.sqrt(2) * np.sin(theta)
        elif crs.kind == "laea":
            e, lam0, fe, fn, qp, beta0, rq, d = _laea()
            beta = np.arcsin(np.clip(_qs(np.sin(phi), e) / qp, -1, 1))
            dl = lam - lam0
            denominator = 1 + math.sin(beta0) * np.sin(beta) + math.cos(beta0) * np.cos(beta) * np.cos(dl)
            b = rq * np.sqrt(2 / denominator)
            x = fe + b * d * np.cos(beta) * np.sin(dl)
            y = fn + b / d * (math.cos(beta0) * np.sin(beta) - math.sin(beta0) * np.cos(beta) * np.cos(dl))
            outside = outside | (denominator <= 1e-12)
        elif crs.kind == "cea":
            e, k0 = _ellipsoid(WGS84_F), math.cos(math.radians(30)) / math.sqrt(1 - (_ellipsoid(WGS84_F) * math.sin(math.radians(30))) ** 2)
            x, y = WGS84_A * k0 * lam, WGS84_A * _qs(np.sin(phi), e) / (2 * k0)
        else:
            raise CrsMismatchError(f"{crs.name} can't be reached by reprojection.")
    return np.where(outside, np.nan, x), np.where(outside, np.nan, y)


def inverse(crs: Crs, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WGS84 degrees of coordinates; not finite where there are none."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    with np.errstate(all="ignore"):
        if crs.projection:
            return crs.projection.inverse(x, y)
        if crs.kind == "degrees":
            return x, y
        if crs.kind == "mercator":
            return np.degrees(x / WGS84_A), np.degrees(np.arctan(np.sinh(y / WGS84_A)))
        if crs.kind == "mollweide":
            sin = y / (WGS84_A * math.sqrt(2))
            theta = np.arcsin(np.where(np.abs(sin) <= 1 + 1e-12, np.clip(sin, -1, 1), np.nan))
            phi = np.arcsin(np.clip((2 * theta + np.sin(2 * theta)) / math.pi, -1, 1))
            cos = np.cos(theta)
            lam = np.where(cos > 1e-12, math.pi * x / (2 * math.sqrt(2) * WGS84_A * np.maximum(cos, 1e-300)), 0)
            lam = np.where(np.isnan(theta) | (np.abs(lam) > math.pi * (1 + 1e-9)), np.nan, np.clip(lam, -math.pi, math.pi))
            return np.degrees(lam), np.degrees(np.where(np.isnan(lam), np.nan, phi))
        if crs.kind == "laea":
            e, lam0, fe, fn, qp, beta0, rq, d = _laea()
            u, v = (x - fe) / d, d * (y - fn)
            rho = np.hypot(u, v)
            c = 2 * np.arcsin(np.where(rho <= 2 * rq, rho / (2 * rq), np.nan))
            safe = np.maximum(rho, 1e-12)
            beta = np.arcsin(np.clip(np.cos(c) * math.sin(beta0) + v * np.sin(c) * math.cos(beta0) / safe, -1, 1))
            lam = lam0 + np.arctan2(u * np.sin(c), safe * math.cos(beta0) * np.cos(c) - v * math.sin(beta0) * np.sin(c))
            return np.degrees(lam), np.degrees(_authalic(beta, e))
        if crs.kind == "cea":
            e = _ellipsoid(WGS84_F)
            k0 = math.cos(math.radians(30)) / math.sqrt(1 - (e * math.sin(math.radians(30))) ** 2)
            sin = 2 * y * k0 / (WGS84_A * _qs(np.array(1.0), e))
            beta = np.arcsin(np.where(np.abs(sin) <= 1 + 1e-12, np.clip(sin, -1, 1), np.nan))
            return np.degrees(x / (WGS84_A * k0)), np.degrees(_authalic(beta, e))
    raise CrsMismatchError(f"{crs.name} can't be left by reprojection.")


def transform(source: Crs, target: Crs, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of ``source`` in ``target``; refuses points that ``target`` can't represent."""
    if source == target:
        return np.asarray(x, float), np.asarray(y, float)
    lon, lat = inverse(source, x, y)
    u, v = forward(target, lon, lat)
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        raise CrsMismatchError("A geometry reaches outside what the population coordinate system can represent.")
    return u, v
