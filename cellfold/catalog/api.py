"""Listing, downloading, registering and resolving population selections."""

from __future__ import annotations

import os
import shutil
import zipfile
from pathlib import Path

from cellfold.catalog import cache
from cellfold.catalog.fetch import extract_member, fetch
from cellfold.catalog.selection import looks_like_selection, parse
from cellfold.catalog.sources import SOURCES, Selection, Source

TOKEN_ENV = "EARTHDATA_TOKEN"
MAX_REGISTERED = 10_000_000_000
CUBE_FILE = "demographics_hybrid_1950_2020_15_min.nc"


def list_sources() -> tuple[Source, ...]:
    return tuple(SOURCES.values())


def info(selection: str) -> Selection:
    return Selection.of(*parse(selection))


def download(selection: str, *, cache_dir=None, refresh: bool = False, offline: bool | None = None, earthdata_token: str | None = None) -> Path:
    """The local file of a selection, downloaded, checked and installed if it isn't there yet."""
    if not isinstance(refresh, bool):
        raise TypeError("refresh must be a boolean.")
    source, year = parse(selection)
    chosen, base = Selection.of(source, year), cache.root(cache_dir)
    entry, without_net = cache.Entry.of(base, source, year), cache.offline(offline)
    if cache.verified(entry.raster, selection) and not refresh:
        return entry.raster
    if without_net and (source.delivery != "cube" or refresh):
        raise ValueError(f"Offline: {selection!r} has no checked local copy.")
    with cache.locked(entry.lock, repr(selection)):
        held = cache.verified(entry.raster, selection)
        if held and not refresh:
            return entry.raster
        if source.delivery == "manual":
            if held:
                raise ValueError(f"{selection!r} was registered by hand and can't be refreshed; register a new file instead.")
            raise ValueError(f"{selection!r} must be obtained by hand from {source.landing_page}; then call register().")
        if refresh:
            entry.partial.unlink(missing_ok=True)
        if source.delivery == "cube":
            return _derive(source, chosen, entry, base, refresh, without_net)
        return _fetch(source, chosen, entry, _headers(source, earthdata_token))


def _headers(source: Source, token: str | None) -> dict | None:
    if source.acquisition != "earthdata":
        return None
    token = (token if token is not None else os.environ.get(TOKEN_ENV) or "").strip()
    if not token:
        raise ValueError(f"{source.source_id} needs your Earthdata token: pass earthdata_token, or set {TOKEN_ENV}.")
    return {"Authorization": f"Bearer {token}"}


def _fetch(source: Source, chosen: Selection, entry: cache.Entry, headers: dict | None) -> Path:
    from cellfold.catalog.check import check_file

    year, archive = chosen.year, entry.partial.with_suffix(".zip.partial")
    target = archive if source.delivery == "zip" else entry.partial
    sha = fetch(chosen.official_url, target, headers, source.max_bytes, source.exact_bytes, source.checksum)
    try:
        if source.delivery == "zip":
            extract_member(archive, source.member.format(year=year), entry.partial)
            sha = cache.digest(entry.partial)
        facts = check_file(entry.partial, source, year, marker=False)
    except (OSError, ValueError, zipfile.BadZipFile):
        entry.partial.unlink(missing_ok=True)
        archive.unlink(missing_ok=True)
        raise
    archive.unlink(missing_ok=True)
    note = "Downloaded from the publisher; cell values unchanged." if source.delivery == "geotiff" else "Extracted from the publisher's archive; cell values unchanged."
    cache.install(entry.partial, entry.raster, chosen, sha, facts, note)
    return entry.raster


def _derive(source: Source, chosen: Selection, entry: cache.Entry, base: Path, refresh: bool, without_net: bool) -> Path:
    """A year of the demographic cube, from one shared source file."""
    shared = cache.source_home(base, source) / "source"
    cube = shared / CUBE_FILE
    with cache.locked(shared / ".lock", f"the source of {source.source_id}"):
        partial = cube.with_name(f"{cube.name}.partial")
        if refresh:
            partial.unlink(missing_ok=True)
        held = None if refresh else cache.verified(cube)
        if held is None:
            if without_net:
                raise ValueError(f"Offline: {chosen.selection!r} has no checked local copy.")
            sha = fetch(chosen.official_url, partial, None, source.max_bytes, source.exact_bytes, source.checksum)
            held = cache.install(partial, cube, chosen, sha, {"format": "NetCDF-4"}, "Shared source of all years.")
    from cellfold.catalog.check import check_file

    try:
        derive_year(cube, entry.partial, chosen.year)
        facts = check_file(entry.partial, source, chosen.year, marker=True)
    except (OSError, ValueError):
        entry.partial.unlink(missing_ok=True)
        raise
    cache.install(entry.partial, entry.raster, chosen, cache.digest(entry.partial), facts, "Summed over age bands; no-data kept.", source_file_sha256=held["local_sha256"])
    return entry.raster


def derive_year(cube: Path, to: Path, year: int) -> None:
    """Write a year's counts of a NetCDF-4 cube; needs h5py, which is imported here only."""
    try:
        import h5py
    except ImportError as error:
        raise ValueError("Reading the demographic cube needs h5py; convert it to Parquet and use cube.year_counts instead.") from error
    import numpy as np
    import pandas as pd
    from pyspark.sql import SparkSession

    from cellfold.catalog.cube_file import VARIABLE, year_blocks
    from cellfold.operators.cube import LATITUDES, LONGITUDES, year_counts
    from cellfold.sources.geotiff import write_geotiff
    from cellfold.sources.grid import GridSpec, Raster

    spark, frames = SparkSession.getActiveSession(), []
    try:
        with h5py.File(cube, "r") as f:
            for low, values in year_blocks(f, year):
                lat, lon = np.mgrid[low : low + len(values), 0:LONGITUDES]
                frames.append(pd.DataFrame({"lat_idx": lat.ravel(), "lon_idx": lon.ravel(), "value": values.ravel()}))
    except FileNotFoundError:
        raise
    except OSError as error:
        raise ValueError(f"The demographic cube can't be read as NetCDF-4: {cube}.") from error
    rows = spark.createDataFrame(pd.concat(frames))
    spec = GridSpec.north_up(-180, 90, 0.25, 0.25, LONGITUDES, LATITUDES, "EPSG:4326", nodata=float("nan"), tags={"population_semantics": "count", "units": "population count per cell", "year": str(year), "source_variable": VARIABLE, "processing": "sum of 14 age bands"})
    to.parent.mkdir(parents=True, exist_ok=True)
    write_geotiff(Raster(spec, year_counts(rows)), to)


def register(selection: str, path, *, cache_dir=None) -> Path:
    """Install a file obtained by hand, after checking its grid, counts and year."""
    from cellfold.catalog.check import check_file

    source, year = parse(selection)
    original = Path(path).expanduser()
    if not original.is_file():
        raise ValueError(f"The file to register does not exist: {original}.")
    entry = cache.Entry.of(cache.root(cache_dir), source, year)
    with cache.locked(entry.lock, repr(selection)):
        check_file(original, source, year, marker=True)
        if original.stat().st_size > MAX_REGISTERED:
            raise ValueError(f"The file exceeds the limit of {MAX_REGISTERED} bytes.")
        if not (entry.raster.exists() and original.samefile(entry.raster)):
            try:
                shutil.copyfile(original, entry.partial)
                facts = check_file(entry.partial, source, year, marker=False)
            except (OSError, ValueError):
                entry.partial.unlink(missing_ok=True)
                raise
            cache.install(entry.partial, entry.raster, Selection.of(source, year), cache.digest(entry.partial), facts, "Registered by the user.")
        else:
            facts = check_file(entry.raster, source, year, marker=True)
            cache.write_receipt(entry.raster, Selection.of(source, year), cache.digest(entry.raster), facts, "Registered by the user.")
    return entry.raster


def resolve(population) -> tuple[str, dict | None]:
    """(path, facts) of a path or selection. An existing file wins over a selection of that name."""
    path = Path(population).expanduser()
    if not path.is_file():
        if not (isinstance(population, str) and looks_like_selection(population)):
            raise ValueError(f"population raster path does not exist or is not a file: {path}.")
        path = download(population)
    receipt = cache.verified(path)
    if receipt:
        return str(path), cache.carried(receipt)
    return str(path), {"source_id": "custom", "population_meaning": "caller-supplied", "local_path": str(path.resolve()), "local_sha256": cache.digest(path)}
