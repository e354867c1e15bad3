import json
import sqlite3
import struct

import numpy as np
import pytest

from cellfold import GridSpec, Raster, assign_population
from cellfold.functions import geometry as G
from cellfold.sources.geotiff import read_geotiff, write_geotiff
from cellfold.sources.grid import block_columns, cell_centers
from cellfold.sources.shakemap import read_shakemap
from cellfold.sources.vector_files import crs_of_wkt, read_vector


def raster(spark, values, **more):
    rows = [(r, c, None if np.isnan(v) else float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    spec = GridSpec.north_up(-2.0, 3.0, 0.5, 0.25, len(values[0]), len(values), more.pop("crs", "EPSG:4326"), **more)
    return Raster(spec, spark.createDataFrame(rows, "row int, col int, value double"))


def values_of(found):
    return {(r.row, r.col): r.value for r in found.cells.collect() if r.value is not None}


@pytest.mark.parametrize("crs", ["EPSG:4326", "EPSG:3857", "ESRI:54009"])
def test_geotiff_round_trip(spark, tmp_path, crs):
    values = np.random.default_rng(1).uniform(0, 1e6, (300, 270))
    values[::7, ::5] = np.nan
    made = raster(spark, values.tolist(), crs=crs, tags={"units": "people & <cells>", "year": "2020"}, unit="count")
    write_geotiff(made, tmp_path / "a.tif", {"more": "x"})
    found = read_geotiff(spark, tmp_path / "a.tif")
    assert (found.spec.shape, found.spec.transform, found.spec.crs, found.spec.unit) == (made.spec.shape, made.spec.transform, crs, "count")
    assert found.spec.tags == {"units": "people & <cells>", "year": "2020", "more": "x"} and np.isnan(found.spec.nodata)
    assert values_of(found) == {(r, c): v for (r, c), v in np.ndenumerate(values) if not np.isnan(v)}


def tiff(path, values, order="<", predictor=1, rows_per_strip=2, nodata=None, compression=8, geo=True):
    """A classic strip file by hand."""
    import zlib

    dtype = np.dtype(values.dtype).newbyteorder(order)
    strips = []
    for i in range(0, len(values), rows_per_strip):
        block = values[i : i + rows_per_strip]
        if predictor == 2:
            block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), block.dtype))
        data = block.astype(dtype).tobytes()
        strips.append(zlib.compress(data) if compression == 8 else data)
    tags = {256: ("I", [values.shape[1]]), 257: ("I", [values.shape[0]]), 258: ("H", [values.dtype.itemsize * 8]), 259: ("H", [compression]), 277: ("H", [1]), 278: ("I", [rows_per_strip]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]])}
    if geo:
        tags |= {33550: ("d", [1.0, 1.0, 0.0]), 33922: ("d", [0, 0, 0, 0.5, 1.5, 0]), 34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 2, 3072, 0, 1, 3857])}
    out = bytearray(8)
    offsets = []
    for s in strips:
        offsets.append(len(out))
        out += s
    tags |= {273: ("I", offsets), 279: ("I", [len(s) for s in strips])}
    if nodata is not None:
        tags[42113] = ("s", nodata.encode() + b"\0")
    kinds, entries = {"H": 3, "I": 4, "d": 12, "s": 2}, b""
    for tag in sorted(tags):
        code, v = tags[tag]
        data = v if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        if len(data) > 4:
            at = len(out)
            out += data
            data = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kinds[code], len(v)) + data.ljust(4, b"\0")
    out[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, len(out))
    out += struct.pack(order + "H", len(tags)) + entries + bytes(4)
    path.write_bytes(bytes(out))
    return path


@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "f8"])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor,compression", [(1, 1), (1, 8), (2, 8)])
def test_foreign_geotiffs(spark, tmp_path, kind, order, predictor, compression):
    if kind[0] == "f" and predictor == 2:
        pytest.skip("predictor 2 is for integers")
    values = np.arange(15).reshape(5, 3).astype(kind)
    found = read_geotiff(spark, tiff(tmp_path / "a.tif", values, order, predictor, nodata="3", compression=compression))
    assert found.spec.transform == (1.0, 0.0, 0.0, 0.0, -1.0, 2.0) and found.spec.crs == "EPSG:3857"
    assert values_of(found) == {(r, c): float(v) for (r, c), v in np.ndenumerate(values) if v != 3}


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no tiff at all")
    with pytest.raises(ValueError, match="could not be opened"):
        read_geotiff(spark, tmp_path / "a.tif")
    with pytest.raises(ValueError, match="unsupported"):
        read_geotiff(spark, tiff(tmp_path / "b.tif", np.ones((2, 2), "f4"), compression=5))
    for name in ("a.geojson", "a.gpkg", "a.shp"):
        (tmp_path / name).write_bytes(b"nothing that can be read here, at all" * 9)
        with pytest.raises(ValueError, match="could not be read"):
            read_vector(spark, tmp_path / name)
    with pytest.raises(ValueError, match="must end in"):
        (tmp_path / "a.csv").write_text("x")
        assign_population(str(tmp_path / "a.csv"), raster(spark, [[1.0]]))


SHAPES = [[[(-2, 2.5), (-1, 2.5), (-1, 3), (-2, 3)]], [[(-1, 2), (0, 2), (0, 3), (-1, 3)], [(-0.75, 2.25), (-0.25, 2.25), (-0.25, 2.75), (-0.75, 2.75)]]]


def geojson(path):
    features = [{"type": "Feature", "properties": {"name": "a", "k": 1}, "geometry": {"type": "Polygon", "coordinates": [[*r, r[0]] for r in SHAPES[0]]}}, {"type": "Feature", "properties": {"name": None, "k": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[[*r, r[0]] for r in SHAPES[1]]]}}]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))


def wkb(shape):
    rings = [[*r, r[0]] for r in shape]
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


def geopackage(path):
    db = sqlite3.connect(path)
    db.executescript("create table gpkg_geometry_columns(table_name, column_name, srs_id); create table gpkg_spatial_ref_sys(srs_id, organization, organization_coordsys_id); insert into gpkg_geometry_columns values('t', 'geom', 4326); insert into gpkg_spatial_ref_sys values(4326, 'EPSG', 4326); create table t(fid integer primary key, geom blob, name text, k integer)")
    for i, shape in enumerate(SHAPES):
        db.execute("insert into t(geom, name, k) values (?, ?, ?)", (b"GP\0\1" + struct.pack("<i", 4326) + wkb(shape), [None, "a"][i == 0], i + 1))
    db.commit()
    db.close()


def shapefile(path):
    records = b""
    for i, shape in enumerate(SHAPES):
        rings = [[*r, r[0]] for r in shape]
        rings = [r[::-1] if (G.ring_area(np.array(r, float)) > 0) == (j == 0) else r for j, r in enumerate(rings)]
        points = [p for r in rings for p in r]
        starts = np.cumsum([0, *map(len, rings)])[:-1]
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">ii", i + 1, len(body) // 2) + body
    path.write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + records)
    fields = [(b"name", b"C", 5, 0), (b"k", b"N", 3, 0)]
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, 2, 32 + 32 * 2 + 1, 9) + b"".join(n.ljust(11, b"\0") + t + bytes(4) + bytes([s, d]) + bytes(14) for n, t, s, d in fields) + b"\r"
    path.with_suffix(".dbf").write_bytes(head + b" a      1" + b"        2")
    path.with_suffix(".prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]')


@pytest.mark.parametrize("name,write", [("a.geojson", geojson), ("a.json", geojson), ("a.gpkg", geopackage), ("a.shp", shapefile)])
def test_vector_files(spark, tmp_path, name, write):
    write(tmp_path / name)
    layer = read_vector(spark, tmp_path / name)
    assert layer.crs == "EPSG:4326"
    rows = sorted((r.k, r.name, G.area(G.from_rows(r.geometry))) for r in layer.frame.collect())
    assert rows == [(1, "a", 0.5), (2, None, 0.75)]
    write_geotiff(raster(spark, [[1.0] * 8] * 8), tmp_path / "p.tif")
    found = assign_population(str(tmp_path / name), str(tmp_path / "p.tif"))
    assert sorted((r.k, round(r.population, 9)) for r in found.frame.collect()) == [(1, 4.0), (2, 6.0)]
    assert found.attrs["population_source"]["source_id"] == "custom" and len(found.attrs["population_source"]["local_sha256"]) == 64


def test_crs_names():
    assert crs_of_wkt('PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere"]') == "EPSG:3857"
    assert crs_of_wkt('PROJCRS["x",ID["EPSG",3035]]') == "EPSG:3035" and crs_of_wkt('PROJCS["World_Mollweide"]') == "ESRI:54009" and crs_of_wkt("LOCAL") is None


def shakemap(lons, lats, values, fields="LON LAT MMI"):
    names = "".join(f'<grid_field index="{i}" name="{n}" units="x"/>' for i, n in enumerate(fields.split(), 1))
    rows = "\n".join(f"{x} {y} {v}" for y, line in zip(lats, values) for x, v in zip(lons, line))
    return f'<shakemap_grid xmlns="http://e"><grid_specification nlon="{len(lons)}" nlat="{len(lats)}" nominal_lon_spacing="0.5" nominal_lat_spacing="0.25"/>{names}<grid_data>\n{rows}\n</grid_data></shakemap_grid>'


def test_shaking_grid(spark, tmp_path):
    (tmp_path / "grid.xml").write_text(shakemap([10, 10.5], [5, 4.75], [[1, 2], [3, 4]]))
    found = read_shakemap(spark, tmp_path / "grid.xml")
    assert found.spec.bounds == (9.75, 4.625, 10.75, 5.125) and values_of(found) == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    for bad in (shakemap([10, 10.5], [4.75, 5], [[1, 2], [3, 4]]), shakemap([10, 10.5, 12], [5, 4.75], [[1, 2, 3], [3, 4, 5]]), shakemap([10, 10.5], [5, 4.75], [[1, 2], [3, 4]], "LON LAT PGA"), shakemap([10], [5], [["1 2"]])):
        (tmp_path / "grid.xml").write_text(bad)
        with pytest.raises(ValueError):
            read_shakemap(spark, tmp_path / "grid.xml")


def test_cells_as_a_table(spark):
    made = raster(spark, [[1.0, float("nan")], [3.0, 4.0]])
    assert sorted(map(tuple, cell_centers(made).collect())) == [(-1.75, 2.625, 3.0), (-1.75, 2.875, 1.0), (-1.25, 2.625, 4.0)]
    rows, cols = block_columns(made.spec)
    assert made.cells.select(rows.alias("r"), cols.alias("c")).distinct().collect() == [(0, 0)]


@pytest.mark.parametrize("name", ["t.csv", "t.parquet", "t.orc", "t.jsonl"])
def test_tables(spark, tmp_path, name):
    from cellfold.sources.tables import read_table, write_table

    frame = spark.createDataFrame([("a", 1.5), ("b", None)], "cell string, population double")
    write_table(frame, str(tmp_path / name))
    found = read_table(spark, str(tmp_path / name), "cell string, population double")
    assert sorted(map(tuple, found.collect())) == [("a", 1.5), ("b", None)]
    if name == "t.csv":
        with pytest.raises(ValueError, match="schema"):
            read_table(spark, str(tmp_path / name))
