import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellfold as cf
from cellfold.functions import geometry as G
from cellfold.functions.crs import KNOWN, as_crs, transform
from cellfold.functions.projections import SYSTEMS, Projection, by_code, columns, from_wkt
from cellfold.sources.grid import GridSpec, Raster
from cellfold.sources.layer import VectorLayer

CLARKE = {"a": 6378206.4, "f": 1 - math.sqrt(1 - 0.00676866)}
#: Worked examples of Snyder's manual.
EXAMPLES = [
    (Projection("lcc", -96, 23, 33, 45, **CLARKE), (-75, 35), (1894410.9, 1564649.5)),
    (Projection("albers", -96, 23, 29.5, 45.5, **CLARKE), (-75, 35), (1885472.7, 1535925.0)),
    (Projection("polar", -100, -90, -71, a=6378388.0, f=1 - math.sqrt(1 - 0.00672267)), (150, -75), (-1540033.6, -560526.4)),
    (Projection("tm", -75, k0=0.9996, **CLARKE), (-73.5, 40.5), (127106.5, 4484124.4)),
]


@pytest.mark.parametrize("projection, point, wanted", EXAMPLES, ids=lambda v: v.kind if isinstance(v, Projection) else "")
def test_worked_examples(projection, point, wanted):
    assert projection.forward(*map(np.float64, point)) == pytest.approx(wanted, abs=0.06)


@pytest.mark.parametrize("name", ["EPSG:32601", "EPSG:32633", "EPSG:32760", "EPSG:25832", *sorted(SYSTEMS)])
def test_round_trips(name):
    rng, p = np.random.default_rng(1), by_code(name)
    south = p.lat0 < 0 or p.lat1 < 0
    lon = rng.uniform(-179, 179, 3000) if p.kind == "polar" else p.lon0 + rng.uniform(-6, 6, 3000)
    lat = rng.uniform(-84, 84, 3000) if p.kind == "tm" else rng.uniform(50 if p.kind == "polar" else 10, 89.9 if p.kind == "polar" else 80, 3000) * (-1 if south else 1)
    lon2, lat2 = p.inverse(*p.forward(lon, lat))
    assert np.abs((lon2 - lon + 180) % 360 - 180).max() < 1e-9 and np.abs(lat2 - lat).max() < 1e-9
    world = KNOWN["EPSG:4326"]
    assert np.allclose(transform(as_crs(name), world, *transform(world, as_crs(name), lon, lat)), (p.lon0 + (lon - p.lon0), lat), atol=1e-9) or p.kind == "polar"


def test_columns_and_arrays_agree(spark):
    m, rng = columns(), np.random.default_rng(4)
    for name in ("EPSG:32733", "EPSG:2154", "EPSG:5070", "EPSG:3031", "EPSG:3413"):
        p = by_code(name)
        lon, lat = p.lon0 + rng.uniform(-5, 5, 50), rng.uniform(20, 70, 50) * (-1 if p.lat0 < 0 or name == "EPSG:32733" else 1)
        frame = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist())), "lon double, lat double")
        x, y = p.forward(F.col("lon"), F.col("lat"), m)
        moved = frame.select("lon", "lat", x.alias("x"), y.alias("y"))
        assert np.allclose(moved.select("x", "y").toPandas().to_numpy().T, p.forward(lon, lat), rtol=0, atol=1e-5)
        if p.kind != "albers":
            lon2, lat2 = p.inverse(F.col("x"), F.col("y"), m)
            assert np.allclose(moved.select(lon2, lat2).toPandas().to_numpy().T, (lon, lat), rtol=0, atol=1e-9)


UTM = """PROJCS["WGS 84 / UTM zone 33N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]],
 PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",15],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]{}]"""
LAMBERT = """PROJCRS["My cone",BASEGEOGCRS["ETRS89",DATUM["ETRS 1989",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0]],CONVERSION["x",METHOD["Lambert Conic Conformal (2SP)",ID["EPSG",9802]],
 PARAMETER["Latitude of false origin",52],PARAMETER["Longitude of false origin",10],PARAMETER["Latitude of 1st standard parallel",35],PARAMETER["Latitude of 2nd standard parallel",65],PARAMETER["Easting at false origin",4000000],PARAMETER["Northing at false origin",2800000]],CS[Cartesian,2],AXIS["x",east],LENGTHUNIT["metre",1]]"""


def test_well_known_text():
    assert from_wkt(UTM.format("")) == ("WGS 84 / UTM zone 33N", by_code("EPSG:32633"))
    assert as_crs(UTM.format(',AUTHORITY["EPSG","32633"]')) == as_crs("EPSG:32633") == as_crs(32633) == as_crs("urn:ogc:def:crs:EPSG::32633")
    assert from_wkt(LAMBERT) == ("My cone", SYSTEMS["EPSG:3034"]) and as_crs(LAMBERT).name == "My cone"
    assert as_crs('GEOGCS["WGS 84",DATUM["x",SPHEROID["WGS 84",6378137,298.257223563]],AUTHORITY["EPSG","4326"]]') == KNOWN["EPSG:4326"]
    polar = 'PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["WGS 84",6378137,298.257223563]]],PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",70],PARAMETER["central_meridian",-45],PARAMETER["false_easting",0],UNIT["metre",1]]'
    assert from_wkt(polar)[1] == SYSTEMS["EPSG:3413"]
    one = 'PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["s",6378137,298.257223563]]],PROJECTION["Lambert_Conformal_Conic_1SP"],PARAMETER["latitude_of_origin",46.5],PARAMETER["central_meridian",3],PARAMETER["scale_factor",0.9998],UNIT["metre",1]]'
    assert from_wkt(one)[1] == Projection("lcc", 3, 46.5, 46.5, 46.5, 0.9998)


@pytest.mark.parametrize("text", [UTM.format("")[:-1], UTM.format("").replace("Transverse_Mercator", "Bonne"), UTM.format("").replace('["Greenwich",0]', '["Paris",2.33]'), UTM.format("").replace('UNIT["metre",1]', 'UNIT["foot",0.3048]'), UTM.format("").replace("scale_factor", "azimuth"), 'GEOGCS["NAD27",AUTHORITY["EPSG","4267"]]', "PROJCS[}", "EPSG:32600", "EPSG:32661", "EPSG:25839", "EPSG:99999"])
def test_unknown_systems_are_refused(text):
    with pytest.raises(ValueError, match="could not be read"):
        as_crs(text, "hazard")


def test_polygons_in_utm_over_degrees(spark):
    """A square of 200 km in UTM over a grid of ones: the sum is its area in cells, by a dense boundary."""
    spec = GridSpec.north_up(10, 54, 0.25, 0.25, 40, 40, "EPSG:4326")
    ones = Raster(spec, spark.range(1600).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.lit(1.0).alias("value")))
    square = G.box(400_000, 5_300_000, 600_000, 5_500_000)
    layer = VectorLayer(spark.createDataFrame([(1, G.to_rows(square))], f"key long, geometry {G.SCHEMA}"), UTM.format(""))
    found = cf.assign_population(layer, ones, allow_reprojection=True).frame.first()
    dense = np.concatenate([a + (b - a) * np.linspace(0, 1, 2000)[:-1, None] for a, b in zip(square[0][0][:-1], square[0][0][1:], strict=True)])
    degrees = np.stack(transform(as_crs(32633), KNOWN["EPSG:4326"], *dense.T), axis=1)
    assert found.population == pytest.approx(abs(G.ring_area(np.vstack((degrees, degrees[:1])))) / 0.0625, rel=2e-3) and found.population_data_complete
