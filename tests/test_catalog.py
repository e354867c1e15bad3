import hashlib
import io
import json
import math
import os
import urllib.error
import zipfile
from email.message import Message
from http.client import IncompleteRead

import numpy as np
import pytest

import cellfold.catalog as catalog
from cellfold.catalog import api, cache, check, fetch, selection
from cellfold.catalog.cube_file import AXES, year_blocks
from cellfold.catalog.sources import SOURCES, catalog_table
from cellfold.sources.geotiff import write_geotiff
from cellfold.sources.grid import GridSpec, Raster


def test_listing(spark):
    assert [s.source_id for s in catalog.list()] == ["worldpop-global-1km", "ghsl-r2023a-mollweide-1km", "gpwv4-r11-count", "chambers-hybrid", "landscan-global"]
    assert catalog_table(spark).count() == 5
    assert catalog.info("landscan-global:2024").doi == "10.48690/1532445" and catalog.info("landscan-global:2023").doi is None
    assert "2015" in catalog.info("gpwv4-r11-count:2015").official_url and catalog.info("landscan-global:2020").citation.startswith("Oak Ridge National Laboratory. (2020)")
    assert SOURCES["worldpop-global-1km"].value("nodata", 2000) > 0 > SOURCES["worldpop-global-1km"].value("nodata", 2001)


@pytest.mark.parametrize("text,error", [("worldpop-global-1km:latest", "fixed year"), ("worldpop-global-1km", "needs a year"), ("WorldPop:2020", "form"), ("a b:2020", "form"), ("unknown:2020", "unknown population source"), ("worldpop-global-1km:1999", "2000-2020"), ("gpwv4-r11-count:2001", "2000, 2005")])
def test_selections(text, error):
    with pytest.raises(ValueError, match=error):
        selection.parse(text)
    with pytest.raises(TypeError):
        selection.parse(5)
    assert selection.parse("chambers-hybrid:1950")[1] == 1950 and not selection.looks_like_selection(3)


@pytest.fixture
def tiny(monkeypatch, spark, tmp_path):
    """A replacement source of 2 by 2 cells, with a maker of files that fit it."""
    source = SOURCES["worldpop-global-1km"]
    small = type(source)(**{**source.__dict__, "width": 2, "height": 2, "cell": (1.0, 1.0), "bounds": (0.0, 0.0, 2.0, 2.0), "nodata": math.nan, "by_year": {}, "max_bytes": 100_000})
    monkeypatch.setitem(SOURCES, source.source_id, small)
    monkeypatch.setattr(check, "PLAUSIBLE_TOTAL", (1.0, 100.0))

    def make(path, values=((1, 2), (3, 4)), left=0.0, tags=None):
        rows = [(r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
        write_geotiff(Raster(GridSpec.north_up(left, 2, 1, 1, 2, 2, "EPSG:4326", tags=tags or {}), spark.createDataFrame(rows, "row int, col int, value double")), path)
        return path

    return make


NAME = "worldpop-global-1km:2020"


def test_register_and_resolve(tiny, tmp_path, monkeypatch):
    monkeypatch.setenv("CELLFOLD_CACHE_DIR", str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="does not exist"):
        catalog.register(NAME, tmp_path / "none.tif")
    with pytest.raises(ValueError, match="say 2020"):
        catalog.register(NAME, tiny(tmp_path / "pop_12020.tif"))
    with pytest.raises(ValueError, match="bounds"):
        catalog.register(NAME, tiny(tmp_path / "moved_2020.tif", left=0.5))
    with pytest.raises(ValueError, match="plausible"):
        catalog.register(NAME, tiny(tmp_path / "huge_2020.tif", ((1, 2), (3, 400))))
    path = catalog.register(NAME, tiny(tmp_path / "good.tif", tags={"year": "2020"}))
    receipt = json.loads(cache.receipt_of(path).read_text())
    assert receipt["selection"] == NAME and receipt["local_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and receipt["observed"]["nodata"] == "NaN"
    found, facts = api.resolve(NAME)
    assert found == str(path) and facts["year"] == 2020 and "publisher" not in facts
    assert catalog.download(NAME, offline=True) == path
    assert catalog.register(NAME, path) == path  # in place
    os.utime(path, (1, 1))
    assert cache.verified(path) is None
    with pytest.raises(ValueError, match="Offline"):
        catalog.download(NAME, offline=True)
    custom, facts = api.resolve(tiny(tmp_path / "x.tif"))
    assert facts["source_id"] == "custom"
    with pytest.raises(ValueError, match="does not exist"):
        api.resolve("nothing")


def test_assignment_by_selection(tiny, spark, tmp_path, monkeypatch):
    from cellfold import VectorLayer, assign_population
    from cellfold.functions import geometry as G

    monkeypatch.setenv("CELLFOLD_CACHE_DIR", str(tmp_path / "cache"))
    catalog.register(NAME, tiny(tmp_path / "a_2020.tif"))
    found = assign_population(VectorLayer.of(spark, [(1, G.box(0, 0, 2, 1))], "k long", "EPSG:4326"), NAME)
    assert found.frame.first().population == 7.0 and found.attrs["population_source"]["selection"] == NAME


class Response(io.BytesIO):
    def __init__(self, data=b"", status=200, breaks=False, **headers):
        super().__init__(data)
        self.status, self.headers, self.breaks = status, Message(), breaks
        for k, v in headers.items():
            self.headers[k.replace("_", "-")] = str(v)

    def read(self, n=-1):
        data = super().read(n)
        if not data and self.breaks:
            raise IncompleteRead(b"")
        return data


@pytest.fixture
def net(monkeypatch):
    """Replies in order; an exception is raised, a function gets the request."""
    replies, asked = [], []

    def answer(request):
        asked.append((request.get_method(), request.get_header("Range"), request.get_header("Authorization")))
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    monkeypatch.setattr(fetch, "open_url", answer)
    return replies, asked


def test_fresh_download(net, tmp_path):
    replies, asked = net
    replies.append(Response(b"data", Content_Length=4))
    assert fetch.fetch("http://x", tmp_path / "p", {"Authorization": "Bearer t"}, checksum="md5:8d777f385d3dfec8815d20f7496026dc") == hashlib.sha256(b"data").hexdigest()
    assert asked == [("GET", None, "Bearer t")]


def test_resumed_download(net, tmp_path):
    replies, asked = net
    (tmp_path / "p").write_bytes(b"da")
    replies += [Response(Accept_Ranges="bytes"), Response(b"ta", 206, Content_Range="bytes 2-3/4")]
    fetch.fetch("http://x", tmp_path / "p", exact_bytes=4)
    assert (tmp_path / "p").read_bytes() == b"data" and asked[1][:2] == ("GET", "bytes=2-")
    for second in (Response(b"xx", 200), Response(b"xx", 206, Content_Range="bytes 0-1/4")):
        (tmp_path / "p").write_bytes(b"da")
        replies += [Response(Accept_Ranges="bytes"), second, Response(b"data", Content_Length=4)]
        fetch.fetch("http://x", tmp_path / "p")
        assert (tmp_path / "p").read_bytes() == b"data"
    (tmp_path / "p").write_bytes(b"da")
    replies += [urllib.error.URLError("no"), Response(b"data")]
    fetch.fetch("http://x", tmp_path / "p")


@pytest.mark.parametrize(
    "replies,options,kept,error",
    [
        ([Response(b"data", 404)], {}, False, "status 404"),
        ([urllib.error.URLError("no")], {}, False, "Could not download"),
        ([Response(b"data", Content_Length=9)], {}, True, "kept for resuming"),
        ([Response(b"data", breaks=True)], {}, True, "broke off"),
        ([Response(b"data", Content_Length=4)], {"max_bytes": 3}, False, "advertised"),
        ([Response(b"data")], {"max_bytes": 3}, False, "limit"),
        ([Response(b"data", Content_Length=4)], {"exact_bytes": 5}, False, "advertised"),
        ([Response(b"data")], {"exact_bytes": 5}, True, "4 of 5"),
        ([Response(b"data")], {"exact_bytes": 3}, False, "expected"),
        ([Response(b"data")], {"checksum": "md5:0"}, False, "checksum"),
        ([Response(b"data", Content_Length="many")], {}, False, "isn't a number"),
    ],
)
def test_failed_downloads(net, tmp_path, replies, options, kept, error):
    net[0].extend(replies)
    with pytest.raises(ValueError, match=error):
        fetch.fetch("http://x", tmp_path / "p", **options)
    assert (tmp_path / "p").exists() == kept


def test_too_large_part(tmp_path):
    (tmp_path / "p").write_bytes(b"12345")
    with pytest.raises(ValueError, match="removed"):
        fetch.fetch("http://x", tmp_path / "p", max_bytes=4)


def test_download_installs_and_rolls_back(tiny, net, tmp_path, monkeypatch):
    monkeypatch.setenv("CELLFOLD_CACHE_DIR", str(tmp_path / "cache"))
    data = tiny(tmp_path / "a.tif").read_bytes()
    net[0].append(Response(data, Content_Length=len(data)))
    path = catalog.download(NAME, offline=False)
    assert path.read_bytes() == data and catalog.download(NAME) == path
    net[0].append(Response(b"not a raster"))
    with pytest.raises(ValueError, match="opened"):
        catalog.download(NAME, refresh=True)
    assert cache.verified(path, NAME) and not path.with_name(f"{path.name}.partial").exists()
    monkeypatch.setattr(cache, "write_receipt", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    net[0].append(Response(data))
    with pytest.raises(OSError):
        catalog.download(NAME, refresh=True)
    assert cache.verified(path, NAME) and path.read_bytes() == data


def test_manual_and_token(tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="by hand"):
        catalog.download("landscan-global:2020", cache_dir=tmp_path)
    monkeypatch.delenv("EARTHDATA_TOKEN", raising=False)
    for token in (None, "  "):
        with pytest.raises(ValueError, match="token"):
            catalog.download("gpwv4-r11-count:2020", cache_dir=tmp_path, earthdata_token=token)
    assert api._headers(SOURCES["gpwv4-r11-count"], " abc ") == {"Authorization": "Bearer abc"}
    with pytest.raises(TypeError):
        catalog.download(NAME, refresh=1)


def test_offline_settings(monkeypatch):
    for text, value in (("yes", True), (" ON ", True), ("0", False), ("", False)):
        monkeypatch.setenv("CELLFOLD_OFFLINE", text)
        assert cache.offline(None) is value
    monkeypatch.setenv("CELLFOLD_OFFLINE", "maybe")
    with pytest.raises(ValueError):
        cache.offline(None)
    assert cache.offline(True)
    with pytest.raises(TypeError):
        cache.offline("yes")


def test_locks(tmp_path):
    with cache.locked(tmp_path / "l", "a"), pytest.raises(ValueError, match="Timed out"):
        with cache.locked(tmp_path / "l", "a", 0.2):
            pass


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return path


def test_archives(tmp_path):
    fetch.extract_member(archive(tmp_path / "a.zip", **{"d__x.tif": "1", "y.txt": "2"}), "x.tif", tmp_path / "x.tif")
    assert (tmp_path / "x.tif").read_text() == "1"
    with pytest.raises(ValueError, match="exactly one"):
        fetch.extract_member(archive(tmp_path / "b.zip", **{"d__x.tif": "1", "e__x.tif": "2"}), "x.tif", tmp_path / "x")
    with pytest.raises(ValueError, match="limit"):
        fetch.extract_member(tmp_path / "a.zip", "x.tif", tmp_path / "x", limit=0)
    out = fetch.extract_prefix(archive(tmp_path / "c.zip", **{"keep__a__b.txt": "1", "other.txt": "2"}), "keep/", tmp_path / "out")
    assert [p.relative_to(tmp_path).as_posix() for p in out] == ["out/keep/a/b.txt"]
    with pytest.raises(ValueError, match="limit"):
        fetch.extract_prefix(tmp_path / "c.zip", "keep", tmp_path / "out", limit=0)


@pytest.mark.parametrize("name", ["layer/../outside.shp", "layer\\..\\..\\outside.shp", "layer/C:/outside.shp", "layer.d/../../x"])
def test_unsafe_members_matter_only_if_asked_for(tmp_path, name):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(name, "1")
        z.writestr("good.txt", "2")
    with pytest.raises(ValueError, match="unsafe path"):
        fetch.extract_prefix(tmp_path / "a.zip", ("layer", "good"), tmp_path / "out")
    assert [p.read_text() for p in fetch.extract_prefix(tmp_path / "a.zip", "good", tmp_path / "out")] == ["2"]


def test_prefixes_end_where_names_do(tmp_path):
    path = archive(tmp_path / "a.zip", **{"layer.shp": "1", "layer.dbf": "2", "layer_backup.shp": "3", "layer2__x": "4", "in__layer.shp": "5"})
    out = fetch.extract_prefix(path, ("layer",), tmp_path / "out")
    assert sorted(p.name for p in out) == ["layer.dbf", "layer.shp"] == sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(ValueError, match="does not contain requested members"):
        fetch.extract_prefix(path, ("lay", "layer_"), tmp_path / "out")


def test_redirects_drop_credentials():
    import urllib.request

    for target, kept in (("https://a.org/y", "t"), ("https://b.org/y", None)):
        request = urllib.request.Request("https://a.org/x", headers={"Authorization": "t", "Range": "bytes=3-"}, method="HEAD")
        there = fetch.redirected(request, target)
        assert there.get_header("Authorization") == kept and there.get_header("Range") == "bytes=3-" and there.get_method() == "HEAD"
    with pytest.raises(urllib.error.URLError):
        fetch.redirected(request, "file:///etc/hosts")


def test_redirects_are_followed_step_by_step(tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            to = {"/a": "/b", "/b": "c", "/loop": "/loop"}.get(self.path)
            self.send_response(302 if to else 200)
            self.send_header("Location" if to else "Content-Length", to or "4")
            self.end_headers()
            self.wfile.write(b"" if to else b"data")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert fetch.fetch(f"{at}/a", tmp_path / "p") == hashlib.sha256(b"data").hexdigest()
        with pytest.raises(ValueError, match="Could not download"):
            fetch.fetch(f"{at}/loop", tmp_path / "q")
    finally:
        server.shutdown()


def test_receipts_name_numbers_that_json_lacks(tiny, tmp_path):
    path = tiny(tmp_path / "a.tif")
    cache.write_receipt(path, cache.Selection.of(SOURCES[NAME.split(":")[0]], 2020), cache.digest(path), {"nodata": float("nan"), "range": (float("-inf"), float("inf"))}, "note")
    assert cache.verified(path)["observed"] == {"nodata": "NaN", "range": ["-Infinity", "Infinity"]}


class Lazy:
    """What a file gives before it is read: a shape, a type and slices of one value."""

    def __init__(self, shape, dtype="float32", value=1.0):
        self.shape, self.dtype, self.value = shape, np.dtype(dtype), value

    def __getitem__(self, at):
        lows, _, _, year = at
        out = np.full((lows.stop - lows.start, *self.shape[1:3]), self.value, self.dtype)
        if lows.start == 0:
            out[0, 0], out[0, 1, 1:] = np.nan, np.nan
        return out + np.float32(year)


def cube_file(**other):
    shape = tuple(map(len, AXES.values()))
    return {"demographic_totals": Lazy(shape), **AXES, **other}


def test_cube_years_are_sums_of_ages():
    blocks = list(year_blocks(cube_file(), 1952, rows=180))
    assert [low for low, _ in blocks] == [0, 180, 360, 540]
    first = blocks[0][1]
    assert np.isnan(first[0, 0]) and first[0, 1] == 3 and first[0, 2] == 14 * 3
    assert all((values == 42).all() for _, values in blocks[1:])


@pytest.mark.parametrize(
    "other, error",
    [
        ({"demographic_totals": None}, "no dataset 'demographic_totals'"),
        ({"year": None}, "no dataset 'year'"),
        ({"demographic_totals": {}}, "no dataset"),
        ({"demographic_totals": Lazy((720, 1440, 14, 71), "float64")}, "must be float32"),
        ({"demographic_totals": Lazy((720, 1440, 14, 70))}, "must be float32 of shape"),
        ({"latitude": AXES["latitude"][::-1]}, "latitude isn't the published axis"),
        ({"longitude": AXES["longitude"] - 180}, "longitude isn't"),
        ({"age_band_lower_bound": AXES["age_band_lower_bound"][1:]}, "age_band_lower_bound isn't"),
        ({"demographic_totals": Lazy((720, 1440, 14, 71), value=-100.0)}, "infinite or negative"),
        ({"demographic_totals": Lazy((720, 1440, 14, 71), value=math.inf)}, "infinite or negative"),
    ],
)
def test_other_cubes_are_refused(other, error):
    with pytest.raises(ValueError, match=error):
        next(year_blocks(cube_file(**other), 1950))


def test_cube_without_the_year():
    with pytest.raises(ValueError, match="no year 2021"):
        next(year_blocks(cube_file(), 2021))


def test_selections_tell_what_is_downloaded():
    found = api.info("chambers-hybrid:1999")
    assert found.resolution == "0.25 degrees" and "NetCDF-4" in found.format
    assert found.expected_filename == "chambers-hybrid-1999.tif" and found.download_size.startswith("4,122,344,510 bytes")
    assert all(s.resolution and s.format and s.download_size for s in api.list_sources())
