"""GeoTIFF scan and sink. Blocks (strips or tiles) are the unit of parallel reading.

The driver reads the directory of a file only; tasks read and decode blocks. Known
forms: classic and BigTIFF, either byte order, strips or tiles, no compression or
deflate, predictors 1 to 3, integers and floats of 8 to 64 bits. Others are refused.
"""

from __future__ import annotations

import os
import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.functions.crs import as_crs
from cellfold.sources.files import file_system
from cellfold.sources.grid import GridSpec, Raster

#: Field types of TIFF as struct codes.
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
DEFLATE = (8, 32946)
TILE = 256


@dataclass(frozen=True)
class Layout:
    """What a task needs to decode a file's blocks."""

    path: str
    order: str
    dtype: str
    width: int
    height: int
    block_width: int
    block_height: int
    samples: int
    separate: bool
    compression: int
    predictor: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    fill: float | None = field(default=None)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)


def read_directory(path: str) -> tuple[Layout, GridSpec]:
    """Layout and grid of the first image of a file."""
    try:
        system, name = file_system(path)
        with system.open_input_file(name) as f:
            head = f.read(16)
            order = {b"II": "<", b"MM": ">"}.get(head[:2])
            version = struct.unpack(order + "H", head[2:4])[0] if order else 0
            if version not in (42, 43):
                raise ValueError("not a TIFF file")
            big = version == 43
            at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
            tags = _tags(f, order, at, big)
    except (OSError, ValueError, struct.error) as error:
        raise ValueError(f"raster could not be opened: {path}.") from error
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    samples, width, height = one(277, 1), one(256), one(257)
    kinds = {1: "u", 2: "i", 3: "f"}
    bits, form = set(tags.get(258, (1,))), set(tags.get(339, (1,)))
    if len(bits) != 1 or len(form) != 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(form)) not in kinds:
        raise ValueError(f"raster has an unsupported sample format: {path}.")
    compression, predictor = one(259, 1), one(317, 1)
    if compression not in (1, *DEFLATE) or predictor not in (1, 2, 3):
        raise ValueError(f"raster has an unsupported compression ({compression}) or predictor ({predictor}): {path}.")
    tiled = 322 in tags
    dtype = f"{order}{kinds[next(iter(form))]}{next(iter(bits)) // 8}"
    layout = Layout(path, order, dtype, width, height, one(322, width) if tiled else width, one(323) if tiled else min(one(278, height), height), samples, one(284, 1) == 2, compression, predictor, tuple(tags[324 if tiled else 273]), tuple(tags[325 if tiled else 279]))
    return layout, _grid(tags, layout)


def _tags(f, order: str, at: int, big: bool) -> dict[int, tuple]:
    f.seek(at)
    (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
    size, room = (20, 8) if big else (12, 4)
    entries, tags = f.read(size * n), {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", entries, i * size)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), entries, i * size + 4)
        code = FIELDS.get(kind)
        if code is None:
            continue
        length = struct.calcsize("=" + code) * count
        raw = entries[i * size + size - room : i * size + size]
        if length > room:
            f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
            raw = f.read(length)
        raw = raw[:length]
        tags[tag] = (raw.split(b"\0")[0].decode("utf-8", "replace"),) if kind == 2 else struct.unpack(order + code * count, raw)
    return tags


def _grid(tags: dict[int, tuple], layout: Layout) -> GridSpec:
    keys = {}
    if 34735 in tags:
        directory = tags[34735]
        for i in range(4, len(directory) - 3, 4):
            key, where, count, value = directory[i : i + 4]
            keys[key] = value if where == 0 else tags.get(where, ("",))[0][value : value + count] if where == 34737 else tags.get(where, (0,))[value]
    transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    if keys.get(1025) == 2:  # coordinates are of cell centres
        a, b, c, d, e, f = transform
        transform = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
    crs, code = None, keys.get(3072, keys.get(2048))
    if code == 54009 or code == 32767 and "mollweide" in str(keys.get(1026, "")).lower() + str(keys.get(3073, "")).lower():
        crs = "ESRI:54009"
    elif isinstance(code, int) and code not in (0, 32767):
        crs = f"EPSG:{code}"
    metadata, unit = {}, None
    if 42112 in tags:
        for item in ET.fromstring(tags[42112][0]).iter("Item"):
            if item.get("role") == "unittype":
                unit = item.text
            elif item.get("sample") in ("0", None):
                metadata[item.get("name")] = item.text or ""
    nodata = None
    if 42113 in tags:
        nodata = float(tags[42113][0].strip())
    return GridSpec(layout.width, layout.height, transform, crs, nodata, metadata, unit, layout.samples, (layout.block_height, layout.block_width))


def decode_block(layout: Layout, data: bytes) -> np.ndarray:
    """(rows, columns, samples of the block) as doubles."""
    samples = 1 if layout.separate else layout.samples
    if layout.compression in DEFLATE:
        data = zlib.decompress(data)
    dtype = np.dtype(layout.dtype)
    rows = len(data) // (layout.block_width * samples * dtype.itemsize)
    data = data[: rows * layout.block_width * samples * dtype.itemsize]
    if layout.predictor == 3:
        # Byte planes from the most significant, as running differences along a row.
        planes = np.frombuffer(data, np.uint8).reshape(rows, -1)
        step = planes.reshape(rows, -1, samples)
        summed = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
        values = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(np.dtype(f">f{dtype.itemsize}"))
        return values.reshape(rows, layout.block_width, samples).astype(float)
    values = np.frombuffer(data, dtype).reshape(rows, layout.block_width, samples)
    if layout.predictor == 2:
        values = np.cumsum(values.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("="))
    return values.astype(float)


def read_geotiff(spark: SparkSession, path: str | os.PathLike) -> Raster:
    """A file as a Raster. Tasks read blocks, so the file must be reachable by all of them."""
    layout, spec = read_directory(os.fspath(path))
    planes = layout.samples if layout.separate else 1
    blocks = spark.range(0, planes * layout.across * layout.down, numPartitions=min(max(1, len(layout.offsets) // 16), 4096))

    def decode(batches):
        system, name = file_system(layout.path)
        with system.open_input_file(name) as f:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    plane, at = divmod(block, layout.across * layout.down)
                    r0, c0 = at // layout.across * layout.block_height, at % layout.across * layout.block_width
                    if not layout.sizes[block]:
                        continue  # a sparse block holds no data
                    f.seek(layout.offsets[block])
                    values = decode_block(layout, f.read(layout.sizes[block]))
                    values = values[: layout.height - r0, : layout.width - c0]
                    row, col = np.mgrid[r0 : r0 + values.shape[0], c0 : c0 + values.shape[1]]
                    for s in range(values.shape[2]):
                        band = np.full(row.size, plane + s + 1, np.int32)
                        columns = [band, row.ravel().astype(np.int32), col.ravel().astype(np.int32), values[:, :, s].ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "row", "col", "value"])

    cells = blocks.mapInArrow(decode, "band int, row int, col int, value double")
    return Raster(spec, cells if spec.bands > 1 else cells.drop("band"), os.fspath(path)).masked()


def write_geotiff(raster: Raster, path: str | os.PathLike, tags: dict | None = None) -> None:
    """A single-band file of doubles: tiles of 256, deflate, predictor 3, no data as NaN.

    Tasks encode tiles; the driver writes them one after another, in order.
    """
    spec = raster.spec
    across, down = -(-spec.width // TILE), -(-spec.height // TILE)

    def encode(key, table):
        tile = np.full((TILE, TILE), np.nan)
        row, col = (np.asarray(table.column(c).combine_chunks()) % TILE for c in ("row", "col"))
        tile[row, col] = table.column("value").combine_chunks().fill_null(float("nan")).to_numpy(zero_copy_only=False)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([pack_tile(tile)], pa.binary())})

    number = F.floor(F.col("row") / TILE) * across + F.floor(F.col("col") / TILE)
    tiles: DataFrame = raster.cells.withColumn("tile", number.cast("long")).groupBy("tile").applyInArrow(encode, "tile long, data binary")
    empty = pack_tile(np.full((TILE, TILE), np.nan))
    partial = f"{os.fspath(path)}.partial"
    with open(partial, "wb") as out:
        out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
        offsets, sizes, expected = [], [], 0
        for tile, data in (*map(tuple, tiles.orderBy("tile").toLocalIterator()), (across * down, None)):
            for block in [empty] * (tile - expected) + ([bytes(data)] if data is not None else []):
                offsets.append(out.tell())
                sizes.append(len(block))
                out.write(block)
            expected = tile + 1
        write_directory(out, spec, {**spec.tags, **(tags or {})}, offsets, sizes)
    os.replace(partial, path)


def pack_tile(tile: np.ndarray) -> bytes:
    """A square tile of doubles: byte planes as running differences, deflated."""
    side = len(tile)
    planes = np.ascontiguousarray(tile, ">f8").view(np.uint8).reshape(side, side, 8).transpose(0, 2, 1).reshape(side, -1)
    return zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes(), 6)


def write_directory(out, spec: GridSpec, tags: dict, offsets: list[int], sizes: list[int], tile: int = TILE) -> None:
    """Write the directory of a file of square tiles at its end, and where it is at its start."""
    a, b, c, d, e, f = spec.transform
    matrix = (a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1)
    crs = as_crs(spec.crs)
    code = int(crs.name.split(":")[1])
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if crs.geographic else 1, 1025, 0, 1, 1, 2048 if crs.geographic else 3072, 0, 1, code]
    items = "".join(f'<Item name={quoteattr(str(k))} sample="0">{escape(str(v))}</Item>' for k, v in tags.items())
    if spec.unit:
        items += f'<Item name="UNITTYPE" sample="0" role="unittype">{escape(spec.unit)}</Item>'
    text = lambda s: (2, s.encode() + b"\0")
    entries = {
        256: (4, [spec.width]), 257: (4, [spec.height]), 258: (3, [64]), 259: (3, [8]), 262: (3, [1]), 277: (3, [1]), 284: (3, [1]), 317: (3, [3]),
        322: (4, [tile]), 323: (4, [tile]), 324: (16, offsets), 325: (16, sizes), 339: (3, [3]), 34264: (12, matrix), 34735: (3, keys), 42113: text("nan"),
    }
    if items:
        entries[42112] = text(f"<GDALMetadata>{items}</GDALMetadata>")
    body = b""
    start = out.tell()
    size = 8 + 20 * len(entries) + 8
    for tag, (kind, values) in sorted(entries.items()):
        data = values if kind == 2 else struct.pack(f"<{len(values)}{FIELDS[kind]}", *values)
        count = len(data) if kind == 2 else len(values)
        if len(data) <= 8:
            value = data.ljust(8, b"\0")
        else:
            value = struct.pack("<Q", start + size)
            size += len(data)
            body += data
        entries[tag] = struct.pack("<HHQ", tag, kind, count) + value
    out.write(struct.pack("<Q", len(entries)) + b"".join(v for _, v in sorted(entries.items())) + struct.pack("<Q", 0) + body)
    out.seek(8)
    out.write(struct.pack("<Q", start))


