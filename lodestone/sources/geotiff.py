"""GeoTIFF rasters as tables: a row per pixel with its centre x, y and band1 to bandN."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.plans.frame import Frame
from lodestone.plans.order import quoted

# Fixed values of the format: tag numbers, and struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 273, 277, 278, 279
PLANAR, TILE_WIDTH, SAMPLE_FORMAT = 284, 322, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, NODATA = 33550, 33922, 34264, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
MAX_BANDS = 64
WRITE_ROWS = 256


@dataclass
class Raster:
    """What the tags say; gt is the affine transform (x0, dx, rx, y0, ry, dy) of pixel corners."""

    order: str
    width: int
    height: int
    bands: int
    dtype: str
    compression: int
    strip_rows: int
    offsets: list[int]
    sizes: list[int]
    planar: int
    gt: list[float]
    nodata: float | None = None
    tags: dict[int, list] = field(default_factory=dict)


def _tags(f, order: str) -> dict[int, list]:
    version = struct.unpack(order + "H", f.read(2))[0]
    if version == 42:
        at, count, entry, inline = struct.unpack(order + "I", f.read(4))[0], "H", "HHI4s", 4
    elif version == 43:
        f.read(4)
        at, count, entry, inline = struct.unpack(order + "Q", f.read(8))[0], "Q", "HHQ8s", 8
    else:
        raise ValueError("not a TIFF file")
    f.seek(at)
    n = struct.unpack(order + count, f.read(struct.calcsize("<" + count)))[0]
    width = struct.calcsize("<" + entry)
    raw, out = f.read(n * width), {}
    for i in range(n):
        tag, kind, values, data = struct.unpack(order + entry, raw[i * width : (i + 1) * width])
        code = FIELDS.get(kind)
        if code is None:
            continue
        length = struct.calcsize("<" + code) * values
        if length > inline:
            f.seek(struct.unpack(order + ("I" if inline == 4 else "Q"), data)[0])
            data = f.read(length)
        form = f"{values}s" if code == "s" else f"{values}{code}"
        out[tag] = list(struct.unpack(order + form, data[:length]))
    return out


def open_raster(path: str) -> Raster:
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        if order is None:
            raise ValueError(f"not a TIFF file: {path}")
        t = _tags(f, order)
    if TILE_WIDTH in t or STRIP_OFFSETS not in t:
        raise ValueError("tiled TIFF files are not supported")
    bands = t.get(SAMPLES, [1])[0]
    if bands > MAX_BANDS:
        raise ValueError(f"more than {MAX_BANDS} bands")
    compression = t.get(COMPRESSION, [1])[0]
    if compression not in (1, 8, 32946):
        raise ValueError(f"unsupported TIFF compression {compression}")
    kind = {1: "u", 2: "i", 3: "f"}.get(t.get(SAMPLE_FORMAT, [1])[0])
    bits = t.get(BITS, [8])[0]
    if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 32):
        raise ValueError("unsupported TIFF sample type")
    # Without a georeference pixels are units, and y rises from the bottom edge.
    gt = [0.0, 1.0, 0.0, float(t[HEIGHT][0]), 0.0, -1.0]
    if TRANSFORM in t:
        m = t[TRANSFORM]
        gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif PIXEL_SCALE in t and TIEPOINT in t:
        (sx, sy), p = t[PIXEL_SCALE][:2], t[TIEPOINT]
        gt = [p[3] - p[0] * sx, sx, 0.0, p[4] + p[1] * sy, 0.0, -sy]
    nodata = None
    if NODATA in t:
        try:
            nodata = float(t[NODATA][0].rstrip(b"\0 ").decode() or "nan")
        except ValueError:
            nodata = None
    height = t[HEIGHT][0]
    return Raster(
        order, t[WIDTH][0], height, bands, f"{order}{kind}{bits // 8}", compression,
        min(t.get(STRIP_ROWS, [height])[0], height), t[STRIP_OFFSETS], t[STRIP_BYTES],
        t.get(PLANAR, [1])[0], gt, nodata,
    )


def _strip(f, r: Raster, i: int) -> np.ndarray:
    f.seek(r.offsets[i])
    data = f.read(r.sizes[i])
    return np.frombuffer(zlib.decompress(data) if r.compression != 1 else data, r.dtype)


class _Strips(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[_Strips]:
        r = open_raster(self.path)
        strips = -(-r.height // r.strip_rows)
        step = max(1, self.rows // r.strip_rows)
        return [_Strips(i, min(i + step, strips)) for i in range(0, strips, step)]

    def read(self, partition: _Strips) -> Iterator[tuple]:
        r = open_raster(self.path)
        strips = -(-r.height // r.strip_rows)
        x0, dx, rx, y0, ry, dy = r.gt
        with open(self.path, "rb") as f:
            for i in range(partition.first, partition.last):
                rows = min(r.strip_rows, r.height - i * r.strip_rows)
                if r.planar == 2:
                    parts = [_strip(f, r, b * strips + i).reshape(rows, r.width) for b in range(r.bands)]
                    pixels = np.stack(parts, axis=-1).astype("f8")
                else:
                    pixels = _strip(f, r, i)[: rows * r.width * r.bands].reshape(rows, r.width, r.bands).astype("f8")
                if r.nodata is not None:
                    pixels[pixels == r.nodata] = np.nan
                col = np.arange(r.width) + 0.5
                for k in range(rows):
                    row = i * r.strip_rows + k + 0.5
                    xs, ys = x0 + col * dx + row * rx, y0 + col * ry + row * dy
                    bands = [[None if v != v else v for v in pixels[k, :, b].tolist()] for b in range(r.bands)]
                    yield from zip(xs.tolist(), ys.tolist(), *bands, strict=True)


class GeoTiffSource(DataSource):
    """options: path, rows (raster rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_geotiff"

    def schema(self) -> str:
        bands = open_raster(self.options["path"]).bands
        return ", ".join(["x double", "y double", *(f"band{i + 1} double" for i in range(bands))])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", WRITE_ROWS)))


def read_geotiff(spark: SparkSession, path: str, batch_size: int = WRITE_ROWS) -> Frame:
    """Uncompressed or deflated strips; nodata and NaN are missing. meta has the raster's shape."""
    r = open_raster(path)
    spark.dataSource.register(GeoTiffSource)
    df = spark.read.format(GeoTiffSource.name()).options(path=path, rows=batch_size).load()
    meta = {"width": r.width, "height": r.height, "nbands": r.bands, "gt": r.gt, "nodata": r.nodata}
    return Frame.of(df, meta=meta)


def _axis(df, name: str) -> tuple[float, float, float]:
    """Least and greatest coordinate and the least gap between two."""
    from pyspark.sql.window import Window

    values = df.select(F.col(name)).distinct()
    gap = F.col(name) - F.lag(name).over(Window.orderBy(name))
    low, high, step = values.select(name, gap.alias("gap")).agg(F.min(name), F.max(name), F.min("gap")).first()
    return low, high, step or 1.0


def write_geotiff(frame: Frame, path: str, compress: bool = False) -> None:
    """A north-up float64 raster over the grid of x and y; cells without a row are NaN.

    The grid's resolution is the least gap between coordinates. Spark sorts the
    pixels by raster row; the driver holds one strip at a time.
    """
    names = [n for n in frame.columns if n not in ("x", "y")]
    kinds = frame.kinds
    if "x" not in kinds or "y" not in kinds or not names:
        raise ValueError("write_geotiff needs columns x, y and a band")
    if any(kinds[n] not in ("double", "int64") for n in [*names, "x", "y"]):
        raise TypeError("write_geotiff: x, y and the bands must be numbers")
    df = frame.to_df().select(*(quoted(n).cast("double").alias(n) for n in ("x", "y", *names)))
    df = df.filter("x is not null and y is not null")
    if df.isEmpty():
        raise ValueError("write_geotiff: no pixels")
    (x0, x1, dx), (y0, y1, dy) = _axis(df, "x"), _axis(df, "y")
    width, height = round((x1 - x0) / dx) + 1, round((y1 - y0) / dy) + 1
    row = F.round((F.lit(y1) - F.col("y")) / dy).cast("int")
    at = F.round((F.col("x") - x0) / dx).cast("int")
    pixels = df.select(row.alias("__r"), at.alias("__c"), *map(quoted, names)).orderBy("__r", "__c")
    strips, offsets, temp = -(-height // WRITE_ROWS), [], f"{path}.writing"
    sizes: list[int] = []
    with open(temp, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))

        def flush(strip: np.ndarray) -> None:
            data = strip.astype("<f8").tobytes()
            data = zlib.compress(data, 6) if compress else data
            offsets.append(f.tell())
            sizes.append(len(data))
            f.write(data)

        def blank(i: int) -> np.ndarray:
            return np.full((min(WRITE_ROWS, height - i * WRITE_ROWS), width, len(names)), np.nan)

        i, strip = 0, blank(0)
        for r in pixels.toLocalIterator(True):
            while r[0] >= (i + 1) * WRITE_ROWS:
                flush(strip)
                i += 1
                strip = blank(i)
            strip[r[0] - i * WRITE_ROWS, r[1]] = [np.nan if v is None else v for v in r[2:]]
        for j in range(i, strips):
            flush(strip if j == i else blank(j))
        bands = len(names)
        tags = [
            (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [64] * bands),
            (COMPRESSION, "H", [8 if compress else 1]), (PHOTOMETRIC, "H", [1]),
            (STRIP_OFFSETS, "Q", offsets), (SAMPLES, "H", [bands]), (STRIP_ROWS, "I", [WRITE_ROWS]),
            (STRIP_BYTES, "Q", sizes), (PLANAR, "H", [1]), (SAMPLE_FORMAT, "H", [3] * bands),
            (PIXEL_SCALE, "d", [dx, dy, 0.0]), (TIEPOINT, "d", [0, 0, 0, x0 - dx / 2, y1 + dy / 2, 0]),
            (NODATA, "s", b"nan\0"),
        ]
        codes = {v: k for k, v in FIELDS.items()}
        entries = []
        for tag, code, values in tags:
            data = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
            if len(data) > 8:
                where = f.tell()
                f.write(data)
                data = struct.pack("<Q", where)
            entries.append(struct.pack("<HHQ", tag, codes[code], len(values)) + data.ljust(8, b"\0"))
        directory = f.tell()
        f.write(struct.pack("<Q", len(entries)) + b"".join(entries) + bytes(8))
        f.seek(8)
        f.write(struct.pack("<Q", directory))
    os.replace(temp, path)
