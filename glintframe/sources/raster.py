"""Single-band GeoTIFF, in strips or tiles, as pixel rows; and back as tiles with their CRS."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: 1, 3: 2, 4: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 12: "d"}
PIXELS = "path string, row int, col int, value double"


def decode(data: bytes) -> tuple[np.ndarray, dict[int, tuple]]:
    """Grid and tags of a single-band TIFF in strips or tiles: integers or floats, plain or deflate, any predictor."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(f"{end}I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(f"{end}H", data[at:at + 2])[0]):
        tag, kind, n, value = struct.unpack(f"{end}HHI4s", data[at + 2 + 12 * k:at + 14 + 12 * k])
        if kind in _CODES:
            size = _SIZES[kind] * n
            place = struct.unpack(f"{end}I", value)[0]
            tags[tag] = struct.unpack(f"{end}{n}{_CODES[kind]}", value[:size] if size <= 4 else data[place:place + size])
        elif kind == 2:
            place = struct.unpack(f"{end}I", value)[0]
            tags[tag] = ((value[:n] if n <= 4 else data[place:place + n]).rstrip(b"\0").decode("latin-1"),)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(277, 1) != 1:
        raise ValueError("only single-band files are read")
    if one(259, 1) not in (1, 8, 32946):
        raise ValueError("only uncompressed and deflate files are read")
    width, height, size = tags[256][0], tags[257][0], one(258, 1) // 8
    kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    if 322 in tags:
        across, down, offsets, lengths = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        across, down, offsets, lengths = width, min(one(278, height), height), tags[273], tags[279]
    columns = -(-width // across)
    grid = np.empty((-(-height // down) * down, columns * across))
    for k, (o, n) in enumerate(zip(offsets, lengths)):
        block = data[o:o + n] if one(259, 1) == 1 else zlib.decompress(data[o:o + n])
        i, j = k // columns * down, k % columns * across
        rows = len(block) // (across * size)  # the last strip may be short
        grid[i:i + rows, j:j + across] = _unpredicted(block, rows, across, one(317, 1), end, kind, size)
    return grid[:height, :width].copy(), tags


def _unpredicted(block: bytes, rows: int, across: int, predictor: int, end: str, kind: str, size: int) -> np.ndarray:
    if predictor == 3:  # bytes of a row's samples, highest first, in planes; differences of bytes
        planes = np.frombuffer(block, np.uint8).reshape(rows, size * across)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, across)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">{kind}{size}")[..., 0]
    if predictor == 2:  # differences of samples, as whole numbers
        whole = np.frombuffer(block, f"{end}u{size}").reshape(rows, across)
        return np.cumsum(whole, axis=1, dtype=f"u{size}").view(f"{kind}{size}")
    return np.frombuffer(block, f"{end}{kind}{size}").reshape(rows, across)


def crs_of(tags: dict[int, tuple]) -> str | None:
    """EPSG code in the geographic keys: of the projection, else of the geographic system."""
    keys = tags.get(34735, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = found.get(3072, found.get(2048))
    return None if code is None else f"EPSG:{code}"


def encode(grid: np.ndarray, ulx: float = 0.0, uly: float = 0.0, dx: float = 5000.0, dy: float = 5000.0, crs: str | None = None, block: int = 16) -> bytes:
    """A tiled float32 deflate TIFF with horizontal differences, pixel scale, upper-left corner and CRS (EPSG:n)."""
    grid = np.asarray(grid, dtype="<f4")
    height, width = grid.shape
    down, across = -(-height // block), -(-width // block)
    padded = np.zeros((down * block, across * block), "<f4")
    padded[:height, :width] = grid
    whole = padded.view("<u4").reshape(down, block, across, block).transpose(0, 2, 1, 3)
    whole = np.diff(whole, axis=3, prepend=np.zeros((down, across, block, 1), "<u4"))
    tiles = [zlib.compress(np.ascontiguousarray(whole[i, j], dtype="<u4").tobytes()) for i in range(down) for j in range(across)]
    out = bytearray(b"II*\0\0\0\0\0")

    def put(data: bytes) -> int:
        at = len(out)
        out.extend(data + b"\0" * (len(data) % 2))
        return at

    offsets, lengths = [put(t) for t in tiles], [len(t) for t in tiles]
    many = lambda v: v[0] if len(v) == 1 else put(struct.pack(f"<{len(v)}I", *v))
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 32), (259, 3, 1, 8), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, 2),
               (322, 4, 1, block), (323, 4, 1, block), (324, 4, len(tiles), many(offsets)), (325, 4, len(tiles), many(lengths)), (339, 3, 1, 3),
               (33550, 12, 3, put(struct.pack("<3d", dx, dy, 0.0))), (33922, 12, 6, put(struct.pack("<6d", 0, 0, 0, ulx, uly, 0)))]
    if crs:
        code = int(crs.rpartition(":")[2])
        geographic = 4000 <= code < 5000
        keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)
        entries.append((34735, 3, len(keys), put(struct.pack(f"<{len(keys)}H", *keys))))
    out[4:8] = struct.pack("<I", len(out))
    return bytes(out) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)


def read_corners(spark: SparkSession, path: str) -> DataFrame:
    """path, ulx, uly, dx, dy, crs of GeoTIFF files; NULL where a file does not say."""
    def corners(frames):
        for pdf in frames:
            tags = [decode(data)[1] for data in pdf["content"]]
            ties, scales = [t.get(33922, (None,) * 6) for t in tags], [t.get(33550, (None,) * 3) for t in tags]
            yield pd.DataFrame({"path": pdf["path"], "ulx": [t[3] for t in ties], "uly": [t[4] for t in ties], "dx": [s[0] for s in scales], "dy": [s[1] for s in scales], "crs": [crs_of(t) for t in tags]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path", "content")
    return files.mapInPandas(corners, "path string, ulx double, uly double, dx double, dy double, crs string")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, value of every pixel of GeoTIFF files, NaN as NULL."""
    def pixels(frames):
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                grid, _ = decode(data)
                r, c = np.indices(grid.shape)
                v = grid.ravel()
                yield pd.DataFrame({"path": name, "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "value": pd.array(np.where(np.isnan(v), None, v), dtype="Float64")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path", "content")
    return files.mapInPandas(pixels, PIXELS)


def grid_files(cells: DataFrame, value: str, by: str = "sid") -> DataFrame:
    """sid, content: the coarse grid (sid, i, j, value) of each scene as a GeoTIFF; 23 x 23 cells fit one row.

    Columns ulx, uly and crs, where there are, place it.
    """
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        grid = np.full((n, n), np.nan)
        grid[pdf["i"], pdf["j"]] = pdf[value]
        placed = {k: pdf[k].iloc[0] for k in ("ulx", "uly", "crs") if k in pdf and not pd.isna(pdf[k].iloc[0])}
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [encode(grid, **placed)]})

    return cells.groupBy(by).applyInPandas(packed, f"{by} {dict(cells.dtypes)[by]}, content binary")


def decoded_grids(files: DataFrame, by: str = "sid") -> DataFrame:
    """sid, i, j, sga, crs of the cells that hold a value, from files as `grid_files` makes them."""
    kind = dict(files.dtypes)[by]

    def cells(frames):
        for pdf in frames:
            for s, data in zip(pdf[by], pdf["content"]):
                grid, tags = decode(bytes(data))
                i, j = np.nonzero(~np.isnan(grid))
                yield pd.DataFrame({by: [s] * len(i), "i": i.astype(np.int32), "j": j.astype(np.int32), "sga": grid[i, j], "crs": crs_of(tags)})

    return files.mapInPandas(cells, f"{by} {kind}, i int, j int, sga double, crs string")


def native(spark: SparkSession, path: str) -> DataFrame:
    """The same pixels kept as Parquet, the engine's own form."""
    return spark.read.parquet(path).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
