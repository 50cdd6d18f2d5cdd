"""Gridded files as long tables: classic NetCDF by latitude band, single-band GeoTIFF, zip members."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserine.sources import files as FI

# Fixed values of the classic NetCDF layout: type code -> (big-endian dtype, size).
_TYPES = {1: (">i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


class _Header:
    """Dimensions, variables and data offsets of one classic file (record variables excluded)."""

    def __init__(self, handle):
        self._f = handle
        magic = handle.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self._offset = ">q" if magic[3] == 2 else ">i"
        self._int()
        self.dims: list[tuple[str, int]] = []
        if self._list(_DIMENSION):
            self.dims = [(self._name(), self._int()) for _ in range(self._count)]
        if self._list(_ATTRIBUTE):
            self._attributes()
        self.variables: dict[str, tuple[list[int], str, int, int]] = {}
        if self._list(_VARIABLE):
            for _ in range(self._count):
                name = self._name()
                shape = [self._int() for _ in range(self._int())]
                if self._list(_ATTRIBUTE):
                    self._attributes()
                kind = self._int()
                self._int()
                begin = struct.unpack(self._offset, handle.read(struct.calcsize(self._offset)))[0]
                self.variables[name] = (shape, *_TYPES[kind], begin)

    def _int(self) -> int:
        return struct.unpack(">i", self._f.read(4))[0]

    def _list(self, tag: int) -> bool:
        found, self._count = self._int(), self._int()
        return found == tag and self._count > 0

    def _name(self) -> str:
        size = self._int()
        return self._f.read(size + (-size) % 4)[:size].decode()

    def _attributes(self) -> None:
        for _ in range(self._count):
            self._name()
            size = _TYPES[self._int()][1] * self._int()
            self._f.read(size + (-size) % 4)


def _axis(handle, header: _Header, name: str) -> np.ndarray:
    shape, dtype, size, begin = header.variables[name]
    handle.seek(begin)
    return np.frombuffer(handle.read(size * header.dims[shape[0]][1]), dtype=dtype)


class _Band(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.variable = options["variable"]
        self.band = int(options.get("band", "30"))

    def partitions(self):
        bands = []
        for path in self.paths:
            with open(path, "rb") as handle:
                header = _Header(handle)
                n_lat = header.dims[header.variables[self.variable][0][1]][1]
            bands += [_Band(path, at, min(at + self.band, n_lat)) for at in range(0, n_lat, self.band)]
        return bands

    def read(self, partition: _Band) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as handle:
            header = _Header(handle)
            shape, dtype, size, begin = header.variables[self.variable]
            names = [header.dims[d][0] for d in shape]
            n_time, n_lat, n_lon = (header.dims[d][1] for d in shape)
            time, lat, lon = (_axis(handle, header, n) for n in names)
            rows = partition.stop - partition.start
            for t in range(n_time):
                handle.seek(begin + size * (t * n_lat + partition.start) * n_lon)
                block = np.frombuffer(handle.read(size * rows * n_lon), dtype=dtype).astype("f8").reshape(rows, n_lon)
                la, lo = np.meshgrid(lat[partition.start:partition.stop], lon, indexing="ij")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(block.size, float(time[t]))), pa.array(la.astype("f8").ravel()), pa.array(lo.astype("f8").ravel()),
                     pa.array(block.ravel(), from_pandas=True)], names=["time", "lat", "lon", "value"])


class ClassicGridSource(DataSource):
    """`var(time, lat, lon)` of classic NetCDF files, one partition per file and latitude band.

    Options: path (comma-separated files on storage every executor mounts),
    variable, band (latitude rows per partition). NaN arrives as NULL.
    """

    @classmethod
    def name(cls) -> str:
        return "classic_grid"

    def schema(self) -> str:
        return "time double, lat double, lon double, value double"

    def reader(self, schema):
        return _GridReader(self.options)


def read_grid(spark: SparkSession, paths: list[str], variable: str, band: int = 30) -> DataFrame:
    spark.dataSource.register(ClassicGridSource)
    return spark.read.format("classic_grid").option("variable", variable).option("band", str(band)).option("path", ",".join(paths)).load()


def classic_bytes(variable: str, time: np.ndarray, lat: np.ndarray, lon: np.ndarray, values: np.ndarray) -> bytes:
    """One classic NetCDF file holding `variable(time, lat, lon)` as 32-bit floats."""
    def name(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * ((-len(raw)) % 4)

    axes = [("time", np.asarray(time, ">f8")), ("lat", np.asarray(lat, ">f8")), ("lon", np.asarray(lon, ">f8"))]
    data = np.asarray(values, ">f4")
    dims = struct.pack(">ii", _DIMENSION, 3) + b"".join(name(n) + struct.pack(">i", len(a)) for n, a in axes)
    sizes = [a.nbytes for _, a in axes] + [data.nbytes + (-data.nbytes) % 4]

    def variables(offset: int) -> bytes:
        out, at = struct.pack(">ii", _VARIABLE, 4), offset
        for i, (n, a) in enumerate([*axes, (variable, data)]):
            shape = [i] if i < 3 else [0, 1, 2]
            out += name(n) + struct.pack(f">i{len(shape)}i", len(shape), *shape) + struct.pack(">ii", 0, 0)
            out += struct.pack(">iii", 5 if i == 3 else 6, sizes[i], at)
            at += sizes[i]
        return out

    head = b"CDF\x01" + struct.pack(">i", 0) + dims + struct.pack(">ii", 0, 0)
    begin = len(head) + len(variables(0))
    return head + variables(begin) + b"".join(a.tobytes() for _, a in axes) + data.tobytes() + b"\0" * ((-data.nbytes) % 4)


def write_files(contents: DataFrame, name: str, folder: str) -> None:
    """One file per row of (name, content) in a folder of its own, through Spark's writer, so on any file system it knows.

    A newline follows the content; the formats here find their parts by offset and do not see it.
    """
    contents.select(name, F.col("content").cast("string").alias("value")).write.partitionBy(name).text(folder)


def band_files(cells: DataFrame) -> DataFrame:
    """(ilat, content): a classic NetCDF file of every latitude row, made by the task that owns the row."""
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="lon", values="value").sort_index()
        content = classic_bytes("field", wide.index.to_numpy(), np.array([pdf["lat"].iloc[0]]), wide.columns.to_numpy(), wide.to_numpy()[:, None, :])
        return pd.DataFrame({"ilat": [int(pdf["ilat"].iloc[0])], "content": [content]})

    return cells.groupBy("ilat").applyInPandas(make, "ilat bigint, content binary")


_CUT = "path string, t0 bigint, t1 bigint, y0 bigint, y1 bigint"
_CELL = "time double, lat double, lon double, value double"


def _runs(axis: np.ndarray, within: tuple[float, float] | None, longest: int) -> list[tuple[int, int]]:
    """Index ranges [start, stop) of at most `longest` positions whose coordinates lie within the closed bounds."""
    wanted = np.flatnonzero((axis >= within[0]) & (axis <= within[1])) if within else np.arange(len(axis))
    runs = np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else []
    return [(int(at), int(min(at + longest, run[-1] + 1))) for run in runs for at in range(run[0], run[-1] + 1, longest)]


def grid_cuts(path: str, handle, variable: str, band: int, times=None, lats=None, size: int = FI.RANGE) -> pd.DataFrame:
    """Ranges of time steps and latitude rows, of about `size` bytes at most, that hold the wanted slice of a file."""
    header = _Header(handle)
    shape, _, width, _ = header.variables[variable]
    time, lat = (_axis(handle, header, header.dims[d][0]).astype("f8") for d in shape[:2])
    rows = _runs(lat, lats, band)
    step = max(1, size // max(1, width * band * header.dims[shape[2]][1]))
    return pd.DataFrame([(path, t0, t1, y0, y1) for y0, y1 in rows for t0, t1 in _runs(time, times, step)], columns=["path", "t0", "t1", "y0", "y1"])


def grid_block(handle, row, variable: str) -> Iterator[pd.DataFrame]:
    """Cells of one range, a time step at a time: only the bytes of its latitude rows are read."""
    handle.seek(0)
    header = _Header(handle)
    shape, dtype, size, begin = header.variables[variable]
    n_lat, n_lon = (header.dims[d][1] for d in shape[1:])
    time, lat, lon = (_axis(handle, header, header.dims[d][0]).astype("f8") for d in shape)
    la, lo = (a.ravel() for a in np.meshgrid(lat[row.y0:row.y1], lon, indexing="ij"))
    for t in range(row.t0, row.t1):
        handle.seek(begin + size * (t * n_lat + row.y0) * n_lon)
        raw = handle.read(size * (row.y1 - row.y0) * n_lon)
        yield pd.DataFrame({"time": time[t], "lat": la, "lon": lo, "value": np.frombuffer(raw, dtype=dtype).astype("f8")})


def read_grid_files(spark: SparkSession, folder: str, variable: str, band: int = 30, times: tuple[float, float] | None = None,
                    lats: tuple[float, float] | None = None, size: int = FI.RANGE) -> DataFrame:
    """`var(time, lat, lon)` of all classic NetCDF files under a folder.

    A file is cut into ranges of latitude bands and time steps that are read by different tasks; bounds on times and latitudes (closed)
    reach the reader, which skips the bytes outside. NaN arrives as NULL. Where files cannot be opened by position, one task decodes a file.
    """
    if FI.by_position(folder):
        cuts = FI.over_files(spark, folder, lambda path, handle: iter([grid_cuts(path, handle, variable, band, times, lats, size)]), _CUT)
        return FI.over_ranges(cuts, lambda handle, row: grid_block(handle, row, variable), _CELL)

    def decode(path, handle):
        for row in grid_cuts(path, handle, variable, band, times, lats, size).itertuples(index=False):
            yield from grid_block(handle, row, variable)

    return FI.over_files(spark, folder, decode, _CELL)


# -- single-band GeoTIFF -----------------------------------------------------------

# Fixed tag numbers of the format.
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _OFFSETS, _COUNTS, _SCALE, _TIEPOINT = 256, 257, 258, 259, 273, 279, 33550, 33922
_FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}


def geotiff_blocks(handle, piece: int = FI.PIECE) -> Iterator[pd.DataFrame]:
    """Pixel centres and codes of an uncompressed single-band image, some rows at a time.

    Strips are read by their offsets in pieces of about `piece` bytes, so the image is never whole in memory.
    """
    def at(offset: int, size: int) -> bytes:
        handle.seek(offset)
        return handle.read(size)

    order = "<" if at(0, 2) == b"II" else ">"
    directory = struct.unpack(order + "I", at(4, 4))[0]
    count = struct.unpack(order + "H", at(directory, 2))[0]
    entries, tags = at(directory + 2, 12 * count), {}
    for k in range(count):
        entry = entries[12 * k : 12 * k + 12]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in _FIELD:
            continue
        code, size = _FIELD[kind]
        raw = entry[8:12] if size * n <= 4 else at(struct.unpack(order + "I", entry[8:12])[0], size * n)
        tags[tag] = struct.unpack(order + code * n, raw[: size * n])
    if tags.get(_COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed images are not read")
    width, height, each = tags[_WIDTH][0], tags[_LENGTH][0], tags[_BITS][0] // 8
    sx, sy, x0, y0 = tags[_SCALE][0], tags[_SCALE][1], tags[_TIEPOINT][3], tags[_TIEPOINT][4]
    lon, row = x0 + (np.arange(width) + 0.5) * sx, 0
    for offset, size in zip(tags[_OFFSETS], tags[_COUNTS], strict=True):
        held = size // (width * each)
        for first in range(0, held, step := max(1, piece // (width * each))):
            rows = min(step, held - first, height - row)
            codes = np.frombuffer(at(offset + first * width * each, rows * width * each), dtype=f"{order}u{each}")
            lat = y0 - (np.arange(row, row + rows) + 0.5) * sy
            yield pd.DataFrame({"lat": np.repeat(lat, width), "lon": np.tile(lon, rows), "code": codes.astype("i8")})
            row += rows
    if row != height:
        raise ValueError(f"strips hold {row} of {height} rows")


def geotiff_cells(payload: bytes) -> pd.DataFrame:
    """All cells of an image held in memory."""
    return pd.concat(geotiff_blocks(io.BytesIO(payload)), ignore_index=True)


def read_geotiff(spark: SparkSession, path: str, zip_member: str | None = None, piece: int = FI.PIECE) -> DataFrame:
    """Images (or the named member of zip archives) under `path` as (lat, lon, code), read in pieces by one task per file."""
    def decode(name, handle):
        if zip_member is None:
            yield from geotiff_blocks(handle, piece)
        else:
            with zipfile.ZipFile(handle) as archive, archive.open(zip_member) as member:
                yield from geotiff_blocks(member, piece)

    return FI.over_files(spark, path, decode, "lat double, lon double, code bigint")


def geotiff_bytes(codes: np.ndarray, step: float, lon0: float, lat0: float) -> bytes:
    """A one-strip image with pixel scale and tie point."""
    codes = np.asarray(codes)
    if codes.size and codes.min() < 0:
        raise ValueError("codes must not be negative")
    width = next(b for b in (1, 2, 4) if not codes.size or codes.max() < 1 << 8 * b)
    codes = codes.astype(f"<u{width}")
    entries = [(_WIDTH, 4, 1, codes.shape[1]), (_LENGTH, 4, 1, codes.shape[0]), (_BITS, 3, 1, 8 * width), (_COMPRESSION, 3, 1, 1),
               (_OFFSETS, 4, 1, 0), (_COUNTS, 4, 1, codes.nbytes), (_SCALE, 12, 3, 0), (_TIEPOINT, 12, 6, 0)]
    directory = 8
    doubles = directory + 2 + 12 * len(entries) + 4
    pixels = doubles + 72
    body = struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        value = {_OFFSETS: pixels, _SCALE: doubles, _TIEPOINT: doubles + 24}.get(tag, value)
        body += struct.pack("<HHII", tag, kind, count, value)
    body += struct.pack("<I", 0) + struct.pack("<9d", step, step, 0.0, 0.0, 0.0, 0.0, lon0, lat0, 0.0)
    return b"II*\0" + struct.pack("<I", directory) + body + codes.tobytes()


def conform_axes(df: DataFrame, renames: dict[str, str], constant: list[str]) -> DataFrame:
    """Rename axes and drop dimensions that hold a single value."""
    if constant:
        sizes = df.agg(*[F.count_distinct(c).alias(c) for c in constant]).collect()[0]
        wide = [c for c in constant if sizes[c] > 1]
        if wide:
            raise ValueError(f"dimensions hold more than one value: {wide}")
    return df.drop(*constant).withColumnsRenamed(renames)


def band_images(cells: DataFrame, step: float, n_lon: int, zipped: bool) -> DataFrame:
    """(ilat, content): an image, or a zip archive that holds it, of every latitude row of `code`."""
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.zeros((1, n_lon), dtype="i8")
        codes[0, pdf["ilon"].to_numpy()] = pdf["code"].to_numpy()
        content = geotiff_bytes(codes, step, -180.0, float(pdf["clat"].iloc[0]) + step / 2)
        if zipped:
            with zipfile.ZipFile(packed := io.BytesIO(), "w") as archive:
                archive.writestr("band.tif", content)
            content = packed.getvalue()
        return pd.DataFrame({"ilat": [int(pdf["ilat"].iloc[0])], "content": [content]})

    return cells.groupBy("ilat").applyInPandas(make, "ilat bigint, content binary")
