"""Files read by position: digests in pieces, slices of grids in ranges, images in strips."""

import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest

from tesserine.operators import checks as Q
from tesserine.sources import files as FI
from tesserine.sources import grids as GR
from tesserine.sources import tables as T


@pytest.fixture
def no_position(monkeypatch):
    monkeypatch.setattr(FI, "by_position", lambda path: False)


def content(folder):
    rng = np.random.default_rng(0)
    made = {"a.bin": rng.bytes(1000), "sub dir/a.bin": rng.bytes(999), "sub dir/empty.bin": b"", "k=1/part%20x.bin": b"\0\n" * 300}
    for name, raw in made.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    return {name: raw for name, raw in made.items() if raw}  # a listing has no empty files


@pytest.mark.parametrize("piece", [1, 7, 1000, 1 << 20])
def test_digests_do_not_depend_on_the_piece(spark, tmp_path, piece):
    made = content(tmp_path)
    got = FI.digests(spark, tmp_path.as_uri().replace("%20", " "), piece=piece).select(FI.relative(str(tmp_path)).alias("f"), "bytes", "sha256").collect()
    assert {(r.f, r.bytes, r.sha256) for r in got} == {(n, len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in made.items()}


def test_digests_elsewhere(spark, tmp_path, no_position):
    made = content(tmp_path)
    got = T.file_manifest(spark, str(tmp_path)).collect()
    assert {(r.file, r.bytes, r.sha256) for r in got} == {(n, len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in made.items()}


def test_a_file_above_two_gigabytes_is_streamed(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as handle:  # a hole: no disk is used
        handle.seek((1 << 31) + 5)
        handle.write(b"end")
    want, zero = hashlib.sha256(), bytes(1 << 20)
    for _ in range(1 << 11):
        want.update(zero)
    want.update(bytes(5) + b"end")
    T.verify_checksum(spark, str(path), want.hexdigest())
    with pytest.raises(ValueError):
        T.verify_checksum(spark, str(path), "0" * 64)


def test_opener_names_the_file_system():
    assert FI.opener("file:/a b/c")[1] == "/a b/c" and FI.opener("/a/c")[1] == "/a/c" and FI.opener("file:///x%20y")[1] == "/x%20y"
    assert FI.by_position("/a") and not FI.by_position("unheard://host/a")


def test_manifests_name_what_differs(spark, tmp_path):
    content(tmp_path)
    before = {r.file: r.sha256 for r in T.file_manifest(spark, str(tmp_path), "*.bin").collect()}
    first = Q.identity(spark, str(tmp_path), "*.bin")
    Q.verify_manifest(spark, str(tmp_path), before, "*.bin")
    assert Q.identity(spark, str(tmp_path), "*.bin") == first
    (tmp_path / "a.bin").write_bytes(b"other")
    (tmp_path / "sub dir" / "a.bin").rename(tmp_path / "sub dir" / "b.bin")
    expected = spark.createDataFrame(list(before.items()), "file string, sha256 string")
    got = Q.manifest_differences(T.file_manifest(spark, str(tmp_path), "*.bin"), expected).collect()
    assert {(r.file, r.status) for r in got} == {("a.bin", "changed"), ("sub dir/a.bin", "missing"), ("sub dir/b.bin", "added")}
    assert Q.identity(spark, str(tmp_path), "*.bin") != first
    with pytest.raises(Q.GateFailure, match="a.bin"):
        Q.verify_manifest(spark, str(tmp_path), before, "*.bin")


GRID = np.random.default_rng(3).normal(size=(6, 7, 5)).astype("f4")
TIME, LAT, LON = np.arange(6.0), np.linspace(75, -75, 7), np.linspace(0, 288, 5)


def grids(folder):
    for k in range(2):
        (folder / f"g{k}.nc").write_bytes(GR.classic_bytes("temp", TIME + 6 * k, LAT, LON, GRID + k))


@pytest.mark.parametrize("elsewhere", [False, True])
@pytest.mark.parametrize(("band", "times", "lats"), [(30, None, None), (2, (4.0, 7.0), None), (1, None, (-30.0, 30.0)), (3, (5.0, 5.0), (70.0, 90.0)), (2, (50.0, 60.0), None)])
def test_slices_of_grids(spark, tmp_path, monkeypatch, elsewhere, band, times, lats):
    if elsewhere:
        monkeypatch.setattr(FI, "by_position", lambda path: False)
    grids(tmp_path)
    got = sorted(map(tuple, GR.read_grid_files(spark, str(tmp_path), "temp", band, times, lats, size=40).collect()))
    inside = lambda v, b: b is None or b[0] <= v <= b[1]
    want = [(t + 6 * k, la, lo, float(np.float32(GRID[i, j, m] + k))) for k in range(2) for i, t in enumerate(TIME) for j, la in enumerate(LAT) for m, lo in enumerate(LON)
            if inside(t + 6 * k, times) and inside(la, lats)]
    np.testing.assert_allclose(np.array(got).reshape(-1, 4), np.array(sorted(want)).reshape(-1, 4))


def test_a_slice_reads_only_its_bytes():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            raw = super().read(size)
            self.taken += len(raw)
            return raw

    values = np.zeros((50, 60, 40), "f4")
    raw = GR.classic_bytes("temp", np.arange(50.0), np.linspace(-89, 89, 60), np.arange(40.0), values)
    cuts = GR.grid_cuts("x", Counted(raw), "temp", 4, (10.0, 12.0), (0.0, 20.0), size=1 << 20)
    assert len(cuts) == 2 and set(zip(cuts.t0, cuts.t1)) == {(10, 13)}
    handle = Counted(raw)
    cells = sum(len(b) for row in cuts.itertuples(index=False) for b in GR.grid_block(handle, row, "temp"))
    assert cells == 3 * 7 * 40 and handle.taken < 2 * 2000 + 4 * cells


def test_bands_and_times_become_several_ranges():
    raw = GR.classic_bytes("temp", TIME, LAT, LON, GRID)
    cuts = GR.grid_cuts("x", io.BytesIO(raw), "temp", 2, size=2 * 4 * 2 * 5)
    assert len(cuts) == 4 * 3 and (cuts.t1 - cuts.t0).max() == 2
    assert sum((r.t1 - r.t0) * (r.y1 - r.y0) for r in cuts.itertuples()) == 6 * 7


@pytest.mark.parametrize("piece", [1, 10, 1 << 20])
@pytest.mark.parametrize("zipped", [False, True])
def test_images_in_pieces(spark, tmp_path, piece, zipped):
    codes = np.arange(5 * 4).reshape(5, 4) + 300
    raw = GR.geotiff_bytes(codes, 0.5, -180.0, 90.0)
    if zipped:
        with zipfile.ZipFile(tmp_path / "i.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("in/i.tif", raw)
    else:
        (tmp_path / "i.tif").write_bytes(raw)
    got = sorted((-r.lat, r.lon, r.code) for r in GR.read_geotiff(spark, str(tmp_path), "in/i.tif" if zipped else None, piece).collect())
    assert [c for _, _, c in got] == codes.ravel().tolist() and got[0][:2] == (-89.75, -179.75)


def test_strips_that_lack_rows_are_refused():
    raw = bytearray(GR.geotiff_bytes(np.ones((4, 3), int), 1.0, 0.0, 0.0))
    at = raw.index(struct.pack("<HHII", 279, 4, 1, 12))
    raw[at : at + 12] = struct.pack("<HHII", 279, 4, 1, 9)
    with pytest.raises(ValueError, match="3 of 4"):
        GR.geotiff_cells(bytes(raw))
