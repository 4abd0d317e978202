"""Masks as tables against walks over the whole mask, and mask files read by ranges."""

import struct
import zlib

import numpy as np
import pytest

from lanegraph.operators import tiles
from lanegraph.operators.raster import Raster, segments_safe
from lanegraph.shared import materialize
from lanegraph.sources import binary as b

W, H = 50, 40
DEG = 111319.49079327357
META = {"width": W, "height": H, "pixel_size_m": 1000.0, "min_x": 0.0, "min_y": 0.0, "max_x": 50000.0, "max_y": 40000.0}


def grid(share=0.04):
    return (np.random.default_rng(5).random((H, W)) < share).astype(np.uint8)


def segments(spark, n=700):
    r = np.random.default_rng(9)
    x0, x1 = r.uniform(-500, 50500, n), r.uniform(-500, 50500, n)
    y0, y1 = r.uniform(-500, 40500, n), r.uniform(-500, 40500, n)
    x0[:60], y0[:60], x1[:60], y1[:60] = (np.round(v[:60], -3) for v in (x0, y0, x1, y1))  # cell corners
    x1[60:80], y1[80:100] = x0[60:80], y0[80:100]  # along an axis
    x1[100:110], y1[100:110] = x0[100:110], y0[100:110]  # no way at all
    x1[110:300], y1[110:300] = x0[110:300] + r.uniform(-3000, 3000, 190), y0[110:300] + r.uniform(-3000, 3000, 190)
    y0, y1 = (np.degrees(2 * np.arctan(np.exp(v / 6378137.0)) - np.pi / 2) for v in (y0, y1))
    rows = [(i, float(a / DEG), float(c), float(d / DEG), float(e)) for i, (a, c, d, e) in enumerate(zip(x0, y0, x1, y1))]
    rows += [(n, 179.0, 0.1, -179.5, 0.1)]
    return spark.createDataFrame(rows, "segment_id long, lon1 double, lat1 double, lon2 double, lat2 double")


def mask_file(land, version, tw=16, th=16):
    head = b.MASK_MAGIC + struct.pack("<III5dI", version, W, H, 1000.0, 0.0, 0.0, 50000.0, 40000.0, 1)
    if version == 1:
        return head + struct.pack("<Q", W * H) + np.packbits(land).tobytes()
    cols, rows = -(-W // tw), -(-H // th)
    head += struct.pack("<IIII", tw, th, cols, rows) + (struct.pack("<I", 1) if version == 3 else b"") + struct.pack("<Q", W * H)
    entry = "<QIII" if version == 3 else "<QII"
    at, listed, body = len(head) + struct.calcsize(entry) * cols * rows, b"", b""
    for k in range(cols * rows):
        part = land[k // cols * th : k // cols * th + th, k % cols * tw : k % cols * tw + tw]
        raw = np.packbits(part).tobytes() if part.any() else b""
        data = zlib.compress(raw) if version == 3 and raw else raw
        listed += struct.pack(entry, at + len(body), len(data), *([len(raw)] if version == 3 else []), int(part.sum()))
        body += data
    return head + listed + body


def found(df):
    return {r["segment_id"]: r["safe"] for r in df.collect()}


@pytest.mark.parametrize("tile_w,heavy", [(16, 1024), (7, 2), (50, 64)])
def test_tables_equal_the_walk(spark, monkeypatch, tile_w, heavy):
    """Also where frequent rows of the mask are broadcast (a row that one in two runs asks for, or one in 64)."""
    monkeypatch.setattr(tiles, "HEAVY", heavy)
    land = grid()
    raster = Raster(W, H, 1000.0, 0.0, 0.0, 50000.0, 40000.0, np.packbits(land).tobytes())
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(land))], "row int, col int")
    want = found(segments_safe(segments(spark), raster))
    assert 100 < sum(want.values()) < 600
    assert found(tiles.segments_safe_tiled(segments(spark), META, tiles.rows_of_cells(cells, tile_w), tile_w)) == want


def test_runs_are_neither_written_nor_joined(spark, monkeypatch):
    """Segments are written once and ask once a group; their runs, here about 30 each, stay in the tasks."""
    written = []
    monkeypatch.setattr(tiles, "materialize", lambda df, tag: written.append(df.count()) or materialize(df, tag))
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(grid()))], "row int, col int")
    got = tiles.segments_safe_tiled(segments(spark), META, tiles.rows_of_cells(cells, 7), 7)
    assert got.count() == 701 and written == [701]


@pytest.mark.parametrize("version", [1, 2, 3])
def test_files_by_ranges(spark, tmp_path, version):
    land = grid()
    path = str(tmp_path / "mask.bin")
    with open(path, "wb") as f:
        f.write(mask_file(land, version))
    whole = b.read_mask(spark, path)
    for slices in (1, 5):
        meta, parts = b.read_mask_tiles(spark, path, slices, 60)  # version 1 in bands of eight rows
        assert parts.agg({"land_pixel_count": "sum"}).first()[0] == land.sum()
        assert parts.rdd.getNumPartitions() == slices
        assert sorted(tuple(r) for r in b.land_cells(parts, meta).collect()) == [(int(r), int(c)) for r, c in zip(*np.nonzero(land))]
    want = found(segments_safe(segments(spark), whole))
    assert found(tiles.segment_safety(segments(spark), meta, parts)) == want
    assert found(tiles.segment_safety(segments(spark), meta, parts, limit=0)) == want


def test_bad_mask_files(tmp_path):
    land = grid()
    good = mask_file(land, 3)
    for data in (b"x" * 200, good[:60], good[:-1], b.MASK_MAGIC + struct.pack("<I", 9) + good[12:], mask_file(land, 1) + b"x"):
        path = str(tmp_path / "bad.bin")
        with open(path, "wb") as f:
            f.write(data)
        with pytest.raises(b.ArtifactError):
            list(b.MaskFile(path).tiles(0, 12))


def test_awkward_segments_and_empty_masks(spark):
    rows = [(1, None, 0.0, 0.1, 0.1), (2, 0.1, 0.1, 0.2, 0.2), (3, 0.1, float("nan"), 0.2, 0.2)]
    asked = spark.createDataFrame(rows, "segment_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    none = spark.createDataFrame([], "row int, tile_col int, bits string")
    got = found(tiles.segments_safe_tiled(asked, META, none, 16))
    assert got[1] is False and got[2] is True
    assert tiles.segments_safe_tiled(asked.limit(0), META, none, 16).count() == 0
