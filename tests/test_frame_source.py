"""The metadata scan: bytes read, columns, filters, partitions."""

import numpy as np
import pytest

from stopwise.sources import dng, frame_source, tags, tiff

from .test_dng import make


def test_a_large_frame_costs_a_few_kilobytes(spark, tmp_path):
    (tmp_path / "big.dng").write_bytes(make(np.zeros((4950, 3740), np.uint16), opcodes=(51009,)))
    (tmp_path / "tiles.tif").write_bytes(tiff.encode(np.zeros((2048, 2048), np.uint16), tile=(16, 16)))
    (tmp_path / "small.TIFF").write_bytes(tiff.encode(np.zeros((3, 5, 3), np.uint16)))
    (tmp_path / "note.txt").write_text("no frame")
    (tmp_path / "x.dng").mkdir()
    got = {r.path.rpartition("/")[2]: r for r in frame_source.frames(spark, str(tmp_path)).collect()}
    assert set(got) == {"big.dng", "tiles.tif", "small.TIFF"}
    big = got["big.dng"]
    assert big.file_bytes > 37_000_000 and big.fetched_bytes < 20_000
    assert (big.width, big.height, big.cfa_pattern, big.corrections, big.corrections_present, big.lens_model) == (3740, 4950, "RGGB", "OpcodeList2", True, "lens 50")
    assert got["tiles.tif"].fetched_bytes < 20_000  # not the tables of 16384 tiles
    assert (got["small.TIFF"].width, got["small.TIFF"].components, got["small.TIFF"].corrections_present) == (5, 3, None)


def test_columns_filters_and_partitions(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}.tif").write_bytes(tiff.encode(np.zeros((i + 1, 4), np.uint16)))
    (tmp_path / "broken.dng").write_bytes(b"not a frame at all")
    whole = frame_source.frames(spark, str(tmp_path), "path", "height", files=3)
    assert whole.columns == ["path", "height"] and whole.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="broken.dng"):
        whole.collect()
    names = frame_source.frames(spark, str(tmp_path), "path", "file_bytes")
    assert names.count() == 8 and sorted(names.columns) == ["file_bytes", "path"]  # opens nothing
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        tifs = frame_source.frames(spark, str(tmp_path), "path", "extension", "height").where("extension = 'tif' AND height > 2")
        assert sorted(r.height for r in tifs.collect()) == [3, 4, 5, 6, 7]  # the broken file is left out before it is opened
        ends = frame_source.frames(spark, str(tmp_path), "path", "height").where("path LIKE '%f3.tif'")
        assert [r.height for r in ends.collect()] == [4]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_folder(spark, tmp_path):
    assert frame_source.frames(spark, str(tmp_path)).collect() == []


def test_ranged_reads():
    class File:
        def __init__(self, data):
            self.data, self.reads = data, []

        def read_at(self, n, at):
            self.reads.append((at, n))
            return self.data[at : at + n]

    data = bytes(range(256)) * 10
    file = File(data)
    r = tags.Ranged(file, len(data), 100)
    for a, b in ((0, 8), (95, 105), (3, 7), (2500, 9999), (2555, 2560), (40, 40)):
        assert r[a:b] == data[a:b]
    assert file.reads == [(0, 100), (100, 100), (2500, 60)] and r.fetched == 260


def test_inspect_agrees_with_the_scan(spark, tmp_path):
    (tmp_path / "a.dng").write_bytes(make(np.zeros((8, 8), int), packed=7, tile=16))
    old = dng.inspect(dng.files(spark, str(tmp_path))).drop("path").first()
    assert frame_source.frames(spark, str(tmp_path)).select(*old.asDict()).first() == old
