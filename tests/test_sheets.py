"""Contact sheets in bands, and the small decode self-tests."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.operators import contact, mosaic


def test_bands_give_the_pixels_of_one_picture(spark, tmp_path):
    """10 000 frames of one run, and runs of a single frame and of two."""
    thumb = F.array_repeat((F.col("i") * 37 % 256).cast("int"), 96 * 72)
    tiles = spark.range(10_003).select(
        F.when(F.col("id") < 10_000, 1).when(F.col("id") == 10_000, 2).otherwise(3).alias("run_id"),
        F.when(F.col("id") < 10_000, F.col("id")).when(F.col("id") == 10_000, 0).otherwise(F.col("id") - 10_001).alias("i"),
    )
    tiles = tiles.select("run_id", F.col("i").alias("input_index"), F.expr("repeat(chr(int(i * 37 % 128)), 6912)").cast("binary").alias("thumb"), F.concat(F.lit("f "), F.col("i").cast("string")).alias("label"))
    made = {r.run_id: r for r in contact.sheets(tiles, f"file://{tmp_path}", rows=100).collect()}
    assert {k: (r.width, r.height, r.bands) for k, r in made.items()} == {1: (432, 2500 * 96, 25), 2: (108, 96, 1), 3: (216, 96, 1)}
    for run, n in ((1, 10_000), (2, 1), (3, 2)):
        want = [(np.full(96 * 72, i * 37 % 128, np.uint8), f"f {i}") for i in range(n)]
        columns = min(n, 4)
        rows = list(contact.read_rows(made[run].uri))
        assert len(rows) == -(-n // columns)
        for k in {0, len(rows) // 2, len(rows) - 1, min(99, len(rows) - 1), min(100, len(rows) - 1)}:
            assert np.array_equal(rows[k], contact.draw(want[k * columns : (k + 1) * columns], columns))
    raw = (tmp_path / made[3].uri.rpartition("/")[2]).read_bytes()
    assert raw.endswith(contact.chunk(b"IEND", b""))


def test_checksums_of_bands_join():
    parts = [bytes([k]) * n for k, n in ((0, 1), (255, 70_000), (7, 3), (1, 65_521))]
    whole = 1
    for p in parts:
        whole = contact.joined_adler(whole, zlib.adler32(p), len(p))
    assert whole == zlib.adler32(b"".join(parts))


def test_damaged_sheets_raise(tmp_path):
    image = np.zeros((96, 108, 3), np.uint8)
    path = tmp_path / "s.png"
    with open(path, "wb") as out:
        sheet = contact.Sheet(out, 108, 96)
        sheet.add(*contact.packed(image, True))
        sheet.close()
    assert len(list(contact.read_rows(f"file://{path}"))) == 1
    good = path.read_bytes()
    for bad in (b"no" + good[2:], good[:60] + bytes([good[60] ^ 1]) + good[61:]):
        path.write_bytes(bad)
        with pytest.raises(Exception):
            list(contact.read_rows(f"file://{path}"))


def test_green_self_test(spark):
    y, x = np.indices((8, 8))
    smooth = (np.sin(x / 5) + y / 8).ravel().tolist()
    noise = np.random.default_rng(1).random(64).tolist()
    rows = spark.createDataFrame([(1, smooth, "RGGB"), (2, noise, "GRBG"), (3, [0.5] * 64, "BGGR")], "i int, s array<double>, pattern string")
    found = {r.i: r.c for r in rows.select("i", mosaic.green_correlation(F.col("s"), 8, 8, F.col("pattern")).alias("c")).collect()}
    a, b = np.array(smooth).reshape(8, 8)[0::2, 1::2].ravel(), np.array(smooth).reshape(8, 8)[1::2, 0::2].ravel()
    assert found[1] == pytest.approx(np.corrcoef(a, b)[0, 1]) and found[2] < 0.9 and found[3] is None
    tested = rows.select("i", mosaic.checked_green(F.col("s"), 8, 8, F.col("pattern")).alias("c"))
    assert tested.where("i = 1").first().c == pytest.approx(found[1])
    for i in (2, 3):
        with pytest.raises(Exception, match="correlate"):
            tested.where(f"i = {i}").collect()


def test_top_centre_needs_light(spark):
    rows = spark.createDataFrame([(1, y, [0.0] * 80) for y in range(50)], "run_id int, y int, samples array<double>")
    with pytest.raises(Exception, match="not positive"):
        mosaic.top_centre_falloff(rows, 80, 50).collect()


def test_small_pictures_are_enlarged_where_they_are_drawn(spark, tmp_path):
    """Runs of 1 to 1100 tiles; what is read back by bands is what whole files hold."""
    sizes = {None: 5, 1: 1, 2: 3, 3: 4, 4: 1100}
    rows = [(run, i, [(i * 7 + k) % 256 for k in range(6)], f"t {i}") for run, n in sizes.items() for i in range(n)]
    tiles = spark.createDataFrame(rows, "run_id long, input_index int, thumb array<int>, label string").repartition(5)
    full = tiles.withColumn("thumb", F.transform(F.sequence(F.lit(0), F.lit(96 * 72 - 1)), lambda i: F.get("thumb", (F.floor(F.floor(i / 96) * 2 / 72) * 3 + F.floor((i % 96) * 3 / 96)).cast("int"))))
    small, whole = (spark.createDataFrame(contact.sheets(t, f"file://{tmp_path}", rows=8, side=side).collect(), "run_id long, uri string, width int, height int, bands int, bytes long, starts array<long>") for t, side in ((tiles, (3, 2)), (full, None)))
    bands = {n: -(-(-(-n // min(n, 4))) // 8) for n in sizes.values()}
    assert {r.run_id: r.bands for r in small.collect()} == {run: bands[n] for run, n in sizes.items()}
    uris = {r.run_id: r.uri for r in whole.collect()}
    for r in small.collect():
        assert all(np.array_equal(a, b) for a, b in zip(contact.read_rows(r.uri), contact.read_rows(uris[r.run_id]), strict=True))
    want = {run: sum(3 * 1152 * sum(t) for q, _, t, _ in rows if q == run) for run in sizes}
    found = small.join(contact.band_sums(small), "uri").collect()
    assert {r.run_id: r.thumb_sum for r in found} == want
    path = found[0].uri.removeprefix("file://")
    with open(path, "r+b") as file:
        file.seek(found[0].starts[-1] + 9)
        byte = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        contact.band_sums(small).collect()


def test_contact_sheets_number_rows_in_ranges(spark, tmp_path):
    """A plane travels as its 64 samples, labels of null and of one row have sheets, and a row without a plane has no tile."""
    from stopwise.plans import queries

    spark.createDataFrame([(i, None if i == 7 else [i / 5000] * 64, (None, 3)[i % 3 > 0] if i < 2999 else 9) for i in range(3000)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges a label
    try:
        placed = queries.in_labels(spark.range(1000).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("vec_id"))).collect()
        assert all(r.input_index == r.vec_id // 3 for r in placed)
        made = {r.run_id: (r.width, r.height, r.bands) for r in queries.contact_sheets(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert made == {None: (432, 250 * 96, 4), 3: (432, 500 * 96, 8), 9: (108, 96, 1)}
