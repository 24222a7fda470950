"""Reading driver tables, and the stand-in views that give capture operators their shapes.

The tables hold no photographs: planes and frame evidence are deterministic functions of their rows, and
their values have no optical meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.deploy import ship

SIDE = 8  # an embedding of 64 values is a plane of 8 x 8
PLANES, FILES = 512, 256  # suppliers of which a task makes planes, or files


METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table. Unless the session sets a limit, generated methods are held to what the JVM compiles: sums of groups make larger ones, which it would interpret."""
    ship(spark)
    if spark.conf.get(METHOD_BYTES) == "65535":
        spark.conf.set(METHOD_BYTES, "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, samples: 64 row-major doubles above 0."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 1.0).alias("samples"))


def _drift(*terms: tuple[int, str]) -> Column:
    total = sum((F.col(c) * k for k, c in terms[1:]), F.col(terms[0][1]) * terms[0][0])
    return (total % 101 - 50) / 1000.0


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``framed`` makes frames of: a lineitem's keys and its place in its run. Rows are narrow: whoever reads frames twice keeps these."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", *order, "l_returnflag")
    index = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", index.alias("input_index"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineitem is a frame, one supplier a run, one line number an aperture step."""
    return framed(numbered(spark, sf_dir))


def framed(rows: DataFrame) -> DataFrame:
    """Frames of ``numbered`` rows, one by one."""
    s, o, n, p = (F.col(c) for c in ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))
    base = (
        F.when(s % 4 == 0, 0.0).when(s % 4 == 1, 0.25).when(s % 4 == 2, 0.12).otherwise(F.when(n == 7, -0.1).otherwise(0.35))
    )
    steps = F.array(*[F.lit(x) for x in (2.8, 4.0, 5.6, 8.0, 11.0, 16.0, 22.0)])
    ledge = F.when(s % 10 == 3, 0.01).when(s % 10 == 7, 0.01).otherwise(0.15)
    peak = F.when(s % 8 >= 4, 3).otherwise(5)
    tilted = (s % 7 == 6) & (p % 3 == 0)
    df = rows.select(
        s.cast("long").alias("run_id"),
        "input_index",
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when((s % 13 == 5) & (n == 3), None)
        .when((s % 13 == 7) & (p % 2 == 0), "lens alt")
        .otherwise(F.concat(F.lit("lens "), s.cast("string")))
        .alias("lens_model"),
        (s % 5 + 24).cast("double").alias("focal_length_mm"),
        F.when((s % 17 == 3) & (n == 7), None).otherwise(F.get(steps, F.least(n, F.lit(7)) - 1)).alias("f_number"),
        ((s % 3 != 2) | (F.col("l_returnflag") != "R")).alias("eligible"),
        (base + _drift((31, "l_orderkey"), (17, "l_partkey"), (7, "l_linenumber"))).alias("d_top"),
        (base + _drift((13, "l_orderkey"), (29, "l_partkey"), (5, "l_linenumber"))).alias("d_bot"),
        (F.lit(2.0) - ledge * F.abs(n - peak)).alias("ac_centre"),
        (F.lit(1.6) - F.lit(0.12) * F.abs(n - 5)).alias("ac_corner"),
        F.when((s % 5 == 4) & (p % 97 == 0), 0.1).otherwise(0.2).alias("contrast_tl"),
        (F.lit(1.0) + (o % 7) * F.when(s % 9 == 8, 0.1).otherwise(0.005)).alias("lum_centre"),
        (
            F.lit(-0.1) * (F.lit(8) - n) + ((p * 7 + o) % 11 - 5) / 200.0 - F.when((s % 6 == 5) & (p % 50 == 0), 0.3).otherwise(0.0)
        ).alias("fall"),
        F.when(s % 6 == 1, -0.25).otherwise(0.0).alias("bias_tr"),
        F.when(tilted, "gated").when(p % 41 == 0, "blocked").otherwise("passed").alias("target_status"),
        ((p % 10) / 10.0 + F.when(tilted, 2.0).otherwise(0.0)).alias("keystone_pct"),
    )
    return df


CORNER_NAMES = ("tl", "tr", "bl", "br")


def target_blockers(p: Column) -> Column:
    return F.when(p % 3 == 0, "low_contrast,weak_target_geometry").when(p % 3 == 1, "no_suitable_target_reference").otherwise("line_discontinuous,low_contrast")


def corner_blockers(p: Column, o: Column, k: int) -> Column:
    """What stands against a corner's colour shift, comma-separated; null where nothing does."""
    return (
        F.when(p % 31 == 0, "flat_profile")
        .when((p + 3 * k) % 37 == 0, "correlation_peak_not_found")
        .when((o + k) % 41 == 0, "profile_too_short,low_texture")
        .when((p + o + k) % 43 == 0, "unsupported_colour_channels")
        .when((p + 5 * k) % 29 == 0, "low_texture")
    )


def zone_values(frames: DataFrame) -> DataFrame:
    """Stand-in evidence of frames: adds per-corner acutance (ac_), contrast (co_) and falloff (fa_) columns, colour shifts and bow evidence."""
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    df = frames.select(
        *frames.columns,
        (F.col("ac_corner") + F.col("d_top") / 2).alias("ac_tl"),
        (F.col("ac_corner") - F.col("d_top") / 2).alias("ac_tr"),
        (F.col("ac_corner") + F.col("d_bot") / 2).alias("ac_bl"),
        (F.col("ac_corner") - F.col("d_bot") / 2).alias("ac_br"),
        F.col("contrast_tl").alias("co_tl"),
        *[F.lit(0.2).alias(f"co_{c}") for c in ("tr", "bl", "br", "centre")],
        *[(F.col("fall") + F.col("bias_tr") if c == "tr" else F.col("fall")).alias(f"fa_{c}") for c in CORNER_NAMES],
        *[corner_blockers(p, o, k).alias(f"cb_{c}") for k, c in enumerate(CORNER_NAMES)],
        *[(((p + 7 * k) % 9 - 4) / 4.0).alias(f"cx_{c}") for k, c in enumerate(CORNER_NAMES)],
        *[(((o + 5 * k) % 7 - 3) / 4.0).alias(f"cy_{c}") for k, c in enumerate(CORNER_NAMES)],
        F.when(p % 12 == 3, "no_straight_reference").when(p % 4 == 2, "line_discontinuous").alias("bow_blocker"),
        (p % 4 != 1).alias("bow_measured"),
        (((p + o) % 21 - 10) / 10.0).alias("bow"),
        F.when(F.col("target_status") == "blocked", target_blockers(p)).alias("target_blockers"),
        F.when(p % 2 == 0, "vertical").otherwise("horizontal").alias("target_axis"),
    )
    return df


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and tag values made of document ids."""
    d = F.col("doc_id")
    ends = F.array(*[F.lit(x) for x in (".dng", ".TIF", ".tiff", ".nef", ".jpg", "")])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("frame_"), d.cast("string"), F.get(ends, (d % 6).cast("int"))).alias("path"),
        F.when(d % 4 > 0, d % 4).cast("int").alias("opcodes"),
        F.when(d % 3 == 0, F.lit(" ")).when(d % 3 == 1, F.concat(F.lit(" lens "), (d % 5).cast("string"), F.lit(" "))).alias("exif_lens"),
        F.when(d % 7 == 0, F.concat(F.lit(" body lens "), (d % 2).cast("string"), F.lit("\0rest"))).alias("raw_lens"),
        (d % 9).cast("int").alias("maker_lens_id"),
        F.when(d % 10 == 0, float("inf")).when(d % 10 == 1, float("nan")).otherwise((d % 10) * 1.4).alias("f_value"),
        F.when(d % 4 == 0, (d % 5 + 1) * 100).alias("iso_speed"),
        ((d % 6 + 1) * 50).alias("iso_ratings"),
    )


def suppliers(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """run_id of each supplier, dealt by it to tasks of about ``each``: what is made of a supplier is far larger than its row, and stays in its task."""
    rows = table(spark, sf_dir, "supplier").select(s_key().alias("run_id"))
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // each)), "run_id")


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 96 x 96 plane of dark horizontal courses for each supplier; periods differ by supplier. Rows: run_id, y, samples."""
    s = F.col("run_id")
    p1, p2 = s % 3 * 2 + 10, F.when(s % 4 == 0, s % 3 * 2 + 10).when(s % 4 == 1, s % 3 * 2 + 13).when(s % 4 == 2, s % 3 * 2 + 11).otherwise(60)
    y = F.col("y")
    period = F.when(y < 48, p1).otherwise(p2)
    dark = y % period < 3
    rows = suppliers(spark, sf_dir, PLANES).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(95))))
    value = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda x: F.when(F.col("dark"), 0.05).otherwise(F.lit(0.85) + (x % 3) * 0.01))
    return rows.withColumn("dark", dark).select("run_id", "y", value.alias("samples"))


def bowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 80 x 50 plane with a bowed line for each supplier: its place, sagitta, span and polarity differ. Rows: run_id, y, samples."""
    s = F.col("run_id")
    plane = suppliers(spark, sf_dir, PLANES).select(
        s,
        F.when(s % 5 == 0, 8).when(s % 5 == 1, 40).when(s % 5 == 2, 25).when(s % 5 == 3, 12).otherwise(36).alias("y0"),
        (s % 7 - 3).cast("double").alias("sag"),
        F.when(s % 6 == 5, 30).otherwise(0).alias("from_x"),
        F.when(s % 6 == 5, 44).when(s % 6 == 4, 70).otherwise(80).alias("to_x"),
        (s % 8 == 7).alias("flat"),
        (s % 2 == 0).alias("dark"),
    )
    y = F.col("y")
    rows = plane.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(49))))
    line = F.transform(
        F.sequence(F.lit(0), F.lit(79)),
        lambda x: F.when(
            ~F.col("flat") & (x >= F.col("from_x")) & (x < F.col("to_x"))
            & (F.abs(y - (F.col("y0") + F.lit(4.0) * F.col("sag") * (x / F.lit(79.0)) * (F.lit(1.0) - x / F.lit(79.0)))) <= 1.0),
            F.when(F.col("dark"), 0.05).otherwise(0.85),
        ).otherwise(F.when(F.col("dark"), 0.85).otherwise(0.05)),
    )
    return rows.select(s, "y", line.alias("samples"))


def dimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 80 x 50 plane for each supplier that darkens from a place of its own outwards. Rows: run_id, y, samples."""
    rows = suppliers(spark, sf_dir, PLANES).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(49))))
    s, y = F.col("run_id"), F.col("y")

    def value(x: Column) -> Column:
        away = (x - (s % 11 + 35)) * (x - (s % 11 + 35)) + (y - 25) * (y - 25)
        return F.lit(1.0) - away * (s % 5 + 1) / F.lit(20000.0) + (x % 3) * 0.001

    return rows.select("run_id", "y", F.transform(F.sequence(F.lit(0), F.lit(79)), value).alias("samples"))


def s_key() -> Column:
    return F.col("s_suppkey").cast("long")


PAINTED = ("vignetting", "colour_shift", "bow", "courses")


def few(batches):
    """Batches of 32 rows: of 10,000, files would take more than an Arrow column of bytes holds."""
    for pdf in batches:
        for at in range(0, len(pdf), 32):
            yield pdf.iloc[at : at + 32]



def painted(kind: str, sign: int):
    """A plane of three 16-bit components with known truth."""
    import numpy as np

    if kind == "vignetting":  # corners at half the centre's level
        image = np.full((100, 100), 30000)
        image[43:56, 43:56] = 40000
        for y in (slice(0, 20), slice(80, 100)):
            for x in (slice(0, 20), slice(80, 100)):
                image[y, x] = 20000
        return np.repeat(image[:, :, None], 3, 2)
    if kind == "colour_shift":  # red lies a pixel to the right or to the left of green and blue
        y, x = np.indices((100, 100))
        texture = lambda x: 10000 + (x * 40503 + 977) % 65521 * 24000 // 65521 + y * 60493 % 65521 * 16000 // 65521
        return np.stack([texture(x - sign), texture(x), texture(x)], 2)
    if kind == "bow":  # a dark line near the top, bent by 5 pixels
        y, t = np.indices((70, 100))[0], np.arange(100) / 99
        image = np.where(np.abs(y - (12 + 4 * -5 * sign * t * (1 - t))) <= 1, 2000, 50000)
        return np.repeat(image[:, :, None], 3, 2)
    y, x = np.indices((96, 96))  # dark courses that widen, or don't
    image = np.where(y % np.where(y < 48, 12, 16 if sign > 0 else 12) < 3, 3000, 55000 + x % 3 * 600)
    return np.repeat(image[:, :, None], 3, 2)


def painted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIFF files made of suppliers, four to a run: path, content, run_id, input_index, kind, sign."""
    from stopwise.sources import tiff

    def work(batches):
        for pdf in few(batches):
            yield pdf.assign(content=[tiff.encode(painted(k, s)) for k, s in zip(pdf["kind"], pdf["sign"])])

    s = F.col("run_id")
    kind = F.get(F.array(*[F.lit(k) for k in PAINTED]), (s % 4).cast("int"))
    rows = suppliers(spark, sf_dir, FILES).select(
        F.concat(F.lit("/shots/frame_"), s.cast("string"), F.lit(".tif")).alias("path"), F.floor(s / 4).alias("run_id"), (s % 4).alias("input_index"),
        kind.alias("kind"), F.when(F.floor(s / 4) % 2 == 0, 1).otherwise(-1).alias("sign"),
    )
    return rows.mapInPandas(work, "path string, run_id long, input_index long, kind string, sign int, content binary")


#: Apertures of a painted run (in tenths), and the fine texture of its frames at each.
LADDER = ((40, 10), (56, 10), (80, 10), (110, 10))
TEXTURE = (3000, 5000, 6500, 4000)


def painted_run_frame(kind: int, step: int, repeat: int):
    """A linear colour plane of dark courses under a fine texture, strongest at the third aperture.

    ``kind`` 0 and 2: both sides alike; 1: a third of the texture on the right side; 3: courses that widen downwards.
    """
    import numpy as np

    y, x = np.indices((192, 192))
    courses = np.where(y % np.where((y >= 96) & (kind == 3), 16, 12) < 3, 20000, 40000) + 200 * repeat
    texture = np.where((x >= 128) & (kind == 1), TEXTURE[step] // 3, TEXTURE[step])
    return np.repeat((courses + texture * (np.minimum(x, 191 - x) % 2 * 2 - 1)).astype(np.uint16)[:, :, None], 3, 2)


def painted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight files a supplier, two repeats of four apertures: path, content, run_id, input_index.

    By supplier mod 4: a centred lens, one whose right side is soft, a centred one as TIFF, which says nothing of its lens, and a target that is not square.
    """
    from stopwise.sources import dng, tiff

    def work(batches):
        made = {}
        for pdf in few(batches):
            out = []
            for run, i in zip(pdf["run_id"], pdf["input_index"]):
                kind, step, repeat = run % 4, i // 2, i % 2
                if (kind, step, repeat) not in made:
                    plane = painted_run_frame(kind, step, repeat)
                    made[kind, step, repeat] = tiff.encode(plane) if kind == 2 else dng.encode(plane, lens="bench lens", f_number=LADDER[step], focal=50)
                out.append(made[kind, step, repeat])
            yield pdf.assign(content=out)

    rows = painted_captures(spark, sf_dir).select("path", "run_id", "input_index")
    return rows.mapInPandas(work, "path string, run_id long, input_index long, content binary")


def painted_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, run_id and input_index of ``painted_runs``, without painting."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    end = F.when(F.col("run_id") % 4 == 2, ".tif").otherwise(".dng")
    runs = suppliers(spark, sf_dir, FILES // 8).select("run_id", at.alias("input_index"))
    return runs.withColumn("path", F.concat(F.lit("/shots/"), F.col("run_id").cast("string"), F.lit("/"), F.col("input_index").cast("string"), end))


def written_frames(spark: SparkSession, sf_dir: str) -> str:
    """A file of each document, in a new shared folder, which is returned: a mosaic, a gray or a colour picture whose samples are the text's bytes.

    Files have 16 columns and as many rows as the text needs; metadata go by the document's id.
    """
    import uuid

    from stopwise.deploy import shared_dir

    folder = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"

    def work(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        from stopwise.sources import dng, tiff

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data, parts = (t or "").encode(), 3 if d % 3 == 2 else 1
                rows = max(2, -(-len(data) // (32 * parts)))
                samples = np.frombuffer(data.ljust(rows * 32 * parts, b"\0"), "<u2").reshape(rows, 16, parts)
                if d % 3:
                    content = tiff.encode(samples)
                else:
                    stop = {0: (1, 0), 1: (0, 0)}.get(d % 10, (d % 10 * 14, 10))
                    lens = "" if d % 5 == 0 else f" lens {d % 5} "
                    content = dng.encode(samples[:, :, 0], dng_pattern(d // 3 % 4), d % 3, 60000 + d % 3, lens, stop, 24 + d % 5, (1, d % 7 + 1), 50 * (d % 6 + 1), d % 4)
                with fs.open_output_stream(f"{base}/frame_{d}{('.dng', '.tif', '.TIFF')[d % 3]}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return folder


def dng_pattern(k: int) -> str:
    from stopwise.operators.mosaic import PATTERNS

    return tuple(PATTERNS)[k]
