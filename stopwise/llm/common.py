"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import hadoop_path, shared_dir, ship

#: A word is a run of bytes other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, tag: str, packed: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs tasks, not the table, and what has been computed
    once (a tokenised corpus, fingerprints) is read by later jobs instead of being computed anew.
    The shuffle files of the write are freed as it ends. ``packed``: a compression other than the session's.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if before == "false":
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=packed)
    finally:
        if before == "false":
            spark.conf.set(CLEANUP, "false")
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete tables of ``stash`` that nothing reads any more."""
    for df in stashed:
        fs, path = hadoop_path(df.sparkSession, df._stashed)
        fs.delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a fast path for pure ASCII, where it does the same; other texts take ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Tables whose rows take no more than this in memory may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def row_bytes(stored: DataFrame) -> int:
    """Bytes that all rows take in memory: a word for each field, and what strings, binaries and arrays of words hold."""
    width = F.lit(8 + 16 * len(stored.columns)).cast("long")
    for f in stored.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif kind == "array":
            width += 8 * F.coalesce(F.size(F.col(f.name)), F.lit(0))
    return stored.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def checked_broadcast(stored: DataFrame) -> DataFrame:
    """``stored`` (a table in files) with a broadcast hint if the size of its rows allows that."""
    return F.broadcast(stored) if row_bytes(stored) <= BROADCAST_BYTES else stored


#: Of items of one key that a task holds.
BLOCK_BYTES = 32 << 20


def split_crowded(
    keyed: DataFrame, sample: DataFrame, item: str, block: int, share: int
) -> list[DataFrame]:
    """Cut groups of (key, item) rows that are too large for one task.

    ``sample`` holds the rows of one item in ``share``. Keys that it shows to have more than ``block``
    items, or where it has a column ``bytes`` more than BLOCK_BYTES of them, are cut into parts of about that many,
    and every two parts meet under a key of their own; every two items of a key still meet somewhere. The list's
    frames have the columns of ``keyed``.
    """
    load = F.count(F.lit(1)) / block
    if "bytes" in sample.columns:
        load = F.greatest(load, F.sum("bytes") / BLOCK_BYTES)
    crowded = stash(
        sample.groupBy("key").agg((load * share).alias("load")).where("load > 1").select("key", F.ceil("load").cast("int").alias("parts")),
        "crowded",
    )
    if crowded.isEmpty():
        return [keyed]
    hot = (
        keyed.join(crowded, "key")
        .withColumn("mine", F.pmod(F.xxhash64(item, F.lit(1)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    )
    return [keyed.join(crowded, "key", "left_anti"), hot.select(*keyed.columns)]
