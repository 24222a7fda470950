"""Exact dedup by 128-bit content hash with byte comparison inside groups.

Main path: DataFrame functions only. Hashes are counted first, 16 bytes a row, and only texts whose hash is met more than
once travel, if a list of those hashes may be broadcast; else all do. They are grouped by (hash, bytes) with map-side combine, so
a group of copies that holds a third of the corpus reaches a reducer as one row for each map
partition, and the grouping itself compares the bytes: two texts with one hash are two groups.
Rows then look up their group by (hash, SHA-256), 48 bytes a row instead of the text.

Edge cases: a null text counts as empty; a null id never beats another id, and a group whose ids
are all null has a null ``keep_id`` and keeps one row; of rows with equal id and equal text one
stays. An empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import BROADCAST_BYTES, ascii_lower, discard, row_bytes, stash, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the smallest or the largest id of a group stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    norm = docs.select(
        F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")
    )
    hashed = norm.withColumn("hash", F.unhex(F.md5("norm")))
    every = stash(hashed.select("doc_id", "hash", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    met = stash(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "exact-hashes")
    if row_bytes(met) <= BROADCAST_BYTES:
        hashed = hashed.join(F.broadcast(met), "hash", "left_semi")
    groups = (
        hashed.groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", "keep_id")
        # Two byte-different texts under one (hash, SHA-256) would make the lookup ambiguous.
        .groupBy("hash", "sha")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("group_size").alias("group_size"),
            F.max("keep_id").alias("keep_id"),
        )
        .withColumn(
            "group_size",
            F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                F.raise_error(F.lit("two texts share both digests")).cast("long")
            ),
        )
        .drop("texts")
    )
    rows = every.groupBy("doc_id", "hash", "sha").agg(F.count(F.lit(1)).alias("times"))
    # Read from files, both sides of the join are plain shuffles, and a large group's rows can be split.
    groups = stash(groups, "exact-groups")
    discard(met)
    return (
        rows.join(groups, ["hash", "sha"], "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), r AS (
  SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS nth
  FROM n
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
