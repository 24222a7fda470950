"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / quality, u being a hash of its id, so reruns and retried tasks
agree. Within a source documents go by rising key; the prefix sum of their sizes is held
against the token budget that is left once complete epochs have been taken. Main path: DataFrame
functions only.

Scale: sizes are counted once and written to the shared folder. The prefix sum has two levels:
rows are dealt to tasks by ranges of (source, key), whose bounds Spark takes from a sample of the rows, so that parts
are even whatever the qualities are and a source with a third of all rows is spread over many tasks; rows are ordered
only inside (source, part), and the parts' totals supply the offsets. Sources are ranked in the same way, and the level
of the targets is found by aggregations that bring two numbers to the driver each.

Edge cases: a null or wordless text has size 0 and is taken 0 words; a null source is a source of
its own, ranked last; repeated rows count each; a missing, non-positive, infinite or NaN quality counts as
``default_quality``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import stash, table, word_count

#: Weights dealt to sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_key(src: Column) -> Column:
    """Never null, and in the order of sources by code point, null last."""
    return F.when(src.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), src))


def ranged(df: DataFrame, by: list[str], per_task: int, tag: str) -> DataFrame:
    """``df`` in files, dealt to parts by ranges of the columns ``by``; adds ``part``, which rises with them."""
    parts = max(1, -(-df.count() // per_task))
    return stash(df.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), tag)


def targets(totals: DataFrame, share: float, weights: tuple[int, ...], cap: float, per_task: int = 200_000) -> DataFrame:
    """Water-filling over one row per source (``source_key``, ``source_size``): adds weight and target.

    A source's target is level * weight, or ``cap`` times its size where that is less. The level rises
    until no more sources are full; each step is one aggregation.
    """
    rows = ranged(totals, ["source_key"], per_task, "mix-sources")
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a part
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1 + F.col("before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = rows.join(before, "part").withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    rows = stash(rows.select("source_key", "source_size", "weight", "most"), "mix-weights")
    total, level, before = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        full = F.col("most") < F.col("weight") * F.lit(level)
        filled, open_, n = rows.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if open_ is None:  # all are full, or there is none
            return rows.withColumn("target", F.col("most")).drop("most")
        if n == before:  # the level only rises, so that these are the sources that were full before
            return rows.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("most")
        level, before = (share * total - (filled or 0.0)) / open_, n


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    *,
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    cap: float = 2.0,
    default_quality: float = 0.5,
    seed: int = 7,
    per_task: int = 200_000,
) -> DataFrame:
    """One row per document: doc_id, text_key, size, source_size, target, taken, copies.

    ``quality``: (doc_id, quality weight), optional. ``taken`` is the number of words taken, whose
    sum over a source is the integer part of its target; only the document at the boundary is
    taken in part. ``copies`` counts how often a reader that takes whole documents reads it.
    """
    sized = docs.select("doc_id", F.col("source").alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    if quality is not None:
        best = quality.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
        sized = sized.join(best, "doc_id", "left")
    else:
        sized = sized.withColumn("q", F.lit(default_quality))
    q = F.col("q").cast("double")
    q = F.when((q > 0) & (q < float("inf")), q).otherwise(F.lit(default_quality))
    key = -F.log(uniform(seed, F.col("doc_id"), F.col("src"))) / q
    sized = stash(sized.select("doc_id", "text_key", "size", source_key(F.col("src")).alias("source_key"), key.alias("key")), "mix-sized")
    goal = stash(targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), share, weights, cap, per_task), "mix-targets")
    rows = ranged(sized, ["source_key", "key"], per_task, "mix-ranged")
    earlier = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("source_key", "part")
        .agg(F.sum("size").alias("part_size"))
        .withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
        .join(goal, "source_key")
        .select("source_key", "part", "offset", "source_size", "target")
    )
    inside = Window.partitionBy("source_key", "part").orderBy("key", "doc_id", "text_key", "size")
    ranked = rows.withColumn(
        "within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("within")
    return (
        ranked.join(offsets, ["source_key", "part"])
        .withColumn("epochs", epochs)
        .withColumn("fraction", F.greatest(F.lit(0).cast("long"), F.least("size", left)))
        .select(
            "doc_id",
            "text_key",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("fraction")).alias("taken"),
            (F.col("epochs") + (F.col("fraction") > 0).cast("long")).alias("copies"),
        )
    )


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weights from the label table: 1 for good documents, 1/4 for poor ones."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).alias("quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_quality(table(spark, sf_dir, "labels"))).drop("text_key")


ORACLE = r"""
WITH lab AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 END)::DOUBLE AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(q, 0.5::DOUBLE) AS q,
    text
  FROM documents d LEFT JOIN lab USING (doc_id)
), k AS (
  SELECT *, power((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(src, '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE, 1::DOUBLE / q) AS key
  FROM d
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 3::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 2::DOUBLE END AS w
  FROM d GROUP BY src
), l AS (
  SELECT *, 2::DOUBLE * source_size AS most,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2::DOUBLE * source_size) OVER o, 0::DOUBLE))
      / (sum(w) OVER () - coalesce(sum(w) OVER o, 0::DOUBLE)) AS level
  FROM s WINDOW o AS (ORDER BY 2::DOUBLE * source_size / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT src, source_size, least(most, coalesce((SELECT arg_min(level, most / w) FROM l WHERE level * w <= most) * w, most)) AS target FROM l
), r AS (
  SELECT k.*, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY k.src ORDER BY key DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN g ON k.src IS NOT DISTINCT FROM g.src
), p AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before))::BIGINT AS part FROM r
)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, (epochs + (part > 0)::BIGINT)::BIGINT AS copies FROM p
"""
