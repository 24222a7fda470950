"""Acutance, contrast and median luminance of patches (row-major ``samples`` of a given width)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.arrays import blur_columns, blur_rows, mean, variance

# Fixed values.
FINE, COARSE = 1.0, 2.5
LEAST_SIGNAL = 1e-6
TEXTURED = 0.15


def blurs(patches: DataFrame, width: int) -> DataFrame:
    """Adds fine and coarse: separable blurs with zero padding, columns first."""
    down = patches.withColumn("_fine", blur_columns(F.col("samples"), width, FINE)).withColumn(
        "_coarse", blur_columns(F.col("samples"), width, COARSE)
    )
    return (
        down.withColumn("fine", blur_rows(F.col("_fine"), width, FINE))
        .withColumn("coarse", blur_rows(F.col("_coarse"), width, COARSE))
        .drop("_fine", "_coarse")
    )


def median(values: Column) -> Column:
    """Of a sorted array."""
    n = F.size(values)
    return (F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))) / 2.0


def spread(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the population deviation of an array column."""
    return (
        df.withColumn("_mean", mean(F.col(column)))
        .withColumn(name, F.sqrt(variance(F.col(column), F.col("_mean"))))
        .drop("_mean")
    )


def patch_metrics(patches: DataFrame, width: int) -> DataFrame:
    """Adds acutance, contrast, luminance. A median that is not positive raises."""
    df = blurs(patches, width)
    df = df.withColumn("detail", F.zip_with("samples", "fine", lambda a, b: a - b)).withColumn(
        "middle", F.zip_with("fine", "coarse", lambda a, b: a - b)
    )
    df = spread(spread(spread(df, "samples", "sd"), "detail", "sd_detail"), "middle", "sd_middle")
    df = df.withColumn("level", mean(F.col("samples"))).withColumn("luminance", median(F.array_sort("samples")))
    flat = (F.col("sd") <= LEAST_SIGNAL) | (F.col("sd_middle") <= LEAST_SIGNAL)
    return (
        df.withColumn("acutance", F.when(flat, 0.0).otherwise(F.col("sd_detail") / F.when(flat, 1.0).otherwise(F.col("sd_middle"))))
        .withColumn("contrast", F.when(F.col("level") <= 0, 0.0).otherwise(F.col("sd") / F.when(F.col("level") <= 0, 1.0).otherwise(F.col("level"))))
        .withColumn(
            "luminance",
            F.when(F.col("luminance") > 0, F.col("luminance")).otherwise(F.raise_error(F.lit("median luminance is not positive")).cast("double")),
        )
        .drop("fine", "coarse", "detail", "middle", "sd", "sd_detail", "sd_middle", "level")
    )
