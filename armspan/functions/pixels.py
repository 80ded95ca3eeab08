"""Feature columns: pixel scaling, flattening and vector assembly."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_pixels(pixels: Column) -> Column:
    """Byte intensities as 32-bit floats in [0, 1]."""
    return F.transform(pixels, lambda v: (v / F.lit(255.0)).cast("float"))


def grid(pixels: Column, width: int, height: int) -> Column:
    """A flat array as ``height`` rows of ``width`` values."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(height - 1)), lambda row: F.slice(pixels, row * width + 1, width)
    )


def pixel_columns(pixels: Column, size: int, prefix: str = "pixel") -> list[Column]:
    """One column per array position: ``pixel0`` to ``pixel{size-1}``."""
    return [F.get(pixels, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]


def flatten_to_columns(images: DataFrame, image_col: str, size: int, *keep: str) -> DataFrame:
    """Two-dimensional images as one wide row each, followed by the ``keep`` columns."""
    flat = images.select(*keep, F.flatten(image_col).alias("_flat"))
    return flat.select(*pixel_columns(F.col("_flat"), size), *keep)


def gather_columns(wide: DataFrame, size: int, *keep: str, prefix: str = "pixel") -> DataFrame:
    """The inverse: wide pixel columns as one ``features`` array."""
    return wide.select(*keep, F.array(*[F.col(f"{prefix}{i}") for i in range(size)]).alias("features"))


def assemble_columns(wide: DataFrame, size: int, prefix: str = "pixel") -> DataFrame:
    """Adds the ``features`` vector of wide pixel columns; a null pixel fails the query."""
    inputs = [f"{prefix}{i}" for i in range(size)]
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(wide)


def assemble_array(tidy: DataFrame, array_col: str) -> DataFrame:
    """Adds the ``features`` vector of an array column; a null entry fails the query."""
    values = F.col(array_col).cast("array<double>")
    has_gap = values.isNull() | F.exists(values, lambda v: v.isNull())
    checked = F.when(has_gap, F.raise_error(F.lit(f"null in feature column {array_col}"))).otherwise(values)
    return tidy.withColumn("features", array_to_vector(checked))
