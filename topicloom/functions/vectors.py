"""Vector algebra on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(doubles(a), lambda x: x / length)).otherwise(doubles(a))


def mean_vectors(df: DataFrame, by: list[str], vec: str, out: str) -> DataFrame:
    """Mean vector of each group (of all rows without ``by``); sums are combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = df.select(*by, array_to_vector(doubles(F.col(vec))).alias("_v"))
    return own.groupBy(*by).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*by, vector_to_array("_m").alias(out))


def frobenius_norm(df: DataFrame, vec: str) -> DataFrame:
    """One row: the norm of all vectors as one matrix."""
    return df.agg(F.sqrt(F.sum(dot(F.col(vec), F.col(vec)))).alias("norm"))
