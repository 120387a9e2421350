"""Matrices as cells (i, j, v) or (row, col, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a: i, k, v; b: k, j, v. A join on the inner index and a sum that is combined map-side."""
    left, right = a.select("i", "k", F.col("v").alias("__a")), b.select("k", "j", F.col("v").alias("__b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def transpose(cells: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    rest = [c for c in cells.columns if c not in (row, col)]
    return cells.select(F.col(col).alias(row), F.col(row).alias(col), *rest)


def unit(spark: SparkSession, n: int) -> DataFrame:
    """The unit matrix's ones; other cells are zero."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def value(matrix: DataFrame, i: int, j: int) -> DataFrame:
    return matrix.filter((F.col("i") == i) & (F.col("j") == j)).select("v")


def square(rows: Column) -> Column:
    """Rows of a matrix (struct(i, values)) in order, as an array of arrays: a sheet's matrix, at most 256 wide."""
    return F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["values"])


@F.pandas_udf(DoubleType())
def determinant(matrices: pd.Series) -> pd.Series:
    """Of arrays of arrays; null unless square."""
    return pd.Series([_square(m, np.linalg.det) for m in matrices], dtype=object).astype(float)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def inverse(matrices: pd.Series) -> pd.Series:
    """Null if there is none."""
    return pd.Series([_square(m, lambda x: np.linalg.inv(x).tolist()) for m in matrices], dtype=object)


def _square(matrix, function):
    if matrix is None:
        return None
    full = np.array([list(r) for r in matrix], float)
    if full.ndim != 2 or full.shape[0] != full.shape[1]:
        return None
    try:
        return function(full)
    except np.linalg.LinAlgError:
        return None
