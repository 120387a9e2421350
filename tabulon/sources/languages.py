"""Language numbers as a dimension table. Numbers are the public locale identifiers, so the table is Python's own."""

from __future__ import annotations

import locale

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def languages(spark: SparkSession) -> DataFrame:
    """language_id, language, country (ISO codes; an empty country where there is none)."""
    rows = [(k, *(name.split("_")[0], name.split("_")[-1] if "_" in name else "")) for k, name in sorted(locale.windows_locale.items())]
    return spark.createDataFrame(rows, "language_id int, language string, country string")


def with_language(df: DataFrame, column: str = "language_id") -> DataFrame:
    """df with language and country; unknown numbers give null. The dimension has some 200 rows and is broadcast."""
    names = languages(df.sparkSession).withColumnRenamed("language_id", column)
    return df.join(F.broadcast(names), column, "left")
