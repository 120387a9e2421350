"""Files that arrive: the same cell tables and call traces, as streams.

Sheets have no stream of their own; these read a folder's new files once each, and keep
running subtotals with a watermark where cells carry a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans.specs import Query
from tabulon.sources.office import read_cells

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_cells(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """The cells of spreadsheets as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read_cells(files)


def running_totals(events: DataFrame, time: str, by: list[str], value: str, window: str = "1 hour", late: str = "2 hours", query: Query | None = None) -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped, and state with them."""
    from tabulon.operators.query import filtered

    found = filtered(events, query) if query else events
    return found.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def latest_changes(log: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """A change log without repeated changes (same keys and time), within the watermark."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, time])
