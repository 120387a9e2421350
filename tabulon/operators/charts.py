"""Charts as tables: the data matrix in long form, series, and the statistics a chart can show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of series and axes.
SERIES_KINDS = ("area", "bar", "bubble", "circle", "column", "gantt", "line", "radar", "ring", "scatter", "stock", "surface")
AXIS_KINDS = ("none", "numeric", "logarithmic", "sequence", "sequence-skip-empty")


def chart_data(cells: DataFrame, by: list[str], first_row_titles: bool = True, first_column_titles: bool = True) -> DataFrame:
    """Cells (row, col, value, text) of a chart's range in long form: by, series, category, ord, value. Columns are series.

    Titles are the range's first row and column where it has them, else numbers from 1."""
    ends = cells.groupBy(*by).agg(F.min("row").alias("__r"), F.min("col").alias("__c"))
    placed = cells.join(ends, by).withColumns({"__i": F.col("row") - F.col("__r") - int(first_row_titles), "__j": F.col("col") - F.col("__c") - int(first_column_titles)})
    body = placed.filter("__i >= 0 and __j >= 0").select(*by, "__i", "__j", "value")
    number = lambda c: (F.col(c) + 1).cast("string")
    out = body
    if first_row_titles:
        out = out.join(placed.filter("__i = -1 and __j >= 0").select(*by, "__j", F.col("text").alias("series")), [*by, "__j"], "left")
    if first_column_titles:
        out = out.join(placed.filter("__j = -1 and __i >= 0").select(*by, "__i", F.col("text").alias("category")), [*by, "__i"], "left")
    series = F.coalesce("series", number("__j")) if first_row_titles else number("__j")
    category = F.coalesce("category", number("__i")) if first_column_titles else number("__i")
    return out.select(*by, series.alias("series"), category.alias("category"), F.col("__i").alias("ord"), "value")


def on_axis(data: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """data with position: where a value stands along its category axis. Logarithmic positions of values not above zero are null."""
    if kind not in AXIS_KINDS:
        raise ValueError(f"no axis kind {kind}")
    window = Window.partitionBy(*by).orderBy("ord")
    place = {
        "none": F.lit(None).cast("double"), "numeric": F.col("category").try_cast("double"), "sequence": (F.col("ord") + 1).cast("double"),
        "logarithmic": F.when(F.col("category").try_cast("double") > 0, F.log10(F.col("category").try_cast("double"))), "sequence-skip-empty": F.sum(F.col("value").isNotNull().cast("int")).over(window).cast("double"),
    }
    out = data.withColumn("position", place[kind])
    return out.filter("value is not null") if kind == "sequence-skip-empty" else out


def stacked(data: DataFrame, by: list[str], series_order: str = "series", percent: bool = False) -> DataFrame:
    """data with low and high: where a series' value begins and ends in a stack (in percent of the category's sum)."""
    group = Window.partitionBy(*by, "ord")
    up = group.orderBy(series_order).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.lit(100.0) / F.nullif(F.sum(F.abs("value")).over(group), F.lit(0.0)) if percent else F.lit(1.0)
    high = F.sum("value").over(up) * scale
    return data.withColumns({"low": high - F.col("value") * scale, "high": high})


def statistics(data: DataFrame, by: list[str], error: str = "stdev", amount: float = 0.0) -> DataFrame:
    """Per series: n, mean, low and high of the error bar, and the line of best fit over the order.

    error: stdev, variance, percent (of the mean), margin (percent of the largest value) or constant."""
    spread = {"stdev": F.stddev_pop("value"), "variance": F.var_pop("value"), "percent": F.abs(F.avg("value")) * amount / 100, "margin": F.abs(F.max("value")) * amount / 100, "constant": F.lit(float(amount))}[error]
    x = F.col("ord") + 1.0
    made = data.groupBy(*by, "series").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), spread.alias("__e"), F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept"), F.regr_r2("value", x).alias("r2"))
    return made.withColumns({"low": F.col("mean") - F.col("__e"), "high": F.col("mean") + F.col("__e")}).drop("__e")


def fitted(kind: str, y: Column, x: Column, over: Window) -> Column:
    """A regression curve's value at each row: linear, logarithmic, exponential or power."""
    line = lambda a, b: F.regr_intercept(a, b).over(over) + F.regr_slope(a, b).over(over) * b
    made = {"linear": lambda: line(y, x), "logarithmic": lambda: line(y, F.ln(x)), "exponential": lambda: F.exp(line(F.ln(y), x)), "power": lambda: F.exp(line(F.ln(y), F.ln(x)))}
    return made[kind]()
