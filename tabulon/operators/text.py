"""Text documents as tables: statistics, list numbers, pages, fields, attributes, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numbering import list_label


def statistics(df: DataFrame, text: str = "text", ids: list[str] | None = None) -> DataFrame:
    """Paragraphs (lines), words (runs without white space) and characters of each text; with ids [] the sums."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = {"paragraphs": F.when(body == "", 0).otherwise(F.regexp_count(body, F.lit("\n")) + 1), "words": F.regexp_count(body, F.lit("[^ \\t\\n\\r]+")), "chars": F.char_length(body)}
    if ids:
        return df.select(*ids, *(v.cast("long").alias(k) for k, v in own.items()))
    return df.agg(*(F.sum(v.cast("long")).alias(k) for k, v in own.items()))


def numbered(paragraphs: DataFrame, by: list[str], order: str, level: str, start: str | None = None, restart: Column | None = None, levels: int = 10) -> DataFrame:
    """List numbers: label_numbers is the array of counters down to the paragraph's level. A counter starts anew below each higher level's paragraph, and where restart holds.

    One window per level, all over the same partitioning and order, so there is one sort."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out, counters = paragraphs, []
    begin = F.coalesce(F.col(start), F.lit(1)) if start else F.lit(1)
    again = F.coalesce(restart, F.lit(False)) if restart is not None else F.lit(False)
    for k in range(levels):
        # A block of level k: since the last paragraph of a higher level, or the last restart.
        block = F.sum(((F.col(level) < k) | (F.col(level) == k) & again).cast("int")).over(window)
        out = out.withColumn(f"__b{k}", block)
    for k in range(levels):
        inner = Window.partitionBy(*by, f"__b{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        first = F.first(F.when(F.col(level) == k, begin), True).over(inner)
        count = F.sum((F.col(level) == k).cast("int")).over(inner)
        out = out.withColumn(f"__n{k}", F.coalesce(F.greatest(first + count - 1, F.lit(0)), F.lit(0)))
        counters.append(F.col(f"__n{k}"))
    out = out.withColumn("label_numbers", F.slice(F.array(*counters), F.lit(1), F.col(level) + 1))
    return out.drop(*(f"__b{k}" for k in range(levels)), *(f"__n{k}" for k in range(levels)))


def label(numbers: Column, kinds: list[str], separator: str = ".") -> Column:
    """The text of a list number, each level in its kind."""
    parts = [F.when(F.size(numbers) > k, list_label(F.get(numbers, F.lit(k)), kind)) for k, kind in enumerate(kinds)]
    return F.array_join(F.array_compact(F.array(*parts)), separator)


def paged(paragraphs: DataFrame, by: list[str], order: str, breaks: Column) -> DataFrame:
    """page: one more at each paragraph with a break, from 1."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("page", F.sum(breaks.cast("int")).over(window) + 1)


def attributed(texts: DataFrame, ranges: DataFrame, ids: list[str]) -> DataFrame:
    """Text cut where attributes begin or end: ids, begin, end, attributes. ranges: ids, begin, end (-1: a point), attribute; offsets from 0, end excluded.

    Boundaries are cut once, and each piece gets the attributes that were opened and not closed, by running sums per attribute: nothing is compared pair by pair."""
    real = ranges.filter(F.col("end") > F.col("begin"))
    edges = real.select(*ids, F.explode(F.array("begin", "end")).alias("at")).unionByName(texts.select(*ids, F.explode(F.array(F.lit(0), F.char_length("text"))).alias("at"))).distinct()
    window = Window.partitionBy(*ids).orderBy("at")
    pieces = edges.withColumn("end", F.lead("at").over(window)).filter("end is not null").withColumnRenamed("at", "begin")
    changes = real.select(*ids, "attribute", F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("c")).groupBy(*ids, "attribute", F.col("c.at").alias("at")).agg(F.sum("c.d").alias("d"))
    running = Window.partitionBy(*ids, "attribute").orderBy("at")
    spans = changes.withColumns({"open": F.sum("d").over(running.rowsBetween(Window.unboundedPreceding, 0)), "upto": F.lead("at").over(running)}).filter("open > 0 and upto > at")
    # Each open span covers whole pieces: deal it to the pieces that begin in it.
    numbered = pieces.withColumn("k", F.row_number().over(Window.partitionBy(*ids).orderBy("begin")))
    ends = numbered.select(*ids, F.col("begin").alias("at"), F.col("k").alias("k0"))
    stops = numbered.select(*ids, F.col("end").alias("upto"), F.col("k").alias("k1"))
    covered = spans.join(ends, [*ids, "at"]).join(stops, [*ids, "upto"]).select(*ids, "attribute", F.explode(F.sequence("k0", "k1")).alias("k"))
    listed = covered.groupBy(*ids, "k").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))  # at most as many as there are attributes
    return numbered.join(listed, [*ids, "k"], "left").select(*ids, "begin", "end", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))


def outline(paragraphs: DataFrame, level: str, order: list[str], most: int = 10) -> DataFrame:
    """A table of contents: headings (level 0 and more) up to a depth."""
    return paragraphs.filter(F.col(level).between(0, most - 1)).orderBy(*order)


def index_entries(marks: DataFrame, key: str, page: str) -> DataFrame:
    """An alphabetical index: each key's pages, least first. A key's pages are distinct page numbers."""
    return marks.groupBy(key).agg(F.array_sort(F.collect_set(page)).alias("pages"))


# Fields.


def chapter(paragraphs: DataFrame, by: list[str], order: str, heading: Column, name: str = "chapter") -> DataFrame:
    """The last heading up to each paragraph."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn(name, F.last(heading, True).over(window))


def variable(paragraphs: DataFrame, by: list[str], order: str, value: Column, name: str = "value") -> DataFrame:
    """A variable as it reads at each paragraph: the last value set before or there."""
    return chapter(paragraphs, by, order, value, name)


def sequence(paragraphs: DataFrame, by: list[str], order: str, marks: Column, name: str = "sequence") -> DataFrame:
    """A sequence field: the number of marked paragraphs so far."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn(name, F.sum(marks.cast("int")).over(window))


def hidden_text(condition: Column, text: Column) -> Column:
    """A conditional field: its text is split on the first bar; the first part where the condition holds."""
    at = F.instr(text, "|")
    yes = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    no = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))
    return F.when(F.coalesce(condition, F.lit(False)), yes).otherwise(no)


def visible(paragraphs: DataFrame, hidden: Column) -> DataFrame:
    return paragraphs.filter(~F.coalesce(hidden, F.lit(False)))


def referred(references: DataFrame, marks: DataFrame, key: str = "mark") -> DataFrame:
    """References with the text of the mark they name."""
    return references.join(marks.select(key, F.col("text").alias("target_text")), key, "left")


# Field kinds by number.
FIELD_KINDS = (
    "db user filename dbName inDate40 inTime40 pageNumber author chapter docStat getExp setExp getRef hiddenText postIt fixDate fixTime reg varReg setRef "
    "input macro dde tbl hiddenPara docInfo templName dbNextSet dbNumSet dbSetNumber extUser pageSet pageGet INet jumpEdit script dateTime authority combinedChar dropDown"
).split()
#: Kinds that never give text.
SILENT = frozenset("reg varReg setRef macro dde dbNextSet dbSetNumber pageSet pageGet script authority combinedChar dropDown".split())


def expanded(fields: DataFrame) -> DataFrame:
    """Fields (kind, value, condition, page, offset, chapter, record map, meta map) with their text. A kind that gives none has null."""
    c = F.col
    meta = lambda k: F.element_at(c("meta"), F.lit(k))
    texts = {
        "db": F.element_at(c("record"), c("value")), "user": c("value"), "filename": F.regexp_extract(c("value"), "([^/]*)$", 1), "dbName": c("value"), "inDate40": F.current_date().cast("string"),
        "inTime40": F.date_format(F.current_timestamp(), "HH:mm:ss"), "pageNumber": (c("page") + F.coalesce(c("offset"), F.lit(0))).cast("string"), "author": meta("meta:initial-creator"), "chapter": c("chapter"),
        "docStat": meta("statistic"), "getExp": c("value"), "setExp": c("value"), "getRef": c("value"), "hiddenText": hidden_text(c("condition"), c("value")), "postIt": c("value"), "fixDate": c("value"), "fixTime": c("value"),
        "input": c("value"), "tbl": c("value"), "hiddenPara": F.lit(""), "docInfo": F.element_at(c("meta"), c("value")), "templName": c("value"), "dbNumSet": F.lit(""), "extUser": F.element_at(c("record"), c("value")), "INet": c("value"),
        "jumpEdit": c("value"), "dateTime": c("value"),
    }
    out = F.lit(None).cast("string")
    for kind, text in texts.items():
        out = F.when(c("kind") == kind, text).otherwise(out)
    return fields.withColumn("text", out)
