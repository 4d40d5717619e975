"""Marked-up paragraphs: runs, highlights, anchors and rendered transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.text import anchor_ms, context, normalized
from spanloom.operators.intervals import islands


def highlights(runs: DataFrame, keys: list[str], marked: Column) -> DataFrame:
    """keys, start, end, text: touching marked runs (run, text) of a paragraph as character ranges."""
    line = Window.partitionBy(*keys).orderBy("run")
    end = F.sum(F.length("text")).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    placed = runs.withColumn("end", end).withColumn("start", F.col("end") - F.length("text")).where(marked & (F.length("text") > 0))
    merged = islands(placed, keys, order=["run"])
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "")
    return merged.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("text")).drop("island")


def with_context(marks: DataFrame, paragraphs: DataFrame, keys: list[str], width: int = 12) -> DataFrame:
    """marks (keys, start, end) with the characters before and after them in paragraphs (keys, body)."""
    before, after = context(F.col("body"), F.col("start"), F.col("end"), width)
    return marks.join(paragraphs, keys).withColumn("before", before).withColumn("after", after).drop("body")


def split_alignable(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks that hold text to align, and those that are punctuation only."""
    full = F.length(normalized(F.col("text"))) > 0
    return marks.where(full), marks.where(~full)


def anchored(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, paragraph (from 0), anchor_ms, body: lines grouped under the last anchor before them."""
    line = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_ms", anchor_ms(F.col("text")))
    rows = rows.withColumn("paragraph", F.sum(F.col("_ms").isNotNull().cast("long")).over(line) - 1).withColumn("_at", F.last("_ms", ignorenulls=True).over(line))
    body = rows.where("_ms IS NULL AND paragraph >= 0").where(F.trim("text") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n")
    return body.groupBy(*keys, "paragraph").agg(F.first("_at").alias("anchor_ms"), text.alias("body"))


def base_offsets(paragraphs: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """paragraphs with base, the normalised length of all paragraphs before."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("base", F.coalesce(F.sum(F.length(normalized(F.col(text)))).over(before), F.lit(0)).cast("long"))


def transcript(tokens: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """keys, text: tokens (token, text, segment) in order, with a line and a label at each segment's start."""
    first = F.lag("segment").over(Window.partitionBy(*keys).orderBy("token"))
    new = first.isNull() | (first != F.col("segment"))
    part = F.when(new, F.concat(F.when(first.isNull(), F.lit("")).otherwise(F.lit("\n")), F.lit("["), label, F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    rows = tokens.withColumn("_part", part)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", "_part"))), lambda x: x["_part"]), "").alias("text"))


def rolled_up(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, highlights, characters: how many marks (start, end) there are and how long they are in all."""
    return marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("highlights"), F.sum(F.col("end") - F.col("start")).cast("long").alias("characters"))


#: Fixed value of the report: why a mark was skipped.
PUNCTUATION = "punctuation_only_highlight"


def skipped_report(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, index (the place among all marks of the paragraph, from 0), start, end, text, reason: marks that hold nothing to align.

    A blank mark is an error of the document: reason blank_highlight.
    """
    line = Window.partitionBy(*keys).orderBy("start", "end")
    rows = marks.withColumn("index", (F.row_number().over(line) - 1).cast("long"))
    blank = F.length(F.regexp_replace("text", r"\s", "")) == 0
    rows = rows.where(F.length(normalized(F.col("text"))) == 0)
    return rows.select(*keys, "index", "start", "end", "text", F.when(blank, F.lit("blank_highlight")).otherwise(F.lit(PUNCTUATION)).alias("reason"))


def shifted(marks: DataFrame, bodies: DataFrame, keys: list[str], order: str) -> DataFrame:
    """marks (keys, order, start, end) moved to the text of the paragraph that bodies (keys, order, text), joined by line feeds, make."""
    line = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = bodies.select(*keys, order, F.coalesce(F.sum(F.length("text") + 1).over(line), F.lit(0)).cast("long").alias("_base"))
    return marks.join(base, [*keys, order]).withColumns({"start": F.col("start") + F.col("_base"), "end": F.col("end") + F.col("_base")}).drop("_base")


def token_offsets(tokens: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """tokens (token, text, segment) with from and to: where their text stands in what :func:`transcript` renders."""
    line = Window.partitionBy(*keys).orderBy("token")
    first = F.lag("segment").over(line)
    lead = F.when(first.isNull() | (first != F.col("segment")), F.length(label) + 3 + F.when(first.isNull(), 0).otherwise(1)).otherwise(0)
    end = F.sum(F.col("_lead") + F.length("text")).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    rows = tokens.withColumn("_lead", lead).withColumn("to", end)
    return rows.withColumn("from", F.col("to") - F.length("text")).drop("_lead")
