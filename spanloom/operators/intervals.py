"""Half-open intervals [start, end): islands, gaps, edit lists, overlap and nearest neighbours.

Islands and gaps take one shuffle by key and a running maximum; overlaps become equality joins
on the grid cells that an interval touches, so no pair is compared that does not share a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clamp(df: DataFrame, low: int | None = None, high: int | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals cut to [low, high]; what is empty then goes."""
    a, b = F.col(start), F.col(end)
    if low is not None:
        a = F.greatest(a, F.lit(low))
    if high is not None:
        b = F.least(b, F.lit(high))
    return df.withColumn(start, a).withColumn(end, b).where(F.col(end) > F.col(start))


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", slack: Column | float = 0, order: list[str] | None = None) -> DataFrame:
    """df with `island`, the running number of merged intervals in each key: touching ones merge, as do
    those that begin at most `slack` after the furthest end so far."""
    line = Window.partitionBy(*keys).orderBy(start, end, *(order or []))
    before = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + slack), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge(df: DataFrame, keys: list[str], low: int | None = None, high: int | None = None, slack: float = 0) -> DataFrame:
    """keys, start, end of the merged intervals of each key. The second aggregate needs no shuffle."""
    rows = islands(clamp(df.select(*keys, "start", "end"), low, high), keys, slack=slack)
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(merged: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """keys, start, end of what merged intervals leave of [low, high]; only keys that occur in merged."""
    rows = clamp(merged, low, high)
    line = Window.partitionBy(*keys).orderBy("start")
    gaps = rows.select(*keys, F.coalesce(F.lag("end").over(line), F.lit(low)).alias("gap_start"), F.col("start").alias("gap_end"), "end", F.lead("start").over(line).isNull().alias("_last"))
    tail = F.when(F.col("_last"), F.struct(F.col("end").alias("start"), F.lit(high).cast("long").alias("end")))
    both = gaps.select(*keys, F.explode(F.array_compact(F.array(F.struct(F.col("gap_start").alias("start"), F.col("gap_end").alias("end")), tail))).alias("g"))
    return both.select(*keys, F.col("g.start").cast("long").alias("start"), F.col("g.end").cast("long").alias("end")).where("end > start")


def edited_length(kept: DataFrame, keys: list[str], fade: int) -> DataFrame:
    """keys, pieces, kept_length (after crossfades), kept_raw: kept ranges joined in order.

    Each join overlaps by the least of `fade`, what has been joined so far and the next piece.
    """
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: x["end"] - x["start"])
    rows = kept.groupBy(*keys).agg(lengths.alias("_l"))
    first = F.element_at("_l", 1)
    joined = F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), first, lambda acc, x: acc + x - F.least(F.lit(fade).cast("long"), acc, x))
    return rows.select(*keys, F.size("_l").cast("long").alias("pieces"), joined.alias("kept_length"), F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x).alias("kept_raw"))


def cells(df: DataFrame, width: int, start: Column, end: Column, name: str = "_cell") -> DataFrame:
    """A row for each grid cell that [start, end] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], width: int, strict: bool = True) -> DataFrame:
    """Pairs of left (l_start, l_end) and right (r_start, r_end) rows that overlap, with equal `on`.

    strict: r_end > l_start and r_start < l_end; otherwise both sides inclusive. A pair that
    shares several cells is kept in the later of its first cells only, so no distinct is needed.
    """
    last = 1 if strict else 0
    a = cells(left, width, F.col("l_start"), F.greatest(F.col("l_end") - last, F.col("l_start")))
    b = cells(right, width, F.col("r_start"), F.greatest(F.col("r_end") - last, F.col("r_start"))).withColumnRenamed("_cell", "_rcell")
    b = b.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in b.columns])
    match = F.col("_cell") == F.col("_rcell")
    for c in on:
        match = match & (F.col(c) == F.col(f"_r_{c}"))
    fits = (F.col("r_end") > F.col("l_start")) & (F.col("r_start") < F.col("l_end")) if strict else (F.col("r_end") >= F.col("l_start")) & (F.col("r_start") <= F.col("l_end"))
    first = F.greatest(F.floor(F.col("l_start") / width), F.floor(F.col("r_start") / width))
    return a.join(b, match & fits & (F.col("_cell") == first)).drop("_cell", "_rcell", *[f"_r_{c}" for c in on])


def guards(spans: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """spans with left_guard, the latest end before each, and right_guard, the earliest start after it.

    Both are null where they cross.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    left = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(start).over(line.rowsBetween(1, Window.unboundedFollowing))
    rows = spans.withColumn("_left", left).withColumn("_right", right)
    crossed = F.coalesce(F.col("_right") <= F.col("_left"), F.lit(False))
    return rows.withColumn("left_guard", F.when(~crossed, F.col("_left"))).withColumn("right_guard", F.when(~crossed, F.col("_right"))).drop("_left", "_right")
