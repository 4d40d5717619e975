"""Projects as rows: gates, edits, history, checks of records, and change detection of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.intervals import overlaps


#: Fixed value of the stored format: why an annotation of older form needs review.
LEGACY = "legacy_boundary_precision_unknown"


def export_gate(candidates: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, open, changed, ready: ready when nothing awaits review and every source has its old digest.

    sources: keys, sha256, stored_sha256 and, for audio, shape and stored_shape.
    """
    waiting = candidates.groupBy(*keys).agg(F.count_if(F.col("status") == "needs_review").alias("open"))
    odd = F.count_if(~F.col("sha256").eqNullSafe(F.col("stored_sha256")) | ~F.col("shape").eqNullSafe(F.col("stored_shape")))
    rows = waiting.join(sources.groupBy(*keys).agg(odd.alias("changed")), keys, "full").na.fill(0, ["open", "changed"])
    return rows.withColumn("ready", (F.col("open") == 0) & (F.col("changed") == 0))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: files that were added, removed, or have another size, time or digest. Both: path, size, modified, sha256."""
    b = before.select("path", F.struct("size", "modified", "sha256").alias("_b"))
    rows = b.join(after.select("path", F.struct("size", "modified", "sha256").alias("_a")), "path", "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")


def file_stamps(spark, path: str) -> DataFrame:
    """path, size, modified, sha256 of the files at a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def history(events: DataFrame, keys: list[str], order: str, most: int = 100) -> DataFrame:
    """The last `most` events of each key, which is what can be undone."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return events.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def without(annotations: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return annotations.join(removed, keys, "left_anti")


def confirmed(annotations: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """annotations whose boundary was reviewed need no review; their reasons go."""
    rows = annotations.join(reviews.select(*keys, F.lit(True).alias("_seen")).distinct(), keys, "left")
    seen = F.coalesce("_seen", F.lit(False))
    return rows.withColumn("review_required", F.col("review_required") & ~seen).withColumn("review_reasons", F.when(seen, F.array().cast("array<string>")).otherwise(F.col("review_reasons"))).drop("_seen")


def widened(annotations: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """annotations (keys, id, start, end) after edits (keys, id, start, end, wave_start, wave_end): one delete mark for each edit.

    An edit takes in the annotations that its recognised range [start, end] touches, ends inclusive,
    and keeps the first one's id; the bounds drawn in the waveform, where there are any, stand for
    its own. Annotations that no edit touches stay. Ranges meet in cells, not all with all.
    """
    width = 1 << 16
    left = edits.select(*keys, F.col("id").alias("_edit"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = annotations.select(*keys, F.col("id").alias("_old"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = overlaps(left, right, keys, width, strict=False)
    taken = met.groupBy(*keys, "_edit").agg(F.min_by("_old", F.struct("r_start", "r_end", "_old")).alias("_first"), F.min("r_start").alias("_s"), F.max("r_end").alias("_e"))
    rows = edits.withColumnRenamed("id", "_edit").join(taken, [*keys, "_edit"], "left")
    drawn = F.coalesce(F.col("wave_end") > F.col("wave_start"), F.lit(False))
    start, end = F.when(drawn, F.col("wave_start")).otherwise(F.col("start")), F.when(drawn, F.col("wave_end")).otherwise(F.col("end"))
    new = rows.select(*keys, F.coalesce("_first", "_edit").alias("id"), F.least(start, F.col("_s")).alias("start"), F.greatest(end, F.col("_e")).alias("end"))
    rest = annotations.join(met.select(*keys, F.col("_old").alias("id")).distinct(), [*keys, "id"], "left_anti").select(*keys, "id", "start", "end")
    return rest.unionByName(new)


def with_preview(intervals: DataFrame, preview: DataFrame, keys: list[str]) -> DataFrame:
    """intervals and the previewed ones that are not among them."""
    return intervals.unionByName(preview.join(intervals, [*keys, "start", "end"], "left_anti").select(*intervals.columns))


def with_defaults(records: DataFrame) -> DataFrame:
    """Stored annotations of older form: without a review flag they need review, for a reason of their own."""
    old = F.col("review_required").isNull()
    reasons = F.when(old, F.array(F.lit(LEGACY))).otherwise(F.coalesce("review_reasons", F.array().cast("array<string>")))
    return records.withColumn("review_reasons", reasons).withColumn("review_required", F.coalesce("review_required", F.lit(True)))


def not_monotone(spans: DataFrame, keys: list[str], order: list[str], slack: float) -> DataFrame:
    """Spans whose start or end lies more than slack before what went before."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_s", F.max("start").over(line)).withColumn("_e", F.max("end").over(line)).where((F.col("start") < F.col("_s") - slack) | (F.col("end") < F.col("_e") - slack)).drop("_s", "_e")


def beyond_duration(paragraphs: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Keys whose last anchor lies behind the end of the audio."""
    last = paragraphs.groupBy(key).agg(F.max("anchor_ms").alias("last_anchor_ms"))
    return last.join(durations, key).where(F.col("last_anchor_ms") > F.col("duration_ms"))


def line_numbers(characters: DataFrame, keys: list[str]) -> DataFrame:
    """characters (keys, pos, letter) with segment, the number of line feeds before each."""
    line = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return characters.withColumn("segment", F.coalesce(F.sum((F.col("letter") == "\n").cast("long")).over(line), F.lit(0).cast("long")))


def table_rows(candidates: DataFrame, labels: dict[str, str]) -> DataFrame:
    """What a table shows: number, paragraph from 1, times, percent, label of the status, reasons in one line."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return candidates.select(
        "id", (F.col("paragraph") + 1).alias("paragraph"), F.format_string("%.3f - %.3f", F.col("start_ms") / 1000, F.col("end_ms") / 1000).alias("time"), F.format_string("%d%%", F.bround(F.col("confidence") * 100).cast("int")).alias("percent"),
        F.coalesce(F.try_element_at(known, F.col("status")), F.col("status")).alias("label"), F.array_join(F.transform("reasons", lambda r: F.replace(r, F.lit("_"), F.lit(" "))), ", ").alias("reasons"),
    )


def json_depth_problems(value, depth: int = 0, most: int = 8) -> list[str]:
    """What is wrong with a diagnostic record: too deep, a number that isn't finite, a key that is no string."""
    if depth > most:
        return ["too_deep"]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return ["not_finite"]
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([] if isinstance(k, str) else ["key"]) + json_depth_problems(v, depth + 1, most)]
    if isinstance(value, list | tuple):
        return [p for v in value for p in json_depth_problems(v, depth + 1, most)]
    return [] if value is None or isinstance(value, str | int | float | bool) else ["type"]


def without_repeats(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows of which those with equal keys are one, the first in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")
