"""Review of candidates: folds of events, filters, summaries, annotations, validation and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.intervals import islands

SELECTED = ("auto_approved", "approved")
RANKS = {"character": 0, "token": 1, "segment": 2, "unknown": 3}


def status_after(candidates: DataFrame, events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """candidates (id, status, review_required, final_start, final_end) as the events (id, action, start, end) leave them.

    Events follow `order` (at, then action): approve sets the final bounds, both or neither - an approval with one of them
    is none and ignored -; skip keeps them; reset clears them and goes back to review, or to automatic
    approval where none is required.
    """
    order = order or ["at", "action"]
    valid = events.where((F.col("action") != "approve") | (F.col("start").isNull() == F.col("end").isNull()))
    line = F.struct(*order)
    bounds = F.when(F.col("action").isin("approve", "reset"), line)
    last = valid.groupBy("id").agg(F.max_by("action", line).alias("_action"), F.max_by(F.struct("action", "start", "end"), bounds).alias("_bounds"))
    rows = candidates.join(last, "id", "left")
    again = F.when(F.col("review_required"), "needs_review").otherwise("auto_approved")
    then = F.when(F.col("_action") == "approve", "approved").when(F.col("_action") == "skip", "skipped").when(F.col("_action") == "reset", again).otherwise(F.col("status"))
    final = lambda name: F.when(F.col("_bounds.action") == "approve", F.col(f"_bounds.{name}")).when(F.col("_bounds.action").isNull(), F.col(f"final_{name}"))
    return rows.withColumns({"status": then, "final_start": final("start"), "final_end": final("end")}).drop("_action", "_bounds")


def in_mode(mode: str) -> Column:
    """The filter of a table of candidates: all, needs, selected or skipped."""
    return {"all": F.lit(True), "needs": F.col("status") == "needs_review", "selected": F.col("status").isin(*SELECTED), "skipped": F.col("status") == "skipped"}[mode]


def effective(name: str) -> Column:
    """The final bound where there is one, else the suggested bound."""
    return F.coalesce(F.col(f"final_{name}"), F.col(f"suggested_{name}"))


def next_open(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with next_open: the next place, going round, whose status needs review; null without one."""
    open_ = F.when(F.col("status") == "needs_review", F.col(order))
    line = Window.partitionBy(*keys).orderBy(order)
    ahead = F.min(open_).over(line.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("next_open", F.coalesce(ahead, F.min(open_).over(Window.partitionBy(*keys))))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidates, selected, open, skipped, removed (sum of selected lengths)."""
    chosen = F.col("status").isin(*SELECTED)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(chosen).alias("selected"),
        F.count_if(F.col("status") == "needs_review").alias("open"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.sum(F.when(chosen, F.col("end") - F.col("start")).otherwise(0)).cast("long").alias("removed"),
    )


def annotations(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, start, end: marks (id, start, end; ends inclusive) merged where they touch; the first id stays."""
    rows = islands(marks, keys, order=["id"])
    return rows.groupBy(*keys, "island").agg(F.min_by("id", F.struct("start", "end", "id")).alias("id"), F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


#: Fixed values of the stored format: why a fresh annotation needs review; confidence below which it is low.
UNVERIFIED, COARSE, UNKNOWN, LOW = "boundary_precision_unverified", "coarse_timestamp", "model_confidence_unavailable", "low_model_confidence"
LOW_CONFIDENCE = 0.40


def token_facts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, precisions (sorted), tokens, available, mean and least confidence (4 decimals), review_required, reasons.

    A model's time is no cut boundary yet, so every fresh annotation needs review.
    """
    least = F.min("confidence")
    told = {UNVERIFIED: F.lit(True), COARSE: F.bool_or(F.col("precision") != "character"), UNKNOWN: F.count("confidence") < F.count(F.lit(1)), LOW: least < LOW_CONFIDENCE}
    return tokens.groupBy(*keys).agg(
        F.array_sort(F.collect_set("precision")).alias("precisions"),
        F.count(F.lit(1)).alias("tokens"),
        F.count("confidence").alias("available"),
        F.bround(F.avg("confidence"), 4).alias("mean_confidence"),
        F.bround(least, 4).alias("min_confidence"),
        F.lit(True).alias("review_required"),
        F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in told.items()])).alias("reasons"),
    )


def violations(rows: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """id, rule: a row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return rows.select(id_column, F.explode(found).alias("rule"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how often, where they occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def reusable(sources: DataFrame, results: DataFrame, strategy: str) -> DataFrame:
    """sources (size, sha256) with the stored results of equal content made by the same strategy."""
    return sources.join(results.where(F.col("strategy") == strategy), ["size", "sha256"])
