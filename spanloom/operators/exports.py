"""What an export or a preview is made of: pieces, totals, windows by mode, and the check of what was rendered.

Rendering itself is an external program's; these tables are what it is told and held against.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.intervals import clamp, complement, edited_length, merge
from spanloom.operators.records import first_existing
from spanloom.sinks import save_json

#: Fixed value: milliseconds of a crossfade.
FADE_MS = 8


def export_plan(cuts: DataFrame, keys: list[str], low: int, high: int, fade: int) -> DataFrame:
    """keys, pieces, kept_length (after crossfades), kept_raw, removed: what an export of [low, high) keeps and removes.

    A key of which nothing is kept has no pieces, which is an error to whoever exports it.
    """
    merged = clamp(merge(cuts, keys, low, high), low, high)
    removed = merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("removed"))
    kept = edited_length(complement(merged, keys, low, high), keys, fade)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("pieces", "kept_length", "kept_raw")]
    return removed.join(kept, keys, "left").select(*keys, *zero, "removed")


def preview_ranges(selections: DataFrame, cuts: DataFrame, keys: list[str], pad: int, total: int) -> DataFrame:
    """keys, mode, start, end of what a preview plays of selections (keys, start, end), one for each key.

    original: the selection and `pad` on either side; selection: itself; edited: what the cuts,
    with the selection among them, leave of the padded window.
    """
    window = selections.select(*keys, F.greatest(F.lit(0).cast("long"), F.col("start") - pad).alias("_low"), F.least(F.lit(total).cast("long"), F.col("end") + pad).alias("_high"))
    whole = window.select(*keys, F.lit("original").alias("mode"), F.col("_low").alias("start"), F.col("_high").alias("end"))
    own = selections.select(*keys, F.lit("selection").alias("mode"), "start", "end")
    every = cuts.select(*keys, "start", "end").unionByName(selections.select(*keys, "start", "end")).join(window, keys)
    inside = every.select(*keys, F.greatest("start", "_low").alias("start"), F.least("end", "_high").alias("end")).where("end > start")
    gaps = complement(merge(inside, keys), keys, 0, total).join(window, keys)
    left = gaps.select(*keys, F.lit("edited").alias("mode"), F.greatest("start", "_low").alias("start"), F.least("end", "_high").alias("end")).where("end > start")
    return whole.unionByName(own).unionByName(left)


def rendered_problems(expected: Column, found: Column, rate_expected: Column, rate_found: Column, slack: int = 1) -> Column:
    """What is wrong with a rendered file: missing, another rate, or not as many samples as planned."""
    return F.when(found.isNull(), "missing").when(rate_found != rate_expected, "rate").when(F.abs(found - expected) > slack, "length")


def program(name: str, explicit: str | None = None, variable: str | None = None, beside: str | None = None, bundled: str | None = None) -> Path | None:
    """Where a program is: as told, by an environment variable, beside another program, bundled, or on the path."""
    told = os.environ.get(variable) if variable else None
    sibling = Path(beside).with_name(name) if beside else None
    found = first_existing(explicit, told, sibling, Path(bundled) / name if bundled else None)
    return found or (Path(p) if (p := shutil.which(name)) else None)


def self_test(spark: SparkSession, path: Path) -> dict:
    """Run what an installation needs once and write the outcome as JSON: versions, a merge, a fold and an Arrow function."""
    checks = {}
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 12, 15)], "k long, start long, end long")
    for name, test in {
        "merge": lambda: merge(rows, ["k"]).count() == 2,
        "plan": lambda: export_plan(rows, ["k"], 0, 20, 1).first().removed == 12,
        "arrow": lambda: rows.mapInArrow(lambda bs: bs, rows.schema).count() == 3,
    }.items():
        try:
            checks[name] = "ok" if test() else "wrong"
        except Exception as why:  # noqa: BLE001  a self test reports whatever breaks
            checks[name] = f"{type(why).__name__}: {why}"[:300]
    told = {"python": sys.version.split()[0], "spark": spark.version, "checks": checks, "ok": all(c == "ok" for c in checks.values())}
    save_json(json.loads(json.dumps(told)), path)
    return told
