"""Stored records: typed fields of JSON, rules that records have to keep, defaults of older forms, and opening projects again."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.scoring import REASONS

#: Fixed values of the stored format.
STATUSES = ("needs_review", "auto_approved", "approved", "skipped")
PRECISIONS = ("character", "token", "segment", "unknown")
BUNDLED = "bundled-local"
STRATEGY = {"purpose": "alignment_strategy", "name": "audio-text-primary", "version": "6"}
#: How a field may be: it has to be there, it may be null or missing, or it has a default (any other value).
REQUIRED, NULLABLE = object(), object()
KINDS = {"string": "string", "bool": "boolean", "int": "bigint", "number": "double", "strings": "array<string>", "list": "array<variant>"}


# --- typed fields


def fits(kind: str, told: Column) -> Column:
    """Whether a JSON value, whose schema is told, is of a kind. A boolean is no number, and a number with a point no integer."""
    whole = told == "BIGINT"
    return {
        "string": told == "STRING",
        "bool": told == "BOOLEAN",
        "int": whole,
        "number": whole | (told == "DOUBLE") | told.startswith("DECIMAL"),
        "strings": told.isin("ARRAY<STRING>", "ARRAY<VOID>"),
        "list": told.startswith("ARRAY"),
    }[kind]


def fields(df: DataFrame, raw: str, spec: Mapping[str, tuple[str, object]]) -> DataFrame:
    """df with a column for each field of the JSON objects in `raw`, and problems: `not_an_object`, `missing:name` or `type:name`.

    spec gives (kind, how) by name: see KINDS; how is REQUIRED, NULLABLE or a default, which a
    missing field takes. A field with a problem is null.
    """
    rows = df.withColumn("_v", F.try_parse_json(raw))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    problems, columns = [F.when(~is_object, F.lit("not_an_object"))], {}
    for name, (kind, how) in spec.items():
        value = F.try_variant_get("_v", f"$.{name}", "variant")
        told = F.schema_of_variant(value)
        there = told.isNotNull()
        ok = there & fits(kind, told)
        empty = ~there | (told == "VOID") if how is NULLABLE else ~there
        default = F.lit(None) if how is REQUIRED or how is NULLABLE else F.array(*map(F.lit, how)) if isinstance(how, list) else F.lit(how)
        columns[name] = F.when(ok, F.try_variant_get("_v", f"$.{name}", KINDS[kind])).when(is_object & empty, default.cast(KINDS[kind]) if kind != "list" else F.lit(None))
        problems.append(F.when(is_object & ~there & F.lit(how is REQUIRED), F.lit(f"missing:{name}")).when(is_object & ~empty & ~ok, F.lit(f"type:{name}")))
    return rows.withColumns(columns).withColumn("problems", F.array_compact(F.array(*problems))).drop("_v")


def interval_of(raw: Column) -> Column:
    """(start, end) of an interval given as JSON: an object with start_sample and end_sample, or a list of two; null for anything else."""
    v = F.try_parse_json(raw)
    told = F.schema_of_variant(v)
    a = F.when(told.startswith("OBJECT"), F.try_variant_get(v, "$.start_sample", "bigint")).when(told.startswith("ARRAY") & F.try_variant_get(v, "$[2]", "variant").isNull(), F.try_variant_get(v, "$[0]", "bigint"))
    b = F.when(told.startswith("OBJECT"), F.try_variant_get(v, "$.end_sample", "bigint")).when(told.startswith("ARRAY"), F.try_variant_get(v, "$[1]", "bigint"))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


# --- rules


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))


def no_interval(start: str, end: str) -> Column:
    return ~((F.col(start) >= 0) & (F.col(end) > F.col(start)))


def half(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def candidate_problems(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with problems: the rules of a stored candidate that each breaks.

    Reads id, paragraph_index, highlight_index, text, suggested/final/source_start/end, confidence,
    status, review_required and total_samples. A value that has to be there and is null breaks
    its rule; ids and places have to be unique among equal keys.
    """
    pair = lambda name: F.col(f"{name}_start").isNotNull() & F.col(f"{name}_end").isNotNull() & no_interval(f"{name}_start", f"{name}_end")
    rules = {
        "id_empty": F.coalesce(F.trim("id"), F.lit("")) == "",
        "place_negative": ~((F.col("paragraph_index") >= 0) & (F.col("highlight_index") >= 0)),
        "text_empty": F.coalesce(F.trim("text"), F.lit("")) == "",
        "suggested_interval": no_interval("suggested_start", "suggested_end"),
        "confidence_range": ~((F.col("confidence") >= 0) & (F.col("confidence") <= 1)) | F.isnan("confidence"),
        "status_unknown": ~F.col("status").isin(*STATUSES),
        "review_skipped": F.coalesce(F.col("review_required") & (F.col("status") == "auto_approved"), F.lit(False)),
        "source_half": half("source_start", "source_end"),
        "source_interval": pair("source"),
        "final_half": half("final_start", "final_end"),
        "final_interval": pair("final"),
        "beyond_audio": F.coalesce(F.coalesce("final_end", "suggested_end") > F.col("total_samples"), F.lit(False)),
        "id_repeated": F.count(F.lit(1)).over(Window.partitionBy(*keys, "id")) > 1,
        "place_repeated": F.count(F.lit(1)).over(Window.partitionBy(*keys, "paragraph_index", "highlight_index")) > 1,
    }
    return rows.withColumn("problems", broken(rules))


def token_problems(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows (text, start, end, confidence, precision, total_samples) with problems; times must not go back in `order`."""
    line = Window.partitionBy(*keys).orderBy(order)
    back = (F.col("start") < F.lag("start").over(line)) | (F.col("end") < F.lag("end").over(line))
    rules = {
        "text_empty": F.coalesce(F.length("text"), F.lit(0)) == 0,
        "interval": ~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("total_samples"))),
        "confidence_range": ~((F.col("confidence") >= 0) & (F.col("confidence") <= 1)),
        "precision_unknown": ~F.col("precision").isin(*PRECISIONS),
        "order": F.coalesce(back, F.lit(False)),
    }
    return rows.withColumn("problems", broken(rules))


def annotation_problems(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (id, operation, text, token_start/end, start, end, review_required, review_reasons, tokens, total_samples) with problems."""
    reasons = F.coalesce("review_reasons", F.array().cast("array<string>"))
    rules = {
        "id_empty": F.coalesce(F.length("id"), F.lit(0)) == 0,
        "operation": F.col("operation") != "delete",
        "text_empty": F.coalesce(F.length("text"), F.lit(0)) == 0,
        "token_range": ~((F.col("token_start") >= 0) & (F.col("token_start") < F.col("token_end")) & (F.col("token_end") <= F.col("tokens"))),
        "interval": ~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("total_samples"))),
        "reason_blank": F.exists(reasons, lambda r: r.isNull() | (r == "")),
        "reasons_missing": F.coalesce(F.col("review_required") & (F.size(reasons) == 0), F.lit(False)),
        "id_repeated": F.count(F.lit(1)).over(Window.partitionBy(*keys, "id")) > 1,
    }
    return rows.withColumn("problems", broken(rules))


def segment_problems(starts: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys of the lists of segment starts (position, start, tokens) that don't begin with 0, don't rise, or go beyond the tokens."""
    line = Window.partitionBy(*keys).orderBy(position)
    first = F.row_number().over(line) == 1
    bad = (first & (F.col("start") != 0)) | F.coalesce(F.col("start") <= F.lag("start").over(line), F.lit(False)) | (F.col("start") >= F.col("tokens"))
    return starts.withColumn("_bad", bad).where("_bad").select(*keys).distinct()


def duration_problems(audio: DataFrame) -> DataFrame:
    """audio (sample_rate, channels, total_samples, duration_ms) with duration_ms derived where it is missing, and problems: a stored
    duration has to be the one that the samples give, rounded down."""
    derived = F.floor(F.col("total_samples") * 1000 / F.col("sample_rate")).cast("long")
    rules = {"sample_rate": ~(F.col("sample_rate") > 0), "channels": ~(F.col("channels") > 0), "total_samples": ~(F.col("total_samples") >= 0), "duration": F.col("duration_ms").isNotNull() & (F.col("duration_ms") != derived)}
    return audio.withColumn("problems", broken(rules)).withColumn("duration_ms", F.coalesce("duration_ms", derived))


def unordered_anchors(anchors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The anchors (anchor_ms) that are not later than the one before them."""
    line = Window.partitionBy(*keys).orderBy(order)
    return anchors.withColumn("_before", F.lag("anchor_ms").over(line)).where(F.col("anchor_ms") <= F.col("_before")).drop("_before")


# --- records made and opened


def from_alignment(candidates: DataFrame) -> DataFrame:
    """Stored candidates of judged ones (paragraph, highlight, text, start, end, confidence, reasons, status, review_required): an id
    from the place; a status that is not known needs review."""
    known = F.col("status").isin("auto_approved", "approved", "skipped")
    return candidates.select(
        *[c for c in candidates.columns if c not in ("paragraph", "highlight", "start", "end", "status", "review_required")],
        F.format_string("p%04d-h%03d", "paragraph", "highlight").alias("id"), F.col("paragraph").alias("paragraph_index"), F.col("highlight").alias("highlight_index"), F.col("start").alias("suggested_start"), F.col("end").alias("suggested_end"),
        F.when(known, F.col("status")).otherwise("needs_review").alias("status"), (~F.coalesce(known, F.lit(False)) | F.coalesce("review_required", F.lit(False))).alias("review_required"),
    )


def short_downgraded(candidates: DataFrame, norm: Column, most: int = 2) -> DataFrame:
    """candidates whose normalised text has at most two characters need review, for that reason, whatever they were."""
    short = F.length(norm) <= most
    reasons = F.when(short & ~F.array_contains("reasons", REASONS["short"]), F.concat("reasons", F.array(F.lit(REASONS["short"])))).otherwise(F.col("reasons"))
    return candidates.withColumns({"reasons": reasons, "status": F.when(short, "needs_review").otherwise(F.col("status")), "review_required": F.col("review_required") | short})


def with_models(used: DataFrame, manifest: DataFrame) -> DataFrame:
    """used (purpose, name) with version and digest of the manifest's models (name, revision, sha256), defaults where there are none."""
    rows = used.join(manifest, "name", "left")
    return rows.select(*used.columns, F.coalesce("revision", F.lit(BUNDLED)).alias("version"), F.coalesce("sha256", F.lit("")).alias("digest"))


def is_current(models: Column, strategy: Mapping[str, str] = STRATEGY) -> Column:
    """Whether a project's models (an array of structs) hold the strategy of today."""
    return F.exists(models, lambda m: (m["purpose"] == strategy["purpose"]) & (m["name"] == strategy["name"]) & (m["version"] == strategy["version"]))


def reopened(projects: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """projects (key, models, role, size, sha256, a row for each source) with path, found and current.

    A source is found by its content, wherever it lies: the path of the file (path, size, sha256) with equal
    size and digest, the first by name. current says whether the strategy is today's; a project
    with ready false has to be analysed or linked again.
    """
    at = files.groupBy("size", "sha256").agg(F.min("path").alias("path"))
    rows = projects.join(at, ["size", "sha256"], "left").withColumn("found", F.col("path").isNotNull()).withColumn("current", is_current(F.col("models")))
    return rows.withColumn("ready", F.min(F.col("found") & F.col("current")).over(Window.partitionBy(key)))


def with_output(projects: DataFrame) -> DataFrame:
    """projects (path of the audio, output_directory): an empty output goes beside the audio."""
    beside = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    return projects.withColumn("output_directory", F.when(F.coalesce(F.trim("output_directory"), F.lit("")) == "", beside).otherwise(F.col("output_directory")))


# --- what a run needs


def first_existing(*paths: str | Path | None) -> Path | None:
    """The first of several paths, by precedence, that is there."""
    return next((Path(p) for p in paths if p and Path(p).exists()), None)


def platform_key(system: str, machine: str) -> str:
    """The tag of a platform's resources."""
    known = {("win32", "amd64"): "windows-x86_64", ("win32", "x86_64"): "windows-x86_64", ("darwin", "arm64"): "macos-arm64", ("darwin", "aarch64"): "macos-arm64"}
    return known.get((system, machine.lower()), f"{system}-{machine.lower()}")


def missing(wanted: Column, there: Column) -> Column:
    """What is wanted and not there, in the order it is wanted."""
    return F.array_except(wanted, there)
