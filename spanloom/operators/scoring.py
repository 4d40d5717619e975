"""Evidence about a candidate interval: fused edges, flags, confidence, reasons, approval and the record of it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the evidence rules.
TOLERANCE_MS, MIN_FORCE, MIN_ASR, AUTO = 120.0, 0.80, 0.65, 0.82
MARGIN, MEAN_CONFIDENCE, LEAST_CONFIDENCE, LOW_SHARE = 0.12, 0.72, 0.40, 0.20
LONGEST_MS, LONG_MS, SHORT_MS, SHORT = 4000.0, 1200.0, 15.0, 2
#: Penalties by flag.
PENALTIES = {"short": 0.20, "repeated": 0.12, "ambiguous": 0.20, "insufficient": 0.20, "disagreement": 0.25, "unstable": 0.12, "coarse": 0.18, "low_confidence": 0.18, "guard_missing": 0.08}
#: Fixed values of the stored format: the reason code of each flag, in the order of the reasons.
REASONS = {
    "proportional": "fallback_character_ratio",
    "document_time": "document_time_search_fallback",
    "short": "short_highlight",
    "repeated": "repeated_context",
    "ambiguous": "alignment_candidate_margin_too_small",
    "insufficient": "insufficient_coverage",
    "disagreement": "boundary_disagreement_over_120ms",
    "unstable": "local_context_alignment_unstable",
    "anomaly": "timestamp_validation_failed",
    "coarse": "coarse_timestamp_not_character_level",
    "confidence_unavailable": "model_character_confidence_unavailable",
    "low_confidence": "low_model_character_confidence",
    "guard_missing": "adjacent_character_guard_unavailable",
    "local_missing": "local_audio_recognition_refinement_unavailable",
    "force_missing": "force_aligner_unavailable",
    "asr_missing": "asr_aligner_unavailable",
}
EXPANDED, UNCERTAIN = "boundary_expanded_for_speech_edge", "boundary_refinement_evidence_incomplete"
#: Columns of a range, as they are named behind force_ and asr_.
RANGE = ("start", "end", "coverage", "mean", "min", "low", "precision", "margin", "valid", "confidence_coverage", "voice_start", "voice_end")


def flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def there(engine: str) -> Column:
    return F.col(f"{engine}_start").isNotNull()


def fused(df: DataFrame, duration_ms: Column | None = None) -> DataFrame:
    """df with edge_difference, start_ms and end_ms: the mean where both engines agree, else the force range if its
    contexts agree (consensus) and recognition was refined (local), else recognition, else force, else the
    proportional position; kept within the audio if its duration is given."""
    force, asr = there("force"), there("asr")
    apart = F.when(force & asr, F.greatest(F.abs(F.col("force_start") - F.col("asr_start")), F.abs(F.col("force_end") - F.col("asr_end"))))

    def edge(name: str) -> Column:
        f, a = F.col(f"force_{name}"), F.col(f"asr_{name}")
        told = F.when(flag(apart <= TOLERANCE_MS), (a + f) / 2).when(force & asr & flag(F.col("consensus")) & flag(F.col("local")), f).when(asr, a).when(force, f).otherwise(F.col(f"proportional_{name}"))
        return told if duration_ms is None else F.greatest(F.lit(0.0), F.least(duration_ms, told))

    return df.withColumns({"edge_difference": apart, "start_ms": edge("start"), "end_ms": edge("end")})


def flags(df: DataFrame) -> DataFrame:
    """df (with what :func:`fused` adds) with a boolean for each flag of the evidence.

    Reads the columns RANGE of both engines; length; located (the paragraph was found in the
    audio), local, weak_context, unstable, repeated; force_given, force_there and asr_there
    (an engine was asked, a track came back), asr_track_valid, split; left_guard, right_guard.
    """
    force, asr = there("force"), there("asr")
    located, local = flag(F.col("located")), flag(F.col("local"))
    wide = F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms"))
    odd = (wide > F.greatest(F.lit(LONGEST_MS), F.col("length") * LONG_MS)) | ((F.col("length") >= 3) & (wide < F.col("length") * SHORT_MS))
    few = (force & flag(F.col("force_coverage") < MIN_FORCE)) | (asr & flag(F.col("asr_coverage") < MIN_ASR))
    lost = (flag(F.col("force_there")) & ~force) | (flag(F.col("asr_there")) & ~asr) | (flag(F.col("force_given")) & located & ~force)
    broken = (asr & ~flag(F.col("asr_valid"))) | (force & ~flag(F.col("force_valid"))) | (flag(F.col("asr_there")) & ~flag(F.col("asr_track_valid")))
    unsure = (F.col("asr_mean") < MEAN_CONFIDENCE) | (F.col("asr_min") < LEAST_CONFIDENCE) | (F.col("asr_low") > LOW_SHARE)
    told = {c: flag(F.col(c)) for c in ("repeated", "unstable")}
    return df.withColumns(
        told
        | {
            "short": flag(F.col("length") <= SHORT),
            "insufficient": few | lost | flag(F.col("weak_context")),
            "disagreement": flag(F.col("edge_difference") > TOLERANCE_MS),
            "anomaly": broken | flag(odd),
            "coarse": (asr & flag(F.col("asr_precision") != "character")) | (force & flag(F.col("force_precision") != "character")),
            "ambiguous": asr & (flag(F.least("asr_margin", "force_margin") < MARGIN) | flag(F.col("split"))),
            "confidence_unavailable": asr & flag(F.col("asr_confidence_coverage") < 1),
            "low_confidence": asr & F.col("asr_mean").isNotNull() & flag(unsure),
            "guard_missing": F.col("left_guard").isNull() | F.col("right_guard").isNull(),
            "proportional": ~force & ~asr,
            "document_time": ~located,
            "local_missing": located & ~local,
            "force_missing": ~flag(F.col("force_given")),
            "asr_missing": ~flag(F.col("asr_there")),
        }
    )


def confidence(df: DataFrame) -> DataFrame:
    """df with confidence, 0 to 0.99, four decimals half to even: base, bonuses, penalties and caps."""
    force, asr = there("force"), there("asr")
    agree = F.when(~F.col("disagreement"), 0.08 * F.greatest(F.lit(0.0), 1 - F.col("edge_difference") / TOLERANCE_MS)).otherwise(0.0)
    base = F.when(force & asr, 0.55 + 0.25 * F.col("force_coverage") + 0.12 * F.col("asr_coverage") + agree).when(force, 0.45 + 0.30 * F.col("force_coverage")).when(asr, 0.25 + 0.30 * F.col("asr_coverage")).otherwise(0.15)
    told = asr & F.col("asr_mean").isNotNull() & ~F.col("confidence_unavailable")
    mixed = F.when(told, 0.72 * base + 0.28 * F.col("asr_mean")).when(F.col("confidence_unavailable"), F.least(base, F.lit(0.69))).otherwise(base)
    # one fold instead of nine branches: the compiled method of the projection stays small enough for the JIT
    held = F.array(*[F.col(name).cast("double") * cost for name, cost in PENALTIES.items()])
    mixed = F.aggregate(held, mixed, lambda left, cost: left - cost)
    capped = F.when(F.col("anomaly"), F.least(mixed, F.lit(0.20))).otherwise(mixed)
    return df.withColumn("confidence", F.bround(F.least(F.greatest(capped, F.lit(0.0)), F.lit(0.99)), 4))


def reasons(df: DataFrame) -> DataFrame:
    """df with reasons: the codes of the flags that hold, in their fixed order."""
    return df.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f), F.lit(code)) for f, code in REASONS.items()]))))


def approved(df: DataFrame, least: float = AUTO) -> DataFrame:
    """df with auto: no flag against it, both engines there, and confidence of at least `least`.

    A paragraph that was not located and a range that was not refined count against it too;
    that an engine is missing says only that its range is.
    """
    against = F.array(*[F.col(f) for f in REASONS if f not in ("force_missing", "asr_missing")])
    return df.withColumn("auto", ~F.exists(against, lambda x: x) & there("force") & there("asr") & (F.col("confidence") >= least))


def range_record(engine: str) -> Column:
    """A range as it is stored: times to three decimals, shares to four; null without one."""
    c = lambda name: F.col(f"{engine}_{name}")
    return F.when(
        there(engine),
        F.struct(
            F.bround(c("start"), 3).alias("start_ms"), F.bround(c("end"), 3).alias("end_ms"), F.bround(c("coverage"), 4).alias("coverage"), F.bround(c("mean"), 4).alias("mean_model_confidence"), F.bround(c("min"), 4).alias("minimum_model_confidence"),
            F.bround(c("low"), 4).alias("low_confidence_ratio"), c("precision").alias("timestamp_precision"), c("valid").alias("timestamp_valid"), F.bround(c("confidence_coverage"), 4).alias("model_confidence_coverage"), F.bround(c("margin"), 4).alias("alignment_margin"),
            F.bround(c("voice_start"), 3).alias("vad_start_ms"), F.bround(c("voice_end"), 3).alias("vad_end_ms"),
        ),
    )


def recorded(df: DataFrame) -> DataFrame:
    """df with diagnostics: what the judgement rests on, rounded as it is stored."""
    wide = F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms"))
    margin = F.coalesce(F.least("asr_margin", "force_margin"), F.lit(0.0))
    told = F.struct(
        F.lit("ms").alias("timestamp_unit"), F.lit("anchored_monotonic_dp").alias("matching_strategy"), range_record("force").alias("force_alignment"), range_record("asr").alias("asr_alignment"), F.bround("edge_difference", 3).alias("boundary_disagreement_ms"),
        F.bround(wide, 3).alias("candidate_span_ms"), F.bround(margin, 4).alias("alignment_ambiguity_margin"), flag(F.col("split")).alias("dp_forced_partition"), F.col("left_guard").alias("left_guard_sample"), F.col("right_guard").alias("right_guard_sample"),
    )
    return df.withColumn("diagnostics", told)


def judged(df: DataFrame, duration_ms: Column | None = None) -> DataFrame:
    """df with all of the above but the diagnostics."""
    return approved(reasons(confidence(flags(fused(df, duration_ms)))))
