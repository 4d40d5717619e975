"""The driver tables read as the engine's own abstractions, in DataFrames and in the SQL of the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, start, end: a cut interval for each order."""
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), start.alias("start"), "o_orderkey")
    return rows.select("project", "start", (F.col("start") + 1 + F.col("o_orderkey") % 30).alias("end"), "o_orderkey")


CUTS = """cuts AS (SELECT o_custkey AS project, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS BIGINT) AS e, o_orderkey FROM orders)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, text, start, end (microseconds), confidence, precision: a token for each event."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    precision = F.element_at(F.array(*[F.lit(x) for x in ("character", "token", "segment")]), (F.col("event_id") % 3 + 1).cast("int"))
    confidence = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 101) / F.lit(100.0))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("text"), start.alias("start"), (start + F.col("event_id") % 600 * 1_000_000).alias("end"), "value", confidence.alias("confidence"), precision.alias("precision"))


TOKENS = """tokens AS (SELECT user_id, event_id, event_type AS text, epoch_us(ts) AS s, epoch_us(ts) + event_id % 600 * 1000000 AS e, value,
    CASE WHEN event_id % 7 <> 0 THEN (event_id % 101) / 100.0 END AS confidence, (['character', 'token', 'segment'])[event_id % 3 + 1] AS precision FROM events)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, sample, v: the numbers of an embedding as samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("sample", "v")).select("vec_id", F.col("sample").cast("long").alias("sample"), F.col("v").cast("double").alias("v"))


SIGNAL = """signal AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS sample, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) AS g(i))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of evidence about a candidate for each line item, made so that each rule holds for some and fails for some."""
    k, q = F.col("k"), F.col("q")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") * 10.0).alias("base"), F.col("l_quantity").cast("long").alias("q"))
    force, asr = k % 5 != 0, k % 7 != 0
    length = q % 12 + 1
    wide = F.when(k % 29 == 0, 20.0).when(k % 31 == 0, 20000.0).otherwise(length * 100.0)
    shift = (k % 9) * 20.0
    part = lambda n, low: (k % n + low) / F.lit(100.0)
    of = lambda test, value: F.when(test, value)
    return rows.select(
        "l_orderkey", "l_linenumber", length.alias("length"), (k % 11 == 0).alias("repeated"), (k % 37 != 0).alias("located"), (k % 41 != 0).alias("local"), (k % 43 == 0).alias("weak_context"), (k % 19 == 0).alias("unstable"), (k % 3 == 0).alias("consensus"),
        (k % 47 != 0).alias("force_given"), (k % 10 != 5).alias("force_there"), (k % 14 != 7).alias("asr_there"), (k % 53 != 0).alias("asr_track_valid"), (k % 97 == 0).alias("split"),
        of(force, F.col("base")).alias("force_start"), of(force, F.col("base") + wide).alias("force_end"), of(force, part(40, 60)).alias("force_coverage"), of(force, F.lit(None).cast("double")).alias("force_mean"), of(force, F.lit(None).cast("double")).alias("force_min"), of(force, F.lit(None).cast("double")).alias("force_low"),
        of(force, F.when(k % 59 == 0, "segment").otherwise("character")).alias("force_precision"), of(force, part(95, 6)).alias("force_margin"), of(force, k % 23 != 0).alias("force_valid"), of(force, F.lit(0.0)).alias("force_confidence_coverage"), of(force, F.lit(None).cast("double")).alias("force_voice_start"), of(force, F.lit(None).cast("double")).alias("force_voice_end"),
        of(asr, F.col("base") + shift).alias("asr_start"), of(asr, F.col("base") + shift + wide).alias("asr_end"), of(asr, part(50, 50)).alias("asr_coverage"), of(asr & (k % 8 != 0), part(60, 40)).alias("asr_mean"), of(asr & (k % 8 != 0), part(80, 20)).alias("asr_min"), of(asr & (k % 8 != 0), part(25, 0)).alias("asr_low"),
        of(asr, F.when(k % 13 == 0, "token").otherwise("character")).alias("asr_precision"), of(asr, part(100, 0)).alias("asr_margin"), of(asr, k % 61 != 0).alias("asr_valid"), of(asr, F.when(k % 6 == 0, 0.5).otherwise(1.0)).alias("asr_confidence_coverage"), of(asr, F.col("base") - 30).alias("asr_voice_start"), of(asr, F.lit(None).cast("double")).alias("asr_voice_end"),
        of(k % 17 != 0, F.lit(0).cast("long")).alias("left_guard"), F.lit(1).cast("long").alias("right_guard"), (F.col("base") + 1).alias("proportional_start"), (F.col("base") + 200).alias("proportional_end"),
    )


EVIDENCE = """e0 AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k, l_partkey * 10.0::DOUBLE AS base, CAST(trunc(l_quantity) AS BIGINT) % 12 + 1 AS length FROM lineitem),
  e1 AS (SELECT *, k % 5 <> 0 AS force, k % 7 <> 0 AS asr, k % 37 <> 0 AS located, k % 41 <> 0 AS local, k % 43 = 0 AS weak_context, k % 11 = 0 AS repeated, k % 19 = 0 AS unstable, k % 3 = 0 AS consensus, k % 47 <> 0 AS force_given,
    k % 10 <> 5 AS force_there, k % 14 <> 7 AS asr_there, k % 53 <> 0 AS track_valid, k % 97 = 0 AS split, k % 17 = 0 AS guard_missing, CASE WHEN k % 29 = 0 THEN 20.0::DOUBLE WHEN k % 31 = 0 THEN 20000.0::DOUBLE ELSE length * 100.0::DOUBLE END AS wide, (k % 9) * 20.0::DOUBLE AS shift,
    (k % 40 + 60) / 100.0::DOUBLE AS fc, (k % 50 + 50) / 100.0::DOUBLE AS ac, (k % 95 + 6) / 100.0::DOUBLE AS fm, (k % 100) / 100.0::DOUBLE AS am,
    CASE WHEN k % 8 <> 0 THEN (k % 60 + 40) / 100.0::DOUBLE END AS mc, CASE WHEN k % 8 <> 0 THEN (k % 80 + 20) / 100.0::DOUBLE END AS nc, CASE WHEN k % 8 <> 0 THEN (k % 25) / 100.0::DOUBLE END AS low_share, k % 6 = 0 AS partly FROM e0),
  e2 AS (SELECT *, CASE WHEN force AND asr THEN shift END AS apart, base AS fs, base + wide AS fe, base + shift AS s, base + shift + wide AS t FROM e1),
  e3 AS (SELECT *, CASE WHEN apart <= 120 THEN (s + fs) / 2 WHEN force AND asr AND consensus AND local THEN fs WHEN asr THEN s WHEN force THEN fs ELSE base + 1 END AS start_ms,
    CASE WHEN apart <= 120 THEN (t + fe) / 2 WHEN force AND asr AND consensus AND local THEN fe WHEN asr THEN t WHEN force THEN fe ELSE base + 200 END AS end_ms FROM e2),
  ev AS (SELECT *, length <= 2 AS short, coalesce(apart > 120, false) AS disagreement,
    (force AND fc < 0.8) OR (asr AND ac < 0.65) OR (force_there AND NOT force) OR (asr_there AND NOT asr) OR weak_context OR (force_given AND located AND NOT force) AS insufficient,
    (asr AND k % 61 = 0) OR (force AND k % 23 = 0) OR (asr_there AND NOT track_valid) OR greatest(end_ms - start_ms, 0) > greatest(4000, length * 1200) OR (length >= 3 AND greatest(end_ms - start_ms, 0) < length * 15) AS anomaly,
    (asr AND k % 13 = 0) OR (force AND k % 59 = 0) AS coarse, asr AND (least(am, CASE WHEN force THEN fm ELSE am END) < 0.12 OR split) AS ambiguous, asr AND partly AS confidence_unavailable,
    asr AND mc IS NOT NULL AND (mc < 0.72 OR nc < 0.4 OR low_share > 0.2) AS low_confidence FROM e3)"""
SCORE = """CASE WHEN force AND asr THEN 0.55::DOUBLE + 0.25::DOUBLE * fc + 0.12::DOUBLE * ac + CASE WHEN NOT disagreement THEN 0.08::DOUBLE * greatest(0.0::DOUBLE, 1 - apart / 120.0::DOUBLE) ELSE 0.0::DOUBLE END
    WHEN force THEN 0.45::DOUBLE + 0.30::DOUBLE * fc WHEN asr THEN 0.25::DOUBLE + 0.30::DOUBLE * ac ELSE 0.15::DOUBLE END"""
CODES = {
    "NOT force AND NOT asr": "fallback_character_ratio", "NOT located": "document_time_search_fallback", "short": "short_highlight", "repeated": "repeated_context", "ambiguous": "alignment_candidate_margin_too_small", "insufficient": "insufficient_coverage",
    "disagreement": "boundary_disagreement_over_120ms", "unstable": "local_context_alignment_unstable", "anomaly": "timestamp_validation_failed", "coarse": "coarse_timestamp_not_character_level", "confidence_unavailable": "model_character_confidence_unavailable",
    "low_confidence": "low_model_character_confidence", "guard_missing": "adjacent_character_guard_unavailable", "located AND NOT local": "local_audio_recognition_refinement_unavailable", "NOT force_given": "force_aligner_unavailable", "NOT asr_there": "asr_aligner_unavailable",
}
SCORED = f"""b AS (SELECT *, {SCORE} AS base_score FROM ev),
  m AS (SELECT *, CASE WHEN asr AND mc IS NOT NULL AND NOT confidence_unavailable THEN 0.72::DOUBLE * base_score + 0.28::DOUBLE * mc WHEN confidence_unavailable THEN least(base_score, 0.69::DOUBLE) ELSE base_score END AS mixed FROM b),
  p AS (SELECT *, mixed - CASE WHEN short THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN repeated THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN ambiguous THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN insufficient THEN 0.20::DOUBLE ELSE 0 END
    - CASE WHEN disagreement THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN unstable THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN coarse THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN low_confidence THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN guard_missing THEN 0.08::DOUBLE ELSE 0 END AS less FROM m),
  scored AS (SELECT *, round_even(least(greatest(CASE WHEN anomaly THEN least(less, 0.20::DOUBLE) ELSE less END, 0.0::DOUBLE), 0.99::DOUBLE), 4) AS confidence,
    list_filter([{", ".join(f"CASE WHEN {test} THEN '{code}' END" for test, code in CODES.items())}], lambda x: x IS NOT NULL) AS reasons FROM p)"""
