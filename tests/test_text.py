import random

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import align, markup, review, scoring


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_normalisation_keeps_origins(spark):
    text = "Ａ，汉 A-B！"
    assert T.normalize_with_origin(text) == ("a汉ab", [0, 2, 4, 6])
    df = spark.createDataFrame([(text,)], "t string")
    got = T.normalized_any(df, "t").select(T.normalized_range(F.col("origin"), F.lit(2), F.lit(5)).alias("a"), T.normalized_range(F.col("origin"), F.lit(1), F.lit(2)).alias("b")).first()
    assert tuple(got.a) == (1, 3) and got.b is None


def test_overlapping_occurrences(spark):
    assert one(spark, T.occurrences(F.col("t"), "aa"), t="aaaa") == 3
    assert one(spark, T.occurrences(F.col("t"), "a.b"), t="a.bxaxb a.b") == 2


def test_anchors_and_clock(spark):
    assert [one(spark, T.anchor_ms(F.col("t")), t=t) for t in (f"{T.SPEAKER} 0:01", f"{T.SPEAKER} A B 1:02:03", f"{T.SPEAKER} 00:60", "x", f" {T.SPEAKER}\u3000 12:00 ", "0:01", f"{T.SPEAKER} 1:02\n")] == [1000, 3723000, None, None, 720000, None, None]
    assert one(spark, T.clock(F.col("t")), t=3723999) == "01:02:03"


def test_samples_round_half_to_even(spark):
    r = one(spark, T.sample_range(F.col("a"), F.col("b"), 1000, 10000), a=0.5, b=1.5)
    assert tuple(r) == (0, 2)
    assert tuple(one(spark, T.sample_range(F.col("a"), F.col("b"), 1000, 100), a=500.0, b=501.0)) == (99, 100)


def test_serialized_tokens(spark):
    r = one(spark, T.serialized_tokens(F.col("t")), t="ab 0 10.5; c d 11 12;bad;")
    assert [tuple(x) for x in r] == [("ab", 0.0, 10.5), ("c d", 11.0, 12.0)]


def brute(a, b):
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            if i == len(a) and j == len(b):
                best[i, j] = 0.0
                continue
            s = []
            if i < len(a) and j < len(b):
                s.append(best[i + 1, j + 1] + (align.MATCH if a[i] == b[j] else align.MISMATCH))
            if i < len(a):
                s.append(best[i + 1, j] + align.DELETE)
            if j < len(b):
                s.append(best[i, j + 1] + align.INSERT)
            best[i, j] = max(s)
    return best[0, 0]


def test_alignment_is_optimal_and_monotone():
    random.seed(5)
    for _ in range(100):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(2))
        best, second, _ = align.two_best(a, b)
        assert abs(best.score - brute(a, b)) < 1e-9
        assert second is None or second.score <= best.score
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(best.matches, best.matches[1:], strict=False))


def test_anchored_alignment_finds_the_thinned_text():
    text = "thequickbrownfoxjumpsoverthelazydogandrunsaway"
    thin = text[:20] + text[21:]
    found = align.aligned(text, thin)
    assert not found.split and 0 <= found.margin <= 1 and len(found.matches) == len(thin)
    assert all(text[i] == thin[j] for i, j, _ in found.matches)


def test_highlights_coalesce(spark):
    runs = spark.createDataFrame([(0, 0, "ab", None), (0, 1, "cd", "yellow"), (0, 2, "ef", "YELLOW"), (0, 3, "g", "red"), (0, 4, "h", "yellow")], "p int, run int, text string, highlight string")
    got = sorted((r.start, r.end, r.text) for r in markup.highlights(runs, ["p"], F.lower("highlight") == "yellow").collect())
    assert got == [(2, 6, "cdef"), (7, 8, "h")]


def test_score_without_evidence(spark):
    ranges = ", ".join(f"CAST(NULL AS {'string' if n == 'precision' else 'boolean' if n == 'valid' else 'double'}) AS {e}_{n}" for e in ("force", "asr") for n in scoring.RANGE)
    df = spark.sql(f"SELECT 5L AS length, false AS repeated, true AS located, false AS local, false AS weak_context, false AS unstable, false AS consensus, false AS force_given, false AS force_there, false AS asr_there, CAST(NULL AS boolean) AS asr_track_valid, false AS split, 0L AS left_guard, 1L AS right_guard, 1.0D AS proportional_start, 200.0D AS proportional_end, {ranges}")
    out = scoring.recorded(scoring.judged(df)).first()
    assert (out.confidence, out.start_ms, out.auto) == (0.15, 1.0, False)
    assert out.reasons == ["fallback_character_ratio", "local_audio_recognition_refinement_unavailable", "force_aligner_unavailable", "asr_aligner_unavailable"]
    assert out.diagnostics.force_alignment is None and out.diagnostics.candidate_span_ms == 199.0


def test_review_round(spark):
    rows = spark.createDataFrame([(0, k, s) for k, s in enumerate(["needs_review", "approved", "skipped", "needs_review"])], "project long, id long, status string")
    got = [r.next_open for r in review.next_open(rows, ["project"], "id").orderBy("id").collect()]
    assert got == [3, 3, 3, 0]
    marks = spark.createDataFrame([(0, 7, 0, 10), (0, 3, 10, 20), (0, 1, 40, 50)], "project long, id long, start long, end long")
    assert sorted((r.id, r.start, r.end) for r in review.annotations(marks, ["project"]).collect()) == [(1, 40, 50), (7, 0, 20)]
