import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.operators import align, tracks


def result(**kv):
    return json.dumps([kv])


def test_margins_by_position_and_segments():
    assert align.aligned("", "abc").margin == 0.0 and align.aligned("abc", "").matches == ()
    sure = align.aligned("abcdefgh", "abcdefgh")
    assert sure.margin == 1.0 and not sure.margins and len(sure.matches) == 8
    twice = align.aligned("xay", "xaaxxay")
    assert 0 <= twice.margin <= 1 and all(m == twice.margin for _, m in twice.margins)
    near = align.aligned("ab", "abab", None, [0, 1], [0, 0, 1, 1])
    assert {i for i, *_ in near.matches} == {0, 1}
    assert align.line_of("a\nb\r\nc", [0, 2, 5]) == [0, 1, 3]


def test_timestamps_and_their_codes():
    raw = [[0, 100], "x", [50, 52], [-3, 60], [900, 1003], [998, 1004], [5000, 6000], {"start": 500, "end": 700}, [400, 450], ["t", 800, 900]]
    kept, codes = tracks.timestamps(raw, 1.0, 10.0, 1010.0)
    assert kept[0] == (0, 10.0, 110.0) and codes[0] == "timestamp_pair_invalid:1" and "timestamp_interval_invalid:2" in codes
    assert "timestamp_not_monotonic:3" in codes and "timestamp_outside_window:6" in codes and "timestamp_collapsed_after_clamp:5" in codes
    assert tracks.timestamps("no list", 1.0, 0.0, None) == ([], [])


@pytest.mark.parametrize(
    ("record", "forced", "letters", "precision"),
    [
        ({"text": "hi yo", "timestamp": [[0, 100], [100, 200]]}, False, "hiyo", "token"),
        ({"text": "a b", "timestamp": [[0, 100], [100, 200]]}, False, "ab", "character"),
        ({"text": "abcd", "timestamp": [[0, 100], [100, 200]]}, False, "abcd", "token"),
        ({"text": "ab", "timestamp": [[0, 100], [100, 200]]}, False, "ab", "character"),
        ({"tokens": ["x", {"word": "y", "prob": 0.5}], "timestamp": [[0, 100], [100, 200]]}, False, "xy", "character"),
        ({"text": "q 0 100; r 100 200;", "timestamp": [[0, 100], [100, 200]]}, True, "re", "character"),
        ({"text": "ab 0 1; c 1 2; d 2 3", "timestamp": [[0, 100], [100, 200], [200, 300]]}, True, "abcd", "token"),
        ({"text": "", "timestamp": [[0, 100]]}, False, "", "unknown"),
        ({"sentence_info": [{"text": "hey", "start": 0, "end": 300, "score": 0.9}]}, False, "hey", "segment"),
    ],
)
def test_shapes_of_results(record, forced, letters, precision):
    told = tracks.heard([record], "re", forced)
    assert "".join(x[0] for x in told.letters) == letters
    assert max((x[4] for x in told.letters), key=tracks.RANK.__getitem__, default="unknown") == precision


def test_confidences_and_segments():
    told = tracks.heard({"text": "a b c", "timestamp": [[0, 100], [700, 800], [1400, 1500]], "scores": [0.5, True, 2]})
    assert [(x[3], x[5]) for x in told.letters] == [(0.5, 0), (None, 1), (None, 2)]
    voiced = tracks.heard({"text": "a b", "timestamp": [[0, 100], [700, 800]], "vad": [[0, 150], [600, 900]]})
    assert [x[5] for x in voiced.letters] == [0, 1] and voiced.voice == [(0.0, 150.0), (600.0, 900.0)]
    assert tracks.own_confidences({"score": 0.7}, 1) == [0.7] and tracks.own_confidences({"score": 0.7}, 2) == [None, None]
    assert tracks.heard([]).codes == ["timestamped_tokens_unavailable"]
    short = tracks.heard({"tokens": ["a"], "timestamp": [[0, 100], [100, 200]]})
    assert short.codes == ["timestamp_without_token:1"]


def test_tracks_of_results(spark):
    raw = result(text="a b c d", timestamp=[[0, 0.1], [0.1, 0.2], [0.2, 0.3], [0.3, 0.4]], scores=[0.9, 0.3, 0.8, 0.6], value=[[0, 0.4]])
    rows = [(1, raw, "A, b.\nc d e", "asr", False, True, 1000.0, 2000.0), (2, result(timestamp=[[0, 100]]), "abc", "asr", False, False, 0.0, None), (3, raw, "", "asr", False, True, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, raw string, transcript string, engine string, forced boolean, seconds boolean, first_ms double, last_ms double")
    got = {r.id: r for r in tracks.tracks_from_results(df, "id").collect()}
    one = got[1]
    assert (one.coverage, one.min_confidence, one.low_share, one.precision, one.valid) == (0.8, 0.3, 0.25, "character", True)
    assert [(s.a, s.start_ms, s.end_ms) for s in one.spans] == [(0, 1000.0, 1100.0), (1, 1100.0, 1200.0), (2, 1200.0, 1300.0), (3, 1300.0, 1400.0)]
    assert one.diagnostics == ["timestamp_unit:seconds", "matching_strategy:anchored_monotonic_dp"] and (one.voice[0].start, one.voice[0].end) == (1000.0, 1400.0)
    assert not got[2].spans and "vad_ranges_unavailable" in got[2].diagnostics and got[3].coverage == 0.0
    tokens = tracks.tokens_from_results(df, "id").where("id = 1").orderBy("position").collect()
    assert [(t.text, t.confidence_available) for t in tokens] == [(c, True) for c in "abcd"]
    assert [(r.start, r.end) for r in tracks.voice_ranges(df, "id").where("id = 1").collect()] == [(1000.0, 1400.0)]


def span(a, s, e, **kv):
    return {"a": a, "b": a + 1, "start_ms": s, "end_ms": e} | kv


def test_answers_by_the_error_policy(spark):
    def aligner(audio, text, first, last):
        if audio == "gone":
            raise tracks.Unavailable
        if audio == "odd":
            raise RuntimeError("anything")
        if audio == "bad":
            return [{"a": 0, "b": 1, "start_ms": 100, "end_ms": 50}]
        if audio == "worse":
            return "text"
        return {"spans": [{"a": i, "b": i + 1, "start_ms": first + 10 * i, "end_ms": first + 10 * i + 10, "model_confidence": 0.5} for i in range(len(text))]}

    rows = spark.createDataFrame([(k, a, "abcd", "e", 100.0, 200.0) for k, a in enumerate(["fine", "gone", "odd", "bad", "worse"])], "id long, audio string, transcript string, engine string, first_ms double, last_ms double")
    got = {r.id: r for r in tracks.invoked(rows, aligner, "id").collect()}
    assert set(got) == {0, 3, 4} and got[0].coverage == 1.0 and got[0].precision == "unknown" and got[0].mean_confidence == 0.5
    assert got[3].diagnostics == ["aligner_result_rejected:ValueError"] and not got[3].valid and got[4].diagnostics == ["aligner_result_rejected:TypeError"]
    assert tracks.invoked(rows, None, "id").count() == 0


def test_ranges_and_guards_of_tracks(spark):
    spans = [span(0, 0, 100, model_confidence=0.9, precision="character"), span(1, 100, 200, precision="token"), {"a": 4, "b": 8, "start_ms": 2000.0, "end_ms": 2400.0, "model_confidence": 0.2, "margin": 0.05}]
    track = tracks.coerced({"spans": spans, "coverage": 0.5, "vad_ranges": [(0, 150), (1900, 2100), (5000, 6000)]}, "e", 10)
    rows = spark.createDataFrame([(7, *(track[n] for n in tracks.TRACK.names))], StructType([StructField("track", LongType()), *tracks.TRACK]))
    asks = spark.createDataFrame([(7, 1, 0, 2, False, None), (7, 2, 0, 6, False, None), (7, 3, 0, 6, True, 1500.0), (7, 4, 2, 4, False, None), (7, 5, 5, 7, True, 10.0), (8, 6, 0, 2, False, None)], "track long, id long, low long, high long, cap boolean, max_gap_ms double")
    got = {r.id: r for r in tracks.track_ranges(asks, rows, "track", "id", 3).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1].start_ms, got[1].end_ms, got[1].coverage, got[1].precision, got[1].confidence_coverage, got[1].voice_start, got[1].voice_end) == (0.0, 200.0, 1.0, "token", 0.5, 0.0, 150.0)
    assert (got[2].start_ms, got[2].end_ms, round(got[2].coverage, 6), got[2].margin, got[2].voice_end) == (0.0, 2200.0, round(4 / 6, 6), 0.05, 2100.0)
    assert (got[5].start_ms, got[5].end_ms, got[5].coverage, got[5].low_share) == (2100.0, 2300.0, 0.5, 1.0)
    asks = spark.createDataFrame([(7, 1, 1, 2), (7, 2, 0, 1), (7, 3, 4, 8), (7, 4, 2, 4), (9, 5, 0, 1)], "track long, id long, low long, high long")
    sides = {r.id: (r.left_ms, r.right_ms) for r in tracks.range_guards(asks, rows, "track", "id").collect()}
    assert sides == {1: (100.0, 2000.0), 2: (None, 100.0), 3: (200.0, None), 4: (200.0, 2000.0), 5: (None, None)}
    crossed = rows.withColumn("spans", F.transform("spans", lambda s: s.withField("start_ms", F.when(s["a"] == 4, 20.0).otherwise(s["start_ms"]))))
    assert [(r.left_ms, r.right_ms) for r in tracks.range_guards(asks.where("id = 4"), crossed, "track", "id").collect()] == [(None, None)]
