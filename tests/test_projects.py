import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import labels
from spanloom.operators import projects, refine

CUT = "id long, key long, predicted_start long, predicted_end long, left_guard long, right_guard long, vad_start long, vad_end long"
RATE = 8000


def voice(n, on, off, hum=0.0):
    """A tone from sample on to off, over hum."""
    t = np.arange(n)
    return np.where((t >= on) & (t < off), 0.5 * np.sin(2 * np.pi * 200 * t / RATE + 0.4), hum * np.sin(2 * np.pi * 50 * t / RATE))[:, None]


def test_boundaries_move_to_edges_and_crossings():
    pcm = voice(8000, 3000, 5000)
    r = refine.cut_at(pcm, 2900, 5100, RATE, (2500, 5500))
    assert r["start_edge"].method == r["end_edge"].method == "energy" and abs(r["refined_start"] - 3000) <= 60 and abs(r["refined_end"] - 5000) <= 60
    assert not r["expanded"] and r["reasons"] == [] and pcm[r["start_crossing"]] * pcm[r["start_crossing"] - 1] <= 0
    silent = refine.cut_at(np.zeros((8000, 1)), 2900, 5100, RATE)
    assert (silent["refined_start"], silent["refined_end"]) == (2900, 5100) and silent["reasons"] == ["start_speech_edge_missing", "end_speech_edge_missing", "start_zero_crossing_missing", "end_zero_crossing_missing"]


def test_no_guard_no_outward_move():
    pcm = voice(8000, 2990, 5010)
    kept = refine.cut_at(pcm, 3000, 5000, RATE)
    assert kept["refined_start"] >= 3000 and kept["refined_end"] <= 5000
    grown = refine.cut_at(pcm, 3000, 5000, RATE, (2000, 6000))
    assert grown["expanded"] and grown["refined_start"] < 3000 and grown["refined_end"] > 5000 and grown["reasons"][-1] == "boundary_expanded"
    near = refine.cut_at(pcm, 3000, 5000, RATE, (2930, 5070))
    assert near["refined_start"] >= 2930 + RATE * 5 // 1000 and near["refined_end"] <= 5070 - RATE * 5 // 1000


def test_voice_edges_win_and_conflicts_keep_the_prediction():
    pcm = voice(8000, 3000, 5000, hum=0.01)
    r = refine.cut_at(pcm, 2990, 5010, RATE, (2000, 6000), (3100, 4900))
    assert (r["start_edge"].method, r["start_edge"].at, r["end_edge"].at) == ("vad", 3100, 4900) and abs(r["refined_start"] - 3100) <= 64
    far = refine.cut_at(pcm, 2990, 5010, RATE, (2000, 6000), (100, 7900))
    assert far["start_edge"].method == "energy"
    r = refine.cut_at(pcm, 3000, 5000, RATE, (4990, 3100))
    assert (r["refined_start"], r["refined_end"]) == (3000, 5000) and r["reasons"][0] == "adjacent_guard_conflict"
    stereo = np.concatenate([voice(8000, 3000, 5000), -voice(8000, 3000, 5000)], axis=1)
    assert refine.cut_at(stereo, 2900, 5100, RATE)["start_edge"].method == "energy"


def plain_crossing(v, at, low, high, reach, side):
    """Brute force: the crossing of least score, sample by sample."""
    a, b = max(0, low, at - reach), min(len(v) - 1, high, at + reach)
    rms = {i: (sum(v[j] ** 2 for j in range(max(a, i - side), min(b, i + side) + 1)) / (min(b, i + side) - max(a, i - side) + 1)) ** 0.5 for i in range(a, b + 1)}
    peak = max(rms.values(), default=0) or 1.0
    found = [i for i in range(a, b + 1) if v[i] == 0 or (i > a and np.signbit(v[i]) != np.signbit(v[i - 1]))]
    return min(found, key=lambda i: (round(0.75 * rms[i] / peak + 0.25 * abs(i - at) / max(1, reach), 9), i), default=None)


def test_crossings_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(80):
        v = np.round(rng.normal(0, 1, 200), 1) + rng.choice([0.0, 1.5])
        at, low, high = rng.integers(0, 200), rng.integers(0, 100), rng.integers(100, 220)
        assert refine.crossing(v, at, 1000, low, high, 20) == plain_crossing(v, at, low, high, 20, 2)


def test_refine_rows(spark):
    pcm = voice(8000, 3000, 5000)[:, 0]
    signal = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(pcm)], "key long, sample long, v double")
    rows = spark.createDataFrame([(1, 1, 2900, 5100, 2500, 5500, None, None), (2, 1, 10, 12, None, None, None, None), (3, 2, 10, 500, None, None, None, None), (4, 1, 0, 8000, None, None, None, None)], CUT)
    got = {r.id: r for r in refine.refine(rows, signal, "id", "key", RATE).collect()}
    want = refine.cut_at(pcm[:, None], 2900, 5100, RATE, (2500, 5500))
    assert (got[1].refined_start, got[1].refined_end, got[1].review_required) == (want["refined_start"], want["refined_end"], False)
    assert got[2].refined_start is None and got[3].refined_start is None and got[4].refined_end <= 8000 and len(got) == 4


def test_applied(spark):
    cand = spark.createDataFrame([(1, 0, 10, ["a"], "auto_approved"), (2, 0, 2, [], "auto_approved"), (3, 0, 9, [], "approved")], "id long, start long, end long, reasons array<string>, status string")
    r = spark.createDataFrame([(1, 1, 9, True, False), (2, None, None, None, None), (3, 2, 8, False, True)], "id long, refined_start long, refined_end long, review_required boolean, expanded boolean")
    got = {x.id: x for x in refine.applied(cand, r, "id").collect()}
    assert (got[1].start, got[1].end, got[1].reasons, got[1].status) == (1, 9, ["a", "boundary_refinement_evidence_incomplete"], "needs_review")
    assert (got[2].start, got[2].end, got[2].status) == (0, 2, "auto_approved")
    assert (got[3].start, got[3].reasons, got[3].status) == (2, ["boundary_expanded_for_speech_edge"], "approved")


def test_changes_and_gate(spark):
    a = spark.createDataFrame([("x", 1, 1, "s"), ("y", 1, 1, "s")], "path string, size long, modified long, sha256 string")
    b = spark.createDataFrame([("x", 1, 2, "s"), ("z", 1, 1, "s")], "path string, size long, modified long, sha256 string")
    assert sorted(map(tuple, projects.changed_files(a, b).collect())) == [("x", "changed"), ("y", "removed"), ("z", "added")]
    cand = spark.createDataFrame([(1, "approved"), (2, "needs_review")], "p long, status string")
    src = spark.createDataFrame([(1, "a", "a", "s", "s"), (2, "a", "a", "s", "s"), (3, "a", None, "s", "s")], "p long, sha256 string, stored_sha256 string, shape string, stored_shape string")
    assert {r.p: r.ready for r in projects.export_gate(cand, src, ["p"]).collect()} == {1: True, 2: False, 3: False}


def test_annotation_edits(spark):
    marks = spark.createDataFrame([("a", 1, 5, True, ["x"]), ("b", 7, 9, None, None)], "id string, start long, end long, review_required boolean, review_reasons array<string>")
    old = {r.id: (r.review_required, r.review_reasons) for r in projects.with_defaults(marks).collect()}
    assert old == {"a": (True, ["x"]), "b": (True, ["legacy_boundary_precision_unknown"])}
    seen = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.review_required for r in projects.confirmed(projects.with_defaults(marks), seen, ["id"]).collect()} == {"a": False, "b": True}
    assert [r.id for r in projects.without(marks, seen, ["id"]).collect()] == ["b"]
    edits = spark.createDataFrame([(1, "n", 3, 7, 2, 8), (1, "m", 20, 30, None, None), (2, "o", 3, 7, None, None)], "p long, id string, start long, end long, wave_start long, wave_end long")
    old = marks.selectExpr("1L AS p", "id", "start", "end").union(spark.createDataFrame([(1, "z", 50, 60)], "p long, id string, start long, end long"))
    assert {(r.p, r.id): (r.start, r.end) for r in projects.widened(old, edits, ["p"]).collect()} == {(1, "a"): (1, 9), (1, "z"): (50, 60), (1, "m"): (20, 30), (2, "o"): (3, 7)}


def test_labels(spark):
    row = spark.createDataFrame([("abc abd abc", 44100 * 2, "/x/y.tar.gz", "2024-01-02T03:04:05Z")], "t string, r long, p string, d string")
    got = row.select(
        labels.excerpt(F.col("t"), F.lit(4), F.lit(7), 2).alias("e"), labels.is_repeated(F.col("t"), F.lit("abc"), F.lit(""), F.lit(" abd")).alias("rep"), labels.mp3_rate(F.col("r")).alias("mp3"), labels.output_name(F.col("p"), "_cut.wav").alias("name"),
        labels.iso_with_zone(F.col("d")).alias("iso"), labels.iso_with_zone(F.lit("2024-01-02T03:04:05")).alias("no"), labels.next_match(F.col("t"), "abc", F.lit(1)).alias("ahead"), labels.next_match(F.col("t"), "abc", F.lit(9)).alias("around"),
        labels.reason_label(F.lit("edge_gone"), {"a": "b"}).alias("label"), labels.clock_ms(F.lit(61234)).alias("clock"),
    ).first()
    assert tuple(got.e) == ("c abd a", 2, 5) and got.rep is False and got.mp3 == 44100 and got.name == "y.tar_cut.wav"
    assert (got.iso, got.no, got.ahead, got.around, got.label, got.clock) == (True, False, 8, 0, "edge gone", "1:01.234")
    assert projects.json_depth_problems({"a": [1, float("nan"), {1: 2}]}) == ["not_finite", "key"]
