import random

from pyspark.sql import functions as F

from spanloom.operators import intervals, segments


def frame(spark, rows, names="project long, start long, end long"):
    return spark.createDataFrame(rows, names)


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_merge_clamps_and_joins_touching(spark):
    df = frame(spark, [(1, 20, 30), (1, -5, 3), (1, 3, 8), (1, 25, 40), (1, 99, 120)])
    assert values(intervals.merge(df, ["project"], 0, 100), "start", "end") == [(0, 8), (20, 40), (99, 100)]


def test_complement_and_crossfade(spark):
    df = frame(spark, [(1, 1000, 2000), (1, 1500, 2500), (1, 7000, 8000)])
    kept = intervals.complement(intervals.merge(df, ["project"]), ["project"], 0, 10000)
    assert values(kept, "start", "end") == [(0, 1000), (2500, 7000), (8000, 10000)]
    row = intervals.edited_length(kept, ["project"], 384).first()
    assert (row.pieces, row.kept_length, row.kept_raw) == (3, 7500 - 2 * 384, 7500)


def test_merge_is_idempotent_and_tiles_the_window(spark):
    random.seed(3)
    rows = [(k % 5, s, s + random.randint(1, 9)) for k in range(200) for s in [random.randint(0, 300)]]
    df = frame(spark, rows)
    merged = intervals.merge(df, ["project"], 0, 320)
    again = intervals.merge(merged, ["project"])
    assert values(merged, "project", "start", "end") == values(again, "project", "start", "end")
    both = merged.unionByName(intervals.complement(merged, ["project"], 0, 320))
    assert {r.n for r in both.groupBy("project").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()} == {320}


def test_overlaps_equal_the_direct_predicate(spark):
    random.seed(4)
    make = lambda n: [(s, s + random.randint(1, 40), k) for k in range(n) for s in [random.randint(0, 500)]]
    left, right = make(80), make(80)
    l = spark.createDataFrame([(1, *x) for x in left], "p long, l_start long, l_end long, a long")
    r = spark.createDataFrame([(1, *x) for x in right], "p long, r_start long, r_end long, b long")
    for strict in (True, False):
        got = values(intervals.overlaps(l, r, ["p"], 16, strict), "a", "b")
        want = sorted((a, b) for s, e, a in left for t, f, b in right if (f > s and t < e if strict else f >= s and t <= e))
        assert got == want


def tokens(spark, spans):
    return spark.createDataFrame([(1, s, e) for s, e in spans], "user long, start long, end long")


def test_segments(spark):
    df = tokens(spark, [(0, 200), (250, 450), (1000, 1200), (31500, 31700)])
    out = segments.by_gap_or_length(df, ["user"], ["start"], "start", "end", 500, 30000).orderBy("token").collect()
    assert [r.segment for r in out] == [0, 0, 1, 2]
    long = tokens(spark, [(k * 100, k * 100 + 90) for k in range(10)])
    out = segments.by_gap_or_length(long, ["user"], ["start"], "start", "end", 500, 300).orderBy("token").collect()
    assert [r.segment for r in out] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_voice_boundaries(spark):
    toks = spark.createDataFrame([(1, 0, 1100.0), (1, 1, 1300.0), (1, 2, 2200.0), (1, 3, 2400.0)], "user long, token long, mid double")
    voice = spark.createDataFrame([(1, 900, 1500), (1, 2000, 2600)], "user long, start long, end long")
    assert values(segments.by_voice(toks, voice, "user"), "token", "boundary") == [(2, 1750.0)]


def test_rejected_rows_do_not_move_the_state(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 100.0, 110.0), (1, 2, 50.0, 500.0), (1, 3, 105.0, 120.0)], "u long, k long, s double, e double")
    out = segments.accepted_timestamps(rows, ["u"], ["k"], "s", "e").orderBy("token").collect()
    assert [r.code for r in out] == [None, None, "timestamp_not_monotonic", None]


def test_guards(spark):
    df = tokens(spark, [(0, 10), (12, 20), (30, 40)])
    assert values(intervals.guards(df, ["user"], ["start"], "start", "end").where("start = 12"), "left_guard", "right_guard") == [(10, 30)]
    crossed = tokens(spark, [(0, 50), (12, 20), (30, 40)])
    row = intervals.guards(crossed, ["user"], ["start"], "start", "end").where("start = 12").first()
    assert row.left_guard is None and row.right_guard is None
