import random

import math

from spanloom.operators import signals


def frame(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "id long, sample long, v double")


def test_envelope_keeps_a_part_of_a_block(spark):
    out = signals.envelope(frame(spark, [-1, 0.5, 1, -0.25, 0.75]), "id", 2).orderBy("block").collect()
    assert [(r.min, r.max) for r in out] == [(-1, 0.5), (-0.25, 1), (0.75, 0.75)]
    assert out[-1].rms == 0.75


def test_pyramid_levels(spark):
    out = signals.pyramid(frame(spark, range(128)), "id", 4, 4, 1, 128).groupBy("level", "block_size").count().orderBy("level").collect()
    assert [(r.block_size, r["count"]) for r in out] == [(4, 32), (8, 16), (16, 8), (32, 4)]


def test_extremes_survive_the_viewport(spark):
    v = [0.0] * 1000
    v[123], v[777] = -5.0, 7.0
    out = signals.viewport(signals.envelope(frame(spark, v), "id", 1), "id", 0, 1000, 20).collect()
    assert len(out) <= 20 and min(r.min for r in out) == -5 and max(r.max for r in out) == 7


def test_crossings(spark):
    sine = [math.sin(2 * math.pi * (i + 0.5) / 20) for i in range(200)]
    for i in range(135, 151):
        sine[i] = 0.0
    row = signals.best_crossing(frame(spark, sine), "id", 120, 0, 199, 40, 8).first()
    assert 135 <= row.crossing <= 150
    silent = signals.best_crossing(frame(spark, [0.0] * 100), "id", 10, 30, 50, 40, 2).first()
    assert silent.crossing == 30
    flat = signals.best_crossing(frame(spark, [1.0] * 100), "id", 10, 0, 50, 5, 2).first()
    assert flat.crossing == 10


def test_negative_zero_counts_as_negative(spark):
    out = signals.zero_crossings(frame(spark, [1.0, -0.0, 1.0]), "id").collect()
    assert sorted(r.sample for r in out) == [1, 2]


def test_loudest_channel_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.5)], "id long, channel int, sample long, v double")
    assert signals.loudest_channel(df, ["id"]).first().channel == 0


def test_edges_of_a_burst(spark):
    v = [0.001] * 100 + [1.0] * 50 + [0.001] * 100
    out = sorted((r.kind, r.edge) for r in signals.energy_edges(frame(spark, v), "id", 2, 1).collect())
    assert [k for k, _ in out] == ["end", "start"] and 98 <= dict(out)["start"] <= 101 and 149 <= dict(out)["end"] <= 152


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    values = [round(rng.choice([0.0, 0.001, 1.0]) * rng.uniform(-1, 1), 3) for _ in range(300)]
    whole = [sorted(map(tuple, f(frame(spark, values)).collect())) for f in (lambda d: signals.energy_edges(d, "id", 4, 2), lambda d: signals.zero_crossings(d, "id"), lambda d: signals.resampled(d, "id", 24_000))]
    monkeypatch.setattr(signals, "BLOCK", 7)
    cut = [sorted(map(tuple, f(frame(spark, values)).collect())) for f in (lambda d: signals.energy_edges(d, "id", 4, 2), lambda d: signals.zero_crossings(d, "id"), lambda d: signals.resampled(d, "id", 24_000))]
    assert whole == cut and all(whole)
