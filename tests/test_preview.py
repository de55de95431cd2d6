"""Previewed steps: leads, waiting and order; batches that confirm or take back; the tracked part of batches; odd rows."""

import math
import random

import pytest

from waymark.operators import motion, preview, stateful
from waymark.streaming.runs import finish, parquet_source

NAMES = "shown xs ys reason waiting steps metres x y ahead ahead_m".split()


def fold(rows, kernel=preview.PREVIEW):
    state, out = None, []
    for r in rows:
        state, told = kernel.step(state, r)
        out.append(dict(zip(NAMES, told, strict=True)))
    return out


def peaks(n, start=0, every=600, **more):
    base = {"tracking": True, "heading": 0.0, "stride": 0.7, "steps": 0, "metres": 0.0, "through": None, "cadence": None} | more
    return [(start + k, 10_000 + every * k if k else None, *base.values()) for k in range(n + 1)]


def test_before_anything_is_confirmed_thirty_steps_or_24_metres_lead():
    assert fold(peaks(60, stride=0.7))[-1]["steps"] == 30 and fold(peaks(60, stride=1.0))[-1]["steps"] == 24
    assert fold(peaks(60))[-1]["reason"] == "waits: steps" and fold(peaks(60, stride=1.0))[-1]["reason"] == "waits: metres"
    assert fold(peaks(60, steps=5, metres=3.5, stride=0.5))[-1]["steps"] == 17  # 5 confirmed and 12 ahead
    assert fold(peaks(60, steps=5, metres=3.5, stride=1.0))[-1]["steps"] == 13  # 13.5 m are 10 ahead


def test_a_lagging_confirmation_has_eight_seconds():
    rows = peaks(60, through=10_000, every=500)
    out = fold(rows)
    assert all(o["waiting"] == 0 for o in out[:17]) and out[-1]["ahead"] == 16 and out[-1]["reason"] == "waits: steps"


@pytest.mark.parametrize("seed", range(5))
def test_peaks_are_shown_in_order_and_never_lead_too_far(seed):
    pick = random.Random(seed)
    rows, count, ms, through, came = [(0, None, True, 0.0, 0.7, 0, 0.0, None, None)], 0, 10_000, None, []
    for _ in range(400):
        more, ms = pick.choice([0, 1, 1, 1, 2]), ms + pick.choice([300, 600, 900])
        count += more
        came += [ms] * more
        if pick.random() < 0.04:
            through = ms - pick.choice([0, 2000, 5000])
        rows.append((count, ms, True, pick.random() * 360, pick.choice([0.5, 0.7, 0.9, 9.0, None]), count, 0.7 * count, through, None))
    out = fold(rows)
    shown = [p for o in out for p in o["shown"]]
    assert shown == sorted(shown) and set(shown) <= set(came)
    for r, o, before in zip(rows[1:], out[1:], out, strict=False):
        if r[7] is not None and r[1] - r[7] > 8_000 and o["shown"]:
            assert o["ahead"] <= 12 and o["ahead_m"] <= 10 + 1e-9
        assert o["steps"] - before["steps"] == len(o["shown"]) and o["waiting"] <= 40
    assert out[-1]["metres"] == pytest.approx(sum(math.hypot(x - a, y - b) for o, p in zip(out[1:], out, strict=False) for (x, y), (a, b) in zip(zip(o["xs"], o["ys"], strict=True), [(p["x"], p["y"]), *zip(o["xs"], o["ys"], strict=True)], strict=False)))


def test_reasons():
    after = lambda *rows: [o["reason"] for o in fold(list(rows))]
    r = lambda count, ms, tracking=True, heading=0.0, cadence=None: (count, ms, tracking, heading, 0.7, 0, 0.0, None, cadence)
    assert after(r(5, 1000), r(6, 1100), r(7, 1900), r(8, 4000), r(9, 4600, cadence=4.0), r(10, 5100, cadence=2.0)) == ["begin", "dense", None, "sparse", None, None]
    assert after(r(5, 1000), r(6, 1350, cadence=1.0), r(6, 1400), r(7, None), r(8, 2000, False), r(9, 2500, heading=None), r(2, 3000), r(None, 1)) == ["begin", "cadence", None, "no time", "not tracking", "no heading", "begin", None]


def test_stopped_tracking_forgets_what_waits_and_too_many_overflow():
    rows = peaks(60)
    assert fold([*rows, (61, 10**6, False, 0.0, 0.7, 0, 0.0, None, None)])[-1]["waiting"] == 0
    many = fold([(0, None, True, 0.0, 0.7, 9, 6.3, None, None), (500, 10_000, True, 0.0, 0.7, 0, 0.0, None, None)])[-1]
    assert many["steps"] == 30 and many["waiting"] == 10


def test_table_and_stream_agree(spark, tmp_path):
    rows = [(s, k, *r) for s in range(3) for k, r in enumerate(peaks(50, every=500 + 100 * s, through=10_000 if s else None))]
    table = spark.createDataFrame(rows, "session long, seq long, " + preview.PREVIEW.inputs)
    want = {str(tuple(r)) for r in stateful.replay(table, "session", "seq", preview.PREVIEW).collect()}
    for part in range(3):
        table.where(f"seq >= {20 * part} and seq < {20 * part + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = finish(stateful.stream(parquet_source(spark, str(tmp_path / "in"), 1), "session", "seq", preview.PREVIEW))
    assert {str(tuple(r)) for r in got.collect()} == want


def test_a_batch_confirms_or_takes_back(spark):
    steps = spark.createDataFrame([(1, 1000 * k, 0.0, 0.7, 0.7) for k in range(1, 7)], "session int, ms long, dx double, dy double, metres double")
    batches = spark.createDataFrame([(1, 4500, 3000, 0.0, 2.1), (1, 6500, 5000, 1.0, 3.5)], "session int, ms long, through long, x double, y double")
    samples = spark.createDataFrame([(1, k, 1000 * k + 700) for k in range(8)] + [(2, 0, 5)], "session int, seq int, ms long")
    out = {(r.session, r.seq): r for r in preview.reconciled(samples, batches, steps, "session").collect()}
    assert [round(out[1, k].y, 6) for k in range(8)] == [0, 0.7, 1.4, 2.1, 2.8, 3.5, 4.2, 4.2] and [out[1, k].ahead for k in range(8)] == [0, 1, 2, 3, 1, 2, 1, 1]
    assert [round(out[1, k].taken_back, 6) for k in range(8)] == [0, 0, 0, 0, 0, 0, 1, 0] and out[2, 0].y == 0
    assert preview.reconciled(samples.limit(0), batches, steps, "session").count() == 0


def test_tracked_parts_add_up(spark):
    batches = [
        (1, 1, 10, 0, 10_000, None, True), (1, 2, 10, 10_000, 20_000, None, True), (1, 3, 5, 20_000, 30_000, [21_000, 22_000, 29_000, 40_000], True),
        (1, 4, 6, None, 30_000, None, False), (1, 5, 6, 30_000, 30_000, [1], True), (2, 1, 7, 0, 1000, [], True), (1, 6, 4, 24_000, 30_000, None, True),
    ]
    turns = [(1, 4_000, False), (1, 8_000, True), (1, 15_000, False), (1, 15_500, False), (1, 28_000, True), (1, 30_000, False)]
    from pyspark.sql import functions as F

    out = preview.tracked_part(
        spark.createDataFrame(batches, "session int, batch int, steps int, a long, b long, peaks array<long>, on boolean"), spark.createDataFrame(turns, "session int, at long, on boolean"), "session", F.lit(True)
    )
    got = {(r.session, r.batch): (r.kept, round(r.fraction, 4), r.from_ms, r.to_ms, r.peaks) for r in out.collect()}
    assert got == {
        (1, 1): (6, 0.6, 0, 10_000, None), (1, 2): (5, 0.5, 10_000, 15_000, None), (1, 3): (2, 0.3333, 28_000, 30_000, [29_000]), (1, 4): (0, 0.0, None, 30_000, None),
        (1, 5): (6, 1.0, 30_000, 30_000, [1]), (2, 1): (7, 1.0, 0, 1000, []), (1, 6): (1, 0.3333, 28_000, 30_000, None),
    }


def test_offsets_follow_the_nearer_end_and_are_held():
    def run(rows):
        state, out = None, []
        for r in rows:
            state, told = motion.WALK_OFFSET.step(state, r)
            out.append(told)
        return out

    walk = lambda ms, **more: tuple(({"ms": ms, "swinging": True, "net": 0.0, "walk": 200.0, "sure": 0.9, "heading": 0.0} | more).values())
    followed = run([walk(100 * k) for k in range(200)])
    assert followed[-1][0] == pytest.approx(20.0, abs=0.1) and followed[5][1]  # 200 is 20 seen from its other end
    assert max(abs(o) for o, _ in run([walk(100 * k, walk=85.0) for k in range(400)])) <= 60.0
    assert run([walk(0), walk(100, net=25.0), walk(1500)])[-1] == run([walk(0), walk(100, net=25.0)])[-1]
    assert run([*(walk(100 * k) for k in range(50)), walk(5000 + 12_000, swinging=False)])[-1][0] == pytest.approx(followed[49][0] * math.exp(-12.1 / 12), rel=1e-3)
    assert run([walk(0, sure=0.1), walk(100, walk=None), walk(200, heading=None), (None,) * 6])[-1] == (0.0, False)
