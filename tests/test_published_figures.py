"""Published figures whose inputs are published beside them, as fixed values."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import change
from ledgerline.plans.stand_in import STABLE

# Northern and southern median, premium in per cent.
HALVES = [(1532.5586, 1333.3333, 14.9419), (1644.4183, 1451.8344, 13.2649), (1772.5333, 1665.8471, 6.4043), (1826.5634, 1666.19, 9.6252)]
# Mean move, mean dispersion, ratio, stable.
STABILITY = [
    (10.8267, 9.719, 1.114, False), (10.9688, 5.308, 2.0665, False), (11.7628, 5.5555, 2.1173, False), (7.2457, 6.1416, 1.1798, False), (9.3723, 6.6423, 1.411, False),
    (3.0803, 11.6361, 0.2647, True), (4.2454, 17.5109, 0.2424, True), (4.8192, 18.7839, 0.2566, True), (2.9497, 67.7982, 0.0435, True),
]
# Price a litre, units a litre, unit cost, multiple of 209.5.
SELF_GENERATION = [(1266.33, 2.5, 506.53, 2.42), (1266.33, 3.0, 422.11, 2.01), (1266.33, 3.5, 361.81, 1.73), (1266.33, 4.0, 316.58, 1.51)]
# Cheapest, dearest, spread, ratio.
LOCATIONS = [(980.88, 6777.45, 5796.57, 6.91), (730.24, 1690.91, 960.67, 2.32), (850.98, 1803.1, 952.13, 2.12)]
# Label as printed, normalised label, prefix that decides, mode.
MODES = [
    ("Air fare charg.for specified routes single journey", "air fare charg.for specified routes single journey", "air fare", "AIR"),
    ("Bus journey intercity, state route, charg. per per", "bus journey intercity, state route, charg. per per", "bus journey intercity", "BUS_INTERCITY"),
    ("Bus journey within  city , per  drop constant  rou", "bus journey within city , per drop constant rou", "bus journey within", "BUS_INTRACITY"),
    ("Journey by motorcycle (okada) per drop", "journey by motorcycle (okada) per drop", "journey by motorcycle", "OKADA"),
    ("Water transport : water way passenger  transportat", "water transport : water way passenger transportat", "water transport", "WATER"),
]


def test_premium_of_halves(spark):
    got = spark.createDataFrame([h[:2] for h in HALVES], "a double, b double").select(change.ratio_pct(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([h[2] for h in HALVES], abs=2e-4)


def test_four_metrics_are_stable(spark):
    rows = spark.createDataFrame([s[:2] for s in STABILITY], "m double, c double").select(F.try_divide("m", "c").alias("r"), (F.try_divide("m", "c") < STABLE).alias("s")).collect()
    assert [r["r"] for r in rows] == pytest.approx([s[2] for s in STABILITY], abs=2e-4)
    assert [r["s"] for r in rows] == [s[3] for s in STABILITY] and sum(r["s"] for r in rows) == 4


def test_self_generation_and_locations(spark):
    rows = spark.createDataFrame([s[:2] for s in SELF_GENERATION], "p double, e double").select(F.round(F.col("p") / F.col("e"), 2), F.round(F.try_divide(F.col("p") / F.col("e"), F.lit(209.5)), 2)).collect()
    assert [tuple(r) for r in rows] == [s[2:] for s in SELF_GENERATION]
    rows = spark.createDataFrame([x[:2] for x in LOCATIONS], "lo double, hi double").select(F.col("hi") - F.col("lo"), F.try_divide("hi", "lo")).collect()
    for row, (_, _, spread, ratio) in zip(rows, LOCATIONS, strict=True):
        assert row[0] == pytest.approx(spread, abs=0.011) and round(row[1], 2) == ratio


def test_labels_resolve_to_modes(spark):
    df = spark.createDataFrame([(m[0],) for m in MODES], "x string")
    name = labels.normalise(F.col("x"))
    mode = F.coalesce(*[F.when(name.startswith(p), k) for _, _, p, k in sorted(MODES, key=lambda m: -len(m[2]))])
    assert [tuple(r) for r in df.select(name, mode).collect()] == [(m[1], m[3]) for m in MODES]
