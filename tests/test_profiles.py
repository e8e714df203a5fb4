"""Profiles by tiles of the contig: their work doesn't follow pairs of fragments and regions, and tiles leave no seams."""

import random

import numpy as np
import pytest

from fragspark.operators import profiles
from fragspark.plans import catalog

FRAGMENT = "contig string, start bigint, stop bigint, mapq int, is_forward boolean"
REGION = "contig string, start bigint, stop bigint, name string, idx bigint"


def shuffled(spark, frame):
    """Rows that a frame's run writes to shuffles."""
    context = spark.sparkContext
    gateway, jvm = context._gateway, context._jvm

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    frame.write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.fixture(scope="module")
def deep(spark):
    """300 fragments and 300 regions that all meet: 90,000 pairs, 60,000 positions of regions."""
    rng = random.Random(3)
    rows = [("c1", s := rng.randint(4000, 4150), s + rng.randint(120, 180), 60, rng.random() < 0.5) for _ in range(300)]
    return spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame([("c1", 4000 + i % 7, 4200 + i % 7, ".", i) for i in range(300)], REGION)


def test_cleavage_does_not_shuffle_pairs(spark, deep):
    assert shuffled(spark, profiles.cleavage_profile(*deep)) < 10_000


def test_scores_do_not_shuffle_pairs(spark, deep):
    assert shuffled(spark, profiles.wps(*deep)) < 10_000


def test_scores_of_odd_windows_do_not_shuffle_pairs(spark, deep):
    assert shuffled(spark, profiles.wps(*deep, window_size=121)) < 10_000


@pytest.fixture(scope="module")
def seams(spark):
    """Fragments around the ends of tiles, short, long and empty, and regions that begin, end and lie there; one where nothing is known."""
    rng, t = random.Random(4), profiles.TILE
    rows = [(f"c{rng.randint(1, 2)}", s := max(0, rng.choice([0, t, 2 * t, 5 * t]) + rng.randint(-150, 150)), s + rng.choice([0, 1, rng.randint(20, 300), 3 * t]), 60, rng.choice([True, False, None])) for _ in range(600)]
    regions = [(f"c{rng.randint(1, 2)}", s := max(0, rng.choice([0, t, 2 * t, 5 * t]) + rng.randint(-40, 40)), s + rng.choice([0, 1, 40, 90]), ".", i) for i in range(40)]
    regions += [("c1", t, 2 * t, ".", 40), ("c2", 3 * t + 7, 3 * t + 20, ".", 41), ("c3", 5, 9, ".", 42), (None, 5, 9, ".", 43)]
    return rows, regions, spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame(regions, REGION)


@pytest.mark.parametrize("window", [40, 41, 150, 151, 400])  # the last is too wide for fragments of 300 bases, which are joined to each region
def test_scores_at_seams(seams, window):
    rows, regions, f, r = seams
    got = {(x["idx"], x["start"]): x["wps"] for x in profiles.wps(f, r, window, 0, 300).collect()}
    assert len(got) == sum(b - a for _, a, b, _, _ in regions)
    for contig, start, stop, _, idx in regions:
        near = [x for x in rows if x[0] == contig and x[2] - x[1] <= 300 and max(start - 300, 0) <= (x[1] + x[2]) // 2 < stop + 300]
        a, b = np.array([x[1] for x in near]), np.array([x[2] for x in near])
        for c in range(start, stop):
            low, high = np.rint(c - window / 2), np.rint(c + window / 2 - 1)
            ends = ((low <= a) & (a <= high)) | ((low <= b) & (b <= high))
            assert got[idx, c] == ((a < low) & (b > high)).sum() - ends.sum(), (idx, c)


def test_cleavage_at_seams(seams):
    rows, regions, f, r = seams
    got = {(x["idx"], x["pos"]): x["proportion"] for x in profiles.cleavage_profile(f, r).collect()}
    assert len(got) == sum(b - a for _, a, b, _, _ in regions)
    for contig, start, stop, _, idx in regions:
        near = [x for x in rows if x[0] == contig and x[2] > start and x[1] < stop]
        a, b, end = np.array([x[1] for x in near]), np.array([x[2] for x in near]), np.array([x[1] if x[4] else x[2] for x in near])
        for p in range(start, stop):
            depth = ((a <= p) & (b > p)).sum()
            assert got[idx, p] == (100.0 * (end == p).sum() / depth if depth else 0), (idx, p)


@pytest.fixture
def on_deep(spark, deep, monkeypatch):
    """Rows that a query of the catalog writes to shuffles, on the deep tables."""
    monkeypatch.setattr(catalog, "view", lambda spark, d, name: dict(zip(("fragments", "regions"), deep, strict=True))[name])
    return lambda name: shuffled(spark, catalog.QUERIES[name](spark, ""))


def test_adjusted_scores_do_not_shuffle_bases(on_deep):
    assert on_deep("adjust_wps") < 10_000


def test_edges_do_not_shuffle_bases(on_deep):
    assert on_deep("edge_subtract") <= 300


@pytest.mark.parametrize("query", ["running_median_adjust", "running_mean_adjust"])
def test_running_windows_do_not_shuffle_bases(on_deep, query):
    assert on_deep(query) <= 300


@pytest.fixture(scope="module")
def signals(spark):
    """The same signal with a row a base, a row a region, and rows of a few bases; regions of 0 to 150 bases."""
    rng = random.Random(5)
    regions = [(i, f"c{i % 2}", rng.randint(0, 500), [float(rng.randint(0, 9)) for _ in range(n)]) for i, n in enumerate([0, 1, 3, 7, 8, 9, 40, 150])]
    bases = [(i, c, at + k, v) for i, c, at, values in regions for k, v in enumerate(values)]
    cut = [(i, c, at + k, values[k : k + 6]) for i, c, at, values in regions for k in range(0, len(values), 6)]
    rows = "idx bigint, contig string, at bigint, values array<double>"
    return spark.createDataFrame(bases, "idx bigint, contig string, pos bigint, value double"), spark.createDataFrame(regions, rows), spark.createDataFrame(rng.sample(cut, len(cut)), rows)


def rows_of(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=str)


@pytest.mark.parametrize("smooth", [None, (5, 2)])
@pytest.mark.parametrize("mean", [True, False])
def test_adjusting_is_the_same_by_bases_regions_and_pieces(signals, mean, smooth):
    bases, regions, cut = signals
    expected = rows_of(profiles.adjust(bases, 8, mean, 3, smooth))
    assert {r[3] for r in expected} > {"ok"}
    assert rows_of(profiles.adjust(regions, 8, mean, 3, smooth, whole=True)) == expected
    assert rows_of(profiles.adjust(cut, 8, mean, 3, smooth)) == expected


@pytest.mark.parametrize("edge", [1, 5, 200])
def test_edges_and_means_are_the_same_by_bases_and_regions(signals, edge):
    bases, regions, _ = signals
    assert rows_of(profiles.edges_subtracted(regions, edge)) == rows_of(profiles.edges_subtracted(bases, edge))
    assert rows_of(profiles.running_mean_adjusted(regions, 8)) == rows_of(profiles.running_mean_adjusted(bases, 8))


def test_edges_pass_over_nulls(spark):
    regions = spark.createDataFrame([(1, "c", 5, [None, 4.0, 1.0, 2.0]), (2, "c", 5, [None, None, 1.0, None]), (3, "c", 5, None)], "idx bigint, contig string, at bigint, values array<double>")
    bases = profiles.spread(regions)
    assert rows_of(profiles.edges_subtracted(regions, 2)) == rows_of(profiles.edges_subtracted(bases, 2))
