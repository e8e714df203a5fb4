"""Per-position profiles: protection scores, cleavage, and their smoothing.

Scores are running sums over events. A fragment changes a score at its ends alone, so it
emits a few (position, change) rows. They are counted once a position of the contig, however many fragments and regions
meet there, and summed up along tiles of the contig; a region then cuts its pieces out of the tiles.
So work follows fragments plus positions, not their product, and neither pairs nor positions of regions are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.functions import kernels
from fragspark.functions.sequence import midpoint
from fragspark.operators.fragments import select_fragments
from fragspark.operators.intervals import interval_join

#: Bases of a contig whose values are one row, and their bits in a position.
BITS = 12
TILE = 1 << BITS


def positions(regions: DataFrame) -> DataFrame:
    """(idx, contig, pos): every base of every region."""
    return regions.where("stop > start").select("idx", "contig", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))


def running_sum(regions: DataFrame, events: DataFrame) -> DataFrame:
    """(idx, contig, pos, value): events (idx, pos, change) summed up to each base; those before a region count from its start."""
    spine = positions(regions).select("idx", "contig", "pos", F.lit(0).cast("bigint").alias("change"), F.lit(True).alias("base"))
    starts = regions.select("idx", "contig", "start", "stop")
    inside = events.join(starts, "idx").where(F.col("pos") < F.col("stop"))
    inside = inside.groupBy("idx", "contig", F.greatest("pos", "start").alias("pos")).agg(F.sum("change").alias("change"))
    both = spine.unionByName(inside.select("idx", "contig", "pos", F.col("change").cast("bigint").alias("change"), F.lit(False).alias("base")))
    along = Window.partitionBy("idx").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("value", F.sum("change").over(along)).where("base").select("idx", "contig", "pos", "value")


def pieces(regions: DataFrame) -> DataFrame:
    """(idx, contig, tile, at, n, first): the ``n`` bases from ``at`` that a region has of a tile; ``first`` where the region begins there."""
    tile = F.explode(F.sequence(F.shiftright("start", BITS), F.shiftright(F.col("stop") - 1, BITS)))
    r = regions.where("stop > start").select("idx", "contig", "start", "stop", tile.alias("tile"))
    at = F.greatest("start", F.col("tile") * TILE)
    return r.select("idx", "contig", "tile", at.alias("at"), (F.least("stop", (F.col("tile") + 1) * TILE) - at).cast("int").alias("n"), (at == F.col("start")).alias("first"))


def tiles(events: DataFrame, parts: list[str], wanted: DataFrame, values: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(contig, tile, ...): arrays over the bases of the ``wanted`` tiles, their types in ``schema``.

    ``parts`` are columns of ``events`` (contig, pos) that make up the change at a position together. ``values`` takes the changes summed
    up along the contig to each base of a tile, and each part at each base.
    """
    at = ["contig", "tile"]
    counts = events.groupBy("contig", "pos").agg(*[F.sum(p).alias(p) for p in parts])
    # the whole of the parts is needed wherever this is read, so it is made once
    counts = counts.select("contig", F.shiftright("pos", BITS).alias("tile"), F.col("pos").bitwiseAND(TILE - 1).cast("int").alias("off"), *parts).where("contig is not null and tile is not null")
    change = reduce(add, [F.col(p) for p in parts])
    # what is summed up before a tile is a row a tile
    totals = counts.select(*at, change.alias("change"), F.lit(False).alias("wanted"))
    totals = totals.unionByName(wanted.where("contig is not null").select(*at, F.lit(0).cast("bigint").alias("change"), F.lit(True).alias("wanted")))
    totals = totals.groupBy(*at).agg(F.sum("change").alias("change"), F.max("wanted").alias("wanted"))
    before = F.sum("change").over(Window.partitionBy("contig").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.withColumn("carried", F.coalesce(before, F.lit(0))).where("wanted").select(*at, "carried")

    def lay(table: pa.Table) -> pa.Table:
        found = table.filter(table.column("off").is_valid())
        off, dense = found.column("off").to_numpy(), {}
        for p in parts:
            dense[p] = np.zeros(TILE, np.int64)
            dense[p][off] = found.column(p).to_numpy()
        out = values(table.column("carried")[0].as_py() + np.cumsum(sum(dense.values())), **dense)
        return pa.table({c: table.column(c).slice(0, 1) for c in at} | {k: pa.array([v]) for k, v in out.items()})

    return carried.join(counts, at, "left").groupBy(*at).applyInArrow(lay, f"contig string, tile bigint, {schema}")


def _events(*pairs: tuple[Column, int | Column]) -> Column:
    return F.explode(F.array(*[F.struct(p.cast("bigint").alias("pos"), (F.lit(c) if isinstance(c, int) else c).cast("bigint").alias("change")) for p, c in pairs]))


#: The place of a piece's first base in the arrays of its tile.
_LOW = "cast((at & (%d)) + 1 as int)" % (TILE - 1)


def _cut(parts: DataFrame, tiles: DataFrame, values: Column, none: Column) -> DataFrame:
    """(idx, contig, at, values): what each of the ``pieces`` takes of its tile's arrays; ``none`` at each base where the tile isn't known."""
    joined = parts.join(tiles, ["contig", "tile"], "left")
    return joined.select("idx", "contig", "at", F.coalesce(values, F.array_repeat(none, F.col("n"))).alias("values"))


def spread(signal: DataFrame) -> DataFrame:
    """(idx, contig, pos, value): a row for each of ``values`` of (idx, contig, at, values), from the position ``at`` on."""
    return signal.select("idx", "contig", "at", F.posexplode("values").alias("i", "value")).select("idx", "contig", (F.col("at") + F.col("i")).alias("pos"), "value")


def wps_pieces(
    frags: DataFrame, regions: DataFrame, window_size: int = 120, min_length: int = 120, max_length: int = 180, quality_threshold: int = 30
) -> DataFrame | None:
    """(idx, contig, at, values): the scores of ``wps``, tile by tile; None if they are no matter of the position alone.

    They are where no fragment that changes the score of a base can have its midpoint further than ``max_length`` from it.
    """
    h, odd = window_size // 2, window_size % 2
    if min_length < 0 or h + odd > max_length // 2:
        return None
    f = select_fragments(frags, quality_threshold=quality_threshold, min_length=min_length, max_length=max_length).where(midpoint(F.col("start"), F.col("stop")) >= 0)
    a, b = F.col("start"), F.col("stop")
    spans = b - a > window_size if odd else b - a >= window_size
    low, high = (-h if odd else 1 - h), h + 1
    change = _events((a + low, -1), (F.when(spans, a + high).otherwise(b + high), F.when(spans, 2).otherwise(1)), (b + low, F.when(spans, -2).otherwise(0)), (b + high, F.when(spans, 1).otherwise(0)))
    events = f.select("contig", change.alias("e")).select("contig", "e.pos", "e.change").where("change <> 0")
    if odd:
        # the halves of an odd window round to even: the base c sees [c - h, c + h] if c - h is even, and what c - 1 sees otherwise, so
        # a change comes into force at the next base of the first kind
        events = events.withColumn("pos", F.col("pos") + F.pmod(F.col("pos") - h, F.lit(2)))
    parts = pieces(regions)
    scores = tiles(events, ["change"], parts, lambda value, change: {"value": value}, "value array<bigint>")
    return _cut(parts, scores, F.slice("value", F.expr(_LOW), F.col("n")), F.lit(0).cast("bigint"))


def wps(
    frags: DataFrame, regions: DataFrame, window_size: int = 120, min_length: int = 120, max_length: int = 180, quality_threshold: int = 30
) -> DataFrame:
    """(contig, start, wps, idx): at each base, fragments that span its window less those that end inside it.

    The window of base c holds rint(c - w/2) .. rint(c + w/2 - 1). Fragments count by their midpoint within ``max_length``
    of the region; only where the window is wider than that leaves room for are they joined to each region.
    """
    scores = wps_pieces(frags, regions, window_size, min_length, max_length, quality_threshold)
    if scores is not None:
        return spread(scores).select("contig", F.col("pos").alias("start"), F.col("value").alias("wps"), "idx")
    f = select_fragments(frags, quality_threshold=quality_threshold, min_length=min_length, max_length=max_length).select("contig", "start", "stop")
    near = regions.select("contig", F.greatest(F.col("start") - max_length, F.lit(0)).alias("start"), (F.col("stop") + max_length).alias("stop"), "idx")
    joined = interval_join(f, near)
    a, b, w = F.col("start"), F.col("stop"), window_size
    if w % 2 == 0:
        h = w // 2
        spans = b - a >= w
        change = _events((a - h + 1, -1), (F.when(spans, a + h + 1).otherwise(b + h + 1), F.when(spans, 2).otherwise(1)), (b - h + 1, F.when(spans, -2).otherwise(0)), (b + h + 1, F.when(spans, 1).otherwise(0)))
        events = joined.select(F.col("r_idx").alias("idx"), change.alias("e")).select("idx", "e.pos", "e.change").where("change <> 0")
        scores = running_sum(regions, events)
    else:
        # the halves of an odd window round to even: with h = (w - 1) / 2 the base c sees [c - h, c + h] if c - h is even, and what c - 1 sees
        # otherwise. So scores are summed along for windows [c - h, c + h], and every second one counts for two bases
        h = w // 2
        spans = b - a > w
        change = _events((a - h, -1), (F.when(spans, a + h + 1).otherwise(b + h + 1), F.when(spans, 2).otherwise(1)), (b - h, F.when(spans, -2).otherwise(0)), (b + h + 1, F.when(spans, 1).otherwise(0)))
        events = joined.select(F.col("r_idx").alias("idx"), change.alias("e")).select("idx", "e.pos", "e.change").where("change <> 0")
        wider = regions.where("stop > start").select("idx", "contig", (F.col("start") - 1).alias("start"), "stop")
        evens = running_sum(wider, events).where(F.pmod(F.col("pos") - h, F.lit(2)) == 0)
        both = evens.select("idx", "contig", F.explode(F.array(F.col("pos"), F.col("pos") + 1)).alias("pos"), "value")
        scores = both.join(regions.select("idx", "start", "stop"), "idx").where("pos >= start and pos < stop").select("idx", "contig", "pos", "value")
    return scores.select("contig", F.col("pos").alias("start"), F.col("value").alias("wps"), "idx")


def cleavage_profile(frags: DataFrame, regions: DataFrame, min_length: int | None = None, max_length: int | None = None, quality_threshold: int = 30) -> DataFrame:
    """(contig, pos, proportion, idx): ends at each base (starts of forward, stops of reverse fragments) per hundred fragments over it; 0 without any.

    A fragment that stops where the region starts isn't in the region, so its end doesn't count there. One that stops before it starts is none.
    """
    f = select_fragments(frags, quality_threshold=quality_threshold, min_length=min_length, max_length=max_length).where("stop >= start")
    forward, holds = F.coalesce("is_forward", F.lit(False)), F.col("stop") > F.col("start")
    start, stop = F.col("start"), F.col("stop")
    # a region's first base knows no fragment that ends or is empty there: ``first`` counts the other ends, ``later`` those, and ``rest`` makes up the change
    rows = F.explode(F.array(
        F.struct(start.alias("pos"), (forward & holds).cast("bigint").alias("first"), (forward & ~holds).cast("bigint").alias("later"), (~forward).cast("bigint").alias("rest")),
        F.struct(stop.alias("pos"), F.lit(0).cast("bigint").alias("first"), (~forward).cast("bigint").alias("later"), F.when(forward, -1).otherwise(-2).cast("bigint").alias("rest")),
    ))
    events = f.select("contig", rows.alias("e")).select("contig", "e.pos", "e.first", "e.later", "e.rest")
    parts = pieces(regions)

    def shares(depth: np.ndarray, first: np.ndarray, later: np.ndarray, rest: np.ndarray) -> dict[str, np.ndarray]:
        over = np.maximum(depth, 1)
        return {"share": np.where(depth > 0, (first + later) * 100.0 / over, 0.0), "edge": np.where(depth > 0, first * 100.0 / over, 0.0)}

    found = tiles(events, ["first", "later", "rest"], parts, shares, "share array<double>, edge array<double>")
    low = F.expr(_LOW)
    share = F.when(F.col("first"), F.concat(F.slice("edge", low, 1), F.slice("share", low + 1, F.col("n") - 1))).otherwise(F.slice("share", low, F.col("n")))
    return spread(_cut(parts, found, share, F.lit(0.0))).select("contig", "pos", F.col("value").alias("proportion"), "idx")


def running_mean_adjusted(signal: DataFrame, width: int) -> DataFrame:
    """(idx, contig, pos, value): the signal less its running mean; the outer halves of the window go.

    A signal with a row a base, (idx, contig, pos, value), is taken natively; one with a row a region, (idx, contig, at, values), by ``adjust``, without a shuffle.
    """
    if width % 2:
        raise InvalidInputError("the running window must be even")
    if "values" in signal.columns:
        return adjust(signal, width, mean=True, smooth=None, whole=True).where("status = 'ok'").drop("status")
    half = width // 2
    along = Window.partitionBy("idx").orderBy("pos")
    mean = F.avg("value").over(along.rowsBetween(-half, half - 1))
    rank, size = F.row_number().over(along), F.count(F.lit(1)).over(Window.partitionBy("idx"))
    marked = signal.select("idx", "contig", "pos", (F.col("value") - mean).alias("value"), rank.alias("rank"), size.alias("size"))
    return marked.where((F.col("rank") > half) & (F.col("rank") <= F.col("size") - half)).drop("rank", "size")


def _mean(values: Column) -> Column:
    """The mean of an array's values, nulls left out."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def edges_subtracted(signal: DataFrame, edge: int) -> DataFrame:
    """The signal less the mean of the means of its first and last ``edge`` bases, by region.

    The signal has a row a base, (idx, contig, pos, value), or a row a region, (idx, contig, at, values), which needs neither shuffle nor sort.
    """
    if "values" in signal.columns:
        size = F.size("values")
        ends = F.slice("values", F.lit(1), F.lit(edge)), F.slice("values", F.greatest(size - edge, F.lit(0)) + 1, F.lit(edge))
        mean = reduce(add, [_mean(x) for x in ends]) / 2
        # a mean is worked out before its region is laid out; "outer" makes no filter that works the array out again
        each = signal.select("idx", "contig", "at", "values", mean.alias("mean")).select("idx", "contig", "at", "mean", F.posexplode_outer("values").alias("i", "value"))
        return each.where("i is not null").select("idx", "contig", (F.col("at") + F.col("i")).alias("pos"), (F.col("value") - F.col("mean")).alias("value"))
    region = Window.partitionBy("idx")
    first, last = F.row_number().over(region.orderBy("pos")), F.row_number().over(region.orderBy(F.col("pos").desc()))
    marked = signal.withColumn("first", first).withColumn("last", last)
    mean = (F.avg(F.when(F.col("first") <= edge, F.col("value"))).over(region) + F.avg(F.when(F.col("last") <= edge, F.col("value"))).over(region)) / 2
    return marked.select("idx", "contig", "pos", (F.col("value") - mean).alias("value"))


ADJUSTED = "idx bigint, contig string, pos bigint, value double, status string"


def _adjusted(regions: list[tuple[int | None, str | None, np.ndarray, np.ndarray]], args: tuple) -> pa.RecordBatch:
    """The rows of ``adjust`` for some regions' (idx, contig, positions, values)."""
    parts, n = [], []
    for _, _, pos, value in regions:
        try:
            pos, value = kernels.adjust(pos, value.astype(np.float64), *args)
            parts.append((pa.array(pos, pa.int64()), pa.array(value, pa.float64()), "ok"))
        except InvalidInputError as e:
            parts.append((pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), str(e)))
        n.append(len(parts[-1][0]))
    row = pa.array(np.repeat(np.arange(len(n)), n))
    idx, contig, status = pa.array([r[0] for r in regions], pa.int64()), pa.array([r[1] for r in regions], pa.string()), pa.array([p[2] for p in parts], pa.string())
    pos, value = pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts])
    return pa.record_batch([idx.take(row), contig.take(row), pos, value, status.take(row)], names=["idx", "contig", "pos", "value", "status"])


#: Bases that go back from Python at once, and the regions they belong to are adjusted together.
BASES = 1 << 16


def adjust(signal: DataFrame, width: int = 1000, mean: bool = False, edge: int | None = None, smooth: tuple[int, int] | None = (21, 2), whole: bool = False) -> DataFrame:
    """(idx, contig, pos, value, status): running median (or mean) taken out and the rest smoothed, region by region.

    The signal has a row a base, (idx, contig, pos, value), or rows of several, (idx, contig, at, values); where each region is ``whole`` in
    one of these, nothing is shuffled. A region that can't be adjusted (gaps, too short) gives one row without a position, and why in ``status``.
    """
    args = (width, mean, edge, smooth)

    def numbers(column: pa.Array) -> np.ndarray:
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def of_bases(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        values = numbers(table.column("value").combine_chunks())
        return pa.Table.from_batches([_adjusted([(table.column("idx")[0].as_py(), table.column("contig")[0].as_py(), table.column("pos").to_numpy(), values)], args)])

    def of_pieces(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), (numbers(x.values) for x in table.column("values")), strict=True), key=lambda x: x[0])
        pos, values = np.concatenate([np.arange(at, at + len(v)) for at, v in rows]), np.concatenate([v for _, v in rows])
        return pa.Table.from_batches([_adjusted([(table.column("idx")[0].as_py(), table.column("contig")[0].as_py(), pos, values)], args)])

    def of_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, n = [], 0
            for idx, contig, at, values in zip(*(batch.column(c) for c in ("idx", "contig", "at", "values")), strict=True):
                values = numbers(values.values) if values.is_valid else []
                if not len(values):
                    continue
                some.append((idx.as_py(), contig.as_py(), np.arange(at.as_py(), at.as_py() + len(values)), values))
                n += len(values)
                if n >= BASES:
                    yield _adjusted(some, args)
                    some, n = [], 0
            if some:
                yield _adjusted(some, args)

    if "values" not in signal.columns:
        return signal.select("idx", "contig", "pos", "value").groupBy("idx").applyInArrow(of_bases, ADJUSTED)
    signal = signal.select("idx", "contig", "at", "values")
    return signal.mapInArrow(of_regions, ADJUSTED) if whole else signal.where(F.size("values") > 0).groupBy("idx").applyInArrow(of_pieces, ADJUSTED)


def aggregate_signal(signal: DataFrame, regions: DataFrame, size: int, median_window_size: int = 1, mean: bool = False) -> DataFrame:
    """(rel, value): the sum (or mean) of the signal by place in the stranded regions of just ``size`` bases; missing values are 0.

    With a median window of m, m // 2 bases are cut off in front and (m + 1) // 2 behind, before reverse regions are
    flipped. Without a window nothing is added up: all values are 0.
    """
    spark = signal.sparkSession
    low, high = median_window_size // 2, size - (median_window_size + 1) // 2
    spine = spark.range(high - low).select(F.col("id").alias("rel"))
    if median_window_size == 0:
        return spine.select("rel", F.lit(0.0).alias("value"))
    r = regions.where((F.col("stop") - F.col("start") == size) & F.col("strand").isin("+", "-"))
    bases = r.select("contig", "strand", "start", F.explode(F.sequence(F.col("start") + low, F.col("start") + high - 1)).alias("pos"))
    rel = F.when(F.col("strand") == "-", F.col("start") + high - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("start") - low)
    joined = bases.join(signal.select("contig", "pos", F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value")), ["contig", "pos"], "left")
    value = F.coalesce("value", F.lit(0.0))
    sums = joined.groupBy(rel.alias("rel")).agg((F.avg(value) if mean else F.sum(value)).alias("value"))
    return spine.join(sums, "rel", "left").select("rel", F.coalesce("value", F.lit(0.0)).alias("value"))
