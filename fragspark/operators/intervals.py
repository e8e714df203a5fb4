"""Interval algebra: binned range joins, merging, centring and clipping.

A range predicate alone leaves a join on the contig, whose two dozen values make
each task a quadratic loop. The joins here cut the axis into bins and join on (contig,
bin) with the range as residue, so that work follows overlaps and keys spread. A fragment
has one bin by its midpoint; where both sides are spread over bins, a pair counts in
the bin of its later start alone, so nothing needs to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.functions.sequence import div, midpoint
from fragspark.operators.fragments import in_region

BIN = 4096
#: Bases of a contig that one window of an ordered pass takes.
CHUNK = 1 << 24


def _bins(start: Column, stop: Column, size: int) -> Column:
    """The bins of [start, stop); an empty interval is in the bin of its start."""
    return F.explode(F.sequence(div(start, size), F.greatest(div(stop - 1, size), div(start, size))))


def interval_join(frags: DataFrame, regions: DataFrame, policy: str = "midpoint", how: str = "inner", bin_size: int = BIN, extra: Column | None = None, longest: int | None = None) -> DataFrame:
    """Joins fragments to the regions that they belong to.

    ``inner``: all columns of the fragment, and the region's with the prefix ``r_``. ``semi`` and ``anti``: fragments with or
    without a region, each once; for ``any`` they need to know the ``longest`` fragment, and look for it where it isn't given. ``extra`` is one more
    condition on a pair, on the same names.
    """
    if how not in ("inner", "semi", "anti"):
        raise InvalidInputError(f"unknown join {how!r}")
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns])
    belongs = in_region(policy, F.col("r_start"), F.col("r_stop"))
    if extra is not None:
        belongs = belongs & extra
    r = r.withColumn("r_bin", _bins(F.col("r_start"), F.col("r_stop"), bin_size))
    if policy == "midpoint":
        f = frags.withColumn("f_bin", div(midpoint(F.col("start"), F.col("stop")), bin_size))
        on = (F.col("contig") == F.col("r_contig")) & (F.col("f_bin") == F.col("r_bin")) & belongs
        joined = f.join(r, on, {"inner": "inner", "semi": "left_semi", "anti": "left_anti"}[how])
        return joined.drop("f_bin", "r_bin")
    if how == "inner":
        f = frags.withColumn("f_bin", _bins(F.col("start"), F.col("stop"), bin_size))
        once = F.col("f_bin") == div(F.greatest("start", "r_start"), bin_size)
        on = (F.col("contig") == F.col("r_contig")) & (F.col("f_bin") == F.col("r_bin")) & belongs & once
        return f.join(r, on).drop("f_bin", "r_bin")
    # a fragment is looked up once, in the bin of its start; a region waits in every bin where a fragment that meets it may start
    if longest is None:
        longest = int(frags.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 0)
    while bin_size < longest:
        bin_size *= 2
    r = r.withColumn("r_bin", _bins(F.col("r_start") - max(longest, 1), F.greatest(F.col("r_stop"), F.col("r_start") + 1), bin_size))
    f = frags.withColumn("f_bin", div(F.col("start"), bin_size))
    on = (F.col("contig") == F.col("r_contig")) & (F.col("f_bin") == F.col("r_bin")) & belongs
    return f.join(r, on, "left_semi" if how == "semi" else "left_anti").drop("f_bin")


def overlaps(regions: DataFrame, others: DataFrame, how: str = "anti", bin_size: int = 1 << 20) -> DataFrame:
    """Regions (with a distinct ``idx``) with or without an overlap with any of ``others`` on their contig."""
    o = others.select(F.col("contig").alias("r_contig"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    o = o.withColumn("r_bin", _bins(F.col("r_start"), F.col("r_stop"), bin_size))
    f = regions.withColumn("f_bin", _bins(F.col("start"), F.col("stop"), bin_size))
    on = (F.col("contig") == F.col("r_contig")) & (F.col("f_bin") == F.col("r_bin")) & (F.col("start") < F.col("r_stop")) & (F.col("stop") > F.col("r_start"))
    found = f.join(o, on, "left_semi").select("idx").distinct()
    return regions.join(found, "idx", "left_anti" if how == "anti" else "left_semi").select(*regions.columns)


def merge(regions: DataFrame, strictly: bool = False, by: str = "contig", chunk: int = CHUNK) -> DataFrame:
    """Unions of overlapping intervals of each contig; touching ones merge too, unless ``strictly``.

    Windows run over chunks of a contig; what reaches into a chunk from those before, and how many islands begin there, is
    carried over in a row a chunk.
    """
    rows = regions.select(by, "start", "stop", div(F.col("start"), chunk).alias("chunk"))
    along = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(by, "chunk").agg(F.max("stop").alias("stop")).select(by, "chunk", F.max("stop").over(along).alias("carried"))
    order = Window.partitionBy(by, "chunk").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(before, "carried")  # nulls are passed over
    apart = (F.col("start") >= reach) if strictly else (F.col("start") > reach)
    marked = rows.join(carry, [by, "chunk"]).withColumn("begins", F.when(reach.isNull() | apart, 1).otherwise(0))
    nth = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = marked.withColumn("nth", nth).groupBy(by, "chunk", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    # an island that goes on in the next chunk is the 0th there, and takes the number of the last one before
    number = F.struct("chunk", "nth")
    last = parts.groupBy(by, "chunk").agg(F.max("nth").alias("last")).where("last > 0").select(by, "chunk", F.struct("chunk", F.col("last").alias("nth")).alias("own"))
    origin = parts.select(by, "chunk").distinct().join(last, [by, "chunk"], "left").select(by, "chunk", F.last("own", True).over(along).alias("open"))
    island = F.when(F.col("nth") > 0, number).otherwise(F.col("open"))
    return parts.join(origin, [by, "chunk"]).groupBy(by, island.alias("island")).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def centred(regions: DataFrame, sizes: DataFrame | None, size: int) -> DataFrame:
    """Windows of ``size`` around the midpoints, clipped to the contig; a window ends where the next of its contig begins, and empty ones go."""
    mid = midpoint(F.col("start"), F.col("stop"))
    low, high = F.greatest(mid - size // 2, F.lit(0)), mid + (size - size // 2)
    w = regions
    if sizes is not None:
        w = w.join(F.broadcast(sizes.select("contig", "size")), "contig")
        high = F.least(high, F.col("size"))
    w = w.select("contig", "idx", low.cast("bigint").alias("start"), high.cast("bigint").alias("stop"))
    after = F.lead("start").over(Window.partitionBy("contig").orderBy("start", "idx"))
    return w.withColumn("stop", F.least("stop", F.coalesce(after, "stop"))).where("stop > start")


def padded(regions: DataFrame, sizes: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Intervals widened on both sides, clipped to the contig (unknown contigs go) and merged where they truly overlap."""
    w = regions.join(F.broadcast(sizes.select("contig", "size")), "contig").select(
        "contig", F.greatest(F.col("start") - left, F.lit(0)).alias("start"), F.least(F.col("stop") + right, F.col("size")).alias("stop")
    )
    return merge(w, strictly=True)


def valid(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """``regions`` with a column ``is_valid``: on a known contig, inside it, and not empty."""
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("size")) & (F.col("stop") >= 0) & (F.col("stop") <= F.col("size")) & (F.col("start") < F.col("stop"))
    return regions.join(F.broadcast(sizes.select("contig", "size")), "contig", "left").select(*regions.columns, F.coalesce(inside, F.lit(False)).alias("is_valid"))
