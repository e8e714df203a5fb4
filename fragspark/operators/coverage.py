"""Coverage and fragment lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragspark.operators.fragments import length, select_fragments
from fragspark.operators.intervals import interval_join


def single_coverage(frags: DataFrame, contig: str | None = None, start: int | None = 0, stop: int | None = None, name: str = ".", **filters) -> DataFrame:
    """(contig, start, stop, name, coverage): one row, the fragments of one region."""
    n = select_fragments(frags, contig, start, stop, **filters).agg(F.count(F.lit(1)).alias("coverage"))
    lit = lambda x, t: F.lit(x).cast(t)
    return n.select(lit(contig, "string").alias("contig"), lit(start, "bigint").alias("start"), lit(stop, "bigint").alias("stop"), F.lit(name or ".").alias("name"), "coverage")


def coverage(frags: DataFrame, regions: DataFrame, scale_factor: float = 1.0, normalize: bool = False, intersect_policy: str = "midpoint", **filters) -> DataFrame:
    """(contig, start, stop, name, idx, coverage) for every region, empty ones too; normalised by all fragments that pass the filters."""
    passed = select_fragments(frags, **filters)
    counts = interval_join(passed.select("contig", "start", "stop"), regions.select("contig", "start", "stop", "idx"), intersect_policy)
    counts = counts.groupBy(F.col("r_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    out = regions.join(counts, "idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.col("n") * F.lit(float(scale_factor))
    if normalize:
        out = out.crossJoin(F.broadcast(passed.agg(F.count(F.lit(1)).alias("total"))))  # one row
        value = F.try_divide(value, F.col("total"))
    return out.select("contig", "start", "stop", "name", "idx", value.alias("coverage"))


def lengths(frags: DataFrame, **filters) -> DataFrame:
    return select_fragments(frags, **filters).select(length().alias("length"))


def length_counts(frags: DataFrame, **filters) -> DataFrame:
    """(length, n)."""
    return lengths(frags, **filters).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def length_bins(frags: DataFrame, min_length: int = 0, max_length: int | None = None, bin_size: int = 1, **filters) -> DataFrame:
    """(min, max, count): a histogram from ``min_length`` (or the shortest) to the longest, empty bins too."""
    h = length_counts(frags, min_length=min_length, max_length=max_length, **filters)
    ends = h.agg(F.min("length").alias("low"), F.max("length").alias("high"))
    low = F.lit(min_length).cast("bigint") if min_length else F.col("low")
    ends = ends.where("low is not null").select(low.alias("low"), "high")  # one row
    bin_of = lambda x: F.floor((x - F.col("low")) / bin_size).cast("bigint")
    spine = ends.select("low", F.explode(F.sequence(F.lit(0).cast("bigint"), bin_of(F.col("high")))).alias("bin"))
    binned = h.crossJoin(F.broadcast(ends)).select(bin_of(F.col("length")).alias("bin"), "n")
    filled = spine.join(binned, "bin", "left")
    return filled.groupBy("low", "bin").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count")).select(
        (F.col("low") + F.col("bin") * bin_size).alias("min"), (F.col("low") + (F.col("bin") + 1) * bin_size - 1).alias("max"), "count"
    )


def _ranks(mode: str) -> tuple[Column, Column]:
    """The two ranks whose lengths are averaged. ``reference`` takes the rank below the middle of an odd count."""
    n = F.col("total")
    half = F.floor(n / 2)
    even = n % 2 == 0
    odd = F.greatest(half, F.lit(1)) if mode == "reference" else half + 1
    return F.when(even, half).otherwise(odd), F.when(even, half + 1).otherwise(odd)


def length_statistics(counts: DataFrame, by: list[str], short: int = 150, median_mode: str = "reference") -> DataFrame:
    """Statistics of (by..., length, n): mean, median, population deviation, extremes, count and the share up to ``short``.

    All of it from counts by length, so a region with any number of fragments is as small as its distinct lengths.
    """
    every = Window.partitionBy(*by)
    upto = every.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("total", F.sum("n").over(every)).withColumn("upto", F.sum("n").over(upto))
    first, second = _ranks(median_mode)
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("length")), F.sum(F.col("n") * F.col("length") * F.col("length"))
    return c.groupBy(*by).agg(
        (s / n).alias("mean"),
        ((F.min(F.when(F.col("upto") >= first, F.col("length"))) + F.min(F.when(F.col("upto") >= second, F.col("length")))) / 2).alias("median"),
        F.sqrt(F.greatest((n * q - s * s).cast("double"), F.lit(0.0)) / (n * n)).alias("stdev"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
        n.alias("count"),
        (F.coalesce(F.sum(F.when(F.col("length") <= short, F.col("n"))), F.lit(0)) / n).alias("short_fraction"),
    )


def length_intervals(
    frags: DataFrame, regions: DataFrame, short_reads: int = 150, median_mode: str = "reference", intersect_policy: str = "midpoint", empty: float | None = -1, **filters
) -> DataFrame:
    """Length statistics of every region; regions without fragments hold ``empty`` everywhere (None: null)."""
    f = select_fragments(frags, **filters).select("contig", "start", "stop")
    joined = interval_join(f, regions.select("contig", "start", "stop", "idx"), intersect_policy)
    counts = joined.groupBy(F.col("r_idx").alias("idx"), length().alias("length")).agg(F.count(F.lit(1)).alias("n"))
    out = regions.join(length_statistics(counts, ["idx"], short_reads, median_mode), "idx", "left")
    names = ["mean", "median", "stdev", "min", "max", "count", "short_fraction"]
    filled = [F.coalesce(F.col(c), F.lit(empty).cast(out.schema[c].dataType)).alias(c) if empty is not None else F.col(c) for c in names]
    return out.select("contig", "start", "stop", "name", "idx", *filled)
