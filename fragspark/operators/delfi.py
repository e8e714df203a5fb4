"""Short and long fragments by genome window, with GC correction and merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragspark.functions import kernels
from fragspark.operators import genome, motifs
from fragspark.operators.fragments import length, select_fragments
from fragspark.operators.intervals import interval_join

#: Windows of hg19 that have no coverage, by their place after NOARM windows are gone.
NO_COVERAGE = (8779, 13664)
CORRECTED = ("short", "long", "num_frags", "ratio")


def windows(
    frags: DataFrame, bins: DataFrame, reference: DataFrame | None = None, gaps: DataFrame | None = None, blacklist: DataFrame | None = None, quality_threshold: int = 30
) -> DataFrame:
    """(idx, contig, start, stop, arm, short, long, gc, num_frags) of each bin (contig, start, stop, idx) outside gaps.

    Fragments of 100 to 220 bases count by midpoint; those of 151 and more are long. A fragment goes if both its ends lie in one blacklisted region inside
    the bin, or if it is over a centromere or all telomeres. ``gc`` is null in bins without fragments.
    """
    if gaps is not None:
        bins = genome.with_arms(genome.without_gaps(bins, gaps), gaps).withColumn("arm", F.coalesce("arm", "contig"))
    else:
        bins = bins.withColumn("arm", F.col("contig"))
    f = select_fragments(frags, quality_threshold=quality_threshold, min_length=100, max_length=220).select("contig", "start", "stop")
    j = interval_join(f, bins.select("contig", "start", "stop", "idx"), "midpoint", bin_size=100_000)
    if blacklist is not None:
        region = blacklist.select(F.col("contig").alias("b_contig"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
        # a region belongs to a bin that holds it whole, so both meet by the region's own bin of the axis
        owned = interval_join(region.select(F.col("b_contig").alias("contig"), F.col("b0").alias("start"), F.col("b1").alias("stop")).where("stop > start"), bins.select("contig", "start", "stop", "idx"), "any", bin_size=100_000)
        owned = owned.where((F.col("start") >= F.col("r_start")) & (F.col("stop") <= F.col("r_stop"))).select(F.col("r_idx").alias("b_idx"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
        ends_in = (F.col("r_idx") == F.col("b_idx")) & (F.col("start") >= F.col("b0")) & (F.col("start") < F.col("b1")) & (F.col("stop") >= F.col("b0")) & (F.col("stop") < F.col("b1"))
        j = j.join(owned, ends_in, "left_anti")
    if gaps is not None:
        j = j.join(F.broadcast(genome.contig_gaps(gaps)), "contig", "left").where(~F.coalesce(genome.in_tcmere(F.col("start"), F.col("stop")), F.lit(False)))
    counts = j.groupBy(F.col("r_idx").alias("idx")).agg(
        F.count_if(length() <= 150).alias("short"), F.count_if(length() >= 151).alias("long"), F.count(F.lit(1)).alias("num_frags")
    )
    out = bins.join(counts, "idx", "left").na.fill(0, ["short", "long", "num_frags"])
    if reference is not None:
        out = out.join(motifs.gc_of(bins.select("contig", "start", "stop", "idx"), reference), "idx")
        gc = F.when(F.col("num_frags") > 0, F.col("gc_bases") / (F.col("stop") - F.col("start")))
    else:
        gc = F.lit(None).cast("double")
    return out.select("idx", "contig", "start", "stop", "arm", "short", "long", gc.alias("gc"), "num_frags")


def ratio(bins: DataFrame) -> DataFrame:
    """Adds short / long, null without long fragments."""
    return bins.withColumn("ratio", F.try_divide(F.col("short").cast("double"), F.col("long")))


def without_no_coverage(bins: DataFrame, places: tuple[int, ...] = NO_COVERAGE) -> DataFrame:
    """Leaves out windows by their place in the order of ``idx``, after those without an arm are gone."""
    armed = bins.where("arm <> 'NOARM'")
    return armed.withColumn("_place", F.row_number().over(Window.orderBy("idx")) - 1).where(~F.col("_place").isin(*places)).drop("_place")


def merged(bins: DataFrame, bins_per_window: int = 50, corrected: bool = False) -> DataFrame:
    """Runs of ``bins_per_window`` bins of each arm, p arms counted from their start and q arms from their end; shorter runs go."""
    a = bins.where(F.col("arm").contains("p") | F.col("arm").contains("q"))
    up = F.row_number().over(Window.partitionBy("arm").orderBy("idx"))
    down = F.row_number().over(Window.partitionBy("arm").orderBy(F.col("idx").desc()))
    a = a.withColumn("chunk", F.floor((F.when(F.col("arm").contains("p"), up).otherwise(down) - 1) / bins_per_window))
    sums = [F.sum(c).alias(c) for c in ("short", "long", "num_frags")] + [F.avg("gc").alias("gc"), F.avg("ratio").alias("ratio")]
    if corrected:
        sums += [F.sum(f"{c}_corrected").alias(f"{c}_corrected") for c in CORRECTED[:3]] + [F.avg("ratio_corrected").alias("ratio_corrected")]
    g = a.groupBy("arm", "chunk").agg(F.min("idx").alias("idx"), F.min("start").alias("start"), F.max("stop").alias("stop"), *sums, F.count(F.lit(1)).alias("bins")).where(F.col("bins") == bins_per_window)
    more = [f"{c}_corrected" for c in CORRECTED] if corrected else []
    return g.select("idx", F.expr("left(arm, length(arm) - 1)").alias("contig"), "start", "stop", "arm", "short", "long", "gc", "num_frags", "ratio", *more)


def gc_corrected(bins: DataFrame, alpha: float = 0.75) -> DataFrame:
    """Adds short, long, num_frags and ratio less their local regression on GC, plus their median.

    The regression is fitted on the bins that have all values (a genome has some 26,000 bins of
    100 kb, whatever its depth; they are one small table) and read off a grid of steps of 0.01.
    """
    names = [*CORRECTED]
    rows = bins.select("idx", "gc", *[F.col(c).cast("double").alias(c) for c in names])

    def run(table: pa.Table) -> pa.Table:
        columns = {c: np.array(table.column(c).to_pylist(), dtype=float) for c in ("gc", *names)}
        ok = np.all([np.isfinite(v) for v in columns.values()], axis=0)
        out = [table.column("idx")]
        if ok.any():
            gc = columns["gc"][ok]
            grid = np.arange(gc.min(), gc.max() + 0.01, 0.01)
            for c in names:
                line = kernels.loess(gc, columns[c][ok], grid, alpha)
                fixed = columns[c] - np.interp(columns["gc"], grid, line) + np.median(columns[c][ok])
                out.append(pa.array(fixed, from_pandas=True))
        else:
            out += [pa.nulls(table.num_rows, pa.float64()) for _ in names]
        return pa.table(out, names=["idx", *[f"{c}_corrected" for c in names]])

    fitted = rows.groupBy().applyInArrow(run, "idx bigint, " + ", ".join(f"{c}_corrected double" for c in names))
    return bins.join(fitted, "idx")


def delfi(
    frags: DataFrame, bins: DataFrame, reference: DataFrame | None = None, gaps: DataFrame | None = None, blacklist: DataFrame | None = None, quality_threshold: int = 30,
    gc_correct: bool = True, remove_nocov: bool = True, merge_bins: bool = True, bins_per_window: int = 50,
) -> DataFrame:
    """The whole profile: windows, ratios, GC correction and merged windows, in the order of ``idx``."""
    out = ratio(windows(frags, bins, reference, gaps, blacklist, quality_threshold).where("arm <> 'NOARM'"))
    if remove_nocov:
        out = without_no_coverage(out)
    if gc_correct:
        out = gc_corrected(out)
    return merged(out, bins_per_window, gc_correct) if merge_bins else out


def trimmed(bins: DataFrame, trim_percentile: float = 10) -> DataFrame:
    """Counts of windows below the percentile of ``num_frags`` become null."""
    cut = bins.agg(F.percentile("num_frags", trim_percentile / 100).alias("cut"))  # one row
    j = bins.crossJoin(F.broadcast(cut))
    return j.select(*[F.when(F.col("num_frags") >= F.col("cut"), F.col(c)).alias(c) if c in ("short", "long", "num_frags") else F.col(c) for c in bins.columns])
