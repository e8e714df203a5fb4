"""Gap tracks: arms, centromeres, telomeres. A genome has a few hundred gaps; they are joined as one row a contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragspark.operators.intervals import overlaps


def contig_gaps(gaps: DataFrame) -> DataFrame:
    """(contig, cen_start, cen_stop, telomeres, has_short_arm) of contigs with a centromere, the first one."""
    place = F.struct("start", "stop")
    cen = F.when(F.col("type") == "centromere", place)
    g = gaps.groupBy("contig").agg(
        F.min(cen).alias("cen"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "telomere", place))).alias("telomeres"),
        F.max(F.coalesce(F.col("type") == "short_arm", F.lit(False))).alias("has_short_arm"),
    )
    return g.where("cen is not null").select("contig", F.col("cen.start").alias("cen_start"), F.col("cen.stop").alias("cen_stop"), "telomeres", "has_short_arm")


def in_tcmere(start: Column, stop: Column) -> Column:
    """Over the centromere, or over every telomere there is; null for contigs without a centromere."""
    every = (F.size("telomeres") > 0) & F.forall("telomeres", lambda t: (stop > t["start"]) & (start < t["stop"]))
    return ((stop > F.col("cen_start")) & (start < F.col("cen_stop"))) | every


def in_tcmere_any(start: Column, stop: Column) -> Column:
    """Over the centromere, or over any telomere."""
    return ((stop > F.col("cen_start")) & (start < F.col("cen_stop"))) | F.exists("telomeres", lambda t: (stop > t["start"]) & (start < t["stop"]))


def arm(contig: Column, start: Column, stop: Column) -> Column:
    """``1p``, ``1q`` or ``NOARM``, from columns of ``contig_gaps``; null where there is no centromere."""
    name = F.regexp_replace(contig, "chr", "")
    p = F.when(F.col("has_short_arm"), F.lit("NOARM")).otherwise(F.concat(name, F.lit("p")))
    return F.when(F.col("cen_start").isNull(), F.lit(None)).when(stop < F.col("cen_start"), p).when(start > F.col("cen_stop"), F.concat(name, F.lit("q"))).otherwise(F.lit("NOARM"))


def with_arms(regions: DataFrame, gaps: DataFrame) -> DataFrame:
    # a row a contig that has a centromere
    return regions.join(F.broadcast(contig_gaps(gaps)), "contig", "left").select(*regions.columns, arm(F.col("contig"), F.col("start"), F.col("stop")).alias("arm"))


def without_gaps(regions: DataFrame, gaps: DataFrame) -> DataFrame:
    return overlaps(regions, gaps, "anti")


def over_gaps(regions: DataFrame, gaps: DataFrame) -> DataFrame:
    return overlaps(regions, gaps, "semi")


def strip_chr(gaps: DataFrame) -> DataFrame:
    """The track with contigs named without ``chr``."""
    return gaps.withColumn("contig", F.regexp_replace("contig", "chr", ""))
