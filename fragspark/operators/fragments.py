"""Filters on fragments and on aligned reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.functions.sequence import midpoint

POLICIES = ("midpoint", "any")
#: Flags of reads that are left out: unmapped, mate unmapped, secondary, failed, duplicate, supplementary; and of those wanted: paired, properly.
FLAGS_OUT, FLAGS_IN = 3852, 3


def length() -> Column:
    return F.col("stop") - F.col("start")


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def bounded(value: Column, low: int | None, high: int | None) -> Column:
    """Both bounds inclusive; None is open."""
    return both([value >= low] * (low is not None) + [value <= high] * (high is not None))


def in_region(policy: str, start: Column | int | None, stop: Column | int | None, f_start: Column | None = None, f_stop: Column | None = None) -> Column:
    """Whether a fragment belongs to a region: by its midpoint, or by any overlap. A missing bound is open."""
    a, b = F.col("start") if f_start is None else f_start, F.col("stop") if f_stop is None else f_stop
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    if policy == "midpoint":
        mid = midpoint(a, b)
        return both([mid >= lit(start)] * (start is not None) + [mid < lit(stop)] * (stop is not None))
    if policy == "any":
        return both([b > lit(start)] * (start is not None) + [a < lit(stop)] * (stop is not None))
    raise InvalidInputError(f"unknown policy {policy!r}; there are {POLICIES}")


def select_fragments(
    frags: DataFrame,
    contig: str | None = None,
    start: int | None = None,
    stop: int | None = None,
    quality_threshold: int = 30,
    min_length: int | None = None,
    max_length: int | None = None,
    intersect_policy: str = "midpoint",
) -> DataFrame:
    """The fragments of a region that pass quality and length; all of it reaches the scan as one predicate."""
    if contig is None and (stop is not None or start not in (None, 0)):
        raise InvalidInputError("a start or stop needs a contig")
    wanted = [F.col("mapq") >= quality_threshold, bounded(length(), min_length, max_length)]
    if contig is not None:
        wanted.append(F.col("contig") == contig)
    wanted.append(in_region(intersect_policy, start, stop))
    return frags.where(both(wanted))


def frags_in_region(frags: DataFrame, start: int, stop: int) -> DataFrame:
    """Fragments that begin before ``stop`` and end at ``start`` or later: a base wider than the policy ``any``."""
    return frags.where((F.col("start") < stop) & (F.col("stop") >= start))


def proper_reads(reads: DataFrame, quality_threshold: int = 30, read1_only: bool = True) -> DataFrame:
    flag = F.col("flag")
    return reads.where(
        (flag.bitwiseAND(FLAGS_OUT) == 0)
        & (flag.bitwiseAND(FLAGS_IN) == FLAGS_IN)
        & (F.col("mapq") >= quality_threshold)
        & ((flag.bitwiseAND(128) == 0) if read1_only else F.lit(True))
    )


def low_quality_pair(quality_threshold: int) -> Column:
    """Reads that are no good as a pair: flags, either mate's quality, or both mates on the reverse strand."""
    flag = F.col("flag")
    return (
        (flag.bitwiseAND(FLAGS_OUT) != 0)
        | (flag.bitwiseAND(FLAGS_IN) != FLAGS_IN)
        | (F.col("mapq") < quality_threshold)
        | (flag.bitwiseAND(48) == 48)
        | (F.coalesce(F.col("mate_mapq"), F.col("mapq")) < quality_threshold)
    )


def not_read1_or_low_quality(quality_threshold: int) -> Column:
    return (F.col("flag").bitwiseAND(64) == 0) | low_quality_pair(quality_threshold)


def from_reads(reads: DataFrame, quality_threshold: int = 30, read1_only: bool = True) -> DataFrame:
    """Fragments spanned by proper pairs, from the template length; its sign says on which side the mate lies, and 0 is no fragment."""
    ahead = F.col("tlen") > 0
    return (
        proper_reads(reads, quality_threshold, read1_only)
        .where("tlen <> 0")
        .select(
            "contig",
            F.when(ahead, F.col("start")).otherwise(F.col("stop") + F.col("tlen")).alias("start"),
            F.when(ahead, F.col("start") + F.col("tlen")).otherwise(F.col("stop")).alias("stop"),
            "mapq",
            (F.col("flag").bitwiseAND(16) == 0).alias("is_forward"),
        )
    )
