"""Filtered copies of fragment tables: quality, length, and lists of regions to keep or leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.operators.fragments import bounded, length
from fragspark.operators.intervals import interval_join


def filter_fragments(
    frags: DataFrame,
    whitelist: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    min_length: int | None = None,
    max_length: int | None = None,
    intersect_policy: str = "midpoint",
    quality_threshold: int = 30,
) -> DataFrame:
    """Fragments that pass; ``any`` needs one base of overlap with a region, ``midpoint`` half the fragment's length with one region.

    Each fragment comes out once, however many regions of the whitelist it meets.
    """
    if intersect_policy not in ("midpoint", "any"):
        raise InvalidInputError(f"unknown policy {intersect_policy!r}")
    out = frags.where((F.col("mapq") >= quality_threshold) & bounded(length(), min_length, max_length))
    half = None
    if intersect_policy == "midpoint":
        half = 2 * (F.least("stop", "r_stop") - F.greatest("start", "r_start")) >= length()
    if whitelist is None and blacklist is None:
        return out
    for regions, how in ((whitelist, "semi"), (blacklist, "anti")):
        if regions is not None:
            out = interval_join(out, regions.select("contig", "start", "stop"), "any", how, extra=half, longest=max_length)
    return out.select(*frags.columns)
