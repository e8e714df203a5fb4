"""Structured Streaming over new fragment files: running counts by region and by length.

Regions are few and static: each is spread over its bins, and a batch of fragments joins them
by (contig, bin). The state is one counter a region, or one a length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.operators.fragments import length, select_fragments
from fragspark.operators.intervals import interval_join
from fragspark.schema import FRAGMENT


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of Parquet files as they land in a folder."""
    return spark.readStream.schema(FRAGMENT).parquet(path)


def running_coverage(stream: DataFrame, regions: DataFrame, **filters) -> DataFrame:
    """(idx, coverage), for output mode complete or update."""
    f = select_fragments(stream, **filters).select("contig", "start", "stop")
    return interval_join(f, regions.select("contig", "start", "stop", "idx")).groupBy(F.col("r_idx").alias("idx")).agg(F.count(F.lit(1)).alias("coverage"))


def running_lengths(stream: DataFrame, **filters) -> DataFrame:
    """(length, n)."""
    return select_fragments(stream, **filters).groupBy(length().alias("length")).agg(F.count(F.lit(1)).alias("n"))
