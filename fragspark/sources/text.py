"""Line formats: fragments, intervals, sizes, gap tracks and motif tables.

Lines are read by Spark from any store, plain or ``.gz``; every field is cast with
try_cast and rows that don't fit are left out by a filter on the result, so that what is left does
not depend on which columns are asked for. BGZF files named ``.bgz`` are
decompressed from their bytes. Compressed files are one task each: convert them to
Parquet once.
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError, UnsupportedFormatError

FRAGMENT_SUFFIXES = (".gz", ".bgz", ".tsv", ".bed", ".frag")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): the lines of a file and their place."""
    if path.endswith(".bgz"):

        def text(batches):
            import pyarrow as pa

            for batch in batches:
                for content in batch.column(0).to_pylist():
                    yield pa.record_batch([pa.array(gzip.decompress(content).decode().splitlines())], names=["value"])

        found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(text, "value string")
    else:
        found = spark.read.text(path)
    return found.select("value", F.monotonically_increasing_id().alias("at"))


def _fields(frame: DataFrame, separator: str = "\t", comments: tuple[str, ...] = ("#",)) -> DataFrame:
    keep = F.trim("value") != ""
    for c in comments:
        keep = keep & ~F.col("value").startswith(c)
    return frame.where(keep).select(F.split("value", separator).alias("f"), "at")


def _cast(i: int, kind: str):
    return F.get("f", F.lit(i)).try_cast(kind)


def read_fragments(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """Fragments of a tab-separated file: contig, start, stop, quality, strand, or with a name before the quality (``bed6``)."""
    if not path.endswith(FRAGMENT_SUFFIXES):
        raise UnsupportedFormatError(f"no fragment reader for {path}")
    rows = _fields(lines(spark, path))
    if layout == "auto":
        first = rows.select(F.size("f").alias("n")).head()
        layout = "bed6" if first is not None and first["n"] > 5 else "frag5"
    if layout not in ("frag5", "bed6"):
        raise InvalidInputError(f"unknown layout {layout!r}")
    quality = 4 if layout == "bed6" else 3
    out = rows.select(
        F.get("f", F.lit(0)).alias("contig"), _cast(1, "bigint").alias("start"), _cast(2, "bigint").alias("stop"), _cast(quality, "int").alias("mapq"),
        F.get("f", F.lit(quality + 1)).contains("+").alias("is_forward"),
    )
    return out.where("contig is not null and start is not null and stop is not null and mapq is not null and is_forward is not null")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, stop, name, strand, idx) of a BED file with three columns or more; idx follows the file's order."""
    rows = _fields(lines(spark, path), r"\s+", ("#", "track", "browser"))
    out = rows.select(
        F.get("f", F.lit(0)).alias("contig"), _cast(1, "bigint").alias("start"), _cast(2, "bigint").alias("stop"),
        F.coalesce(F.get("f", F.lit(3)), F.lit(".")).alias("name"), F.get("f", F.lit(5)).alias("strand"), F.col("at").alias("idx"),
    )
    return out.where("start is not null and stop is not null")


def intervals_of(spark: SparkSession, intervals: str | list[tuple]) -> DataFrame:
    """Intervals from a path or from tuples (contig, start, stop[, name])."""
    if isinstance(intervals, str):
        return read_intervals(spark, intervals)
    if not isinstance(intervals, list):
        raise TypeError("intervals are a path or a list of tuples")
    rows = [(t[0], int(t[1]), int(t[2]), t[3] if len(t) > 3 else ".", None, i) for i, t in enumerate(intervals)]
    return spark.createDataFrame(rows, "contig string, start bigint, stop bigint, name string, strand string, idx bigint")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(contig, size, ord) of a two-column file."""
    rows = _fields(lines(spark, path), r"\s+", ())
    return rows.select(F.get("f", F.lit(0)).alias("contig"), _cast(1, "bigint").alias("size"), F.col("at").alias("ord")).where("size is not null")


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, stop, type) of a four-column BED file."""
    rows = _fields(lines(spark, path), r"\s+", ("#", "track", "browser"))
    return rows.select(F.get("f", F.lit(0)).alias("contig"), _cast(1, "bigint").alias("start"), _cast(2, "bigint").alias("stop"), F.get("f", F.lit(3)).alias("type")).where("start is not null and stop is not null and type is not null")


def read_ucsc_gaps(spark: SparkSession, path: str, strip_chr: bool = False) -> DataFrame:
    """The same from a gap table of a genome browser, whose columns 1, 2, 3 and 7 (from 0) hold the gap; the tables aren't shipped here."""
    rows = _fields(lines(spark, path))
    contig = F.get("f", F.lit(1))
    contig = F.regexp_replace(contig, "chr", "") if strip_chr else contig
    return rows.select(contig.alias("contig"), _cast(2, "bigint").alias("start"), _cast(3, "bigint").alias("stop"), F.get("f", F.lit(7)).alias("type")).where("start is not null and stop is not null and type is not null")


def read_motif_frequencies(spark: SparkSession, path: str, separator: str = "\t", header: int = 0) -> DataFrame:
    """(kmer, freq); the file must have every k-mer of one length, once."""
    rows = lines(spark, path).withColumn("n", F.row_number().over(Window.orderBy("at"))).where(F.col("n") > header)
    out = _fields(rows, separator, ()).select(F.trim(F.get("f", F.lit(0))).alias("kmer"), _cast(1, "double").alias("freq"))
    found = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kmer").alias("d"), F.min(F.length("kmer")).alias("low"), F.max(F.length("kmer")).alias("high")).first()
    if not found["n"] or found["low"] != found["high"] or found["n"] != 4 ** found["low"] or found["d"] != found["n"]:
        raise RuntimeError(f"{path} isn't a whole table of k-mers")
    return out


def read_motif_intervals(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(contig, start, stop, name, idx, total, kmer, n) from a wide table of raw counts with a header."""
    wide = spark.read.csv(path, sep=separator, header=True)
    fixed = ["contig", "start", "stop", "name", "count"]
    kmers = [c for c in wide.columns if c not in fixed]
    if not kmers or len(kmers) != 4 ** len(kmers[0]):
        raise RuntimeError(f"{path} isn't a whole table of k-mers")
    numbered = wide.withColumn("idx", F.monotonically_increasing_id())
    long = numbered.unpivot([*fixed, "idx"], kmers, "kmer", "n")
    return long.select("contig", F.col("start").cast("bigint"), F.col("stop").cast("bigint"), "name", "idx", F.col("count").cast("double").alias("total"), "kmer", F.col("n").cast("double"))


def validate_contigs(a: DataFrame, b: DataFrame, subset: bool = True, sizes: bool = False) -> None:
    """Raises unless a's contigs are among b's (or the same), with the same sizes where asked. Both have a row a contig."""
    from fragspark.errors import ContigMismatchError

    names = ["contig", "size"] if sizes else ["contig"]
    missing = a.select(*names).exceptAll(b.select(*names))
    if not missing.isEmpty() or (not subset and not b.select(*names).exceptAll(a.select(*names)).isEmpty()):
        raise ContigMismatchError(f"contigs differ: {[r[0] for r in missing.limit(5).collect()]}")
