"""Text and bigWig sinks for final, small results, in the layouts of genome browsers.

A sink orders its rows and streams them through the driver one partition at a time
(toLocalIterator), so it needs no memory for the whole; large results belong in Parquet.
"""

from __future__ import annotations

import gzip
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError, UnsupportedFormatError
from fragspark.sources.binary import read_bam, write_bigwig


@contextmanager
def opened(path: str) -> Iterator[IO[str]]:
    """A text file, compressed if its name ends in ``.gz``; ``-`` is standard output."""
    if path == "-":
        yield sys.stdout
    else:
        with gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w") as f:
            yield f


def write_rows(frame: DataFrame, path: str, order: list[str], columns: list[str], separator: str = "\t", header: str | None = None, footer: list[str] | None = None) -> None:
    with opened(path) as out:
        if header is not None:
            out.write(header + "\n")
        for row in frame.orderBy(*order).select(*columns).toLocalIterator():
            out.write(separator.join("nan" if v is None else str(v) for v in row) + "\n")
        out.writelines(f"{line}\n" for line in footer or [])


def write_coverage(frame: DataFrame, path: str) -> None:
    """``.bed``, ``.bed.gz`` or standard output with names, ``.bedgraph`` without."""
    if path.endswith((".bed", ".bed.gz")) or path == "-":
        write_rows(frame, path, ["idx"], ["contig", "start", "stop", "name", "coverage"])
    elif path.lower().endswith((".bedgraph", ".bedgraph.gz")):
        write_rows(frame, path, ["idx"], ["contig", "start", "stop", "coverage"])
    else:
        raise UnsupportedFormatError(f"no coverage format for {path}")


def write_length_intervals(frame: DataFrame, path: str, short_reads: int = 150) -> None:
    names = ["contig", "start", "stop", "name", "mean", "median", "stdev", "min", "max", "count"]
    write_rows(frame, path, ["idx"], [*names, "short_fraction"], header="\t".join([*names, f"s{short_reads}"]))


def write_length_bins(frame: DataFrame, path: str, statistics: dict[str, float] | None = None) -> None:
    write_rows(frame, path, ["min"], ["min", "max", "count"], header="min\tmax\tcount", footer=[f"#{k}: {v}" for k, v in (statistics or {}).items()])


def write_signal(frame: DataFrame, path: str, sizes: list[tuple[str, int]] | None = None) -> None:
    """(contig, pos, value) as bigWig, or as bedGraph, compressed or on standard output."""
    place = {n: i for i, (n, _) in enumerate(sizes or [])}
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("contig")] if place else F.col("contig")
    rows = frame.select("contig", "pos", (F.col("pos") + 1).alias("stop"), F.col("value").cast("double").alias("value"), order.alias("ord"))
    if path.endswith((".bw", ".bigwig", ".bigWig")):
        if not sizes:
            raise InvalidInputError("a bigWig file needs the sizes of contigs")
        write_bigwig(path, sizes, ((r[0], r[1], r[2], r[3]) for r in rows.orderBy("ord", "pos").toLocalIterator()))
    elif path == "-" or path.lower().endswith((".bed.gz", ".bedgraph.gz", ".bedgraph", ".bed")):
        write_rows(rows, path, ["ord", "pos"], ["contig", "pos", "stop", "value"])
    else:
        raise UnsupportedFormatError(f"no signal format for {path}")


def write_wig(frame: DataFrame, path: str, contig: str, start: int) -> None:
    """Values of consecutive bases, one a line, under a fixedStep head."""
    n = frame.count()
    write_rows(frame, path, ["pos"], ["value"], header=f"fixedStep\tchrom={contig}\tstart={start}\tstep=1\tspan={n}")


def write_aggregate(frame: DataFrame, path: str, size: int) -> None:
    write_wig(frame.select(F.col("rel").alias("pos"), "value"), path, ".", -(size // 2))


def write_delfi(frame: DataFrame, path: str) -> None:
    columns = [c for c in frame.columns if c != "idx"]
    if path.endswith(".csv"):
        write_rows(frame, path, ["idx"], columns, ",", ",".join(columns))
    elif path == "-" or path.endswith((".bed", ".tsv", ".bed.gz")):
        write_rows(frame, path, ["idx"], columns, header="#" + "\t".join(columns))
    else:
        raise UnsupportedFormatError(f"no window format for {path}")


def write_motif_frequencies(frame: DataFrame, path: str) -> None:
    write_rows(frame, path, ["kmer"], ["kmer", "freq"], "," if path.endswith(".csv") else "\t")


def write_motif_intervals(wide: DataFrame, path: str) -> None:
    """The wide table of ``motifs.wide``, already in order."""
    sep = "," if path.endswith(".csv") else "\t"
    with opened(path) as out:
        out.write(sep.join(wide.columns) + "\n")
        for row in wide.toLocalIterator():
            out.write(sep.join(map(str, row)) + "\n")


def write_single_motif(counts: DataFrame, regions: DataFrame, kmer: str, path: str, names: bool = True) -> None:
    """One k-mer's counts by region, as BED or (without names) bedGraph."""
    found = counts.where(F.col("kmer") == kmer).select("idx", "n")
    out = regions.join(found, "idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    write_rows(out, path, ["idx"], ["contig", "start", "stop", *(["name"] if names else []), "n"])


def write_diversity(frame: DataFrame, regions: DataFrame, path: str) -> None:
    write_rows(regions.join(frame, "idx", "left"), path, ["idx"], ["contig", "start", "stop", "name", "mds"])


def write_gaps(gaps: DataFrame, path: str) -> None:
    write_rows(gaps, path, ["contig", "start", "stop", "type"], ["contig", "start", "stop", "type"])


def write_fragments(frags: DataFrame, path: str, strand: bool = True) -> None:
    """BED3, or the five columns that ``read_fragments`` takes."""
    columns = ["contig", "start", "stop"] + (["mapq", "strand"] if strand else [])
    out = frags.withColumn("strand", F.when(F.col("is_forward"), "+").otherwise("-")) if strand else frags
    write_rows(out, path, ["contig", "start", "stop"], columns)


def write_lengths(frame: DataFrame, path: str) -> None:
    """A fragment's length each: 32-bit numbers in ``.bin``, or lines on standard output."""
    rows = frame.select("length").toLocalIterator()
    if path == "-":
        sys.stdout.writelines(f"{r[0]}\n" for r in rows)
    elif path.endswith(".bin"):
        with open(path, "wb") as out:
            for r in rows:
                out.write(int(r[0]).to_bytes(4, "little", signed=True))
    else:
        raise UnsupportedFormatError("lengths go to .bin or to standard output")


def bam_to_bed(spark: SparkSession, bam: str, path: str, quality_threshold: int = 30) -> None:
    """The fragments of a BAM file as BED3; a failure is raised, not logged."""
    from fragspark.operators.fragments import from_reads

    write_fragments(from_reads(read_bam(spark, bam), quality_threshold), path, strand=False)
