"""Command line: one command for each feature, from files to files."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError, MissingReferenceError
from fragspark.operators import coverage as C
from fragspark.operators import delfi as D
from fragspark.operators import filtering, motifs, profiles
from fragspark.operators import fragments as fr
from fragspark.operators import intervals as iv
from fragspark.sources import binary, text, writers

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def _fragments(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    path = a.input_file
    if path.endswith(".cram") and not getattr(a, "reference", None):
        raise MissingReferenceError("CRAM needs its reference")
    if path.endswith((".bam", ".cram")):
        return fr.from_reads(binary.read_bam(spark, path), 0)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return text.read_fragments(spark, path)


def _signal(spark: SparkSession, path: str) -> DataFrame:
    s = spark.read.parquet(path) if path.endswith(".parquet") else binary.read_bigwig(spark, path)
    return s.select("contig", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"), "value")


def _sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    return [(r["contig"], r["size"]) for r in text.read_sizes(spark, path).orderBy("ord").collect()]


def _command(name: str, *options: Callable[[argparse.ArgumentParser], object]):
    def add(run: Callable[[SparkSession, argparse.Namespace], None]):
        def build(p: argparse.ArgumentParser) -> None:
            p.add_argument("input_file")
            for o in options:
                o(p)

        COMMANDS[name] = (build, run)
        return run

    return add


def arg(*names: str, **kw) -> Callable[[argparse.ArgumentParser], object]:
    return lambda p: p.add_argument(*names, **kw)


def output(default: str = "-"):
    return arg("-o", "--output-file", default=default)


def quality(default: int = 30):
    return arg("-q", "--quality-threshold", type=int, default=default)


def lengths(low: int | None = None, high: int | None = None):
    return lambda p: (p.add_argument("-min", "--min-length", type=int, default=low), p.add_argument("-max", "--max-length", type=int, default=high))


POLICY = arg("-p", "--intersect-policy", choices=fr.POLICIES, default="midpoint")
INTERVALS = arg("interval_file")
SIZES = arg("-c", "--chrom-sizes")
REFERENCE = arg("reference")
KMER = lambda k: arg("-k", type=int, default=k)
STRAND = arg("--strand", choices=("both", "forward", "reverse"), default="both")


def _strands(a: argparse.Namespace) -> dict[str, bool]:
    return {"both_strands": a.strand == "both", "negative_strand": a.strand == "reverse"}


@_command("coverage", INTERVALS, output(), quality(), lengths(0), POLICY, arg("-s", "--scale-factor", type=float, default=1.0), arg("-n", "--normalize", action="store_true"))
def coverage(spark, a):
    out = C.coverage(_fragments(spark, a), text.read_intervals(spark, a.interval_file), a.scale_factor, a.normalize, a.intersect_policy, quality_threshold=a.quality_threshold, min_length=a.min_length, max_length=a.max_length)
    writers.write_coverage(out, a.output_file)


@_command("frag-length-bins", output(), quality(), lengths(0), POLICY, arg("--contig"), arg("--start", type=int), arg("--stop", type=int), arg("--bin-size", type=int, default=1), arg("--summary-stats", action="store_true"), arg("--short-fraction", type=int, default=150))
def frag_length_bins(spark, a):
    f = _fragments(spark, a)
    where = {"contig": a.contig, "start": a.start, "stop": a.stop, "quality_threshold": a.quality_threshold, "intersect_policy": a.intersect_policy}
    out = C.length_bins(f, a.min_length, a.max_length, a.bin_size, **where)
    found = None
    if a.summary_stats:
        row = C.length_statistics(C.length_counts(f, min_length=a.min_length, max_length=a.max_length, **where), [], a.short_fraction).first()
        found = row.asDict() if row else {}
    writers.write_length_bins(out, a.output_file, found)


@_command("frag-length-intervals", INTERVALS, output(), quality(), lengths(0), POLICY, arg("--short-reads", type=int, default=150))
def frag_length_intervals(spark, a):
    out = C.length_intervals(_fragments(spark, a), text.read_intervals(spark, a.interval_file).drop("strand"), a.short_reads, intersect_policy=a.intersect_policy, quality_threshold=a.quality_threshold, min_length=a.min_length, max_length=a.max_length)
    writers.write_length_intervals(out, a.output_file, a.short_reads)


@_command("cleavage-profile", INTERVALS, arg("chrom_sizes"), output(), quality(20), lengths(0), arg("--left", type=int, default=0), arg("--right", type=int, default=0))
def cleavage_profile(spark, a):
    sizes = text.read_sizes(spark, a.chrom_sizes)
    regions = iv.padded(text.read_intervals(spark, a.interval_file), sizes, a.left, a.right).withColumn("idx", F.monotonically_increasing_id())
    out = profiles.cleavage_profile(_fragments(spark, a), regions, a.min_length, a.max_length, a.quality_threshold)
    writers.write_signal(out.withColumnRenamed("proportion", "value"), a.output_file, _sizes(spark, a.chrom_sizes))


@_command("wps", INTERVALS, SIZES, output(), quality(), lengths(120, 180), arg("-w", "--window-size", type=int, default=120), arg("-i", "--interval-size", type=int, default=5000))
def wps(spark, a):
    sizes = text.read_sizes(spark, a.chrom_sizes) if a.chrom_sizes else None
    regions = iv.centred(text.read_intervals(spark, a.interval_file), sizes, a.interval_size)
    out = profiles.wps(_fragments(spark, a), regions, a.window_size, a.min_length, a.max_length, a.quality_threshold)
    writers.write_signal(out.select("contig", F.col("start").alias("pos"), F.col("wps").alias("value")), a.output_file, _sizes(spark, a.chrom_sizes) if a.chrom_sizes else None)


@_command("adjust-wps", INTERVALS, arg("chrom_sizes"), output(), arg("-i", "--interval-size", type=int, default=5000), arg("-m", "--median-window-size", type=int, default=1000), arg("--savgol-window-size", type=int, default=21), arg("--savgol-poly-deg", type=int, default=2), arg("--no-savgol", action="store_true"), arg("--mean", action="store_true"), arg("--subtract-edges", action="store_true"), arg("--edge-size", type=int, default=500))
def adjust_wps(spark, a):
    half = a.interval_size // 2 + a.median_window_size // 2
    r = iv.centred(text.read_intervals(spark, a.interval_file), None, 2 * half)
    merged = iv.merge(r.select("contig", "start", "stop"), strictly=True).withColumn("idx", F.monotonically_increasing_id())
    s = _signal(spark, a.input_file).withColumn("stop", F.col("pos") + 1).withColumnRenamed("pos", "start")
    joined = iv.interval_join(s, merged).select(F.col("r_idx").alias("idx"), "contig", F.col("start").alias("pos"), "value")
    out = profiles.adjust(joined, a.median_window_size, a.mean, a.edge_size if a.subtract_edges else None, None if a.no_savgol else (a.savgol_window_size, a.savgol_poly_deg))
    writers.write_signal(out.where("status = 'ok'"), a.output_file, _sizes(spark, a.chrom_sizes))


@_command("delfi", REFERENCE, arg("chrom_sizes"), arg("bins_file"), output(), quality(), arg("-b", "--blacklist-file"), arg("-g", "--gap-file"), arg("--no-gc-correct", action="store_true"), arg("--keep-nocov", action="store_true"), arg("--no-merge-bins", action="store_true"))
def delfi(spark, a):
    sizes = text.read_sizes(spark, a.chrom_sizes).withColumnRenamed("ord", "c_ord")
    bins = text.read_intervals(spark, a.bins_file).join(F.broadcast(sizes), "contig")
    # the order of contigs in the sizes file, then of bins
    from pyspark.sql import Window

    bins = bins.withColumn("idx", F.row_number().over(Window.orderBy("c_ord", "idx"))).select("contig", "start", "stop", "idx")
    gaps = text.read_gaps(spark, a.gap_file) if a.gap_file else None
    black = text.read_intervals(spark, a.blacklist_file) if a.blacklist_file else None
    out = D.delfi(_fragments(spark, a), bins, binary.read_reference(spark, a.reference), gaps, black, a.quality_threshold, not a.no_gc_correct, not a.keep_nocov, not a.no_merge_bins)
    writers.write_delfi(out, a.output_file)


def _kmers(spark, a, frags, keep=None):
    make = motifs.breakpoint_kmers if a.command.endswith("breakpoint-motifs") else motifs.end_kmers
    return make(frags, binary.read_reference(spark, a.reference), a.k, keep=keep, **_strands(a))


def _genome_motifs(spark, a):
    f = _fragments(spark, a).where(F.col("mapq") >= a.quality_threshold)
    writers.write_motif_frequencies(motifs.motif_frequencies(_kmers(spark, a, f), a.k), a.output_file)


def _interval_motifs(spark, a):
    regions = text.read_intervals(spark, a.interval_file).drop("strand")
    f = motifs.of_intervals(_fragments(spark, a), regions, a.quality_threshold)
    counts = motifs.interval_counts(_kmers(spark, a, f, ["idx"]))
    if a.k <= 4:
        writers.write_motif_intervals(motifs.wide(counts, regions, a.k, not a.counts), a.output_file)
    else:
        writers.write_rows(counts.join(regions, "idx"), a.output_file, ["idx", "kmer"], ["contig", "start", "stop", "name", "kmer", "n"])


_command("end-motifs", REFERENCE, output(), quality(20), KMER(4), STRAND)(_genome_motifs)
_command("breakpoint-motifs", REFERENCE, output(), quality(20), KMER(6), STRAND)(_genome_motifs)
_command("interval-end-motifs", REFERENCE, INTERVALS, output(), quality(20), KMER(4), STRAND, arg("--counts", action="store_true"))(_interval_motifs)
_command("interval-breakpoint-motifs", REFERENCE, INTERVALS, output(), quality(20), KMER(6), STRAND, arg("--counts", action="store_true"))(_interval_motifs)


@_command("mds", arg("-s", "--sep", default="\t"), arg("--header", type=int, default=0))
def mds(spark, a):
    f = text.read_motif_frequencies(spark, a.input_file, a.sep, a.header)
    k = len(f.first()["kmer"])
    print(motifs.diversity(f.withColumnRenamed("freq", "n"), k).first()["mds"])


@_command("regional-mds", output(), arg("-s", "--sep", default="\t"), arg("--miller-madow", action="store_true"))
def regional_mds(spark, a):
    c = text.read_motif_intervals(spark, a.input_file, a.sep)
    k = len(c.first()["kmer"])
    regions = c.select("contig", "start", "stop", "name", "idx").distinct()
    writers.write_diversity(motifs.interval_diversity(c, k, a.miller_madow, "total"), regions, a.output_file)


@_command("filter-file", output(), quality(), lengths(), POLICY, arg("-w", "--whitelist-file"), arg("-b", "--blacklist-file"))
def filter_file(spark, a):
    read = lambda p: text.read_intervals(spark, p) if p else None
    out = filtering.filter_fragments(_fragments(spark, a), read(a.whitelist_file), read(a.blacklist_file), a.min_length, a.max_length, a.intersect_policy, a.quality_threshold)
    writers.write_fragments(out, a.output_file)


@_command("agg-bw", INTERVALS, output(), arg("-m", "--median-window-size", type=int, default=1), arg("--mean", action="store_true"))
def agg_bw(spark, a):
    regions = text.read_intervals(spark, a.interval_file)
    first = regions.orderBy("idx").first()
    if first is None:
        raise InvalidInputError("no intervals")
    size = first["stop"] - first["start"]
    writers.write_aggregate(profiles.aggregate_signal(_signal(spark, a.input_file), regions, size, a.median_window_size, a.mean), a.output_file, size)


@_command("gap-bed", output(), arg("--strip-chr", action="store_true"))
def gap_bed(spark, a):
    writers.write_gaps(text.read_ucsc_gaps(spark, a.input_file, a.strip_chr), a.output_file)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fragspark", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, (build, _) in COMMANDS.items():
        build(commands.add_parser(name))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("fragspark").getOrCreate()
    COMMANDS[a.command][1](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
