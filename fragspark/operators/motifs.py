"""End motifs and breakpoint motifs, from fragments and tiles of the reference.

The reference is a table of tiles (contig, tile, seq) of ``TILE`` bases and ``LAP``
more from the next, so a k-mer that begins in a tile lies in it. A fragment looks its
k-mers up by an equality join on (contig, tile); no sequence longer than a tile moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.functions.sequence import div, gc_count, gen_kmers, is_kmer, reverse_complement, shannon_diversity
from fragspark.operators.intervals import interval_join

TILE, LAP = 1000, 64


def tiles(sequences: DataFrame, tile: int = TILE, lap: int = LAP) -> DataFrame:
    """(contig, tile, seq) from whole sequences (contig, seq), in upper case: each sequence is cut once, from front to end, and a tile takes its lap from the next."""
    parts = F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))
    cut = sequences.where(F.length("seq") > 0).select("contig", parts.alias("parts"))
    lapped = F.expr(f"transform(parts, (x, i) -> concat(x, coalesce(substring(get(parts, i + 1), 1, {lap}), '')))")
    return cut.select("contig", F.posexplode(lapped).alias("tile", "seq")).select("contig", F.col("tile").cast("bigint").alias("tile"), "seq")


def sizes_of(reference: DataFrame, tile: int = TILE) -> DataFrame:
    """(contig, size) of a tiled reference; where a table of sizes is at hand, give that instead and save a scan."""
    last = F.max_by(F.col("tile") * tile + F.length("seq"), F.col("tile"))
    return reference.groupBy("contig").agg(last.cast("bigint").alias("size"))


def _lookup(ends: DataFrame, reference: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """Adds ``raw``: the k bases from ``at`` on, shorter at the end of the contig; rows before the contig's start or on no contig go."""
    if k > LAP:
        raise InvalidInputError(f"k-mers of up to {LAP} bases lie in a tile")
    found = ends.where("at >= 0").withColumn("tile", div(F.col("at"), tile)).join(reference, ["contig", "tile"])
    return found.withColumn("raw", F.substring(F.col("seq"), (F.col("at") - F.col("tile") * tile + 1).cast("int"), F.lit(k))).drop("seq", "tile")


def _ends(frags: DataFrame, k: int, keep: list[str], both_strands: bool, negative_strand: bool, shift: int, start_ok: Column) -> DataFrame:
    """A row for each end to look at: where its k-mer begins, and whether it is read backwards."""
    if both_strands and negative_strand:
        raise InvalidInputError("either both strands or the negative one")
    forward = F.struct((F.col("start") - shift).alias("at"), F.lit(False).alias("reverse"))
    reverse = F.struct((F.col("stop") - k + shift).alias("at"), F.lit(True).alias("reverse"))
    if both_strands:
        ends = F.array(forward, reverse)
    elif negative_strand:
        ends = F.array(reverse)
    else:
        ends = F.when(F.col("is_forward"), F.array(forward)).otherwise(F.array().cast("array<struct<at:bigint,reverse:boolean>>"))
    return frags.where(start_ok).select("contig", *keep, F.explode(ends).alias("e")).select("contig", *keep, "e.at", "e.reverse")


def end_kmers(frags: DataFrame, reference: DataFrame, k: int = 4, both_strands: bool = True, negative_strand: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(keep..., kmer): the k bases at fragments' ends, the reverse end complemented; k-mers with other letters are left out.

    On both strands a fragment whose start is past its contig has no k-mer at all.
    """
    frags = frags.where("stop > start") if both_strands else frags
    found = _lookup(_ends(frags, k, keep or [], both_strands, negative_strand, 0, F.lit(True)), reference, k)
    return _kmers(found, k, keep or [])


def breakpoint_kmers(frags: DataFrame, reference: DataFrame, k: int = 6, both_strands: bool = True, negative_strand: bool = False, keep: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(keep..., kmer): k/2 bases on each side of fragments' ends; fragments too near the start breakpoint's contig end are left out."""
    if k % 2:
        raise InvalidInputError("breakpoint motifs have an even length")
    h = k // 2
    sized = frags.join(sizes_of(reference) if sizes is None else sizes, "contig")
    ok = (F.col("start") - h >= 0) & (F.col("start") + h < F.col("size"))
    found = _lookup(_ends(sized, k, keep or [], both_strands, negative_strand, h, ok), reference, k)
    return _kmers(found, k, keep or [])


def _kmers(found: DataFrame, k: int, keep: list[str]) -> DataFrame:
    kmer = F.when(F.col("reverse"), reverse_complement(F.col("raw"))).otherwise(F.col("raw"))
    return found.where(is_kmer(F.col("raw"), k)).select(*keep, kmer.alias("kmer"))


def motif_counts(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, n) for all 4^k k-mers."""
    n = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return gen_kmers(kmers.sparkSession, k).join(n, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def motif_frequencies(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, freq): counts by their sum; null where nothing was counted."""
    counts = motif_counts(kmers, k)
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("kmer", F.try_divide(F.col("n"), F.col("total")).alias("freq"))


def of_intervals(frags: DataFrame, regions: DataFrame, quality_threshold: int = 30) -> DataFrame:
    """Fragments (with a column ``idx``) that overlap each region at all; no other filter."""
    f = frags.where(F.col("mapq") >= quality_threshold)
    joined = interval_join(f, regions.select("contig", "start", "stop", "idx"), "any")
    return joined.select(*f.columns, F.col("r_idx").alias("idx"))


def interval_counts(kmers: DataFrame) -> DataFrame:
    """(idx, kmer, n), only k-mers that occur; the rest are 0."""
    return kmers.groupBy("idx", "kmer").agg(F.count(F.lit(1)).alias("n"))


def wide(counts: DataFrame, regions: DataFrame, k: int, frequencies: bool = True) -> DataFrame:
    """A row for each region: its name, count and a column for each k-mer, frequencies with six decimals or raw counts."""
    if k > 4:
        raise InvalidInputError("up to 256 columns; longer k-mers stay in rows")
    names = [r["kmer"] for r in gen_kmers(counts.sparkSession, k).orderBy("kmer").collect()]
    pivoted = counts.groupBy("idx").pivot("kmer", names).agg(F.sum("n"))
    total = counts.groupBy("idx").agg(F.sum("n").alias("count"))
    out = regions.join(total, "idx", "left").join(pivoted, "idx", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    cell = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = lambda c: F.format_string("%.6f", cell(c) / F.col("count")) if frequencies else cell(c)
    none = lambda c: F.when(F.col("count") > 0, value(c)).otherwise(F.lit("NaN")) if frequencies else value(c)
    return out.orderBy("idx").select("contig", "start", "stop", "name", "count", *[none(c).alias(c) for c in names])


def diversity(counts: DataFrame, k: int, miller_madow: bool = False) -> DataFrame:
    """(mds): one row for a table of (kmer, n)."""
    return shannon_diversity(counts, k, [], miller_madow=miller_madow)


def interval_diversity(counts: DataFrame, k: int, miller_madow: bool = False, total: str | None = None) -> DataFrame:
    """(idx, mds)."""
    return shannon_diversity(counts, k, ["idx"], miller_madow=miller_madow, total=total)


def gc_of(regions: DataFrame, reference: DataFrame, tile: int = TILE, sizes: DataFrame | None = None) -> DataFrame:
    """(idx, gc_bases): G and C in each region; regions that aren't inside their contig count 0."""
    sized = regions.join(sizes_of(reference) if sizes is None else sizes, "contig")
    inside = sized.where((F.col("start") >= 0) & (F.col("start") < F.col("size")) & (F.col("stop") <= F.col("size")) & (F.col("start") < F.col("stop")))
    cut = inside.select("idx", "contig", "start", "stop", F.explode(F.sequence(div(F.col("start"), tile), div(F.col("stop") - 1, tile))).alias("tile"))
    j = cut.join(reference, ["contig", "tile"])
    low = F.greatest(F.col("start") - F.col("tile") * tile, F.lit(0))
    high = F.least(F.col("stop") - F.col("tile") * tile, F.lit(tile))
    part = F.substring(F.col("seq"), (low + 1).cast("int"), (high - low).cast("int"))
    counted = j.groupBy("idx").agg(F.sum(gc_count(part)).alias("gc_bases"))
    return regions.select("idx").join(counted, "idx", "left").select("idx", F.coalesce("gc_bases", F.lit(0)).alias("gc_bases"))
