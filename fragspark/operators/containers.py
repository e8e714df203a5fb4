"""Tables of k-mers with the accessors that a caller of single values wants. The data stay DataFrames; an accessor collects what it returns, 4^k rows at most."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.functions.sequence import shannon_diversity
from fragspark.sources import text, writers


class MotifFrequencies:
    """(kmer, freq) of a whole genome."""

    def __init__(self, table: DataFrame, k: int, quality_threshold: int = 30) -> None:
        self.table, self.k, self.quality_threshold = table, k, quality_threshold

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, quality_threshold: int = 30, separator: str = "\t", header: int = 0) -> MotifFrequencies:
        table = text.read_motif_frequencies(spark, path, separator, header)
        return cls(table, len(table.first()["kmer"]), quality_threshold)

    def __iter__(self) -> Iterator[tuple[str, float]]:
        return iter([(r["kmer"], r["freq"]) for r in self.table.orderBy("kmer").collect()])

    def __len__(self) -> int:
        return 4**self.k

    def __str__(self) -> str:
        return "".join(f"{kmer}: {freq}\n" for kmer, freq in self)

    def kmers(self) -> list[str]:
        return [kmer for kmer, _ in self]

    def frequencies(self) -> list[float]:
        return [freq for _, freq in self]

    def freq(self, kmer: str) -> float:
        row = self.table.where(F.col("kmer") == kmer).first()
        if row is None:
            raise InvalidInputError(f"no {self.k}-mer {kmer}")
        return row["freq"]

    def mds(self, miller_madow: bool = False) -> float:
        return shannon_diversity(self.table, self.k, [], "freq", miller_madow).first()["mds"]

    def write(self, path: str) -> None:
        writers.write_motif_frequencies(self.table, path)


class MotifIntervals:
    """(idx, kmer, n) of regions (contig, start, stop, name, idx)."""

    def __init__(self, counts: DataFrame, regions: DataFrame, k: int, quality_threshold: int = 30) -> None:
        self.counts, self.regions, self.k, self.quality_threshold = counts, regions, k, quality_threshold

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, quality_threshold: int = 30, separator: str = ",") -> MotifIntervals:
        long = text.read_motif_intervals(spark, path, separator)
        regions = long.select("contig", "start", "stop", "name", "idx").distinct()
        return cls(long.select("idx", "kmer", "n"), regions, len(long.first()["kmer"]), quality_threshold)

    def freq(self, kmer: str) -> DataFrame:
        """(contig, start, stop, name, idx, n): a row for each region, 0 where the k-mer doesn't occur."""
        own = self.counts.where(F.col("kmer") == kmer).select("idx", "n")
        return self.regions.join(own, "idx", "left").select("contig", "start", "stop", "name", "idx", F.coalesce("n", F.lit(0)).alias("n"))

    def mds_bed(self, path: str, miller_madow: bool = False) -> None:
        writers.write_diversity(shannon_diversity(self.counts, self.k, ["idx"], miller_madow=miller_madow), self.regions, path)

    def to_bed(self, kmer: str, path: str) -> None:
        writers.write_single_motif(self.counts, self.regions, kmer, path)

    def to_bedgraph(self, kmer: str, path: str) -> None:
        writers.write_single_motif(self.counts, self.regions, kmer, path, names=False)


def resolve_length_aliases(min_length: int | None = None, max_length: int | None = None, fraction_low: int | None = None, fraction_high: int | None = None) -> tuple[int | None, int | None]:
    """The bounds of lengths, which older callers give as ``fraction_low`` and ``fraction_high``; both names of one bound are an error."""
    found = []
    for new, old, name in ((min_length, fraction_low, "min_length"), (max_length, fraction_high, "max_length")):
        if new is not None and old is not None:
            raise InvalidInputError(f"{name} is given under two names")
        found.append(old if new is None else new)
    return tuple(found)
