"""Functions on sequences and coordinates, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError


def midpoint(start: Column, stop: Column) -> Column:
    """(start + stop) // 2 of non-negative coordinates, in integers."""
    return F.floor((start + stop) / 2).cast("bigint")


def div(a: Column, b: int) -> Column:
    """Floor division by a positive number."""
    return F.floor(a / F.lit(b)).cast("bigint")


def reverse_complement(seq: Column) -> Column:
    """Reversed, A with T and C with G exchanged; lower case becomes upper, other letters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def is_kmer(kmer: Column, k: int) -> Column:
    """A string of k letters, all of them A, C, G or T."""
    return kmer.rlike(f"^[ACGT]{{{k}}}$")


def gen_kmers(spark: SparkSession, k: int, bases: str = "ACGT") -> DataFrame:
    """All strings of k bases, a row each (``kmer``)."""
    if k < 0:
        raise InvalidInputError("k must not be negative")
    n = len(bases)
    letters = F.array(*[F.lit(b) for b in bases])
    digits = [letters[((F.col("id") / F.lit(n**p)).cast("bigint") % n).cast("int")] for p in range(k - 1, -1, -1)]
    return spark.range(n**k).select((F.concat(*digits) if digits else F.lit("")).alias("kmer"))


def shannon_diversity(counts: DataFrame, k: int, by: list[str], value: str = "n", miller_madow: bool = False, total: str | None = None) -> DataFrame:
    """(by..., mds): normalised Shannon entropy of each group's k-mer counts, -sum(p ln p) / ln(4^k); null without counts.

    ``miller_madow`` adds (m - 1) / 2N before normalising, with m the k-mers seen and N the counts, or the column ``total``.
    """
    n = F.sum(value)
    sums = counts.groupBy(*by).agg(
        n.alias("_n"),
        F.sum(F.when(F.col(value) > 0, F.col(value) * F.ln(F.col(value)))).alias("_nlogn"),
        F.count_if(F.col(value) > 0).alias("_m"),
        (F.max(total) if total else n).alias("_total"),
    )
    entropy = F.ln("_n") - F.col("_nlogn") / F.col("_n")
    if miller_madow:
        entropy = entropy + F.try_divide((F.col("_m") - 1).cast("double"), 2 * F.col("_total"))
    return sums.select(*by, F.when(F.col("_n") > 0, entropy / F.ln(F.lit(float(4**k)))).alias("mds"))


def register(spark: SparkSession) -> None:
    """SQL names: frag_midpoint(start, stop) and reverse_complement(seq)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION frag_midpoint(a BIGINT, b BIGINT) RETURNS BIGINT RETURN (a + b) DIV 2")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCATGCA'))")
