"""Schemas of the record types. Coordinates are 0-based and half-open everywhere."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

FRAGMENT = _struct(("contig", _S), ("start", _L), ("stop", _L), ("mapq", _I), ("is_forward", _B))
INTERVAL = _struct(("contig", _S), ("start", _L), ("stop", _L), ("name", _S), ("idx", _L))
CHROM_SIZE = _struct(("contig", _S), ("size", _L), ("ord", _L))
GAP = _struct(("contig", _S), ("start", _L), ("stop", _L), ("type", _S))
TILE = _struct(("contig", _S), ("tile", _L), ("seq", _S))
SIGNAL = _struct(("contig", _S), ("start", _L), ("stop", _L), ("value", _D))
KMER = _struct(("kmer", _S), ("freq", _D))
READ = _struct(
    ("flag", _I), ("contig", _S), ("start", _L), ("stop", _L), ("mapq", _I), ("tlen", _L), ("mate_contig", _S), ("mate_start", _L), ("mate_mapq", _I)
)
