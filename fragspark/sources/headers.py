"""What a fragment file says about its contigs, from its first bytes alone, through Spark's own file systems."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError
from fragspark.sources import text

#: Compressed bytes read at a time, until the header is whole.
STEP = 1 << 16


def is_sam(path: str) -> bool:
    """Whether the file holds alignments, not fragments."""
    return path.lower().endswith((".sam", ".bam", ".cram"))


def _inflated(spark: SparkSession, path: str):
    """The file's content piece by piece; its gzip members follow one another."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        member = zlib.decompressobj(31)
        while data := bytes(stream.readNBytes(STEP)):
            while data:
                yield member.decompress(data)
                data = member.unused_data
                if member.eof:
                    member = zlib.decompressobj(31)
    finally:
        stream.close()


def bam_contigs(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(contig, size) in the order of a BAM file's header."""
    pieces, have = _inflated(spark, path), bytearray()

    def upto(n: int) -> None:
        while len(have) < n:
            piece = next(pieces, None)
            if piece is None:
                raise InvalidInputError(f"{path} has no whole BAM header")
            have.extend(piece)

    upto(8)
    if have[:4] != b"BAM\x01":
        raise InvalidInputError(f"{path} is no BAM file")
    at = 8 + struct.unpack_from("<i", have, 4)[0]
    upto(at + 4)
    count, at, out = struct.unpack_from("<i", have, at)[0], at + 4, []
    for _ in range(count):
        upto(at + 4)
        n = struct.unpack_from("<i", have, at)[0]
        upto(at + 8 + n)
        out.append((have[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", have, at + 4 + n)[0]))
        at += 8 + n
    return out


def contigs(spark: SparkSession, path: str, sizes: str | None = None) -> DataFrame:
    """(contig, size, ord): from a file of sizes where one is given, else from a BAM's header; a file of fragments alone doesn't know them."""
    if sizes is not None:
        return text.read_sizes(spark, sizes)
    if not is_sam(path):
        raise InvalidInputError("a file of fragments needs a file of contig sizes")
    rows = [(c, n, i) for i, (c, n) in enumerate(bam_contigs(spark, path))]
    return spark.createDataFrame(rows, "contig string, size bigint, ord bigint")


def chroms(spark: SparkSession, path: str) -> dict[str, int | None]:
    """Contigs and sizes; of a file of fragments its contigs, without sizes."""
    if is_sam(path):
        return dict(bam_contigs(spark, path))
    return {r["contig"]: None for r in text.read_fragments(spark, path).select("contig").distinct().orderBy("contig").collect()}
