"""Binary formats on the standard library: BGZF and BAM, 2bit and FASTA, bigWig.

Each decoder takes bytes and gives rows; Spark brings the bytes (``binaryFile``, from any store) and
runs one task a file. They are meant for converting to Parquet once: a Parquet table of
fragments or tiles is what queries should read at scale. CRAM needs an external codec
and raises UnsupportedFormatError.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fragspark.errors import InvalidInputError, UnsupportedFormatError

TILE, LAP = 1000, 64
TILE_SQL = "contig string, tile bigint, seq string"
READ_SQL = "flag int, contig string, start bigint, stop bigint, mapq int, tlen bigint, mate_contig string, mate_start bigint, mate_mapq int"
SIGNAL_SQL = "contig string, start bigint, stop bigint, value double"


def _files(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[list]], schema: str) -> DataFrame:
    from fragspark import ship

    ship(spark)
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows: list = []
                for row in decode(content):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _tiles(contig: str, seq: str) -> Iterator[tuple]:
    for at in range(0, len(seq), TILE):
        yield contig, at // TILE, seq[at : at + TILE + LAP]


def fasta_tiles(content: bytes) -> Iterator[tuple]:
    """Tiles of every record, in upper case; the name ends at the first blank."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    for record in content.decode().split(">")[1:]:
        head, _, body = record.partition("\n")
        yield from _tiles(head.split()[0], "".join(body.split()).upper())


TWOBIT_SIGNATURE = 0x1A412743


def twobit_tiles(content: bytes) -> Iterator[tuple]:
    """Tiles of every sequence of a 2bit file: four bases a byte (T, C, A, G), and blocks of N."""
    order = "<" if struct.unpack("<I", content[:4])[0] == TWOBIT_SIGNATURE else ">"
    signature, _, count, _ = struct.unpack(order + "4I", content[:16])
    if signature != TWOBIT_SIGNATURE:
        raise InvalidInputError("no 2bit file")
    at, index = 16, []
    for _ in range(count):
        n = content[at]
        index.append((content[at + 1 : at + 1 + n].decode(), struct.unpack(order + "I", content[at + 1 + n : at + 5 + n])[0]))
        at += 5 + n
    letters = np.frombuffer(b"TCAG", np.uint8)
    for name, at in index:
        size, blocks = struct.unpack(order + "2I", content[at : at + 8])
        at += 8
        starts = np.frombuffer(content, order + "u4", blocks, at)
        lengths = np.frombuffer(content, order + "u4", blocks, at + 4 * blocks)
        at += 8 * blocks
        masks = struct.unpack(order + "I", content[at : at + 4])[0]
        at += 4 + 8 * masks + 4
        packed = np.frombuffer(content, np.uint8, (size + 3) // 4, at)
        bases = letters[np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()[:size]]
        for s, n in zip(starts.tolist(), lengths.tolist()):
            bases[s : s + n] = ord("N")
        yield from _tiles(name, bases.tobytes().decode())


def write_twobit(path: str, sequences: dict[str, str]) -> None:
    """A 2bit file of upper-case sequences; letters other than ACGT are N."""
    code = np.zeros(256, np.uint8)
    for i, c in enumerate(b"TCAG"):
        code[c] = i
    heads, bodies = [], []
    for name, seq in sequences.items():
        raw = np.frombuffer(seq.upper().encode(), np.uint8)
        unknown = ~np.isin(raw, np.frombuffer(b"ACGT", np.uint8))
        edges = np.flatnonzero(np.diff(unknown.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        two = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
        two[: len(raw)] = code[raw]
        two = two.reshape(-1, 4)
        packed = (two[:, 0] << 6 | two[:, 1] << 4 | two[:, 2] << 2 | two[:, 3]).tobytes()
        bodies.append(struct.pack("<2I", len(raw), len(starts)) + starts.astype("<u4").tobytes() + (ends - starts).astype("<u4").tobytes() + struct.pack("<2I", 0, 0) + packed)
        heads.append(name.encode())
    at = 16 + sum(len(h) + 5 for h in heads)
    out = struct.pack("<4I", TWOBIT_SIGNATURE, 0, len(heads), 0)
    for h, b in zip(heads, bodies):
        out += bytes([len(h)]) + h + struct.pack("<I", at)
        at += len(b)
    with open(path, "wb") as f:
        f.write(out + b"".join(bodies))


#: How many reference bases an operation of an alignment takes: M, D, N, = and X.
CONSUMING = (0, 2, 3, 7, 8)


def bam_reads(content: bytes) -> Iterator[tuple]:
    """Alignments of a BAM file: flag, place, quality, template length, mate, and the mate's quality where tagged (MQ)."""
    data = gzip.decompress(content)
    if data[:4] != b"BAM\x01":
        raise InvalidInputError("no BAM file")
    at = 8 + struct.unpack("<i", data[4:8])[0]
    count = struct.unpack("<i", data[at : at + 4])[0]
    at += 4
    names = []
    for _ in range(count):
        n = struct.unpack("<i", data[at : at + 4])[0]
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    name = lambda i: names[i] if i >= 0 else None
    while at + 4 <= len(data):
        size = struct.unpack("<i", data[at : at + 4])[0]
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", data[at + 4 : at + 36])
        ops = at + 36 + l_name
        span = sum(op >> 4 for op in struct.unpack(f"<{n_ops}I", data[ops : ops + 4 * n_ops]) if op & 15 in CONSUMING)
        tags = ops + 4 * n_ops + (l_seq + 1) // 2 + l_seq
        yield flag, name(ref), pos, pos + span, mapq, tlen, name(mate), mate_pos, _tag(data, tags, at + 4 + size, b"MQ")
        at += 4 + size


#: Sizes of a tag's values by type.
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def _tag(data: bytes, at: int, end: int, wanted: bytes) -> int | None:
    while at + 3 <= end:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(data[at])] * struct.unpack("<i", data[at + 1 : at + 5])[0]
        else:
            if tag == wanted and kind in TAG_FORMATS:
                return struct.unpack(TAG_FORMATS[kind], data[at : at + TAG_SIZES[kind]])[0]
            at += TAG_SIZES[kind]
    return None


def bgzf(data: bytes) -> bytes:
    """Data in blocks of a BGZF file, with its end block."""
    out = []
    for at in [*range(0, len(data), 65_280), None]:
        part = b"" if at is None else data[at : at + 65_280]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(part), len(part)))
    return b"".join(out)


BIGWIG_SIGNATURE = 0x888FFC26


def bigwig_signal(content: bytes) -> Iterator[tuple]:
    """(contig, start, stop, value) of all sections of a bigWig file, whichever of the three kinds they are."""
    if struct.unpack("<I", content[:4])[0] != BIGWIG_SIGNATURE:
        raise InvalidInputError("no bigWig file")
    _, _, _, tree, _, index, _, _, _, _, room, _ = struct.unpack("<IHHQQQHHQQIQ", content[:64])
    names = {}
    _, _, key, value, count, _ = struct.unpack("<4I2Q", content[tree : tree + 32])

    def walk(at: int) -> None:
        leaf, _, n = struct.unpack("<BBH", content[at : at + 4])
        for i in range(n):
            p = at + 4 + i * (key + 8)
            if leaf:
                names[struct.unpack("<I", content[p + key : p + key + 4])[0]] = content[p : p + key].rstrip(b"\0").decode()
            else:
                walk(struct.unpack("<Q", content[p + key : p + key + 8])[0])

    walk(tree + 32)

    def blocks(at: int) -> Iterator[tuple[int, int]]:
        leaf, _, n = struct.unpack("<BBH", content[at : at + 4])
        for i in range(n):
            if leaf:
                yield struct.unpack("<2Q", content[at + 20 + 32 * i : at + 36 + 32 * i])
            else:
                yield from blocks(struct.unpack("<Q", content[at + 20 + 24 * i : at + 28 + 24 * i])[0])

    for at, size in blocks(index + 48):
        section = zlib.decompress(content[at : at + size]) if room else content[at : at + size]
        chrom, start, _, step, span, kind, _, n = struct.unpack("<5IBBH", section[:24])
        for i in range(n):
            if kind == 1:
                a, b, v = struct.unpack("<IIf", section[24 + 12 * i : 36 + 12 * i])
            elif kind == 2:
                a, v = struct.unpack("<If", section[24 + 8 * i : 32 + 8 * i])
                b = a + span
            else:
                v = struct.unpack("<f", section[24 + 4 * i : 28 + 4 * i])[0]
                a, b = start + step * i, start + step * i + span
            yield names[chrom], a, b, v


def write_bigwig(path: str, sizes: list[tuple[str, int]], rows: Iterator[tuple[str, int, int, float]], per_section: int = 1024) -> None:
    """A bigWig file without zoom levels, from rows in the order of ``sizes`` and start."""
    number = {name: i for i, (name, _) in enumerate(sizes)}
    key = max(len(n) for n, _ in sizes)
    tree_at = 64
    tree = struct.pack("<4I2Q", 0x78CA8C91, max(len(sizes), 1), key, 8, len(sizes), 0) + struct.pack("<BBH", 1, 0, len(sizes))
    for name, size in sorted(sizes):
        tree += name.encode().ljust(key, b"\0") + struct.pack("<2I", number[name], size)
    data_at = tree_at + len(tree)
    sections, found, part = [], [], []

    def flush() -> None:
        if part:
            chrom = number[part[0][0]]
            body = struct.pack("<5IBBH", chrom, part[0][1], part[-1][2], 0, 0, 1, 0, len(part)) + b"".join(struct.pack("<IIf", a, b, v) for _, a, b, v in part)
            z = zlib.compress(body)
            found.append((chrom, part[0][1], part[-1][2], data_at + 8 + sum(map(len, sections)), len(z)))
            sections.append(z)
            part.clear()

    last = (-1, -1)
    count = 0
    for row in rows:
        here = (number[row[0]], row[1])
        if here < last:
            raise InvalidInputError("rows of a bigWig file are sorted by contig and start")
        if part and (part[0][0] != row[0] or len(part) == per_section):
            flush()
        part.append(row)
        last, count = here, count + 1
    flush()
    index_at = data_at + 8 + sum(map(len, sections))
    # sections in runs of 256 below one root
    leaves = [found[i : i + 256] for i in range(0, len(found), 256)] or [[]]
    first, end = (found[0], found[-1]) if found else ((0, 0, 0, 0, 0),) * 2
    index = struct.pack("<2IQ4IQ2I", 0x2468ACE0, 256, len(found), first[0], first[1], end[0], end[2], index_at, 1, 0)
    if len(leaves) == 1:
        at = []
    else:
        at = [index_at + 48 + 4 + 24 * len(leaves)]
        for leaf in leaves[:-1]:
            at.append(at[-1] + 4 + 32 * len(leaf))
        index += struct.pack("<BBH", 0, 0, len(leaves)) + b"".join(struct.pack("<4IQ", leaf[0][0], leaf[0][1], leaf[-1][0], leaf[-1][2], p) for leaf, p in zip(leaves, at))
    for leaf in leaves:
        index += struct.pack("<BBH", 1, 0, len(leaf)) + b"".join(struct.pack("<4I2Q", c, a, c, b, o, n) for c, a, b, o, n in leaf)
    head = struct.pack("<IHHQQQHHQQIQ", BIGWIG_SIGNATURE, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, 1 << 16, 0)
    with open(path, "wb") as f:
        f.write(head + tree + struct.pack("<Q", count) + b"".join(sections) + index)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a reference: ``.2bit`` or ``.tb2``, and FASTA under any other name."""
    return _files(spark, path, twobit_tiles if path.endswith((".2bit", ".tb2")) else fasta_tiles, TILE_SQL)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".cram"):
        raise UnsupportedFormatError("CRAM needs an external codec; convert it to BAM first")
    return _files(spark, path, bam_reads, READ_SQL)


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, bigwig_signal, SIGNAL_SQL)
