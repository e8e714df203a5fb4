import struct

import pytest

from fragspark.errors import ContigNotFoundError, InvalidInputError, OutOfBoundsError, UnsupportedFormatError
from fragspark.operators import motifs, reference
from fragspark.operators.containers import MotifFrequencies, MotifIntervals, resolve_length_aliases
from fragspark.sources import binary, headers, writers


def bam(contigs, reads=()):
    body = b"BAM\x01" + struct.pack("<i", 5) + b"@HD\tx" + struct.pack("<i", len(contigs))
    for name, size in contigs:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for ref, pos, flag, tlen, length in reads:
        core = struct.pack("<iiBBHHHiiii", ref, pos, 2, 60, 0, 1, flag, 0, ref, pos + tlen - length, tlen) + b"r\0" + struct.pack("<I", length << 4)
        body += struct.pack("<i", len(core)) + core
    return binary.bgzf(body)


def test_headers_of_many_blocks(spark, tmp_path):
    contigs = [(f"contig{i:05d}" * 3, 1000 + i) for i in range(9000)]
    (tmp_path / "a.bam").write_bytes(bam(contigs))
    path = str(tmp_path / "a.bam")
    assert headers.is_sam(path) and not headers.is_sam("a.frag.gz")
    assert list(headers.chroms(spark, path).items()) == contigs
    assert [(r.contig, r["size"]) for r in headers.contigs(spark, path).orderBy("ord").collect()] == contigs
    (tmp_path / "a.tsv").write_text("chr2\t1\t5\t60\t+\nchr1\t1\t5\t60\t+\n")
    assert headers.chroms(spark, str(tmp_path / "a.tsv")) == {"chr1": None, "chr2": None}
    with pytest.raises(InvalidInputError):
        headers.contigs(spark, str(tmp_path / "a.tsv"))


def test_bam_to_bed_and_lengths(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam([("chr1", 5000)], [(0, 100, 99, 167, 50), (0, 217, 147, -167, 50)]))
    writers.bam_to_bed(spark, str(tmp_path / "a.bam"), str(tmp_path / "a.bed"))
    assert (tmp_path / "a.bed").read_text() == "chr1\t100\t267\n"
    writers.write_lengths(spark.createDataFrame([(167,), (5,)], "length bigint").coalesce(1), str(tmp_path / "a.bin"))
    assert struct.unpack("<2i", (tmp_path / "a.bin").read_bytes()) == (167, 5)
    with pytest.raises(UnsupportedFormatError):
        writers.write_lengths(spark.range(1).toDF("length"), "a.wig")


def test_slices_of_a_reference(spark):
    seq = "ACGTTGCAN" * 40
    tiles = motifs.tiles(spark.createDataFrame([("x", seq)], "contig string, seq string"), 1000).cache()
    assert reference.sequence(tiles, "x") == seq and reference.sequence(tiles, "x", 5, 300) == seq[5:300]
    assert reference.Reference(tiles)["x"][350:900] == seq[350:] and reference.Reference(tiles)["x"][3] == "T"
    with pytest.raises(OutOfBoundsError):
        reference.sequence(tiles, "x", 5, 361)
    with pytest.raises(ContigNotFoundError):
        reference.sequence(tiles, "y")
    small = motifs.tiles(spark.createDataFrame([("x", seq)], "contig string, seq string"), 50)
    regions = spark.createDataFrame([("x", 10, 260, 0), ("x", 340, 999, 1), ("y", 0, 9, 2), ("x", 50, 100, 3)], "contig string, start bigint, stop bigint, idx bigint")
    assert {r.idx: r.seq for r in reference.sequences(regions, small, 50).collect()} == {0: seq[10:260], 1: seq[340:], 2: "", 3: seq[50:100]}


def test_motif_containers(spark, tmp_path):
    kmers = [a + b for a in "ACGT" for b in "ACGT"]
    (tmp_path / "f.tsv").write_text("".join(f"{k}\t{1 / 16}\n" for k in kmers))
    f = MotifFrequencies.from_file(spark, str(tmp_path / "f.tsv"))
    assert len(f) == 16 and f.kmers() == kmers and f.freq("CA") == 1 / 16 and sum(f.frequencies()) == 1 and str(f).startswith("AA: 0.0625\n") and f.mds() == pytest.approx(1)
    with pytest.raises(InvalidInputError):
        f.freq("CAT")
    (tmp_path / "i.csv").write_text("contig,start,stop,name,count," + ",".join(kmers) + "\nx,0,9,n,3," + ",".join(["3"] + ["0"] * 15) + "\n")
    m = MotifIntervals.from_file(spark, str(tmp_path / "i.csv"))
    assert [r.n for r in m.freq("AA").collect()] == [3] and [r.n for r in m.freq("AC").collect()] == [0]
    m.to_bed("AA", str(tmp_path / "o.bed"))
    m.to_bedgraph("AA", str(tmp_path / "o.bedgraph"))
    assert (tmp_path / "o.bed").read_text() == "x\t0\t9\tn\t3.0\n" and (tmp_path / "o.bedgraph").read_text() == "x\t0\t9\t3.0\n"


def test_length_aliases():
    assert resolve_length_aliases(fraction_low=3, max_length=9) == (3, 9) and resolve_length_aliases() == (None, None)
    with pytest.raises(ValueError):
        resolve_length_aliases(min_length=1, fraction_low=2)
