"""Formats: what writers write, readers read."""

import gzip
import struct

import pytest

from fragspark import cli
from fragspark.errors import ContigMismatchError, UnsupportedFormatError
from fragspark.operators import motifs
from fragspark.sources import binary, text, writers


def test_fragment_files(spark, tmp_path):
    five = "#head\n12\t10\t20\t60\t+\n12\tx\t20\t60\t+\n12\t30\t45\t7\t-\n\n"
    for name, data in (("a.frag.gz", gzip.compress(five.encode())), ("a.bgz", binary.bgzf(five.encode())), ("a.tsv", five.encode())):
        (tmp_path / name).write_bytes(data)
        assert sorted(tuple(r) for r in text.read_fragments(spark, str(tmp_path / name)).collect()) == [("12", 10, 20, 60, True), ("12", 30, 45, 7, False)]
    (tmp_path / "b.bed.gz").write_bytes(gzip.compress(b"12\t10\t20\tname\t60\t-\n"))
    assert text.read_fragments(spark, str(tmp_path / "b.bed.gz")).first() == ("12", 10, 20, 60, False)
    with pytest.raises(UnsupportedFormatError):
        text.read_fragments(spark, "x.cram")


def test_interval_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\n#c\nchr1 5 9\nchr2\t1\t2\tname\t.\t-\nbad\n")
    assert [tuple(r)[:5] for r in text.read_intervals(spark, str(tmp_path / "a.bed")).orderBy("idx").collect()] == [("chr1", 5, 9, ".", None), ("chr2", 1, 2, "name", "-")]
    (tmp_path / "s").write_text("chr1 100\n\nchr2\t50\n")
    sizes = text.read_sizes(spark, str(tmp_path / "s"))
    assert [(r["contig"], r["size"]) for r in sizes.orderBy("ord").collect()] == [("chr1", 100), ("chr2", 50)]
    (tmp_path / "gap.txt").write_text("585\tchr1\t0\t10\t1\tN\t10\ttelomere\tno\n")
    assert tuple(text.read_ucsc_gaps(spark, str(tmp_path / "gap.txt"), True).first()) == ("1", 0, 10, "telomere")
    text.validate_contigs(sizes.limit(1), sizes)
    with pytest.raises(ContigMismatchError):
        text.validate_contigs(sizes, sizes.where("contig = 'chr1'"))
    assert text.intervals_of(spark, [("a", 1, 2), ("b", 3, 4, "n")]).count() == 2
    with pytest.raises(TypeError):
        text.intervals_of(spark, 5)


def test_references(spark, tmp_path):
    seq = {"chrA": "ACGTNNNNACGTTGCA" * 150, "b": "NNACG"}
    binary.write_twobit(str(tmp_path / "r.2bit"), seq)
    (tmp_path / "r.fa").write_text("".join(f">{n} more\n{s[:50].lower()}\n{s[50:]}\n" for n, s in seq.items()))
    (tmp_path / "r.fa.gz").write_bytes(gzip.compress((tmp_path / "r.fa").read_bytes()))
    expected = sorted(tuple(r) for r in motifs.tiles(spark.createDataFrame(list(seq.items()), "contig string, seq string")).collect())
    for name in ("r.2bit", "r.fa", "r.fa.gz"):
        assert sorted(tuple(r) for r in binary.read_reference(spark, str(tmp_path / name)).collect()) == expected


def test_alignments(spark, tmp_path):
    def read(flag, pos, ops, tlen, tag=b"MQC\x2d"):
        body = struct.pack("<iiBBHHHiiii", 0, pos, 2, 60, 0, len(ops), flag, 4, 0, pos + 50, tlen) + b"r\0" + struct.pack(f"<{len(ops)}I", *(n << 4 | op for n, op in ops)) + b"\x11\x11" + b"\xff" * 4 + b"XZZabc\0" + tag
        return struct.pack("<i", len(body)) + body

    header = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"12\0" + struct.pack("<i", 1000)
    data = header + read(99, 100, [(70, 0), (5, 1), (5, 2)], 160) + read(147, 185, [(75, 0)], -160)
    (tmp_path / "a.bam").write_bytes(binary.bgzf(data))
    got = [tuple(r) for r in binary.read_bam(spark, str(tmp_path / "a.bam")).collect()]
    assert got == [(99, "12", 100, 175, 60, 160, "12", 150, 45), (147, "12", 185, 260, 60, -160, "12", 235, 45)]
    with pytest.raises(UnsupportedFormatError):
        binary.read_bam(spark, "a.cram")


@pytest.mark.parametrize("n,per", [(10, 1024), (900, 2)])
def test_signals(spark, tmp_path, n, per):
    rows = [("b", i, i + 1, float(i)) for i in range(n)] + [("a", i * 3, i * 3 + 2, 0.5) for i in range(n)]
    path = str(tmp_path / "x.bw")
    binary.write_bigwig(path, [("b", 5000), ("a", 9000)], iter(rows), per)
    assert sorted(tuple(r) for r in binary.read_bigwig(spark, path).collect()) == sorted(rows)


def test_motif_tables(spark, tmp_path):
    f = spark.createDataFrame([(a + b, 1 / 16) for a in "ACGT" for b in "ACGT"], "kmer string, freq double")
    path = str(tmp_path / "m.tsv")
    writers.write_motif_frequencies(f, path)
    assert text.read_motif_frequencies(spark, path).count() == 16
    (tmp_path / "bad.tsv").write_text("AA\t0.1\n")
    with pytest.raises(RuntimeError):
        text.read_motif_frequencies(spark, str(tmp_path / "bad.tsv"))


def test_commands(spark, tmp_path, capsys):
    frags = "".join(f"chr1\t{i * 10}\t{i * 10 + 150}\t60\t{'+-'[i % 2]}\n" for i in range(300))
    (tmp_path / "f.frag.gz").write_bytes(gzip.compress(frags.encode()))
    (tmp_path / "i.bed").write_text("chr1\t500\t900\ta\t.\t+\nchr1\t1500\t1900\tb\t.\t-\n")
    (tmp_path / "s.sizes").write_text("chr1\t5000\n")
    binary.write_twobit(str(tmp_path / "r.2bit"), {"chr1": "ACGGTTACCA" * 500})
    p = {n: str(tmp_path / n) for n in ("f.frag.gz", "i.bed", "s.sizes", "r.2bit", "o.bed", "w.bw", "a.bw", "c.bed.gz", "m.tsv", "im.tsv", "d.csv", "l.bed", "b.tsv", "k.tsv", "agg.wig", "ff.frag.gz", "rm.bed")}

    def run(*args):
        cli.main([str(a) for a in args], spark)

    run("coverage", p["f.frag.gz"], p["i.bed"], "-o", p["o.bed"])
    assert open(p["o.bed"]).read() == "chr1\t500\t900\ta\t40.0\nchr1\t1500\t1900\tb\t40.0\n"
    run("frag-length-bins", p["f.frag.gz"], "-o", p["b.tsv"], "--summary-stats")
    assert "150\t150\t300" in open(p["b.tsv"]).read() and "#mean: 150.0" in open(p["b.tsv"]).read()
    run("frag-length-intervals", p["f.frag.gz"], p["i.bed"], "-o", p["l.bed"])
    assert open(p["l.bed"]).readline().split()[-1] == "s150"
    run("wps", p["f.frag.gz"], p["i.bed"], "-c", p["s.sizes"], "-i", 200, "-o", p["w.bw"])
    assert binary.read_bigwig(spark, p["w.bw"]).count() == 400
    run("adjust-wps", p["w.bw"], p["i.bed"], p["s.sizes"], "-i", 100, "-m", 40, "-o", p["a.bw"])
    assert binary.read_bigwig(spark, p["a.bw"]).count() > 0
    run("agg-bw", p["w.bw"], p["i.bed"], "-o", p["agg.wig"])
    assert open(p["agg.wig"]).readline().startswith("fixedStep\tchrom=.")
    run("cleavage-profile", p["f.frag.gz"], p["i.bed"], p["s.sizes"], "-o", p["c.bed.gz"])
    assert len(gzip.open(p["c.bed.gz"]).readlines()) == 800
    run("end-motifs", p["f.frag.gz"], p["r.2bit"], "-k", 2, "-o", p["m.tsv"])
    run("mds", p["m.tsv"])
    assert 0 < float(capsys.readouterr().out) < 1
    run("interval-end-motifs", p["f.frag.gz"], p["r.2bit"], p["i.bed"], "-k", 2, "--counts", "-o", p["im.tsv"])
    run("regional-mds", p["im.tsv"], "-o", p["rm.bed"])
    assert len(open(p["rm.bed"]).readlines()) == 2
    run("breakpoint-motifs", p["f.frag.gz"], p["r.2bit"], "-k", 2, "-o", p["k.tsv"])
    assert len(open(p["k.tsv"]).readlines()) == 16
    run("delfi", p["f.frag.gz"], p["r.2bit"], p["s.sizes"], p["i.bed"], "--no-merge-bins", "--no-gc-correct", "-o", p["d.csv"])
    assert open(p["d.csv"]).readline().startswith("contig,start,stop,arm,short")
    run("filter-file", p["f.frag.gz"], "-w", p["i.bed"], "-o", p["ff.frag.gz"])
    assert 70 < text.read_fragments(spark, p["ff.frag.gz"]).count() < 110
    with pytest.raises(SystemExit):
        cli.main(["unknown"], spark)
    assert len(cli.COMMANDS) == 16


def test_streaming_counts(spark, tmp_path):
    from fragspark.schema import FRAGMENT
    from fragspark.streaming import increments

    rows = [("a", i, i + 100, 60, True) for i in range(200)]
    for i in range(2):
        spark.createDataFrame(rows[100 * i : 100 * i + 100], FRAGMENT).write.mode("append").parquet(str(tmp_path / "in"))
    regions = spark.createDataFrame([("a", 0, 120, ".", 0)], "contig string, start bigint, stop bigint, name string, idx bigint")
    q = increments.running_coverage(increments.arriving(spark, str(tmp_path / "in")), regions).writeStream.outputMode("complete").format("memory").queryName("cov").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT coverage FROM cov").first()[0] == 70
