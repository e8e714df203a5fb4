"""Operators against brute force, and the figures that the features are known to give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragspark.errors import InvalidInputError, OutOfBoundsError
from fragspark.functions import kernels, sequence
from fragspark.operators import coverage, delfi, filtering, genome, intervals, motifs, profiles
from fragspark.operators import fragments as fr

FRAGMENT = "contig string, start bigint, stop bigint, mapq int, is_forward boolean"
REGION = "contig string, start bigint, stop bigint, name string, idx bigint"
#: Fragments of contig 12 with their known results.
KNOWN = [
    (34443118, 34443284, True), (34443139, 34443300, True), (34443294, 34443491, True), (34443358, 34443538, False), (34443483, 34443660, True),
    (34444089, 34444252, True), (34444696, 34444863, True), (34444954, 34445075, True), (34444968, 34445105, True), (34445136, 34445288, True),
    (34445511, 34445672, False), (34445705, 34445852, True), (34445723, 34445893, True), (34446126, 34446261, True), (34446486, 34446653, True),
]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("12", a, b, 60, s) for a, b, s in KNOWN], FRAGMENT)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randint(1, 2)}", s := rng.randint(0, 20_000), s + rng.randint(20, 400), rng.randint(0, 60), rng.random() < 0.5) for _ in range(800)]
    regions = [(f"c{rng.randint(1, 2)}", s := rng.randint(0, 20_000), s + rng.randint(1, 3000), f"r{i}", i) for i in range(40)]
    return rows, regions, spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame(regions, REGION)


def regions_of(spark, *rows):
    return spark.createDataFrame([(c, a, b, ".", i) for i, (c, a, b) in enumerate(rows)], REGION)


def test_known_coverage(spark, known):
    assert coverage.single_coverage(known, "12", 34443400, 34443600).first()["coverage"] == 2
    out = coverage.coverage(known, regions_of(spark, ("12", 34443118, 34443538), ("12", 34444968, 34446115))).orderBy("idx").collect()
    assert [r["coverage"] for r in out] == [4.0, 6.0]


def test_known_protection_score(spark, known):
    out = profiles.wps(known, regions_of(spark, ("12", 34444145, 34444155))).orderBy("start").collect()
    assert [r["wps"] for r in out] == [-1] * 5 + [1] * 5


def test_known_cleavage(spark, known):
    out = profiles.cleavage_profile(known, regions_of(spark, ("12", 34443195, 34443206))).collect()
    assert [r["proportion"] for r in out] == [0.0] * 11


@pytest.mark.parametrize("policy", ["midpoint", "any"])
@pytest.mark.parametrize("size", [64, 4096])
def test_interval_join(some, policy, size):
    rows, regions, f, r = some
    inside = (lambda a, b, s, e: s <= (a + b) // 2 < e) if policy == "midpoint" else (lambda a, b, s, e: b > s and a < e)
    expected = sorted((fr_[0], fr_[1], fr_[2], rg[4]) for fr_ in rows for rg in regions if fr_[0] == rg[0] and inside(fr_[1], fr_[2], rg[1], rg[2]))
    got = sorted(tuple(x) for x in intervals.interval_join(f, r, policy, bin_size=size).select("contig", "start", "stop", "r_idx").collect())
    assert got == expected
    semi = intervals.interval_join(f.withColumn("fid", F.monotonically_increasing_id()), r, policy, "semi", size).count()
    anti = intervals.interval_join(f.withColumn("fid", F.monotonically_increasing_id()), r, policy, "anti", size).count()
    hit = sum(any(a[0] == b[0] and inside(a[1], a[2], b[1], b[2]) for b in regions) for a in rows)
    assert (semi, anti) == (hit, len(rows) - hit)
    with pytest.raises(InvalidInputError):
        intervals.interval_join(f, r, policy, "outer")


@pytest.mark.parametrize("window", [40, 41, 120])
def test_protection_scores(some, window):
    rows, _, f, _ = some
    spark = f.sparkSession
    got = {r["start"]: r["wps"] for r in profiles.wps(f, regions_of(spark, ("c1", 5000, 5600)), window, 50, 300, 10).collect()}
    near = [x for x in rows if x[0] == "c1" and x[3] >= 10 and 50 <= x[2] - x[1] <= 300 and 4700 <= (x[1] + x[2]) // 2 < 5900]
    for c in range(5000, 5600):
        low, high = np.rint(c - window / 2), np.rint(c + window / 2 - 1)
        assert got[c] == sum(x[1] < low and x[2] > high for x in near) - sum(low <= x[1] <= high or low <= x[2] <= high for x in near)


def test_cleavage(some):
    rows, _, f, _ = some
    got = {r["pos"]: r["proportion"] for r in profiles.cleavage_profile(f, regions_of(f.sparkSession, ("c2", 900, 1500))).collect()}
    near = [x for x in rows if x[0] == "c2" and x[3] >= 30]
    for p in range(900, 1500):
        depth = sum(x[1] <= p < x[2] for x in near)
        ends = sum((x[1] if x[4] else x[2]) == p and x[2] > 900 and x[1] < 1500 for x in near)
        assert got[p] == pytest.approx(100 * ends / depth if depth else 0)


@pytest.mark.parametrize("mode", ["reference", "exact"])
def test_length_statistics(some, mode):
    rows, regions, f, r = some
    for g in coverage.length_intervals(f, r, median_mode=mode).collect():
        own = sorted(x[2] - x[1] for x in rows if x[0] == g["contig"] and x[3] >= 30 and g["start"] <= (x[1] + x[2]) // 2 < g["stop"])
        if not own:
            assert (g["mean"], g["median"], g["count"], g["short_fraction"]) == (-1, -1, -1, -1)
            continue
        n = len(own)
        odd = own[max(n // 2, 1) - 1] if mode == "reference" else own[n // 2]
        assert g["median"] == (odd if n % 2 else (own[n // 2 - 1] + own[n // 2]) / 2)
        assert g["mean"] == pytest.approx(np.mean(own)) and g["stdev"] == pytest.approx(np.std(own), abs=1e-6)
        assert (g["min"], g["max"], g["count"]) == (own[0], own[-1], n) and g["short_fraction"] == pytest.approx(np.mean(np.array(own) <= 150))


def test_length_bins(some):
    rows, _, f, _ = some
    own = [x[2] - x[1] for x in rows if x[3] >= 30]
    got = {r["min"]: (r["max"], r["count"]) for r in coverage.length_bins(f, bin_size=10).collect()}
    assert sum(n for _, n in got.values()) == len(own) and min(got) == min(own)
    assert all(n == sum(a <= x <= b for x in own) and b == a + 9 for a, (b, n) in got.items())
    assert coverage.length_bins(f.limit(0)).collect() == []


def test_merging(spark):
    r = regions_of(spark, ("a", 10, 20), ("a", 15, 25), ("a", 30, 40), ("a", 100, 200), ("b", 1, 2), ("b", 2, 3))
    got = sorted(tuple(x) for x in intervals.merge(r).select("contig", "start", "stop").collect())
    assert got == [("a", 10, 25), ("a", 30, 40), ("a", 100, 200), ("b", 1, 3)]
    assert intervals.merge(r, strictly=True).count() == 5


def test_selection_needs_a_contig(some):
    f = some[2]
    with pytest.raises(InvalidInputError):
        fr.select_fragments(f, start=5)
    with pytest.raises(ValueError):
        fr.select_fragments(f, intersect_policy="most")
    assert fr.select_fragments(f, start=0).count() == sum(x[3] >= 30 for x in some[0])
    assert issubclass(OutOfBoundsError, IndexError)


def test_filters_keep_each_fragment_once(some):
    rows, regions, f, r = some
    half = lambda a, b: a[0] == b[0] and 2 * (min(a[2], b[2]) - max(a[1], b[1])) >= a[2] - a[1]
    good = [a for a in rows if a[3] >= 30]
    assert filtering.filter_fragments(f, whitelist=r).count() == sum(any(half(a, b) for b in regions) for a in good)
    assert filtering.filter_fragments(f, blacklist=r).count() == sum(not any(half(a, b) for b in regions) for a in good)


def test_gaps(spark):
    gaps = spark.createDataFrame([("chr1", 100, 200, "centromere"), ("chr1", 0, 10, "telomere"), ("chr1", 390, 400, "telomere"), ("chr2", 50, 60, "centromere"), ("chr2", 0, 50, "short_arm")], "contig string, start bigint, stop bigint, type string")
    r = regions_of(spark, ("chr1", 20, 30), ("chr1", 150, 160), ("chr1", 250, 260), ("chr2", 1, 9), ("chr3", 1, 2), ("chr1", 5, 395))
    assert [x["arm"] for x in genome.with_arms(r, gaps).orderBy("idx").collect()] == ["1p", "NOARM", "1q", "NOARM", None, "NOARM"]
    j = r.join(genome.contig_gaps(gaps), "contig", "left").orderBy("idx")
    assert [x[0] for x in j.select(genome.in_tcmere(F.col("start"), F.col("stop"))).collect()] == [False, True, False, False, None, True]
    assert [x["idx"] for x in genome.without_gaps(r, gaps).orderBy("idx").collect()] == [0, 2, 4]


def test_kmers_and_complement(spark):
    assert [r["kmer"] for r in sequence.gen_kmers(spark, 2).orderBy("kmer").collect()] == [a + b for a in "ACGT" for b in "ACGT"]
    assert [r["kmer"] for r in sequence.gen_kmers(spark, 0).collect()] == [""]
    with pytest.raises(ValueError):
        sequence.gen_kmers(spark, -1)
    sequence.register(spark)
    assert spark.sql("SELECT reverse_complement('AACGTN') AS a, frag_midpoint(3, 8) AS b").first() == ("NACGTT", 5)


@pytest.mark.parametrize("strands", [{}, {"both_strands": False}, {"both_strands": False, "negative_strand": True}])
def test_motifs(spark, strands):
    rng = random.Random(2)
    seq = {c: "".join(rng.choice("ACGTACGTN") for _ in range(n)) for c, n in (("a", 2500), ("b", 1000))}
    ref = motifs.tiles(spark.createDataFrame(list(seq.items()), "contig string, seq string"))
    rows = [(c := rng.choice("ab"), s := rng.randint(0, len(seq[c]) - 5), s + rng.randint(10, 200), 60, rng.random() < 0.5) for _ in range(500)]
    f = spark.createDataFrame(rows, FRAGMENT)
    complement = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))

    def brute(k, shift, guard):
        out = {}
        for c, a, b, _, forward in rows:
            if guard and (a - shift < 0 or a + shift >= len(seq[c])):
                continue
            ends = []
            if strands.get("both_strands", True) or (forward and not strands.get("negative_strand")):
                ends.append((a - shift, False))
            if strands.get("both_strands", True) or strands.get("negative_strand"):
                ends.append((b - k + shift, True))
            for at, back in ends:
                x = seq[c][at : at + k] if at >= 0 else ""
                if len(x) == k and "N" not in x:
                    x = complement(x) if back else x
                    out[x] = out.get(x, 0) + 1
        return out

    got = {r["kmer"]: r["n"] for r in motifs.motif_counts(motifs.end_kmers(f, ref, 4, **strands), 4).collect()}
    assert len(got) == 256 and {k: n for k, n in got.items() if n} == brute(4, 0, False)
    got = {r["kmer"]: r["n"] for r in motifs.breakpoint_kmers(f, ref, 6, **strands).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == brute(6, 3, True)
    with pytest.raises(InvalidInputError):
        motifs.breakpoint_kmers(f, ref, 5)


def test_diversity(spark):
    counts = spark.createDataFrame([("AAAA", 3), ("CCCC", 1), ("GGGG", 0)], "kmer string, n bigint")
    entropy = -(0.75 * np.log(0.75) + 0.25 * np.log(0.25))
    assert motifs.diversity(counts, 4).first()["mds"] == pytest.approx(entropy / np.log(256))
    assert motifs.diversity(counts, 4, True).first()["mds"] == pytest.approx((entropy + 1 / 8) / np.log(256))
    assert motifs.diversity(counts.where("n = 0"), 4).first()["mds"] is None


def test_kernels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    assert np.allclose(kernels.running(x, 30, False), [np.median(x[i : i + 30]) for i in range(170)])
    assert np.allclose(kernels.running(x, 30, True), [np.mean(x[i : i + 30]) for i in range(170)])
    t = np.arange(50.0)
    assert np.allclose(kernels.savgol(3 * t**2 - t + 1, 21, 2), 3 * t**2 - t + 1)
    assert np.allclose(kernels.loess(t, 2 * t**2 + 1, t[::7]), 2 * t[::7] ** 2 + 1)
    with pytest.raises(InvalidInputError):
        kernels.savgol(x[:5], 21, 2)
    with pytest.raises(InvalidInputError):
        kernels.adjust(np.array([1, 3, 4]), np.zeros(3), 2, False, None, None)


def test_adjustment_names_what_fails(spark):
    rows = [(1, "a", p, float(p % 7)) for p in range(100)] + [(2, "a", p, 1.0) for p in (1, 2, 4, 5, 6, 7)] + [(3, "a", 1, 1.0)]
    out = profiles.adjust(spark.createDataFrame(rows, "idx bigint, contig string, pos bigint, value double"), 4, smooth=None).collect()
    assert sum(r["status"] == "ok" for r in out) == 96 and {r["idx"] for r in out if r["status"] != "ok"} == {2, 3}


@pytest.mark.parametrize("m,expected", [(0, [0.0] * 5), (2, [1.0, 2.0, 3.0])])
def test_aggregated_signal(spark, m, expected):
    s = spark.createDataFrame([("chr1", 1000 + i, float(i)) for i in range(5)], "contig string, pos bigint, value double")
    r = spark.createDataFrame([("chr1", 1000, 1005, "+", 0)], "contig string, start bigint, stop bigint, strand string, idx bigint")
    assert [x["value"] for x in profiles.aggregate_signal(s, r, 5, m).orderBy("rel").collect()] == expected


def test_merged_windows(spark):
    rows = [(i, "chr1", 100 * i, 100 * i + 100, "1p" if i < 7 else "1q", 1, 2, 0.4, 3, 0.5) for i in range(12)]
    b = spark.createDataFrame(rows, "idx bigint, contig string, start bigint, stop bigint, arm string, short bigint, long bigint, gc double, num_frags bigint, ratio double")
    got = [(r["contig"], r["arm"], r["start"], r["stop"], r["num_frags"]) for r in delfi.merged(b, 3).orderBy("idx").collect()]
    assert got == [("1", "1p", 0, 300, 9), ("1", "1p", 300, 600, 9), ("1", "1q", 900, 1200, 9)]
    assert [r["idx"] for r in delfi.without_no_coverage(b, (0, 11)).orderBy("idx").collect()] == list(range(1, 11))


def test_reads(spark):
    reads = spark.createDataFrame([(99, "a", 100, 175, 60, 160, 50), (147, "a", 185, 260, 60, -160, 60), (83, "a", 185, 260, 60, -160, 60), (99, "a", 1, 5, 10, 9, 60), (99 + 1024, "a", 1, 5, 60, 9, 60), (99, "a", 1, 5, 60, 0, 60)], "flag int, contig string, start bigint, stop bigint, mapq int, tlen bigint, mate_mapq int")
    got = sorted((r["start"], r["stop"], r["is_forward"]) for r in fr.from_reads(reads).collect())
    assert got == [(100, 260, True), (100, 260, False)] or got == [(100, 260, False), (100, 260, True)]


def test_delfi_query_covers_whole_documents(spark, tmp_path):
    from fragspark.plans import catalog

    rng = random.Random(6)
    texts = {i: "".join(rng.choice(catalog.LETTERS + "\n") for _ in range(n)) for i, n in enumerate((0, 1, 999, 1000, 1001, 2500, 4100, 5000))}
    lines = [(rng.randrange(4000), rng.randrange(400), rng.randint(1, 7), rng.randrange(100), float(rng.randint(1, 50)), "O") for _ in range(6000)]
    spark.createDataFrame([*texts.items(), (8, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber bigint, l_suppkey bigint, l_quantity double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    frags = [(str((o * 7 + n) % 9), s := (p * 17 + n * 101) % 4000, s + 100 + (p * 7 + n * 13 + k) % 121, int(q) + 10) for o, p, n, k, q, _ in lines]
    frags = [(c, (a + b) // 2, b - a) for c, a, b, m in frags if m >= 30 and 100 <= b - a <= 220]
    bases, expected = str.maketrans(catalog.LETTERS, catalog.BASES), {}
    for i, t in texts.items():
        for at in range(0, len(t), 1000):
            lengths = [n for c, mid, n in frags if c == str(i) and at <= mid < min(at + 1000, len(t))]
            gc = sum(x in "GC" for x in t[at : at + 1000].translate(bases)) / min(1000, len(t) - at)
            expected[str(i), at, min(at + 1000, len(t))] = (sum(n <= 150 for n in lengths), sum(n >= 151 for n in lengths), len(lengths), gc if lengths else None)
    out = catalog.QUERIES["delfi"](spark, str(tmp_path)).collect()
    assert len({r["idx"] for r in out}) == len(out) == len(expected)
    for r in out:
        short, long, n, gc = expected[r["contig"], r["start"], r["stop"]]
        assert (r["short"], r["long"], r["num_frags"]) == (short, long, n) and r["gc"] == (None if gc is None else pytest.approx(gc))
    whole = [r for r in out if r["num_frags"] and r["long"]]
    for c in delfi.CORRECTED:
        x, y = np.array([r["gc"] for r in whole]), np.array([float(r[c]) for r in whole])
        grid = np.arange(x.min(), x.max() + 0.01, 0.01)
        fixed = y - np.interp(x, grid, kernels.loess(x, y, grid, 0.75)) + np.median(y)
        assert np.allclose([r[f"{c}_corrected"] for r in whole], fixed)


def test_merge_carries_islands_over_chunks(spark):
    import random

    rng = random.Random(11)
    rows = [(rng.choice("ab"), s, s + rng.randint(1, 90)) for s in (rng.randint(0, 900) for _ in range(60))] + [("c", 0, 500), ("c", 10, 20), ("c", 499, 600), ("c", 600, 610)]
    frame = spark.createDataFrame(rows, "contig string, start bigint, stop bigint")
    for strictly in (False, True):
        expected = []
        for c in "abc":
            now = None
            for _, s, e in sorted(r for r in rows if r[0] == c):
                if now and (s < now[1] if strictly else s <= now[1]):
                    now[1] = max(now[1], e)
                else:
                    now = [s, e]
                    expected.append((c, now))
        got = sorted((r.contig, [r.start, r.stop]) for r in intervals.merge(frame, strictly, chunk=16).collect())
        assert got == sorted(expected)


def test_tiles_cut_once_and_lap(spark):
    seq = "acgtnACGTRYé" * 30
    ref = {(r.contig, r.tile): r.seq for r in motifs.tiles(spark.createDataFrame([("x", seq), ("y", "a"), ("z", "")], "contig string, seq string"), 50, 7).collect()}
    assert ref == {("x", i): seq.upper()[50 * i : 50 * i + 57] for i in range(-(-len(seq) // 50))} | {("y", 0): "A"}


def test_semi_and_anti_count_each_fragment_once(spark):
    frags = [("a", s, s + n, 60, True) for s, n in ((0, 100), (4090, 20), (4096, 5), (9000, 9000), (9000, 9000), (30_000, 1))]
    regions = [("a", 4000, 4100), ("a", 4095, 12_000), ("a", 17_999, 18_001), ("b", 0, 40_000)]
    f = spark.createDataFrame(frags, "contig string, start bigint, stop bigint, mapq int, is_forward boolean")
    r = spark.createDataFrame(regions, "contig string, start bigint, stop bigint")
    meets = lambda x: any(x[0] == c and x[2] > s and x[1] < e for c, s, e in regions)
    for how in ("semi", "anti"):
        got = sorted(tuple(x) for x in intervals.interval_join(f, r, "any", how).collect())
        assert got == sorted(x for x in frags if meets(x) == (how == "semi"))
