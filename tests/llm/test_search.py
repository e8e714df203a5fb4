import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from fragspark.llm import exchange, graph, op6_jaccard_join, op7_lm_scoring
from fragspark.llm.elias_fano import DECODED, Sequence, Trie, quantise
from fragspark.llm.op7_lm_scoring import score
from fragspark.llm.op8_ann import nearest
from llm_helpers import words


def jaccard_brute(rows, width, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words(text, lower=True)
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width,percent,leaf", [(3, 90, 16 << 20), (5, 80, 100_000)])
def test_jaccard_components(docs, rows, width, percent, leaf, monkeypatch):
    monkeypatch.setattr(op6_jaccard_join, "LEAF_BYTES", leaf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard_join.jaccard_components(docs, width, percent, block_bytes=1 << 14).collect()}
    assert got == jaccard_brute(rows, width, percent)


TABLE = Path("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.skipif(not TABLE.exists(), reason="needs the test tables")
def test_jaccard_components_of_the_test_table(spark):
    table = spark.read.parquet(str(TABLE))
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    sets = {}
    for i, text in rows:
        w = words(text, lower=True)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, own in sets.items():
        for j, both in Counter(j for x in own for j in holders[x] if j < i).items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard_join.jaccard_components(table, 5, 80).collect()}
    assert got == {i: (len(own), root(i)) for i, own in sets.items()}


def test_signatures_lose_no_link():
    rng = np.random.default_rng(4)
    for size, lopsided in [(n, False) for n in (1, 2, 3, 4, 5, 6, 9, 10, 11, 19, 20, 40, 100, 333)] + [(n, True) for n in (4, 8, 20, 60, 200)]:
        for percent in (80, 90):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            if lopsided:  # all elements in few groups: signatures of empty groups must count
                a = np.unique(a >> np.uint64(6))
            for _ in range(15):
                keep = a[rng.random(len(a)) < rng.uniform(0.8, 1)]
                more = rng.integers(0, 2**64, rng.integers(0, 1 + size // 10), dtype=np.uint64)
                b = np.unique(np.concatenate([keep, more >> np.uint64(6) if lopsided and rng.random() < 0.7 else more]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and (len(a) != len(b) or (a != b).any()):
                    sig, row = op6_jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                    assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_sets_do_not_meet_for_their_empty_groups():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(20, 400, 500)]
    sig, row = op6_jaccard_join.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80)
    held = np.array([len(np.unique(row[sig == s])) for s in np.unique(sig)])
    assert (held > 1).sum() < len(held) / 200


def test_packed_points_bound_the_counts():
    rng = np.random.default_rng(15)
    point = rng.integers(0, 40, (50, op6_jaccard_join.DIMENSIONS)) * rng.integers(0, 60, (50, 1))
    again = op6_jaccard_join.unpacked_points(op6_jaccard_join.packed_points(point))
    assert (again >= point).all() and (again - point <= -(-point.max(axis=1) // 15)[:, None]).all()


def test_bitmaps_exclude_no_link_and_most_others():
    rng = np.random.default_rng(17)
    for size in (1, 3, 60, 64, 65, 127, 300, 2000, 9000):
        sets = [np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))]
        for share in (1, 0.99, 0.95, 0.9, 0.85, 0.3, 0):
            kept = sets[0][rng.random(len(sets[0])) < share]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, max(1, size) - int(len(kept) * rng.uniform(0.9, 1)), dtype=np.uint64)])))
        n = np.array([len(s) for s in sets])
        fine = op6_jaccard_join.Bitmaps(op6_jaccard_join.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])))
        a, b = np.triu_indices(len(sets), 1)
        both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
        link = 180 * both >= 80 * (n[a] + n[b])
        may = fine.may_link(n, a, b, 80)
        assert may[link].all()
        if 300 <= size <= 2000:
            assert not may[b == len(sets) - 1].any()


@pytest.mark.parametrize("hot,wide,leaf", [(1, 4096, 40_000), (64, 3, 200_000), (64, 4096, 1 << 20)])
def test_large_groups_of_near_copies_and_hot_passages(spark, hot, wide, leaf, monkeypatch):
    monkeypatch.setattr(op6_jaccard_join, "LEAF_BYTES", leaf)
    monkeypatch.setattr(op6_jaccard_join, "HOT", hot)
    monkeypatch.setattr(op6_jaccard_join, "WIDE", wide)
    rng = random.Random(16)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, passage = prose(60), prose(30)
    rows = []
    for i in range(120):
        copy = list(base) if i % 3 else prose(rng.randint(10, 60)) + passage
        for _ in range(rng.randint(0, 3) if i % 3 else 0):
            copy[rng.randrange(len(copy))] = rng.choice(base)
        rows.append((i * 3, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard_join.jaccard_components(docs, 5, 80, block_bytes=1 << 14).collect()}
    assert got == jaccard_brute(rows, 5, 80)


def test_tree_join_finds_all_links():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(6)]
    sets, cluster = [], []
    for _ in range(300):
        c = int(rng.integers(0, 6))
        keep = base[c][rng.random(len(base[c])) > 0.04]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**64, rng.integers(0, 3), dtype=np.uint64)])))
        cluster.append(c)
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = op6_jaccard_join.links(np.concatenate(sets), offs, np.array(cluster), np.zeros(300, int), 90)
    a, b = op6_jaccard_join.Forest(300), op6_jaccard_join.Forest(300)
    for x, y in found:
        a.join(x, y)
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if cluster[i] == cluster[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                b.join(i, j)
    assert [a.root(i) for i in range(300)] == [b.root(i) for i in range(300)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(500, 600), (600, 500), (7, 7)]
    up = {x: x for e in edges for x in e}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: root(n) for n in up if any(n in e for e in edges if e[0] != e[1])}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_jaccard_edges(empty, odd):
    assert op6_jaccard_join.jaccard_components(empty).collect() == []
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == [(5, 0, 5), (5, 0, 5), (6, 4, 6), (6, 4, 6), (None, 4, None)]


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(7)
    for n, universe in ((0, 10), (1, 1), (5, 5), (300, 400), (1000, 2**40)):
        values = np.sort(rng.integers(0, universe, n))
        s = Sequence.of(values, universe)
        assert (s.get(np.arange(n)).astype(np.int64) == values).all()
        probe = np.concatenate([values, rng.integers(0, universe + 5, 200)])
        at = s.find(probe.astype(np.uint64))
        assert ((at >= 0) == np.isin(probe, values)).all() and (values[at[at >= 0]] == probe[at >= 0]).all()
        few = rng.choice(probe, min(len(probe), max(1, n // 20)))  # too few to decode all
        at = s.find(few.astype(np.uint64))
        assert ((at >= 0) == np.isin(few, values)).all() and (values[at[at >= 0]] == few[at >= 0]).all()
        some = rng.integers(0, max(n, 1), n // 20)
        assert (s.get(some).astype(np.int64) == values[some]).all()
    grams = np.unique(np.column_stack([rng.integers(0, 50, 900), rng.integers(0, 500, 900), rng.integers(0, 9, 900)]), axis=0)
    pairs, third = np.unique(grams[:, :2], axis=0, return_inverse=True)
    tokens = np.unique(pairs[:, 0])
    codes = [rng.integers(1, 255, n).astype(np.uint8) for n in (len(pairs), len(grams))]
    levels = Trie.levels(tokens.astype(np.uint64), (np.searchsorted(tokens, pairs[:, 0]), pairs[:, 1], codes[0]), (third.ravel(), grams[:, 2], codes[1]))
    levels.tofile(tmp_path / "trie")
    known = [{tuple(g): c for g, c in zip(x.tolist(), own.tolist())} for x, own in zip((pairs, grams), codes)]
    for trie in (Trie.mapped(levels), Trie.open(tmp_path / "trie")):
        a, b, c = rng.integers(0, 60, 3000), rng.integers(0, 500, 3000), rng.integers(0, 9, 3000)
        a[:900], b[:900], c[:900] = (grams[rng.integers(0, len(grams), 900), i] for i in range(3))
        root = trie.tokens.find(a.astype(np.uint64))
        pair = trie.child(0, root, b)
        assert trie.code(0, pair).tolist() == [known[0].get(p, 0) for p in zip(a.tolist(), b.tolist())]
        assert trie.code(1, trie.child(1, pair, c)).tolist() == [known[1].get(p, 0) for p in zip(a.tolist(), b.tolist(), c.tolist())]
        assert trie.fan_out(0, trie.tokens.find(np.arange(60).astype(np.uint64))).tolist() == [int((pairs[:, 0] == x).sum()) for x in range(60)]
        assert trie.fan_out(1, np.arange(len(pairs))).tolist() == np.bincount(third.ravel()).tolist()
        assert [int(trie.child(1, pair[i : i + 1], c[i : i + 1])[0]) for i in range(0, 3000, 50)] == trie.child(1, pair, c)[::50].tolist()
    p = 10.0 ** -rng.uniform(0, 9, 100)
    assert np.abs(np.log10(DECODED[quantise(p)]) - np.log10(p)).max() <= 0.0193


@pytest.mark.parametrize("block", [1 << 13, 1 << 20])
def test_lm_scores(docs, rows, block):
    got = {r.doc_id: r for r in score(docs, block_bytes=block).collect()}
    texts = {r[0]: words(r[1], lower=True) + [None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    one, two, contexts = Counter(), Counter(), Counter()
    for i, w in texts.items():
        if not held[i]:
            one.update(w)
            for a, b in zip([0, *w], w):
                two[a, b] += 1
                contexts[a] += 1
    n, v, fan = sum(one.values()), len(one), Counter(a for a, _ in two)
    for i, w in texts.items():
        g, base, model = got[i], 0.0, 0.0
        for a, b in zip([0, *w], w):
            p0 = (one[b] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p0)
            model += math.log10(p0 if not contexts[a] else (max(two[a, b] - 0.75, 0) + 0.75 * fan[a] * p0) / contexts[a])
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(w), sum(one[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.bigram_score == pytest.approx(model, abs=0.02 * len(w))


@pytest.mark.parametrize("block", [1 << 13, 1 << 20])
def test_lm_trigram_scores(docs, rows, block):
    got = {r.doc_id: r for r in score(docs, block_bytes=block).collect()}
    texts = {r[0]: words(r[1], lower=True) + [None] for r in rows}
    grams = [Counter() for _ in range(4)]
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for k in (1, 2, 3):
                grams[k].update(tuple([0, *w][j : j + k]) for j in range(int(k == 1), len(w) + 2 - k))
    n, v = sum(grams[1].values()), len(grams[1])
    size, fan = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for k in (2, 3):
        for g, c in grams[k].items():
            size[k][g[:-1]] += c
            fan[k][g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (grams[1][g] + 0.1) / (n + 0.1 * (v + 1))
        c = size[len(g)][g[:-1]]
        return p(g[1:]) if not c else (max(grams[len(g)][g] - 0.75, 0) + 0.75 * fan[len(g)][g[:-1]] * p(g[1:])) / c

    better = 0
    for i, w in texts.items():
        model = sum(math.log10(p(tuple([0, *w][max(0, j - 1) : j + 2]))) for j in range(len(w)))
        assert got[i].score == pytest.approx(model, abs=0.03 * len(w)), i
        better += got[i].score > got[i].bigram_score + 1
    assert better


def test_lm_answers_take_the_memory_of_a_range(monkeypatch):
    rng = np.random.default_rng(5)
    common = rng.choice(20_000, (8, 60_000), p=(w := 1.0 / np.arange(1, 20_001)) / w.sum())
    tables = [pa.table({"block": pa.array([i], pa.int32()), "id": pa.array([10 * i + 1]), "text": [" ".join(map(str, words.tolist()))]}) for i, words in enumerate(common)]
    counted = pa.concat_tables([op7_lm_scoring._count(1)(t) for t in tables])
    told = op7_lm_scoring._total(1)(counted)
    to = lambda i: told.filter(pa.compute.equal(told.column("dst"), i))
    sent = pa.concat_tables([op7_lm_scoring._pairs(1)(t, to(i)) for i, t in enumerate(tables)])

    def answers() -> tuple[list, int]:
        tracemalloc.start()
        out = op7_lm_scoring._answer(sent)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return list(exchange.read(out)), peak

    monkeypatch.setattr(op7_lm_scoring, "LOAD", 1 << 40, raising=False)
    whole, most = answers()
    monkeypatch.setattr(op7_lm_scoring, "LOAD", 1 << 16, raising=False)
    parts, least = answers()
    assert parts == whole and least < most / 3


def test_lm_edges(empty, odd):
    assert score(empty).collect() == []
    out = score(odd).collect()
    assert len(out) == 5 and sorted(r.n_tokens for r in out) == [1, 1, 7, 7, 7]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, 2.0]), (2080, [None] * 16), (None, x[0].tolist())]
    found = defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), sample=400, leaf=32).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, own in found.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(v == pytest.approx(s[i]) for _, i, v in own)
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        hits += len({i for _, i, _ in own} & set(best.tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_nearest_of_double_vectors_repeated_ids_and_clashing_names(spark):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), i, "x") for i, v in enumerate(x)] + [(7, x[7].tolist(), 1, None)]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cell bigint, class string"), sample=100, leaf=16, recall=1.0).collect()
    for q in range(0, 300, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        s = np.append(x @ x[q], x[7] @ x[q])
        ids = np.append(np.arange(300), 7)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert len(own) == 20 and all(v == pytest.approx(float(x[i] @ x[q]), rel=1e-12) for _, i, v in own)
        assert len({i for _, i, _ in own} & set(ids[best].tolist())) >= 18


def test_nearest_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).collect() == []
    few = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], schema)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
