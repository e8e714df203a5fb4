from collections import Counter, defaultdict

import numpy as np
import pytest

from fragspark.llm import op3_mixing, op4_classifier, op5_rules
from llm_helpers import words


def test_mixing_hits_its_targets(docs, rows):
    got = {r.doc_id: r for r in op3_mixing.mix(docs, block=16).collect()}
    size, source = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[n] for n in full)) / sum(weight[n] for n in names if n not in full)
        over = {n for n in names if n not in full and weight[n] * level > 2 * size[n]}
        if not over:
            break
        full |= over
    target = {n: 2 * size[n] if n in full else weight[n] * level for n in names}
    taken = defaultdict(int)
    for r in rows:
        g = got[r[0]]
        assert g.size == len(words(r[1])) and g.source_size == size[r[3]] and g.target == pytest.approx(target[r[3]])
        assert 0 <= g.taken <= 2 * g.size
        taken[source[r[0]]] += g.taken
    for n in names:
        assert abs(taken[n] - target[n]) < 1
    assert {r.doc_id: r.taken for r in op3_mixing.mix(docs.repartition(5), block=16).collect()} == {k: v.taken for k, v in got.items()}


def test_mixing_edges(empty, odd):
    assert op3_mixing.mix(empty).collect() == []
    out = op3_mixing.mix(odd, block=2).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == 26  # floors of 19.3 and 7.7
    assert all(r.taken == 0 for r in op3_mixing.mix(odd.where("text is null")).collect())


def test_boosted_trees_learn_and_walk_like_a_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.5)).astype(float)
    forest = op4_classifier.fit(x[:2000], y[:2000])
    score = forest.score(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.96
    for row, s in zip(x[2000:2020], score[:20]):
        odds = 0.0
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + 1 + (row[f[node]] >= t[node])
            odds += v[node - (2**forest.depth - 1)]
        assert s == pytest.approx(1 / (1 + np.exp(-odds)))
    assert op4_classifier.fit(x, np.ones(len(x))).score(x[:2]).min() > 0.9
    assert op4_classifier.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


@pytest.fixture(scope="module")
def graded(spark):
    import random

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        good = i % 4 != 0
        if not good:
            w = [x + "$$$" for x in w] if i % 8 else [x for x in w[:10] for _ in range(12)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifier_on_held_out_rows(graded):
    docs, labels = graded
    out = {r.doc_id: r for r in op4_classifier.classify(docs, op4_classifier.train(docs, labels)).collect()}
    held = [(r.quality, out[r.doc_id]) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(held) > 100 and sum(q == o.predicted for q, o in held) / len(held) > 0.97
    import zlib

    assert all(o.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, o in out.items())


def test_classifier_edges(empty, odd, graded):
    forest = op4_classifier.train(*graded)
    assert op4_classifier.classify(empty, forest).collect() == []
    out = op4_classifier.classify(odd, forest, carry=odd.columns)
    assert out.count() == 5 and out.select("row.*").columns == odd.columns and all(0 <= r.score <= 1 for r in out.collect())
    none = op4_classifier.train(graded[0], graded[1].limit(0))
    assert [r.score for r in op4_classifier.classify(odd, none).collect()] == [0.5] * 5


def test_rule_statistics(docs, rows):
    got = {r.doc_id: r for r in op5_rules.statistics(docs).collect()}
    for doc_id, text, *_ in rows:
        w, t = words(text), text or ""
        count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {p for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        g = got[doc_id]
        assert (g.n_words, g.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert g.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert g.n_dup_lines == len(lines) - len(set(lines)) and g.n_repeat_words == len(covered)


def test_rules_reject_what_labels_reject(graded):
    docs, labels = graded
    out = {r.doc_id: r for r in op5_rules.quality_rules(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert all(out[i].kept for i, q in marks.items() if q == 1)
    assert sum(not out[i].kept for i, q in marks.items() if q == 0) > 140
    assert any(r.rule > 0 for r in out.values())


def test_rules_edges(empty, odd, graded):
    labels = graded[1]
    assert op5_rules.quality_rules(empty, labels).collect() == []
    out = op5_rules.quality_rules(odd, labels.limit(0)).collect()
    assert len(out) == 5 and all(r.base_failed and not r.kept for r in out)
