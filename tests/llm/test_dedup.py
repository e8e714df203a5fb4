import hashlib
import random

import numpy as np
import pytest

from llm_helpers import words
from fragspark.llm import suffix_sort
from fragspark.llm import text as T
from fragspark.llm.op1_substring_dedup import substring_dedup
from fragspark.llm.op2_suffix_dedup import suffix_dedup


def test_packed_keys_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 2**63), (500, 1000), (2000, 2**40), (300, 2**64 - 1)):
        keys = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (T.unpack_sorted(T.pack_sorted(keys)) == keys).all()


def test_fold_equals_direct_polynomials():
    h = np.random.default_rng(2).integers(0, 2**63, 50, dtype=np.uint64)
    for width in (1, 2, 3, 5, 20):
        expected = [sum(int(h[i + j]) * 7 ** (width - 1 - j) for j in range(width)) % 2**64 for i in range(50 - width + 1)]
        assert [int(x) for x in T.fold(h, width, 7)] == expected


def substring_brute(rows, width):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        keep = [True] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                keep[s : s + width] = [False] * width
            seen.add(k)
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        out[doc_id] = (len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width,block", [(20, 1 << 14), (3, 1 << 16)])
def test_substring_dedup(docs, rows, width, block):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, width, block_bytes=block).collect()}
    assert got == substring_brute(rows, width)


def suffix_brute(rows, length):
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    seen = {}
    for b in texts.values():
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for doc_id, b in texts.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc_id] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length", [400, 100])
def test_suffix_dedup(docs, rows, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, length, block_bytes=1 << 14).collect()}
    assert got == suffix_brute(rows, length)


def test_suffix_sort_orders_all_suffixes():
    rng = random.Random(3)
    for trial in range(60):
        base = bytes(rng.choice(b"ab\x00\xff" if trial % 2 else b"abcdefgh ") for _ in range(rng.choice([5, 60, 300])))
        data = b"".join(base[: rng.randint(0, len(base))] for _ in range(4))
        starts = np.arange(len(data))
        lengths = np.minimum(len(data) - starts, rng.choice([7, 50, 400]))
        order, common = suffix_sort.sort(np.frombuffer(data + b"\0" * 8, np.uint8), starts, lengths, rng.choice([0, 8, 32]))
        strings = [data[s : s + n] for s, n in zip(starts[order], lengths[order])]
        assert strings == sorted(strings)
        for i in range(1, len(strings)):
            n = int(common[i])
            assert strings[i - 1][:n] == strings[i][:n] and (n == min(len(strings[i - 1]), len(strings[i])) or strings[i - 1][n] != strings[i][n])


def test_hot_contents_are_split(monkeypatch, docs, rows):
    from fragspark.llm import op2_suffix_dedup

    monkeypatch.setattr(op2_suffix_dedup, "BATCH", 50)
    buf, key, starts, sizes, places = b"", [], [], [], []
    for i in range(40):
        text = bytes([97 + i % 3]) * 20 + b"0123456789" * 41 + bytes([97 + i % 5]) * 20
        starts.append(len(buf)), sizes.append(len(text)), key.append(9), places.append(20)
        buf += text
    found = op2_suffix_dedup.repeated_starts(np.frombuffer(buf + b"\0" * 8, np.uint8), np.array(key, np.uint64), np.array(starts), np.array(sizes), np.array(places), np.zeros(40, bool), 400)
    for i in range(40):
        for s in range(sizes[i] - 399):
            string = buf[starts[i] + s : starts[i] + s + 400]
            assert found[i, s] == (sum(buf[a : a + n].count(string) for a, n in zip(starts, sizes)) > 1 or buf[starts[i] : starts[i] + sizes[i]].find(string) != s)


def test_edges(empty, odd):
    assert substring_dedup(empty).collect() == [] and suffix_dedup(empty).collect() == []
    got = [tuple(r) for r in substring_dedup(odd, 3).collect()]
    assert sorted(x[1:3] for x in got) == [(0, 0), (0, 0), (6, 0), (6, 6), (6, 6)]
    removed = sorted(r.n_removed for r in suffix_dedup(odd, 40).collect())
    assert removed == [0] * 5
    out = suffix_dedup(odd, carry=odd.columns)
    assert out.count() == 5 and out.select("row.*").columns == odd.columns
