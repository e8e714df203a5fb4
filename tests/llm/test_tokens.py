import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from fragspark.llm import tokenizer as K  # noqa: E402
from fragspark.llm.op9_token_counts import token_counts  # noqa: E402
from fragspark.llm.op10_packing import pack  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    expected = {r[0]: (len((r[1] or "").encode()), len(i), len(i) > 512) for r, i in zip(rows, ids([r[1] or "" for r in rows]))}
    assert got == expected


@pytest.mark.parametrize("seed", range(3))
def test_transducers_on_odd_strings(seed):
    import random

    rng = random.Random(seed)
    parts = ["a", "'s", "'", "'re", "'r", "'ve", "'ll", "'l", " ", "  ", "\n", "\t", "1", "!", "é", "日本", " ", " ", "The", "<|endoftext|>", "<|endof", "\x1c", "\x85", "²", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    buf = np.frombuffer(b"".join(data), np.uint8)
    counter, encoder = K.Counter(PATH), K.Encoder(PATH)
    starts, ends, special = K.pretokens(buf, offs)
    sums = np.concatenate([[0], np.cumsum(counter.counts(buf, starts, ends, special))])
    expected = ids(texts)
    assert np.diff(sums[np.searchsorted(starts, offs)]).tolist() == [len(e) for e in expected]
    flat, sizes = encoder.encode(buf, starts, ends, special)
    assert flat.tolist() == [i for e in expected for i in e] and sizes.sum() == len(flat)


def test_very_long_pretokens_in_chunks():
    import random

    rng = random.Random(5)
    long = ["x" * 1_000_000, "".join(rng.choice(["the", "tion", "ing", "pre", "é", "er"]) for _ in range(60_000)), "".join(rng.choice("abcdefgh") for _ in range(30_000))]
    for limit in (1_000_000, 2_000):
        machine = K.CountMachine(K.vocabulary(PATH), limit)
        assert [machine.read(w.encode()) for w in long] == [len(i) for i in ids(long)]
    assert len(machine.goto) <= 2_000 + K.CountMachine.CHUNK


def test_chunk_maps_compose():
    after, _ = K.word_machine()
    symbols = np.random.default_rng(1).integers(0, K.CLASSES, 3 * K.CHUNK + 17).astype(np.uint8)
    marks, state, expected = K.run_machine(symbols), K.Z, []
    machine_after, machine_marks = K.word_machine()
    for s in symbols.tolist():
        expected.append(int(machine_marks[state * K.CLASSES + s]))
        state = int(machine_after[state * K.CLASSES + s])
    assert marks.tolist() == expected


def test_memories_may_be_small():
    counter, encoder = K.Counter(PATH, 3), K.Encoder(PATH, 3)
    counter.machine.limit = 10
    for text in ("some words in a row", "others in a row of words", "some words"):
        buf = np.frombuffer(text.encode(), np.uint8)
        s, e, x = K.pretokens(buf, np.array([0, len(buf)]))
        expected = ids([text])[0]
        assert counter.counts(buf, s, e, x).sum() == len(expected)
        assert encoder.encode(buf, s, e, x)[0].tolist() == expected


@pytest.mark.parametrize("ending", ["", " \u3000", "\xa0", "\u2028x", " é"])
def test_new_words_go_through_the_short_call_together(ending):
    encoder, calls = K.Encoder(PATH), []

    class Library:
        def __getattr__(self, name):
            return lambda texts, **options: calls.append((name, len(texts))) or getattr(library, name)(texts, **options)

    library, encoder.library = encoder.library, Library()
    text = "plain words, é à\u00a0 \u2003 \u3000\u3000x \x85 \x85y\r\n  z<|endoftext|>\u1680\u202f it's 12 ñ\u2009" + ending
    buf = np.frombuffer(text.encode(), np.uint8)
    found, sizes = encoder.encode(buf, *(spans := K.pretokens(buf, np.array([0, len(buf)]))))
    assert found.tolist() == ids([text])[0] and len(sizes) == len(spans[0])
    assert [name for name, _ in calls] == ["encode_batch_fast"] * 2 and calls[0][1] == 1


@pytest.mark.parametrize("length", [1024, 8])
def test_packing_is_an_exact_round_trip(docs, rows, length):
    pieces = pack(docs, PATH, length).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for r, own in zip(rows, ids([r[1] or "" for r in rows])):
        own, at = [*own, 0], 0
        for p in sorted(by_doc[r[0]], key=lambda p: p.start):
            part = own[p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(own), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += p.length
        assert at == len(own)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == max(by_sequence)


def test_edges(empty, odd):
    assert token_counts(empty, PATH).collect() == [] and pack(empty, PATH).collect() == []
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_counts(odd, PATH).collect()) == [(False, 0), (False, 0), (False, 6), (False, 6), (True, 6)]
    assert sum(p.length for p in pack(odd, PATH).collect()) == 3 * 7 + 2
