"""Substring dedup with a count-min prefilter.

Round one: every block of documents builds a count-min sketch of its windows of
``width`` words (``DEPTH`` rows; a row is kept as its sorted non-zero cells,
with counters saturating at two, as two is all that matters). Shards merge
the rows of all blocks and tell each block which of its cells hold two or more.
A merged sketch only overestimates, so a window that occurs twice is never lost.
The sketch is as wide as the corpus has windows, and it is split over the
shards; no task holds it whole and nothing of it is broadcast.

Round two: only windows estimated repeated are grouped exactly, by 96-bit keys
of their word sequence, whose two parts come from hashes of the words that share nothing. A block sends the first occurrence of each; the shard
finds the earliest (id, start) and marks the others.

Null or empty text: no words, nothing removed, hash of the empty string. A null
id sorts before all others. Rows that share an id count as one after another, in an
order that their texts fix. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fragspark.llm import exchange as X
from fragspark.llm import text as T

DEPTH = 2
SEEDS = (0x51ED270B7F3A1C29, 0xA3B195354A39B70D)
BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class _Block:
    """The windows of a block, in (id, start) order."""

    def __init__(self, table: pa.Table, width: int, bits: int) -> None:
        self.table = X.ordered(table)
        self.buf, self.offs = T.buffers(self.table.column("text"))
        self.starts, self.ends, self.firsts = T.split_words(self.buf, self.offs)
        words = T.span_hashes(self.buf, self.starts, self.ends)
        self.at = T.windows_inside(self.firsts, width)
        self.key = T.mix(T.fold(words, width, BASES[0])[self.at]) if len(self.at) else np.zeros(0, np.uint64)
        self.width, self.bits = width, bits

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sketch row r: its sorted cells, the cell number of each window, and whether the cell holds two or more here."""
        cells, number, counts = np.unique(T.mix(self.key, SEEDS[r]) >> np.uint64(64 - self.bits), return_inverse=True, return_counts=True)
        return cells, number, counts > 1

    def candidates(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows numbered ``chosen``: keys (two parts) and numbers of the first occurrences, sorted by key; numbers of the others."""
        more = np.zeros(0, np.uint32)
        if len(chosen):
            words = T.span_hashes(self.buf, self.starts, self.ends, T.OTHER_KEYS)
            more = T.mix(T.fold(words, self.width, BASES[1])[self.at[chosen]]).astype(np.uint32)
        key = self.key[chosen]
        order = np.lexsort((chosen, more, key))
        key, more, number = key[order], more[order], chosen[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        return key[first], more[first], number[first], number[~first]


def _sketch(width: int, bits: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        block, src, out = _Block(table, width, bits), table.column("block")[0].as_py(), []
        for r in range(DEPTH):
            cells = block.row(r)[0]
            cuts = X.shard_bounds(cells, bits, shards)
            out += [(s, src, r, T.pack_sorted(cells[cuts[s] : cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts)).tolist()]
        return X.messages(out)

    return run


def _candidates(width: int, bits: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.NO_MESSAGES
        block, src = _Block(table, width, bits), table.column("block")[0].as_py()
        told = {(kind, s): data for _, s, kind, data in X.read(answers)}
        estimated = np.ones(len(block.at), dtype=bool)
        for r in range(DEPTH):
            cells, number, many = block.row(r)
            cuts = X.shard_bounds(cells, bits, shards)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                if (r, s) in told:
                    many[cuts[s] : cuts[s + 1]] |= np.unpackbits(np.frombuffer(told[r, s], np.uint8), count=cuts[s + 1] - cuts[s]).astype(bool)
            estimated &= many[number]
        out = [(src % shards, src, 9, np.packbits(estimated).tobytes())]
        key, more, number, _ = block.candidates(np.flatnonzero(estimated))
        ids = X.ids_of(block.table)[np.searchsorted(block.firsts, block.at[number], "right") - 1]
        cuts = X.shard_bounds(key, 64, shards)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[s], cuts[s + 1])
            out.append((s, src, 1, key[part].tobytes() + ids[part].tobytes() + more[part].tobytes()))
        return X.messages(out)

    return run


def _earliest(table: pa.Table) -> pa.Table:
    """Of each key, the entry with the smallest id stays; the answer has a bit for every entry: whether it goes."""
    sent = list(X.read(table))
    out = [(src, dst, kind, data) for dst, src, kind, data in sent if kind == 9]
    rows = [(src, data) for _, src, kind, data in sent if kind == 1]
    if rows:
        sizes = np.array([len(d) // 20 for _, d in rows])
        key = np.concatenate([np.frombuffer(d, np.uint64, n) for (_, d), n in zip(rows, sizes)])
        ids = np.concatenate([np.frombuffer(d, np.int64, n, 8 * n) for (_, d), n in zip(rows, sizes)])
        more = np.concatenate([np.frombuffer(d, np.uint32, n, 16 * n) for (_, d), n in zip(rows, sizes)])
        order = np.lexsort((ids, more, key))
        goes = np.zeros(len(key), dtype=bool)
        goes[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
        ends = np.cumsum(sizes)
        out += [(src, sent[0][0], 1, np.packbits(goes[e - n : e]).tobytes()) for (src, _), n, e in zip(rows, sizes, ends)]
    return X.messages(out)


def _remove(width: int, bits: int, shards: int, with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _types(with_text)})
        block = _Block(table, width, bits)
        told = {(kind, s): data for _, s, kind, data in X.read(answers)}
        estimated = [d for (kind, _), d in told.items() if kind == 9]
        chosen = np.flatnonzero(np.unpackbits(np.frombuffer(estimated[0], np.uint8), count=len(block.at)))
        key, _, number, again = block.candidates(chosen)
        goes = np.zeros(len(key), dtype=bool)
        cuts = X.shard_bounds(key, 64, shards)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if (1, s) in told:
                goes[cuts[s] : cuts[s + 1]] = np.unpackbits(np.frombuffer(told[1, s], np.uint8), count=cuts[s + 1] - cuts[s]).astype(bool)
        gone = block.at[np.concatenate([number[goes], again])]
        cover = np.zeros(len(block.starts) + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + width, -1)
        kept = np.cumsum(cover[:-1]) == 0
        ids, firsts, data = block.table.column("id"), block.firsts, block.buf.tobytes()
        rows = []
        for i in range(len(ids)):
            keep, n = kept[firsts[i] : firsts[i + 1]], int(firsts[i + 1] - firsts[i])
            words = data[block.offs[i] : block.offs[i + 1]].split()
            left = b" ".join(words if keep.all() else compress(words, keep))
            rows.append((ids[i].as_py(), n, n - int(keep.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
        columns = list(zip(*rows))
        return pa.table({n: pa.array(columns[i], t) for i, (n, t) in enumerate(_types(with_text))})

    return run


def _types(with_text: bool) -> list:
    base = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    return base + [("kept_text", pa.string())] * with_text


def substring_dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of ``width`` words that starts earlier elsewhere.

    Returns (doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row for every row of ``docs``.
    """
    count, _, size = X.block_count(docs, block_bytes, text_col)
    shards = X.shard_count(count, 4)
    bits = int(max(size, 64)).bit_length()  # words take two bytes and more with their space: two to four cells a window at the usual six
    blocks = X.to_blocks(docs, count, id_col, text_col)
    sketch = X.by_block(blocks, _sketch(width, bits, shards), X.MESSAGE_SQL)
    repeated = X.by_shard(sketch, X.shared_keys)
    entries = X.with_answers(blocks, repeated, _candidates(width, bits, shards), X.MESSAGE_SQL)
    marked = X.by_shard(entries, _earliest)
    return X.with_answers(blocks, marked, _remove(width, bits, shards, with_text), SCHEMA + ", kept_text string" * with_text)
