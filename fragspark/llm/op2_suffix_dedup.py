"""Suffix-array dedup: removes every byte covered by a ``length``-byte string that starts anywhere else too.

A sparse suffix array is sorted instead of one of all positions. Every string of
``length`` bytes names an anchor in its first half, the leftmost position whose
16 bytes hash lowest there; equal strings name the same anchor, relative to their
start. An anchor owns a run of consecutive string starts, and together with the
``length - 1`` bytes after the last of them they make its context.

Round one: blocks ask the shards which anchors' forward contents (the bytes from the
anchor that every owned string contains) occur more than once. Other anchors can't own
a repeated string. Round two: the contexts of the rest go to the shard of that
content, a block's equal contexts as one. The shard sorts the contexts' suffixes by
deep-shallow sorting (see suffix_sort.py); where a suffix agrees with a neighbour in
``length`` + t bytes, its first t + 1 strings are repeated. Where contexts with the same
content differ, the suffixes at all owned starts are sorted too, and a string is repeated
if it agrees with a neighbour over its whole length. Both decide on the texts' own bytes;
hashes only bring together what may be equal.

Null or empty text: no bytes, nothing removed. Repeated rows are separate documents, so
their long strings are repeated and go from each. Columns other than id and text are
ignored unless carried. Texts of any length are read in pieces of a quarter of a megabyte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from fragspark.llm import exchange as X
from fragspark.llm import suffix_sort
from fragspark.llm import text as T

GRAM = 16
PIECE = 1 << 18
BATCH = 400_000


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first owned start, last owned start) in text order."""
    width = length // 2 - GRAM + 1
    found = []
    ends = offs[1:]
    for low in range(0, len(buf), PIECE):
        part = buf[low : low + PIECE + length]
        n = min(PIECE, len(part) - length + 1)
        if n <= 0:
            break
        grams = T.fold(T.BYTE_KEYS[part[: n + width + GRAM]], GRAM, 0xD1342543DE82EF95)
        key = ((grams * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        size = -(-(n + width - 1) // width) * width
        if len(key) < size:
            key = np.append(key, np.full(size - len(key), 2**64 - 1, dtype=np.uint64))
        grid = key[:size].reshape(-1, width)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        lowest = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        starts = np.arange(low, low + n)
        doc_end = ends[np.minimum(np.searchsorted(ends, starts, "right"), len(ends) - 1)]
        inside = np.flatnonzero(starts + length <= doc_end)
        at = (lowest[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
            last = np.append(first[1:], len(at)) - 1
            found.append((at[first], starts[inside[first]], starts[inside[last]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


class _Block:
    def __init__(self, table: pa.Table, length: int) -> None:
        self.table, self.length = X.ordered(table), length
        self.buf, self.offs = T.buffers(self.table.column("text"))
        self.at, self.first, self.last = anchors(self.buf, self.offs, length)
        content = length - (length // 2 - GRAM)
        self.key = T.span_hashes(self.buf, self.at, self.at + content)
        self.keys, self.number, counts = np.unique(self.key, return_inverse=True, return_counts=True)
        self.many = counts > 1

    def classes(self, chosen: np.ndarray) -> tuple[list[tuple[int, bytes, int]], np.ndarray, np.ndarray]:
        """The distinct (key, context, place of the anchor) of the chosen anchors, sorted; how often each occurs; the number of each anchor's."""
        data = self.buf.tobytes()
        rows = list(zip(self.key[chosen].tolist(), (data[a:b] for a, b in zip(self.first[chosen].tolist(), (self.last[chosen] + self.length).tolist())), (self.at[chosen] - self.first[chosen]).tolist()))
        kinds = sorted(set(rows))
        place = {k: i for i, k in enumerate(kinds)}
        number = np.array([place[r] for r in rows], dtype=np.int64)
        return kinds, np.bincount(number, minlength=len(kinds)), number


def _ask(length: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        block, src = _Block(table.select(["id", "text"]), length), table.column("block")[0].as_py()
        cuts = X.shard_bounds(block.keys, 64, shards)
        return X.messages([(s, src, 0, T.pack_sorted(block.keys[cuts[s] : cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts)).tolist()])

    return run


def _send(length: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.NO_MESSAGES
        block, src = _Block(table.select(["id", "text"]), length), table.column("block")[0].as_py()
        cuts = X.shard_bounds(block.keys, 64, shards)
        for _, s, _, data in X.read(answers):
            block.many[cuts[s] : cuts[s + 1]] |= X.bits(data, cuts[s + 1] - cuts[s])
        chosen = block.many[block.number]
        out = [(src % shards, src, 9, np.packbits(chosen).tobytes())]
        kinds, counts, _ = block.classes(np.flatnonzero(chosen))
        keys = np.array([k[0] for k in kinds], dtype=np.uint64)
        sizes = np.array([len(k[1]) for k in kinds], dtype=np.int32)
        places = np.array([k[2] for k in kinds], dtype=np.int32)
        cuts = X.shard_bounds(keys, 64, shards)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            p = slice(cuts[s], cuts[s + 1])
            head = [keys[p].tobytes(), sizes[p].tobytes(), places[p].tobytes(), (counts[p] > 1).astype(np.uint8).tobytes()]
            out.append((s, src, 1, np.int64(cuts[s + 1] - cuts[s]).tobytes() + b"".join(head) + b"".join(k[1] for k in kinds[p])))
        return X.messages(out)

    return run


def repeated_starts(buf: np.ndarray, key: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """A row for each context: which of its owned strings occur more than once among all contexts."""
    own = sizes - length + 1
    n, width = len(key), length // 2 - GRAM + 1
    steps = np.arange(width)
    out = many[:, None] & (steps < own[:, None])
    order, common = suffix_sort.sort(buf, starts, sizes)
    best = common.copy()
    best[:-1] = np.maximum(best[:-1], common[1:])
    agree = np.empty(n, np.int64)
    agree[order] = best
    out |= steps < np.minimum(own, agree - length + 1)[:, None]
    # equal contexts are one class; where a content has several classes, strings at all owned starts are compared
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (common[1:] < sizes[order[1:]]) | (sizes[order[1:]] != sizes[order[:-1]]) | (key[order[1:]] != key[order[:-1]]) | (places[order[1:]] != places[order[:-1]])
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(fresh) - 1
    heads = order[fresh]
    keys, group, kinds_of_key = np.unique(key[heads], return_inverse=True, return_counts=True)
    rival = np.flatnonzero(kinds_of_key[group] > 1)
    rival = rival[np.argsort(group[rival], kind="stable")]
    loads = np.cumsum(own[heads[rival]])
    i = 0
    while i < len(rival):
        # whole contents together, as many as make a batch; a larger one is split by the distance to the anchor, which equal strings share
        j = max(i + 1, int(np.searchsorted(loads, (loads[i - 1] if i else 0) + BATCH, "right")))
        while j < len(rival) and group[rival[j]] == group[rival[j - 1]]:
            j += 1
        rows = heads[rival[i:j]]
        row = np.repeat(np.arange(len(rows)), own[rows])
        step = np.arange(len(row)) - np.repeat(np.cumsum(own[rows]) - own[rows], own[rows])
        parts = [slice(None)]
        if len(row) > 2 * BATCH:
            distance = places[rows][row] - step
            by = np.argsort(distance, kind="stable")
            row, step, distance = row[by], step[by], distance[by]
            edges = np.append(np.flatnonzero(np.diff(distance, prepend=distance[0] - 1)), len(row)).tolist()
            parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        for p in parts:
            at = starts[rows[row[p]]] + step[p]
            by, common = suffix_sort.sort(buf, at, np.full(len(at), length))
            hit = np.zeros(len(at), dtype=bool)
            pair = np.flatnonzero(common >= length)
            hit[by[pair]] = True
            hit[by[pair - 1]] = True
            out[rows[row[p][hit]], step[p][hit]] = True
        i = j
    return out | out[heads][kind]


def _sort(length: int):
    def run(table: pa.Table) -> pa.Table:
        sent = list(X.read(table))
        out = [(src, dst, kind, data) for dst, src, kind, data in sent if kind == 9]
        rows = [(src, data, int(np.frombuffer(data, np.int64, 1)[0])) for _, src, kind, data in sent if kind == 1]
        if rows:
            part = lambda at, dtype: np.concatenate([np.frombuffer(d, dtype, n, 8 + at * n) for _, d, n in rows])
            key, sizes, places, many = part(0, np.uint64), part(8, np.int32).astype(np.int64), part(12, np.int32).astype(np.int64), part(16, np.uint8) > 0
            buf = np.frombuffer(b"".join([d[8 + 17 * n :] for _, d, n in rows]) + b"\0" * 8, np.uint8)
            found = repeated_starts(buf, key, np.cumsum(sizes) - sizes, sizes, places, many, length)
            ends = np.cumsum([n for _, _, n in rows])
            out += [(src, sent[0][0], 1, np.packbits(found[e - n : e], axis=1).tobytes()) for (src, _, n), e in zip(rows, ends)]
        return X.messages(out)

    return run


def long_runs(hit: np.ndarray, buf: np.ndarray, offs: np.ndarray, length: int, words: int, sure: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the bytes under runs of consecutive repeated starts that hold more than ``words`` whole words, or ``sure`` bytes."""
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    begins, ends = edges[::2], edges[1::2] + length - 1
    first, last, _ = T.split_words(buf, offs)
    held = np.searchsorted(last, ends, "right") - np.searchsorted(first, begins)
    stays = (held > words) | (ends - begins >= sure)
    return begins[stays], ends[stays]


def _remove(length: int, shards: int, schema: pa.Schema, words: int | None, sure: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        block, width = _Block(table, length), length // 2 - GRAM + 1
        told = {(kind, s): data for _, s, kind, data in X.read(answers)}
        chosen = np.flatnonzero(X.bits(next(d for (kind, _), d in told.items() if kind == 9), len(block.at)))
        kinds, _, number = block.classes(chosen)
        keys = np.array([k[0] for k in kinds], dtype=np.uint64)
        cuts = X.shard_bounds(keys, 64, shards)
        repeated = np.zeros((len(kinds), width), dtype=bool)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if (1, s) in told:
                rows = np.frombuffer(told[1, s], np.uint8).reshape(cuts[s + 1] - cuts[s], -1)
                repeated[cuts[s] : cuts[s + 1]] = np.unpackbits(rows, axis=1, count=width)
        n, offs = len(block.buf), block.offs
        cover = np.zeros(n + 1, dtype=np.int32)
        hit = np.zeros(n, dtype=bool)
        for i in range(0, len(chosen), 50_000):
            row, step = np.nonzero(repeated[number[i : i + 50_000]])
            starts = block.first[chosen[i : i + 50_000]][row] + step
            if words is not None:
                hit[starts] = True
                continue
            np.add.at(cover, starts, 1)
            np.subtract.at(cover, starts + length, 1)
        if words is not None:
            begins, ends = long_runs(hit, block.buf, offs, length, words, sure)
            np.add.at(cover, begins, 1)
            np.subtract.at(cover, ends, 1)
        gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offs[:-1][offs[:-1] < n]] = gone[offs[:-1][offs[:-1] < n]]
        held = np.flatnonzero(gone)
        sums, spans = np.searchsorted(held, offs), np.searchsorted(np.flatnonzero(begins), offs)
        data, texts, hashes = block.buf.tobytes(), [], []
        for a, b, whole in zip(offs[:-1].tolist(), offs[1:].tolist(), (sums[:-1] == sums[1:]).tolist()):
            left = data[a:b] if whole else block.buf[a:b][~gone[a:b]].tobytes()
            hashes.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode("utf-8", "ignore"))
        columns = [block.table.column("id"), pa.array(np.diff(offs)), pa.array(np.diff(sums)), pa.array(np.diff(spans)), pa.array(hashes)]
        if "kept_text" in schema.names:
            null = block.table.column("text").is_null().to_numpy()
            columns += [pa.array(texts, pa.string(), mask=null), block.table.column("row")]
        return pa.table(columns, schema=pa.schema([(n, c.type) for n, c in zip(schema.names, columns)]))

    return run


def suffix_dedup(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, carry: list[str] | None = None,
    words: int | None = None, sure: int = 400,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text, row]), a row for every row of ``docs``.

    With ``carry``, ``kept_text`` is what is left (bytes of a character that was cut in two go; null where the text is) and ``row`` holds the carried columns.
    With ``words``, strings of ``length`` bytes that are repeated at consecutive starts make a run, and only runs of more than ``words`` whole words
    or of at least ``sure`` bytes go.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    count, _, _ = X.block_count(docs, block_bytes, text_col)
    shards = X.shard_count(count, 2)
    blocks = X.to_blocks(docs, count, id_col, text_col, carry)
    fields = [S.StructField(n, S.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [S.StructField("kept_sha256", S.StringType())]
    if carry:
        fields += [S.StructField("kept_text", S.StringType()), blocks.schema["row"]]
    schema = S.StructType(fields)
    asked = X.by_block(blocks, _ask(length, shards), X.MESSAGE_SQL)
    shared = X.by_shard(asked, X.shared_keys)
    sent = X.with_answers(blocks, shared, _send(length, shards), X.MESSAGE_SQL)
    found = X.by_shard(sent, _sort(length))
    return X.with_answers(blocks, found, _remove(length, shards, to_arrow_schema(schema), words, sure), schema)
