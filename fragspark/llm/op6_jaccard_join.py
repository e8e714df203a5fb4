"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct shingles. Documents with equal
sets are one class, its smallest id its representative. Hashing shingles into ``DIMENSIONS`` groups
and counting each group gives a document a point; the overlap of two sets is at most the
sum of the smaller count in every group. An R-tree over the points bounds the
overlap of two boxes the same way, from the boxes' upper corners, and the join walks pairs of
boxes whose bound admits a link. Surviving leaf pairs are verified by exact intersection.

Which documents meet at all follows from the same grouping: cut finer, into
more groups than two linked sets can differ in elements, any link leaves at least one
group of both sets equal. Signatures of these groups meet in shards. A set that has elements in more
groups than it may differ in needs no signature of an empty group, and there are enough groups that nearly every set has:
an empty group says nothing, and its signature would bring all sets together. Documents of a signature meet as points: an R-tree join of
the bucket keeps those pairs whose bound admits a link. In a few groups all large sets look alike, so those pairs are bounded once more by
bitmaps, which tell of as many groups as a set has elements whether they hold any. A signature that too many share for one task
brings its documents together without that test. The pairs make the clusters within which all links lie.

Clusters are packed, and large ones split, into leaves of bounded size in order of their points; a task joins one leaf, and a few documents of
other leaves of its cluster, with itself. Only what that leaves unconnected goes on to pairs of leaves: a box for the largest component of each leaf, boxes
for the rest, and a pair of boxes meets if they are of different components and their corner bound admits a link. So a group of copies of any size
costs a few copies of each member, not one for every leaf. Links become a forest in the task, and
components are found by distributed star steps.

Texts are read twice, or three times where clusters are split: once for sizes, points and signatures, once for the sets of documents
in clusters of two or more. No pair is left out, and pairs within a component
that is already connected aren't verified again.

Null or empty text and texts without words: an empty set, linked with nothing, a component
of its own. A null id: component null. Rows that share an id count as one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragspark.llm import exchange as X
from fragspark.llm import text as T
from fragspark.llm.graph import components
from fragspark.llm.shared import stored

DIMENSIONS = 64
NODE = 32
LEAF_BYTES = 16 << 20
#: A signature that more documents of one batch share, or more of all, brings them together without a look at their points.
HOT, WIDE = 64, 4096
HUBS = 16
#: Pairs whose points are compared at a time.
STEP = 1 << 14
#: Documents with points and bitmaps that meet in a task, counted once for every bucket.
MEET_BYTES = 64 << 20
#: Groups of a bitmap at most, 1 kB: it travels with every bucket of its set. Larger sets are told apart less well, and still verified.
WIDEST = 8192
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RATIO = 1.5


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after another, offsets)."""
    n = len(offs) - 1
    buf = LOWER[buf]
    starts, ends, firsts = T.split_words(buf, offs)
    words = T.span_hashes(buf, starts, ends)
    at = T.windows_inside(firsts, width)
    keys = [T.mix(T.fold(words, width, 0x2545F4914F6CDD1D)[at], width)] if len(at) else []
    docs = [np.searchsorted(firsts, at, "right") - 1] if len(at) else []
    counts = np.diff(firsts)
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        if len(short):
            keys.append(T.mix(T.fold(words, few, 0x2545F4914F6CDD1D)[firsts[short]], few))
            docs.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[first], doc[first]
    return key, np.searchsorted(doc, np.arange(n + 1))


def size_classes(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, class, most elements that two linked sets of the class differ in, groups): the size classes that each set belongs to or visits.

    Class c holds sizes in [floor(RATIO**c), floor(RATIO**(c+1))); sets up to 100 / percent times its top visit it, as they may link with its members.
    """
    tops = [1]
    while tops[-1] <= (int(sizes.max()) if len(sizes) else 0):
        tops.append(max(tops[-1] + 1, int(tops[-1] * RATIO)))
    tops = np.array(tops[1:] or [2])  # class c: sizes below tops[c]
    own = np.searchsorted(tops, sizes, "right")
    row = np.flatnonzero(sizes > 0)
    below = row[own[row] > 0]
    visits = below[percent * sizes[below] <= 100 * (tops[own[below] - 1] - 1)]
    rows, classes = np.concatenate([row, visits]), np.concatenate([own[row], own[visits] - 1])
    # sets of sizes a and b that link differ in at most (a + b) (100 - percent) / (100 + percent) elements
    most = tops[classes] - 1
    differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    # of g groups, g (1 - exp(-size / g)) have elements on average: as many as make that more than the sets may differ in
    low = np.concatenate([[1], tops])[classes]
    groups = np.ceil((differ + 1) / (1 - np.exp(-low / (differ + 1)))).astype(np.int64) + 2
    return rows, classes, differ, groups


def signatures(keys: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row): a hash of every group's elements, for every class of a set; groups without elements count only for sets that have too few others."""
    sizes = np.diff(offs)
    rows, classes, differ, groups = size_classes(sizes, percent)
    useful = differ > 0  # otherwise only equal sets link
    rows, classes, differ, groups = rows[useful], classes[useful], differ[useful], groups[useful]
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = sizes[rows]
    at = np.repeat(offs[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    base = np.cumsum(groups) - groups
    element = keys[at]
    slot = np.repeat(base, count) + (((element >> np.uint64(32)) * np.repeat(groups.astype(np.uint64), count)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    total = int(groups.sum())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(element, 0x5851F42D4C957F2D)[order])])
    edges = np.searchsorted(slot[order], np.arange(total + 1))
    out = sums[edges[1:]] - sums[edges[:-1]]
    number = np.arange(total) - np.repeat(base, groups)
    out = T.mix(out + T.mix((np.repeat(classes, groups).astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64), 7))
    full = edges[1:] > edges[:-1]
    few = np.add.reduceat(full, base, dtype=np.int64) <= differ
    told = full | np.repeat(few, groups)
    return out[told], np.repeat(rows, groups)[told]


def points(keys: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of each set's elements by group: a row of DIMENSIONS numbers for every set."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    group = (keys & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    return np.bincount(doc * DIMENSIONS + group, minlength=(len(offs) - 1) * DIMENSIONS).reshape(-1, DIMENSIONS)


def packed_points(point: np.ndarray) -> pa.Array:
    """Four bits a count, rounded up to a multiple of a scale that comes first: never below the count, so bounds stay bounds."""
    scale = np.maximum(1, -(-point.max(axis=1, initial=0) // 15))
    code = (-(-point // scale[:, None])).astype(np.uint8)
    data = np.concatenate([scale.astype("<u4").view(np.uint8).reshape(-1, 4), code[:, ::2] | code[:, 1::2] << 4], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 + DIMENSIONS // 2), len(point), [None, pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def unpacked_points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = T.buffers(column)[0].reshape(-1, 4 + DIMENSIONS // 2)
    out = np.empty((len(data), DIMENSIONS), dtype=np.int64)
    out[:, ::2], out[:, 1::2] = data[:, 4:] & 15, data[:, 4:] >> 4
    return out * np.ascontiguousarray(data[:, :4]).view("<u4").astype(np.int64)


def bitmaps(keys: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Which groups of a set hold elements, of the least power of two of groups that reaches its size (64 at least, WIDEST at most)."""
    sizes = np.diff(offs)
    groups = np.minimum(WIDEST, 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(groups)])
    held = np.zeros(base[-1], dtype=bool)
    held[np.repeat(base[:-1], sizes) + (keys & np.repeat(groups - 1, sizes).astype(np.uint64)).astype(np.int64)] = True
    data = np.packbits(held, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(data)])


class Bitmaps:
    """Bitmaps of sets by their widths. A set's groups fold to half as many; as far as that is how much two linked sets' widths differ."""

    def __init__(self, column: pa.ChunkedArray | pa.Array) -> None:
        buf, offs = T.buffers(column)
        self.width = np.diff(offs)  # in bytes
        self.own, self.folded = np.zeros(len(self.width), np.int64), np.zeros(len(self.width), np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            half = buf[offs[wider, None] + np.arange(2 * w)]
            self.rows[w] = np.concatenate([buf[offs[own, None] + np.arange(w)], half[:, :w] | half[:, w:]]).view(np.uint64)
            self.own[own], self.folded[wider] = np.arange(len(own)), len(own) + np.arange(len(wider))

    def may_link(self, size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the pairs (a[i], b[i]) may link: elements in groups that the other set has none in aren't shared."""
        ok = np.ones(len(a), dtype=bool)
        least = np.minimum(self.width[a], self.width[b])
        for w in np.unique(least).tolist():
            at = np.flatnonzero((least == w) & (np.maximum(self.width[a], self.width[b]) <= 2 * w))
            step = max(1, (4 << 20) // w)
            for i in range(0, len(at), step):
                p = at[i : i + step]
                x, y = (self.rows[w][np.where(self.width[e[p]] == w, self.own[e[p]], self.folded[e[p]])] for e in (a, b))
                both = np.minimum(size[a[p]] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), size[b[p]] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                ok[p] = (100 + percent) * both >= percent * (size[a[p]] + size[b[p]])
        return ok


READ_SQL = "kind int, doc_id bigint, n bigint, k1 bigint, k2 bigint, point binary, bits binary, dst bigint, data binary"
READ = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("point", pa.binary()),
    ("bits", pa.binary()), ("dst", pa.int64()), ("data", pa.binary()),
])
#: Kinds of rows: a document; a message to a shard; an edge (doc_id, n) between two documents; a document of a bucket (k1).
DOCUMENT, SENT, EDGE, MEMBER = range(4)


def _rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    full = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
    return pa.record_batch([full.get(f.name, pa.nulls(n, f.type)) for f in READ], schema=READ)


def _read(width: int, percent: int, shards: int, bits: int, most: int):
    """Rows of documents, and messages of signatures and ids to the shards; what goes to no shard has a number below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = -1 - (TaskContext.get().partitionId() << 24)
        for batch in batches:
            ids, (buf, offs) = batch.column(0), T.buffers(batch.column(1))
            known = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
            numbers = pa.compute.fill_null(ids, 0).to_numpy()
            first, second = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            found = []
            i = 0
            while i < len(offs) - 1:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + (2 << 20), "right")) - 1)
                keys, at = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                sizes = np.diff(at)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(keys, seed))]) for seed in (1, 2)]
                first[i:j], second[i:j] = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                empty = sizes == 0
                yield _rows(
                    DOCUMENT, doc_id=ids[i:j], n=pa.array(sizes), k1=pa.array(first[i:j], mask=empty), k2=pa.array(second[i:j], mask=empty),
                    point=packed_points(points(keys, at)), bits=bitmaps(keys, at), dst=pa.array(np.full(j - i, own)),
                )
                told = np.where(known[i:j], sizes, 0)
                sig, row = signatures(keys[np.repeat(told > 0, sizes)], np.concatenate([[0], np.cumsum(told)]), percent)
                found.append((sig >> np.uint64(64 - bits), row + i))
                i = j
            if not found:
                continue
            sig, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            # of equal sets in this batch, the smallest id speaks for all
            by = np.lexsort((numbers, second, first))
            order = by[known[by]]
            same = np.ones(len(order), dtype=bool)
            same[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            speaks = np.zeros(len(ids), dtype=bool)
            speaks[order[same]] = True
            keep = speaks[row]
            sig, number = sig[keep], numbers[row[keep]]
            by = np.lexsort((number, sig))
            sig, number = sig[by], number[by]
            # a hot signature is told once; its documents hang on the smallest here
            fresh = np.ones(len(sig), dtype=bool)
            fresh[1:] = sig[1:] != sig[:-1]
            heads = np.flatnonzero(fresh)
            many = np.repeat(np.diff(np.append(heads, len(sig))), np.diff(np.append(heads, len(sig)))) > most
            least = number[np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))] if len(sig) else number
            hang = many & (number != least)
            if hang.any():
                pairs = np.unique(np.column_stack([number[hang], least[hang]]), axis=0)
                yield _rows(EDGE, doc_id=pa.array(pairs[:, 0]), n=pa.array(pairs[:, 1]), dst=pa.array(np.full(len(pairs), own)))
            told = ~many | fresh
            sig, number, many = sig[told], number[told], many[told]
            cuts = X.shard_bounds(sig, bits, shards)
            parts = np.flatnonzero(np.diff(cuts)).tolist()
            if parts:
                data = [_packed(*(x[cuts[s] : cuts[s + 1]] for x in (sig, number, many))) for s in parts]
                yield _rows(SENT, dst=pa.array(parts, pa.int64()), data=pa.array(data, pa.binary()))
            own -= 1
        X.release()

    return run


def _packed(sig: np.ndarray, number: np.ndarray, hot: np.ndarray) -> bytes:
    """Sorted signatures, whether they are hot, and of each the place of its id in a list of ids."""
    ids, place = np.unique(number, return_inverse=True)
    place = place.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
    body = [ids.tobytes(), place.tobytes(), np.packbits(hot).tobytes(), T.pack_sorted(sig)]
    return np.array([len(ids), len(sig)], np.int64).tobytes() + b"".join(body)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
    kind = np.dtype(np.uint16 if k <= 1 << 16 else np.uint32)
    ids, place = np.frombuffer(data, np.int64, k, 16), np.frombuffer(data, kind, n, 16 + 8 * k)
    at = 16 + 8 * k + kind.itemsize * n
    hot = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
    return T.unpack_sorted(data[at + -(-n // 8) :]), ids[place], hot


def _buckets(wide: int):
    """A shard's signatures that two documents share, as rows of their documents; signatures with the same documents are one bucket. Hot ones become stars."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("dst")[0].as_py() < 0:
            return table
        parts = [_unpacked(d.as_py()) for d in table.column("data")]
        sig, ids, hot = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.lexsort((~hot, ids, sig))
        sig, ids, hot = sig[by], ids[by], hot[by]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids, hot = sig[fresh], ids[fresh], hot[fresh]
        head = np.flatnonzero(np.append([True], sig[1:] != sig[:-1]))
        count = np.diff(np.append(head, len(sig)))
        hot = np.logical_or.reduceat(hot, head) | (count > wide)
        least = np.repeat(ids[head], count)
        star = np.repeat(hot, count) & (ids != least)
        edges = np.unique(np.column_stack([ids[star], least[star]]), axis=0)
        bucket = np.add.reduceat(T.mix(ids.view(np.uint64), 21), head)
        told = np.flatnonzero((count > 1) & ~hot)
        told = told[np.unique(bucket[told], return_index=True)[1]]
        size = count[told]
        at = np.repeat(head[told] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        rows = [_rows(EDGE, doc_id=pa.array(edges[:, 0]), n=pa.array(edges[:, 1])), _rows(MEMBER, doc_id=pa.array(ids[at]), k1=pa.array(np.repeat(bucket[told], size).view(np.int64)))]
        return pa.Table.from_batches(rows, schema=READ)

    return run


def unite(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def may_link(point: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bounds of the pairs (a[i], b[i]) admit a link."""
    ok = (100 * size[a] >= percent * size[b]) & (100 * size[b] >= percent * size[a])
    live = np.flatnonzero(ok)
    for i in range(0, len(live), STEP):
        p = live[i : i + STEP]
        ok[p] = (100 + percent) * np.minimum(point[a[p]], point[b[p]]).sum(axis=1) >= percent * (size[a[p]] + size[b[p]])
    return ok


def _meet(percent: int):
    """Of the documents of each bucket, the pairs that may link, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        ids, first, place = np.unique(table.column("doc_id").to_numpy(), return_index=True, return_inverse=True)
        fine = Bitmaps(table.column("bits").take(pa.array(first)))
        size, point = np.zeros(len(ids), np.int64), np.zeros((len(ids), DIMENSIONS), np.int64)
        size[place], point[place] = table.column("n").to_numpy(), unpacked_points(table.column("point"))
        buckets = table.column("buckets").combine_chunks()
        bucket, place = buckets.flatten().to_numpy(), np.repeat(place, buckets.value_lengths().to_numpy())
        by = np.lexsort((place, bucket))
        bucket, place = bucket[by], place[by]
        head = np.flatnonzero(np.append([True], bucket[1:] != bucket[:-1]))
        count = np.diff(np.append(head, len(bucket)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(count[count > 1]).tolist():
            starts = head[count == m]
            if m <= NODE:
                i, j = np.triu_indices(m, 1)
                for k in range(0, len(starts), 1 + (1 << 18) // len(i)):
                    rows = place[starts[k : k + 1 + (1 << 18) // len(i), None] + np.arange(m)]
                    pairs = np.unique(rows[:, i].ravel() * len(ids) + rows[:, j].ravel())
                    u, v = pairs // len(ids), pairs % len(ids)
                    ok = may_link(point, size, u, v, percent)
                    u, v = u[ok], v[ok]
                    ok = fine.may_link(size, u, v, percent)
                    a.append(u[ok])
                    b.append(v[ok])
                continue
            for s in starts.tolist():
                rows = place[s : s + m]
                rows = rows[np.lexsort((*point[rows, :4].T, size[rows]))]
                tree = Tree(point[rows], size[rows], np.zeros(m, np.int64))
                label = np.arange(m)
                for x, y in zip(*joined_boxes(tree, tree, percent)):
                    i, j = np.arange(x * NODE, min(m, (x + 1) * NODE)), np.arange(y * NODE, min(m, (y + 1) * NODE))
                    if (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
                        continue  # all connected already
                    i, j = np.repeat(i, len(j)), np.tile(j, len(i))
                    ok = may_link(point, size, rows[i], rows[j], percent) & (i < j)
                    i, j = i[ok], j[ok]
                    ok = fine.may_link(size, rows[i], rows[j], percent)
                    i, j = i[ok], j[ok]
                    if len(i):
                        old = np.unique(label[np.concatenate([i, j])])
                        new = old[unite(np.searchsorted(old, label[i]), np.searchsorted(old, label[j]), len(old))]
                        at = np.minimum(np.searchsorted(old, label), len(old) - 1)
                        label = np.where(old[at] == label, new[at], label)
                a.append(rows)
                b.append(rows[label])
        label = unite(np.concatenate(a), np.concatenate(b), len(ids))
        off = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[off], pa.int64()), "v": pa.array(ids[label[off]], pa.int64())})

    return run


def _leaves(leaf_bytes: int):
    """Numbers leaves along the order of a partition; a leaf ends when it holds ``leaf_bytes`` of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        leaf, load = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for n in batch.column(batch.schema.get_field_index("n")).to_pylist():
                size = max(8 * n, 8192)
                if load and load + size > leaf_bytes:
                    leaf, load = leaf + 1, 0
                load += size
                out.append(leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "leaf"])

    return run


class Tree:
    """An R-tree packed from points in their given order: boxes of NODE points, then boxes of boxes up to one root.

    A box keeps its upper corner, its range of sizes and its range of clusters.
    """

    def __init__(self, point: np.ndarray, size: np.ndarray, cluster: np.ndarray) -> None:
        self.n = len(size)
        self.levels = []
        corner, low, high, first, last = point, size, size, cluster, cluster
        while len(low) > 1 or not self.levels:
            cut = np.arange(0, len(low), NODE)
            corner, low, high = np.maximum.reduceat(corner, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            self.levels.append((corner, low, high, first, last))


def joined_boxes(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lowest boxes that may hold a link; for a tree with itself each pair once."""
    level = max(len(a.levels), len(b.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        ca, cb = a.levels[la], b.levels[lb]
        if a is b:
            keep = i <= j
            i, j = i[keep], j[keep]
        keep = (ca[3][i] <= cb[4][j]) & (cb[3][j] <= ca[4][i]) & (100 * ca[2][i] >= percent * cb[1][j]) & (100 * cb[2][j] >= percent * ca[1][i])
        i, j = i[keep], j[keep]
        for s in range(0, len(i), STEP):
            p = slice(s, s + STEP)
            bound = np.minimum(ca[0][i[p]], cb[0][j[p]]).sum(axis=1)
            keep[: len(i)][p] = (100 + percent) * bound >= percent * (ca[1][i[p]] + cb[1][j[p]])
        keep = keep[: len(i)]
        i, j = i[keep], j[keep]
        if level == 0:
            return i, j
        level -= 1
        down = lambda tree, k: (np.minimum(k[:, None] * NODE + np.arange(NODE), len(tree.levels[level][1])), True) if level < len(tree.levels) - 1 else (k[:, None], False)
        (di, _), (dj, _) = down(a, i), down(b, j)
        ii, jj = np.broadcast_arrays(di[:, :, None], dj[:, None, :])
        ii, jj = ii.ravel(), jj.ravel()
        real = (ii < len(a.levels[min(level, len(a.levels) - 1)][1])) & (jj < len(b.levels[min(level, len(b.levels) - 1)][1]))
        i, j = ii[real], jj[real]


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(keys: np.ndarray, offs: np.ndarray, cluster: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links among the sets of side 0, or between sides 0 and 1."""
    sizes, point = np.diff(offs), points(keys, offs)
    _, ident, often = np.unique(keys, return_inverse=True, return_counts=True)
    shared = often[ident] > 1  # an element of one set only is in no intersection
    forest, out = Forest(len(sizes)), []
    sides = [np.flatnonzero(side == s) for s in (0, 1)]
    order = [s[np.lexsort((*point[s].T, sizes[s], cluster[s]))] for s in sides]
    trees = [Tree(point[o], sizes[o], cluster[o]) if len(o) else None for o in order]
    two = len(sides[1]) > 0
    if trees[0] is None or (two and trees[1] is None):
        return out
    i, j = joined_boxes(trees[0], trees[1] if two else trees[0], percent)
    place = np.full(len(often), -1, dtype=np.int64)
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]

    def elements(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[rows]
        at = np.repeat(offs[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(np.arange(len(rows)), n)
        keep = shared[at]
        return ident[at[keep]], row[keep]

    for box in np.unique(i).tolist():
        rows = order[0][box * NODE : (box + 1) * NODE]
        own, row = elements(rows)
        kinds = np.unique(own)
        if not len(kinds):
            continue
        place[kinds] = np.arange(len(kinds))
        left = np.zeros((len(rows), len(kinds)), dtype=np.float32)
        left[row, place[own]] = 1
        for other in j[i == box].tolist():
            partners = (order[1] if two else order[0])[other * NODE : (other + 1) * NODE]
            roots = {forest.root(k) for k in rows.tolist()} | {forest.root(k) for k in partners.tolist()}
            if len(roots) == 1:
                continue  # all connected already
            total = sizes[rows][:, None] + sizes[partners][None, :]
            bound = np.minimum(point[rows][:, None, :], point[partners][None, :, :]).sum(axis=2)
            may = ((100 + percent) * bound >= percent * total) & (cluster[rows][:, None] == cluster[partners][None, :])
            if not two and other == box:
                may &= np.arange(len(rows))[:, None] < np.arange(len(partners))[None, :]
            if not may.any():
                continue
            theirs, row = elements(partners)
            at = place[theirs]
            right = np.zeros((len(partners), len(kinds)), dtype=np.float32)
            right[row[at >= 0], at[at >= 0]] = 1
            overlap = np.rint(left @ right.T).astype(np.int64)
            for x, y in zip(*np.nonzero(may & ((100 + percent) * overlap >= percent * total))):
                if forest.join(int(rows[x]), int(partners[y])):
                    out.append((int(rows[x]), int(partners[y])))
        place[kinds] = -1
    return out


def _sets(width: int):
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, offs = T.buffers(batch.column(1))
        i = 0
        while i < len(offs) - 1:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + (2 << 20), "right")) - 1)
            keys, at = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
            data = pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.record_batch([batch.column(0)[i:j], batch.column(2)[i:j], batch.column(3)[i:j], data], names=["doc_id", "cluster", "tasks", "data"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from one(batch)
            X.release()

    return run


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        data = [d.as_py() for d in table.column("data")]
        sizes = np.array([len(d) // 8 for d in data])
        ids = table.column("doc_id").to_numpy()
        found = links(np.frombuffer(b"".join(data), np.uint64), np.concatenate([[0], np.cumsum(sizes)]), table.column("cluster").to_numpy(), table.column("side").to_numpy(), percent)
        return pa.table({"u": pa.array([ids[a] for a, _ in found], pa.int64()), "v": pa.array([ids[b] for _, b in found], pa.int64())})

    return run


def _with_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        point = pa.FixedSizeListArray.from_arrays(pa.array(unpacked_points(batch.column(4)).ravel(), pa.int32()), DIMENSIONS).cast(pa.list_(pa.int32()))
        yield pa.record_batch([*[batch.column(i) for i in range(4)], point], names=["doc_id", "cluster", "leaf", "n", "point"])


def _verified(texts: DataFrame, tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links as a forest (u, v) within the tasks (doc_id, cluster, side, task): the texts meet that list in one shuffle, whatever the sizes; a list
    small enough to be broadcast today isn't at the next size."""
    wanted = tasks.groupBy("doc_id", "cluster").agg(F.collect_set(F.struct("side", "task")).alias("tasks"))
    chosen = texts.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "cluster", "tasks")
    sets = chosen.mapInArrow(_sets(width), "doc_id bigint, cluster bigint, tasks array<struct<side:int,task:string>>, data binary")
    sent = sets.select("doc_id", "cluster", "data", F.explode("tasks").alias("t")).select("t.task", "t.side", "doc_id", "cluster", "data")
    return stored(sent.groupBy("task").applyInArrow(X.releasing(_verify(percent)), "u bigint, v bigint"), "jaccard-links")


def _crossing(split: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The tasks of pairs of leaves of one cluster: (doc_id, cluster, side, task).

    ``split``: documents of clusters of several leaves. In a leaf the largest component is one box, the rest are boxes of NODE documents, or one where
    they are many. Two boxes of different leaves meet unless they are of one component or the corner bound excludes a link.
    """
    rows = split.mapInArrow(_with_points, "doc_id bigint, cluster bigint, leaf bigint, n bigint, point array<int>")
    found = components(links).select(F.col("node").alias("doc_id"), "component")
    rows = rows.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = rows.groupBy("cluster", "leaf", "component").count()
    top = sizes.groupBy("cluster", "leaf").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("all"))
    top = top.select("cluster", "leaf", F.col("m.component").alias("top"), (F.col("all") - F.col("m.count")).alias("others"))
    rows = rows.join(top, ["cluster", "leaf"]).withColumn("main", F.col("component") == F.col("top"))
    # only a few others of a leaf are numbered; the largest component, or many others, need no order
    small = ~F.col("main") & (F.col("others") <= NODE * NODE)
    nth = F.row_number().over(Window.partitionBy("cluster", "leaf").orderBy("n", *[F.col("point")[k] for k in range(4)], "doc_id"))
    numbered = rows.where(small).withColumn("box", F.floor((nth - 1) / NODE).cast("int"))
    rows = numbered.unionByName(rows.where(~small).withColumn("box", F.when(F.col("main"), -1).otherwise(0)))
    rows = stored(rows.select("doc_id", "cluster", "leaf", "box", "component", "n", "point"), "jaccard-boxes")
    corner = F.array(*[F.max(F.col("point")[k]) for k in range(DIMENSIONS)])
    boxes = rows.groupBy("cluster", "leaf", "box").agg(corner.alias("corner"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("component"))
    a, b = boxes.alias("a"), boxes.alias("b")
    bound = F.expr("aggregate(zip_with(a.corner, b.corner, (x, y) -> least(x, y)), 0, (s, x) -> s + x)")
    pairs = a.join(b, F.expr(f"a.cluster = b.cluster and a.leaf < b.leaf and 100 * a.high >= {percent} * b.low and 100 * b.high >= {percent} * a.low"))
    pairs = pairs.where("not (a.box = -1 and b.box = -1 and a.component = b.component)").where((100 + percent) * bound >= percent * (F.col("a.low") + F.col("b.low")))
    ends = []
    for side, own, other in ((0, "a", "b"), (1, "b", "a")):
        task = F.concat_ws("-", "a.leaf", "a.box", "b.leaf", "b.box", "a.cluster")
        ends.append(pairs.select(F.col("a.cluster").alias("cluster"), F.col(f"{own}.leaf").alias("leaf"), F.col(f"{own}.box").alias("box"), F.col(f"{other}.corner").alias("corner"), F.col(f"{other}.low").alias("low"), F.col(f"{other}.high").alias("high"), F.lit(side).alias("side"), task.alias("task")))
    # a document goes to those pairs whose other box admits a link with its own point
    reach = F.expr("aggregate(zip_with(point, corner, (x, y) -> least(x, y)), 0, (s, x) -> s + x)")
    sent = rows.join(ends[0].unionByName(ends[1]), ["cluster", "leaf", "box"]).where((100 + percent) * reach >= percent * (F.col("n") + F.col("low")))
    return sent.where((100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))).select("doc_id", "cluster", "side", "task")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; links need a Jaccard similarity of percent / 100 of word shingles."""
    shards, _, size = X.block_count(docs, block_bytes, text_col)
    bits = min(64, int(max(size, 1 << 16)).bit_length() + 8)  # of signatures; two that agree by chance only meet in vain
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    read = stored(texts.mapInArrow(_read(width, percent, shards, bits, HOT), READ_SQL).groupBy("dst").applyInArrow(X.releasing(_buckets(WIDE)), READ_SQL), "jaccard")
    info = read.where(F.col("kind") == DOCUMENT).select("doc_id", "n", "k1", "k2", "point", "bits")
    classes = info.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = info.join(classes, ["k1", "k2"]).where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "n", "point", "bits")
    often = read.where(F.col("kind") == MEMBER).groupBy("doc_id").agg(F.count(F.lit(1)).alias("often"))
    met = often.join(reps.select("doc_id", F.length("bits").alias("bits")), "doc_id").agg(F.sum(F.expr("often * (128 + bits)"))).first()[0] or 0
    parts = max(8, -(-int(met) // MEET_BYTES))
    # a bucket's documents by their points; equal sets meet as classes, so only the representatives' count. A task gets a document once, with its buckets there
    member = read.where(F.col("kind") == MEMBER).select("doc_id", F.col("k1").alias("bucket"), F.expr(f"cast(pmod(k1, {parts}) as int)").alias("part"))
    placed = member.repartition("doc_id").groupBy("doc_id", "part").agg(F.collect_set("bucket").alias("buckets")).join(reps, "doc_id")
    near = placed.groupBy("part").applyInArrow(X.releasing(_meet(percent)), "u bigint, v bigint")
    hot = read.where(F.col("kind") == EDGE).select(F.col("doc_id").alias("u"), F.col("n").alias("v"))
    clusters = components(near.unionByName(hot))

    members = reps.drop("bits").join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    load = members.agg(F.sum(F.greatest(F.col("n") * 8, F.lit(8192)))).first()[0] or 0
    parts = max(1, -(-int(load) // LEAF_BYTES))
    order = ["cluster", "n", "point", "doc_id"]
    # leaves follow the load, however many partitions the session deals: each cut through a cluster costs pairs
    sorted_members = members.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order)
    leaves = stored(sorted_members.mapInArrow(_leaves(LEAF_BYTES), "doc_id bigint, n bigint, point binary, cluster bigint, leaf bigint"), "jaccard-leaves")
    task = F.col("leaf").cast("string").alias("task")
    tasks = leaves.select("doc_id", "cluster", F.lit(0).alias("side"), task)
    cut = leaves.groupBy("cluster", "leaf").agg(F.min("doc_id").alias("hub"))
    cut = stored(cut.join(cut.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "cluster"), "jaccard-cut")
    several = cut.limit(1).count() > 0
    if several:
        # a document of each of HUBS leaves goes to all leaves of its cluster: what is alike is mostly connected then
        nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("leaf"), "leaf"))
        hubs = cut.withColumn("nth", nth).where(F.col("nth") <= HUBS).select("cluster", F.col("hub").alias("doc_id"))
        tasks = tasks.unionByName(hubs.join(cut.select("cluster", task), "cluster").select("doc_id", "cluster", F.lit(0).alias("side"), "task"))
    links = _verified(texts, tasks, width, percent)
    if several:
        split = leaves.join(cut.select("cluster").distinct(), "cluster", "left_semi").select("doc_id", "cluster", "leaf", "n", "point")
        links = links.unionByName(_verified(texts, _crossing(split, links, percent), width, percent))
    found = components(links).select(F.col("node").alias("rep"), "component")
    of_class = classes.join(found, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = info.join(of_class, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
