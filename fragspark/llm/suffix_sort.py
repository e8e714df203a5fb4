"""Deep-shallow suffix sorting on numpy.

Shallow: multikey quicksort by words of eight bytes (big-endian, so that numbers
compare as strings), all groups of equal prefixes side by side, to a fixed depth.
Deep: groups whose members still agree there are ordered by blind tries. Each group
inserts its members against one of them: their common prefix with it is found once,
branches hang off its path at those lengths, in the order that the first differing
byte gives, and the members of one branch form a group of their own, known to agree past
the branching byte. Only branching bytes are compared again; all groups of a round
are worked on together.

A suffix is (start, length) in a buffer that is padded with eight zero bytes; it is
compared up to its own length, and of two suffixes of which one begins the other the
shorter comes first.
"""

from __future__ import annotations

import numpy as np

WIDTH = 8


def view(buf: np.ndarray) -> np.ndarray:
    """Big-endian words at every byte offset."""
    return np.ndarray(shape=(max(len(buf) - WIDTH + 1, 0),), dtype=">u8", buffer=buf.data, strides=(1,))


def words_at(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The word at ``depth`` of each suffix, with zeros past its length."""
    left = np.clip(lengths - depth, 0, WIDTH).astype(np.uint64)
    out = words[np.minimum(starts + depth, len(words) - 1)].astype(np.uint64)
    shift = (np.uint64(WIDTH) - left) * np.uint64(8)
    return np.where(left == 0, np.uint64(0), out >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)))


def common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers (8 for zero)."""
    out = np.full(len(x), WIDTH, dtype=np.int64)
    for k in range(WIDTH):
        out[(x >> np.uint64(56 - 8 * k) != 0) & (out == WIDTH)] = k
    return out


def lcp(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray | int = 0) -> np.ndarray:
    """Common prefix lengths of the pairs (a[i], b[i]), which are known to agree on ``depth`` bytes."""
    out = np.zeros(len(a), dtype=np.int64) + depth
    most = np.minimum(lengths[a], lengths[b])
    live = np.flatnonzero(out < most)
    while len(live):
        i, j, d = a[live], b[live], out[live]
        same = common_bytes(words[starts[i] + d].astype(np.uint64) ^ words[starts[j] + d].astype(np.uint64))
        out[live] = np.minimum(d + same, most[live])
        live = live[(same == WIDTH) & (out[live] < most[live])]
    return out


def sort(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each suffix with the one before it)."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = view(buf)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    live = np.arange(n)  # positions in the order that share their group with others
    for depth in range(0, shallow, WIDTH):
        if not len(live):
            break
        rows = order[live]
        key = words_at(words, starts[rows], lengths[rows], depth)
        by = np.lexsort((key, group[live]))
        order[live], key = rows[by], key[by]
        g = group[live]
        fresh = np.ones(len(live), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        live = live[~alone]
    tries(words, starts, lengths, order, group, live, shallow)
    out = np.zeros(n, dtype=np.int64)
    out[1:] = lcp(words, starts, lengths, order[:-1], order[1:])
    return order, out


def tries(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, group: np.ndarray, live: np.ndarray, shallow: int) -> None:
    """Orders, in place, the groups of suffixes that agree on the shallow depth."""
    known = np.full(len(live), 0, dtype=np.int64)
    if len(live):
        known = np.minimum(shallow, lengths[order[live]])
    while len(live):
        g = group[live]
        heads = np.ones(len(live), dtype=bool)
        heads[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(heads)
        size = np.diff(np.append(first, len(live)))
        number = np.cumsum(heads) - 1
        rows = order[live]
        trunk = rows[first + size // 2][number]
        depth = np.minimum(known, np.minimum(lengths[rows], lengths[trunk]))
        common = lcp(words, starts, lengths, rows, trunk, depth)
        mine = np.where(common < lengths[rows], words_at(words, starts[rows], lengths[rows], common) >> np.uint64(56), np.uint64(0)).astype(np.int64)
        its = np.where(common < lengths[trunk], words_at(words, starts[trunk], lengths[trunk], common) >> np.uint64(56), np.uint64(0)).astype(np.int64)
        mine = np.where(common < lengths[rows], mine, -1)
        its = np.where(common < lengths[trunk], its, -1)
        side = np.sign(mine - its)  # 0: the trunk itself, or equal to it
        rank = np.where(side < 0, common, np.where(side > 0, -common, 0))
        by = np.lexsort((mine, rank, side, g))
        order[live] = rows[by]
        g, side, common, mine = g[by], side[by], common[by], mine[by]
        fresh = np.ones(len(live), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (side[1:] != side[:-1]) | (common[1:] != common[:-1]) | (mine[1:] != mine[:-1])
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        done = (fresh & np.append(fresh[1:], True)) | (side == 0) | (mine < 0)
        live, known = live[~done], common[~done] + 1
