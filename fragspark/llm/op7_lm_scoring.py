"""LM scoring with Elias-Fano n-gram tries of three levels, trained and queried in rounds over blocks and shards.

Round one counts tokens: blocks send their distinct tokens with training counts, shards
add them up, number the tokens and answer. Round two counts bigrams and trigrams: blocks send their
distinct bigrams with training counts to the shard of the first token, and with each bigram the tokens that follow it. The
shard builds one trie (elias_fano.py) of tokens, bigrams and trigrams, with absolutely discounted
probabilities quantised to a byte, and answers out of the trie: a block's bigrams are found once, and their places
are the contexts in which the third tokens are searched. A frequent first token is split by the second over as many shards as
it has shares of the corpus, and a frequent bigram by the third token, the further parts in tries of their own. A shard
takes its bigrams in sorted ranges, a trie each, so its memory is that of a range and the messages. Blocks
then score their documents. No part of the model is held whole anywhere; what is
gathered grows with the corpus, and the trie's shards are bounded by the share of keys they own.

p(w | v) = (c(v, w) - D) / c(v) + D * T(v) / c(v) * p0(w), with T(v) the distinct successors
of v, and p0(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), the base; an unseen context gives p0.
p(w | u, v) = (c(u, v, w) - D) / c(u, v) + D * T(u, v) / c(u, v) * p(w | v), with p(w | v) for
a first token and for unseen contexts. ``score`` sums the logarithms of the latter, ``bigram_score`` of the former.

Null or empty text: the end token alone. A null id is in training. Rows that repeat count
as often as they occur. Other columns are ignored. There may be any number of distinct tokens: blocks and shards
number what they hold for themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fragspark.llm import exchange as X
from fragspark.llm import text as T
from fragspark.llm.elias_fano import DECODED, Trie, quantise
from fragspark.llm.op6_jaccard_join import LOWER

END = np.uint64(0x3C79AC492BA7B653)
START = np.uint64(0x1C69B3F74AC4AE35)
DISCOUNT = 0.75
#: Pairs and trigrams that a shard takes at a time, and pairs between those that may begin the next.
LOAD, EVERY = 1 << 19, 64
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bigram_score double"


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, as many bytes as the largest takes, like bytes together for the compression."""
    values = np.asarray(values).astype("<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """The numbers of ``_planes``, or those from place ``first`` up to ``end``."""
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)[:, first:end]
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64, copy=False)


def _with_length(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(parts)


def _parts(data: bytes, n: int) -> list[bytes]:
    edges = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int64, n))]) + 8 * n
    return [data[a:b] for a, b in zip(edges, edges[1:])]


class _Block:
    def __init__(self, table: pa.Table) -> None:
        self.table = X.ordered(table)
        buf, offs = T.buffers(self.table.column("text"))
        buf = LOWER[buf]
        starts, ends, firsts = T.split_words(buf, offs)
        self.ids = self.table.column("id").to_pylist()
        self.held = np.array([i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in self.ids], dtype=bool)
        tokens = np.insert(T.span_hashes(buf, starts, ends), firsts[1:], END)
        self.first = firsts + np.arange(len(firsts))
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.train = ~self.held[self.doc]
        self.keys, self.number = np.unique(tokens, return_inverse=True)
        self.counts = np.bincount(self.number, self.train, len(self.keys)).astype(np.int64)

    def learnt(self, answers: list[tuple[int, int, int, bytes]], shards: int) -> None:
        """Takes the answers of round one: totals, counts and numbers of this block's tokens."""
        n_docs, n, kinds, sizes, rows = 0, 0, 0, np.zeros(shards, np.int64), []
        for _, s, _, data in answers:
            head, *body = _parts(data, 3)
            head = np.frombuffer(head, np.int64)
            n, kinds, n_docs, sizes[s] = n + int(head[0]), kinds + int(head[1]), n_docs + int(head[2]), head[3]
            rows.append((s, body))
        bases = np.cumsum(sizes) - sizes
        cuts = X.shard_bounds(self.keys, 64, shards)
        k = len(self.keys)
        # one more number for the start of a document, a context as often as there are documents in training
        self.count, self.ident = np.zeros(k + 1, np.int64), np.zeros(k + 1, np.int64)
        for s, (counts, places) in rows:
            self.count[cuts[s] : cuts[s + 1]] = _values(counts)
            self.ident[cuts[s] : cuts[s + 1]] = bases[s] + _values(places)
        self.n, self.kinds, self.span = n, kinds, int(sizes.sum()) + 1
        self.count[k], self.ident[k] = n_docs, self.span - 1
        begin, wide = self.first[:-1], np.int64(k + 1)
        context = np.empty(len(self.number), np.int64)
        context[1:] = self.number[:-1]
        context[begin] = k
        pairs, self.pair = np.unique(context * wide + self.number, return_inverse=True)
        del context
        self.pair = self.pair.astype(np.int32)
        self.pair_counts = np.bincount(self.pair, self.train, len(pairs)).astype(np.int64)
        self.context_of, self.last = (pairs // wide).astype(np.int32), (pairs % wide).astype(np.int32)
        del pairs
        seen = self.count[self.context_of]
        ways = np.minimum(1 + seen * shards // max(n, 1), shards)
        home = T.mix(self.ident[self.context_of].astype(np.uint64), 11) % np.uint64(shards)
        way = T.mix(self.ident[self.last].astype(np.uint64), 12) % ways.astype(np.uint64)
        self.home = ((home + way) % np.uint64(shards)).astype(np.int32)
        where = np.flatnonzero(np.diff(self.context_of, prepend=-1))
        self.contexts, self.context = self.context_of[where], np.cumsum(np.diff(self.context_of, prepend=-1) != 0) - 1
        self.context_ways, self.context_home = ways[where], home[where].astype(np.int64)
        self.pair_ways = np.minimum(1 + np.minimum(seen, self.count[self.last]) * shards // max(n, 1), shards)
        del seen, ways, home, way, where
        # a trigram is a pair, its context, and the token after it
        later = np.ones(len(self.number), dtype=bool)
        later[begin] = False
        self.later = np.flatnonzero(later).astype(np.int32)
        del later
        trigrams, self.trigram = np.unique(self.pair[self.later - 1] * wide + self.number[self.later], return_inverse=True)
        self.trigram = self.trigram.astype(np.int32)
        self.trigram_counts = np.bincount(self.trigram, self.train[self.later], len(trigrams)).astype(np.int64)
        self.trigram_pair, self.third = (trigrams // wide).astype(np.int32), (trigrams % wide).astype(np.int32)
        del trigrams
        ways = self.pair_ways[self.trigram_pair]
        self.way = np.zeros(len(ways), np.int64)
        some = np.flatnonzero(ways > 1)
        self.way[some] = (T.mix(self.ident[self.third[some]].astype(np.uint64), 14) % ways[some].astype(np.uint64)).astype(np.int64)

    def dealt(self, shards: int):
        """For each shard that this block has keys for: the numbers of the contexts that it must tell about, of the pairs that it owns, and of their trigrams, all sorted."""
        by = np.argsort(self.home, kind="stable")
        cuts = np.searchsorted(self.home[by], np.arange(shards + 1))
        rows = np.repeat(np.arange(len(self.contexts)), self.context_ways)
        way = np.arange(len(rows)) - np.repeat(np.cumsum(self.context_ways) - self.context_ways, self.context_ways)
        home = (self.context_home[rows] + way) % shards
        order = np.lexsort((rows, home))
        edges = np.searchsorted(home[order], np.arange(shards + 1))
        near = np.flatnonzero(self.way == 0)
        at = self.home[self.trigram_pair[near]]
        near, at = near[np.argsort(at, kind="stable")], np.sort(at)
        tops = np.searchsorted(at, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            yield s, rows[order[edges[s] : edges[s + 1]]], by[cuts[s] : cuts[s + 1]], near[tops[s] : tops[s + 1]]

    def dealt_further(self, shards: int):
        """The same for the further parts of frequent pairs: the numbers of the pairs to tell about, of the trigrams, and the place of each one's pair."""
        pairs = np.flatnonzero(self.pair_ways > 1)
        pairs = pairs[np.isin(pairs, self.trigram_pair)]
        ways = self.pair_ways[pairs] - 1
        rows = np.repeat(pairs, ways)
        home = (self.home[rows] + 1 + np.arange(len(rows)) - np.repeat(np.cumsum(ways) - ways, ways)) % shards
        order = np.lexsort((rows, home))
        edges = np.searchsorted(home[order], np.arange(shards + 1))
        far = np.flatnonzero(self.way > 0)
        at = (self.home[self.trigram_pair[far]] + self.way[far]) % shards
        far, at = far[np.argsort(at, kind="stable")], np.sort(at)
        tops = np.searchsorted(at, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            told, own = rows[order[edges[s] : edges[s + 1]]], far[tops[s] : tops[s + 1]]
            yield s, told, own, np.searchsorted(told, self.trigram_pair[own])


def _count(shards: int):
    def run(table: pa.Table) -> pa.Table:
        block, src = _Block(table), table.column("block")[0].as_py()
        cuts = X.shard_bounds(block.keys, 64, shards)
        docs = np.int64((~block.held).sum())
        out = []
        for s in range(shards):
            p = slice(cuts[s], cuts[s + 1])
            # the training documents are told to one shard; every shard tells its totals to every block
            out.append((s, src, 0, _with_length([(docs if s == src % shards else np.int64(0)).tobytes(), T.pack_sorted(block.keys[p]), _planes(block.counts[p])])))
        return X.messages(out)

    return run


def _total(shards: int):
    def run(table: pa.Table) -> pa.Table:
        sent = list(X.read(table))
        rows = []
        docs = 0
        for _, src, _, data in sent:
            head, packed, planes = _parts(data, 3)
            docs += int(np.frombuffer(head, np.int64)[0])
            rows.append((src, T.unpack_sorted(packed), _values(planes)))
        keys, number = np.unique(np.concatenate([k for _, k, _ in rows]), return_inverse=True)
        counts = np.bincount(number, np.concatenate([c for _, _, c in rows]), len(keys)).astype(np.int64)
        head = np.array([counts.sum(), (counts > 0).sum(), docs, len(keys)], dtype=np.int64).tobytes()
        out = []
        for src, own, _ in rows:
            at = np.searchsorted(keys, own)
            out.append((src, sent[0][0], 0, _with_length([head, _planes(counts[at]), _planes(at)])))
        return X.messages(out)

    return run


def _pairs(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.NO_MESSAGES
        block, src = _Block(table), table.column("block")[0].as_py()
        told = list(X.read(answers))
        block.learnt(told, shards)
        del block.pair, block.trigram, block.number, block.later, block.doc  # only scoring needs them
        # what round one said goes on to the last pass by way of a shard
        out = [(src % shards, src, 9, _with_length([np.int64(s).tobytes(), data])) for _, s, _, data in told]
        for s, contexts, pairs, own in block.dealt(shards):
            kinds = block.contexts[contexts]
            body = [
                T.pack_sorted(block.ident[kinds].astype(np.uint64)), _planes(block.count[kinds]), _planes(np.bincount(np.searchsorted(contexts, block.context[pairs]), minlength=len(kinds))),
                _planes(block.ident[block.last[pairs]]), _planes(block.pair_counts[pairs]), _planes(np.bincount(np.searchsorted(pairs, block.trigram_pair[own]), minlength=len(pairs))),
                _planes(block.ident[block.third[own]]), _planes(block.trigram_counts[own]), _planes(np.flatnonzero(block.pair_ways[pairs] > 1)),
            ]
            out.append((s, src, 1, _with_length([np.int64(block.span).tobytes(), *body])))
        for s, pairs, own, place in block.dealt_further(shards):
            body = [_planes(block.ident[block.context_of[pairs]]), _planes(block.ident[block.last[pairs]]), _planes(np.bincount(place, minlength=len(pairs))), _planes(block.ident[block.third[own]]), _planes(block.trigram_counts[own])]
            out.append((s, src, 2, _with_length([np.int64(block.span).tobytes(), *body])))
        return X.messages(out)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Builds the shard's tries and answers from them."""
    kinds = table.column("kind")
    sent = {k: list(X.read(table.filter(pa.compute.equal(kinds, k)))) for k in (9, 1, 2)}
    out = [(src, dst, kind, data) for dst, src, kind, data in sent.pop(9)]
    return X.messages(out + _near_answers(sent.pop(1)) + _far_answers(sent.pop(2)))


def _numbered(groups: list[list[np.ndarray]], span: int, contexts: int) -> tuple[list[list[np.ndarray]], int]:
    """Arrays of token numbers below ``span``; where contexts times tokens would pass 63 bits, numbered anew among themselves."""
    if contexts * span < 1 << 63:
        return groups, span
    names = np.unique(np.concatenate([a for g in groups for a in g]))
    return [[np.searchsorted(names, a) for a in g] for g in groups], len(names)


def _summed(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys with a positive sum of counts, and the sums."""
    key, counts = key[counts > 0], counts[counts > 0]
    keys, number = np.unique(key, return_inverse=True)
    return keys, np.bincount(number, counts, len(keys)).astype(np.int64)


class _Asked:
    """A block's message about pairs and trigrams: all are sorted, and numbers by pair and by trigram stay packed until a step takes them."""

    def __init__(self, data: bytes) -> None:
        head, packed, seen, pairs, self.lasts, self.counts, self.follow, self.thirds, self.trigrams, split = _parts(data, 10)
        self.span = int(np.frombuffer(head, np.int64)[0])
        self.contexts, self.seen, self.split = T.unpack_sorted(packed), _values(seen), _values(split)
        self.tops = np.concatenate([[0], np.cumsum(_values(pairs))])
        self.size = int(self.tops[-1])

    def steps(self, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every so many pairs, the pair's context and last token, and what these pairs and their trigrams are."""
        at = np.arange(0, self.size, every)
        load = np.add.reduceat(_values(self.follow) + 1, at) if self.size else at
        return self.contexts[np.searchsorted(self.tops, at, "right") - 1], _values(self.lasts)[at], load

    def cut(self, bounds: list[tuple[int, int]]) -> None:
        """Sets the places where pairs, and their trigrams, from each (context, last token) on begin."""
        lasts, cuts = _values(self.lasts), [0]
        for context, last in bounds:
            i = int(np.searchsorted(self.contexts, np.uint64(context)))
            low = high = int(self.tops[i])
            if i < len(self.contexts) and int(self.contexts[i]) == context:
                high = int(self.tops[i + 1])
            cuts.append(low + int(np.searchsorted(lasts[low:high], last)))
        self.cuts = np.array([*cuts, self.size], dtype=np.int64)
        self.under = np.concatenate([[0], np.cumsum(_values(self.follow))])[self.cuts]
        self.found: list[list[np.ndarray]] = [[], [], [], [], []]


def _bounds(asked: list[_Asked]) -> list[tuple[int, int]]:
    """Pairs (context, last token) that part all messages' pairs and trigrams into loads of about LOAD."""
    context, last, load = (np.concatenate(x) for x in zip(*(a.steps(EVERY) for a in asked)))
    order = np.lexsort((last, context))
    step = np.cumsum(load[order]) // LOAD
    at = order[np.flatnonzero(np.diff(step, prepend=0))]
    return sorted(set(zip(context[at].tolist(), last[at].tolist())))


def _near_answers(sent: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """Codes of pairs and trigrams, fan-outs of contexts, back-off codes of pairs; of frequent pairs the fan-out and size of this part.

    A range of pairs after another, each with a trie of its own, so that memory is bounded by a range and not by the shard.
    """
    if not sent:
        return []
    asked = [_Asked(data) for *_, data in sent]
    contexts, at = np.unique(np.concatenate([a.contexts for a in asked]), return_index=True)
    seen = np.concatenate([a.seen for a in asked])[at]
    bounds = _bounds(asked)
    for a in asked:
        a.cut(bounds)
    fans = np.zeros(len(contexts), np.int64)
    for k in range(len(bounds) + 1):
        _near_range(asked, k, contexts, seen, fans)
    out = []
    for (dst, src, *_), a in zip(sent, asked):
        second, third, back, split_fans, split_sizes = (np.concatenate(f) for f in a.found)
        body = [second.tobytes(), _planes(fans[np.searchsorted(contexts, a.contexts)]), third.tobytes(), back.tobytes(), _planes(split_fans), _planes(split_sizes)]
        out.append((src, dst, 1, _with_length(body)))
    return out


def _near_range(asked: list[_Asked], k: int, contexts: np.ndarray, seen: np.ndarray, fans: np.ndarray) -> None:
    """Answers about the pairs of range ``k``, added to what each message has ``found``; their number is added to the contexts' ``fans``."""
    every = lambda parts: np.concatenate(list(parts))
    edges = np.concatenate([[0], np.cumsum([a.cuts[k + 1] - a.cuts[k] for a in asked])])
    tops = np.concatenate([[0], np.cumsum([a.under[k + 1] - a.under[k] for a in asked])])
    firsts = every(np.repeat(np.searchsorted(contexts, a.contexts), np.diff(np.clip(a.tops, a.cuts[k], a.cuts[k + 1]))) for a in asked)
    low, high = (int(firsts.min()), int(firsts.max()) + 1) if len(firsts) else (0, 0)
    firsts -= low
    part = lambda name, cuts: every(_values(getattr(a, name), cuts(a)[k], cuts(a)[k + 1]) for a in asked)
    by_pair, by_trigram = (lambda a: a.cuts), (lambda a: a.under)
    lasts, thirds, follow = part("lasts", by_pair), part("thirds", by_trigram), part("follow", by_pair)
    most = max(high - low, len(firsts)) + 1
    [[lasts], [thirds]], span = _numbered([[lasts], [thirds]], asked[0].span, most)
    pairs, counts = _summed(firsts * span + lasts, part("counts", by_pair))
    context = pairs // span
    second = (context, pairs % span, quantise((counts - DISCOUNT) / np.maximum(seen[low:high][context], 1)))
    # a trigram of training has its pair in training
    place = np.minimum(np.searchsorted(pairs, firsts * span + lasts), max(0, len(pairs) - 1))
    n = len(pairs)
    del pairs, counts
    found, counts = _summed(np.repeat(place, follow) * span + thirds, part("trigrams", by_trigram))
    del place
    context = found // span
    sizes = np.append(np.bincount(context, counts, n).astype(np.int64), 0)  # the last one for pairs out of training
    levels = Trie.levels(contexts[low:high], second, (context, found % span, quantise((counts - DISCOUNT) / sizes[context])))
    del second, found, counts, context
    trie = Trie.mapped(levels)
    del levels
    # all messages are answered at once: the trie is decoded a level at a time, however many blocks ask
    fans[low:high] += trie.fan_out(0, np.arange(high - low))
    pair = trie.child(0, firsts, lasts)
    del firsts, lasts
    used = pair[follow > 0]
    third = trie.code(1, trie.child(1, used, thirds, follow[follow > 0]))
    del thirds
    back = quantise(DISCOUNT * trie.fan_out(1, used) / np.maximum(sizes[used], 1))
    second = trie.code(0, pair)
    uses = np.concatenate([[0], np.cumsum(follow > 0)])[edges]
    for i, a in enumerate(asked):
        split = pair[edges[i] + a.split[slice(*np.searchsorted(a.split, a.cuts[k : k + 2]))] - a.cuts[k]]
        own = second[edges[i] : edges[i + 1]], third[tops[i] : tops[i + 1]], back[uses[i] : uses[i + 1]], trie.fan_out(1, split), sizes[split]
        for parts, x in zip(a.found, own):
            parts.append(x.copy())


def _far_answers(sent: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """Codes of trigrams of frequent pairs, and fan-outs and sizes of the shard's parts of the pairs."""
    if not sent:
        return []
    rows, span = [], 1
    for *_, data in sent:
        head, *planes = _parts(data, 6)
        span = int(np.frombuffer(head, np.int64)[0])
        rows.append([_values(p) for p in planes])
    contexts = np.unique(np.concatenate([r[0] for r in rows]))
    (lasts, thirds), span = _numbered([[r[1] for r in rows], [r[3] for r in rows]], span, sum(len(r[0]) for r in rows) + 1)
    firsts = [np.searchsorted(contexts, r[0]) for r in rows]
    pairs = np.unique(np.concatenate([f * span + last for f, last in zip(firsts, lasts)]))
    places = [np.searchsorted(pairs, f * span + last) for f, last in zip(firsts, lasts)]
    found, counts = _summed(np.concatenate([np.repeat(p, r[2]) * span + w for p, r, w in zip(places, rows, thirds)]), np.concatenate([r[4] for r in rows]))
    context = found // span
    sizes = np.bincount(context, counts, len(pairs)).astype(np.int64)
    none = np.zeros(len(pairs), np.uint8)
    trie = Trie.mapped(Trie.levels(contexts.astype(np.uint64), (pairs // span, pairs % span, none), (context, found % span, quantise((counts - DISCOUNT) / sizes[context]))))
    out = []
    for (dst, src, *_), r, last, third in zip(sent, rows, lasts, thirds):
        pair = trie.child(0, trie.tokens.find(r[0].astype(np.uint64)), last)
        code = trie.code(1, trie.child(1, pair, third, r[2]))
        out.append((src, dst, 2, _with_length([code.tobytes(), _planes(trie.fan_out(1, pair)), _planes(sizes[pair])])))
    return out


def _score(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return pa.schema(list(zip(names, types))).empty_table()
        block, told = _Block(table), list(X.read(answers))
        first = [_parts(data, 2) for *_, kind, data in told if kind == 9]
        block.learnt([(0, int(np.frombuffer(s, np.int64)[0]), 0, data) for s, data in first], shards)
        codes, fan = np.zeros(len(block.last), np.uint8), np.zeros(len(block.contexts), np.int64)
        share, back = np.zeros(len(block.third)), np.ones(len(block.last))
        split = block.pair_ways > 1
        fans, sizes = np.zeros(len(block.last), np.int64), np.zeros(len(block.last), np.int64)
        found = {s: data for _, s, kind, data in told if kind == 1}
        for s, contexts, pairs, own in block.dealt(shards):
            own_codes, own_fans, third, lower, split_fans, split_sizes = _parts(found[s], 6)
            codes[pairs] = np.frombuffer(own_codes, np.uint8)
            fan[contexts] += _values(own_fans)
            share[own] = DECODED[np.frombuffer(third, np.uint8)]
            used = np.unique(block.trigram_pair[own])
            lower = np.frombuffer(lower, np.uint8)
            back[used] = np.where(lower > 0, DECODED[lower], 1.0)
            fans[pairs[split[pairs]]], sizes[pairs[split[pairs]]] = _values(split_fans), _values(split_sizes)
        part = sizes[block.trigram_pair]
        found = {s: data for _, s, kind, data in told if kind == 2}
        for s, pairs, own, place in block.dealt_further(shards):
            third, own_fans, own_sizes = _parts(found[s], 3)
            own_sizes = _values(own_sizes)
            share[own], part[own] = DECODED[np.frombuffer(third, np.uint8)], own_sizes[place]
            fans[pairs] += _values(own_fans)
            sizes[pairs] += own_sizes
        # of frequent pairs, each part's shares are of its own size
        parted = split[block.trigram_pair]
        share[parted] *= part[parted] / np.maximum(sizes[block.trigram_pair[parted]], 1)
        whole = split & (sizes > 0)
        back[whole] = DECODED[quantise(DISCOUNT * fans[whole] / sizes[whole])]
        back[split & (sizes == 0)] = 1.0
        base = (block.count[:-1] + 0.1) / (block.n + 0.1 * (block.kinds + 1))
        p0 = base[block.number]
        # the back-off weight is quantised like the probabilities
        seen = block.count[block.contexts]
        lower = np.where(seen > 0, DECODED[quantise(DISCOUNT * fan / np.maximum(seen, 1))], 1.0)
        after = np.minimum(DECODED[codes][block.pair] + lower[block.context[block.pair]] * p0, 1.0)
        third = after.copy()
        third[block.later] = np.minimum(share[block.trigram] + back[block.pair[block.later - 1]] * after[block.later], 1.0)
        n = len(block.ids)
        known = np.bincount(block.doc, block.count[block.number] > 0, n).astype(np.int64)
        columns = [
            block.table.column("id"), block.held, np.diff(block.first), known, np.full(n, block.n),
            np.bincount(block.doc, np.log10(p0), n), np.bincount(block.doc, np.log10(third), n), np.bincount(block.doc, np.log10(after), n),
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bigram_score) for every row."""
    count, _, _ = X.block_count(docs, block_bytes, text_col)
    shards = X.shard_count(count, 2)
    blocks = X.to_blocks(docs, count, id_col, text_col)
    counted = X.by_block(blocks, _count(shards), X.MESSAGE_SQL)
    totals = X.by_shard(counted, _total(shards))
    pairs = X.with_answers(blocks, totals, _pairs(shards), X.MESSAGE_SQL)
    answers = X.by_shard(pairs, _answer)
    return X.with_answers(blocks, answers, _score(shards), SCHEMA)
