"""A byte-level BPE vocabulary compiled to deterministic finite-state transducers.

Two machines make up the tokenizer. ``WordMachine`` splits text into the
pre-tokens of the vocabulary's pattern (contractions, words and numbers and
symbols with one space before, runs of white space): 13 states over 12 classes
of characters, whose transitions are annotated with the pre-tokens that begin
at this or the previous character. It runs over fixed chunks: the map of states
of each chunk (end state for every start state) is found for all chunks side by
side, the maps compose associatively in a parallel prefix scan, and then every
chunk runs once more from its now known state.

``CountMachine`` reads the bytes of one pre-token. A transition is annotated
with the net number of tokens that it emits (negative where a byte lets earlier
tokens merge), so a pre-token's count is the sum along its path. The
last token after a prefix is the one suffix token that is stable beside the last
token of the rest, which takes merge ranks along two spines to decide. So all that the future
may ask of a prefix is, for every suffix of it that begins some token, the last token before that suffix and
how many tokens came since: a state is that list. Lists are bounded by the longest token, so there are finitely many states;
they are numbered as they are met, and prefixes with the same list share one. A long pre-token is read in chunks: every chunk has a partial map from start
states to end state and count, begun from the state that the bytes just before it lead to, as the machine soon forgets
what came earlier; the maps are composed by a prefix scan, and where a composed state is missing in the next chunk's map, that chunk is run from it.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from fragspark.llm import text as T

SPECIAL = b"<|endoftext|>"
LETTER, ENDING, R, V, ELL, E, NUMBER, OTHER, QUOTE, BLANK, WHITE, END = range(12)
CLASSES = 12
Z, SL, SN, SO, SA, SP, SQ, SR, ST, SC, CR, CV, CL = range(13)
STATES = 13
CHUNK = 256
SETTLE = 12
#: Code points with the property White_Space.
WHITE_POINTS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First bytes of those beyond ASCII.
WHITE_HEADS = sorted({chr(p).encode()[0] for p in WHITE_POINTS if p > 127})


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
    out[WHITE_POINTS] = WHITE
    for char, kind in {"s": ENDING, "t": ENDING, "m": ENDING, "d": ENDING, "r": R, "v": V, "l": ELL, "e": E, "'": QUOTE, " ": BLANK}.items():
        out[ord(char)] = kind
    return out


@lru_cache(maxsize=1)
def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) by state * CLASSES + class; mark 1: a pre-token begins here, 2: at the character before."""
    run = {**dict.fromkeys((LETTER, ENDING, R, V, ELL, E), SL), NUMBER: SN, OTHER: SO, QUOTE: SO}
    fresh = run | {QUOTE: SA, BLANK: SP, WHITE: SQ, END: Z}

    def step(state: int, kind: int) -> tuple[int, int]:
        begin = (fresh[kind], 0 if kind == END else 1)
        if state in (SL, SN, SO):
            return (state, 0) if run.get(kind) == state else begin
        if state == SA:
            if kind in (ENDING, R, V, ELL):
                return {ENDING: SC, R: CR, V: CV, ELL: CL}[kind], 0
            return (SO, 0) if kind in (OTHER, QUOTE) else begin
        if state in (CR, CV, CL):
            if kind == (ELL if state == CL else E):
                return SC, 0
            after, mark = step(SL, kind)
            return after, mark | 2
        if state in (SP, SQ, SR, ST) and kind in (BLANK, WHITE):
            return (SR if kind == BLANK else ST), 0
        if state in (SR, ST) and kind != END:
            after, mark = step(SP if state == SR else SQ, kind)
            return after, mark | 2
        if state == SP and kind != END:
            return run[kind], 0
        return begin

    pairs = [step(s, k) for s in range(STATES) for k in range(CLASSES)]
    return np.array([a for a, _ in pairs], np.uint8), np.array([m for _, m in pairs], np.uint8)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, by doubling: row k becomes maps[k] o ... o maps[0]."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d].astype(np.intp), axis=1)
        d *= 2
    return out


def run_machine(symbols: np.ndarray) -> np.ndarray:
    """The mark of every symbol, from state Z on, by chunk maps and a prefix scan."""
    after, marks = word_machine()
    n = len(symbols)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, END, dtype=np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for k in range(SETTLE):
        maps = after[maps * np.uint8(CLASSES) + grid[k]]
    # most chunks forget their start state soon: one column is enough from there on
    open_rows = np.flatnonzero((maps != maps[0]).any(axis=0))
    one, rest = maps[0], maps[:, open_rows]
    for k in range(SETTLE, CHUNK):
        one = after[one * np.uint8(CLASSES) + grid[k]]
    if len(open_rows):
        left = grid[:, open_rows]
        for k in range(SETTLE, CHUNK):
            rest = after[rest * np.uint8(CLASSES) + left[k]]
    maps = np.repeat(one[None, :], STATES, axis=0)
    maps[:, open_rows] = rest
    ends = compose_scan(np.ascontiguousarray(maps.T))
    state = np.full(rows, Z, dtype=np.uint8)
    state[1:] = ends[:-1, Z]
    out = np.empty((CHUNK, rows), dtype=np.uint8)
    for k in range(CHUNK):
        at = state * np.uint8(CLASSES) + grid[k]
        out[k] = marks[at]
        state = after[at]
    return out.T.reshape(-1)[:n]


def segments(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, special): offsets of the parts of the buffer that are tokenised apart, and which of them are the special string."""
    data, found, at = buf.tobytes(), [], 0
    while (at := data.find(SPECIAL, at)) >= 0:
        doc = int(np.searchsorted(offs, at, "right"))
        if at + len(SPECIAL) <= offs[doc]:
            found.append(at)
            at += len(SPECIAL)
        else:
            at += 1
    special = np.array(found, dtype=np.int64)
    cuts = np.unique(np.concatenate([offs, special, special + len(SPECIAL)]))
    return cuts, np.isin(cuts[:-1], special)


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens, and which are the special string."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    cuts, special = segments(buf, offs)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    kinds = class_table()[points]
    first = np.searchsorted(at, cuts)
    for s in np.flatnonzero(special):
        kinds[first[s] : first[s + 1]] = END
    inner = first[1:-1]
    marks = run_machine(np.insert(kinds, inner, END))
    marks = np.append(marks, 0)
    begins = (marks[:-1] & 1) | ((marks[1:] & 2) >> 1)
    begins = np.delete(begins, inner + np.arange(len(inner))).astype(bool)
    begins[first[:-1][special]] = True
    starts = at[begins]
    ends = np.append(starts[1:], len(buf))
    bound = cuts[np.searchsorted(cuts, starts, "right")]
    return starts, np.minimum(ends, bound), np.isin(starts, cuts[:-1][special]) if special.any() else np.zeros(len(starts), bool)


class Vocabulary:
    """Tokens in merge order, as bytes; the two parts of each merged token; ranks of merges."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain}
        chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        code = lambda word: bytes(chars[c] for c in word)
        self.number = {code(w): i for w, i in model["vocab"].items() if all(c in chars for c in w)}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (code(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, whole = self.number[a], self.number[b], self.number[a + b]
            self.merge.setdefault((left, right), rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        self.longest = max(map(len, self.number))
        self.stable: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged into a larger one) along one side of ``token``, from a byte up."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until, token = self.rank[token], self.parts[token][side]

    def keeps(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two adjacent tokens leaves just these two tokens.

        Wherever a piece on the left's right edge and one on the right's left edge exist together, their own merge
        must come after whatever merges them away; of equal ranks the one further left goes first.
        """
        key = left << 20 | right
        known = self.stable.get(key)
        if known is None:
            a, b, i, j, known = self.spine(left, 1), self.spine(right, 0), 0, 0, True
            while True:
                rank = self.merge.get((a[i][0], b[j][0]))
                if rank is not None and rank < a[i][1] and rank <= b[j][1]:
                    known = False
                    break
                if i == len(a) - 1 and j == len(b) - 1:
                    break
                if a[i][1] <= b[j][1]:
                    i += 1
                else:
                    j += 1
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            self.stable[key] = known
        return known


class CountMachine:
    """Lazily determinised; ``limit`` bounds the transitions held, after which it starts again from none."""

    #: Bytes of a chunk, and bytes before it that guess its start state.
    CHUNK, WARM = 4096, 64
    #: A transition is kept as after << SHIFT | emitted + HALF.
    SHIFT, HALF = 20, 1 << 19

    def __init__(self, vocabulary: Vocabulary, limit: int = 1_000_000) -> None:
        self.vocabulary, self.limit = vocabulary, limit
        self.node: dict[int, int] = {}
        self.token, self.inner = array("i", [-1]), bytearray(1)
        for word, number in vocabulary.number.items():
            at = 0
            for byte in word:
                self.inner[at] = 1
                after = self.node.get(at << 8 | byte)
                if after is None:
                    after = self.node[at << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                at = after
            self.token[at] = number
        self.reset()

    def reset(self, *kept: tuple) -> None:
        """Forgets all transitions and all states but the first and ``kept``."""
        self.goto: dict[int, int] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        for state in (((0, -1, 0),), *kept):
            self.intern(state)

    def intern(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def read(self, word: bytes) -> int:
        """The sum of the counts along the word's path."""
        if len(self.goto) > self.limit:
            self.reset()
        return self.run(0, word)[1] if len(word) <= self.CHUNK else self.scan(word)

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """(end state, count)."""
        goto, total, shift, half = self.goto, 0, self.SHIFT, self.HALF
        mask = (1 << shift) - 1
        for byte in data:
            step = goto.get(state << 8 | byte)
            if step is None:
                step = goto[state << 8 | byte] = self.extend(state, byte)
            total += (step & mask) - half
            state = step >> shift
        return state, total

    def scan(self, word: bytes) -> int:
        """The count of a long pre-token by chunk maps; maps are kept by content, so repeated chunks are run once."""
        maps: dict[bytes, dict[tuple, tuple[tuple, int]]] = {}
        known, state, total = 0, self.states[0], 0
        for at in range(0, len(word), self.CHUNK):
            chunk = word[at : at + self.CHUNK]
            own = maps.get(chunk)
            if own is None:
                guess = self.states[self.run(0, word[max(0, at - self.WARM) : at])[0]]
                own = maps[chunk] = {guess: self.mapped(guess, chunk)}
                known += 1
            if state not in own:
                own[state] = self.mapped(state, chunk)
            state, count = own[state]
            total += count
            if len(self.goto) > self.limit:
                self.reset(state)
            if known > 1024:
                maps.clear()
                known = 0
        return total

    def mapped(self, state: tuple, chunk: bytes) -> tuple[tuple, int]:
        end, count = self.run(self.intern(state), chunk)
        return self.states[end], count

    def extend(self, state: int, byte: int) -> int:
        """The transition of a state on a byte: of the suffixes that go on, the longest whose whole is a token that is stable beside the token before it."""
        keeps, moved = self.vocabulary.keeps, []
        for node, last, since in self.states[state]:
            after = self.node.get(node << 8 | byte)
            if after is not None:
                moved.append((after, last, since))
        for node, last, since in moved:
            token = self.token[node]
            if token >= 0 and (last < 0 or keeps(last, token)):
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        emitted = 1 - since
        live = [(n, before, s + emitted) for n, before, s in moved if self.inner[n]]
        return self.intern((*live, (0, token, 0))) << self.SHIFT | emitted + self.HALF


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """Numbers by 64-bit key in two sorted arrays, an old one and a recent one; emptied beyond ``limit`` keys."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int64)] * 2

    def full(self) -> bool:
        return sum(map(len, self.keys)) > self.limit

    def get(self, wanted: np.ndarray) -> np.ndarray:
        """-1 where a key is not known."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        for keys, values in zip(self.keys, self.values):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                out[hit] = values[at[hit]]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds new keys."""
        self.merge(1, keys, values)
        if len(self.keys[1]) > max(20_000, len(self.keys[0]) // 3):
            self.merge(0, self.keys[1], self.values[1])
            self.keys[1], self.values[1] = self.keys[1][:0], self.values[1][:0]

    def merge(self, i: int, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = np.concatenate([self.keys[i], keys]), np.concatenate([self.values[i], values])
        order = np.argsort(keys, kind="stable")
        self.keys[i], self.values[i] = keys[order], values[order]


class Counter:
    """Token counts of pre-tokens by their 64-bit hash."""

    def __init__(self, path: str, limit: int = 1_500_000) -> None:
        self.machine, self.known = CountMachine(vocabulary(path)), Memo(limit)

    def counts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray) -> np.ndarray:
        keys, first, number = np.unique(T.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if self.known.full():
            self.known.clear()
        out = self.known.get(keys)
        new = np.flatnonzero(out < 0)
        read, data = self.machine.read, buf.tobytes()
        out[new] = [read(data[s:e]) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        self.known.put(keys[new], out[new])
        out = out[number]
        out[special] = 1
        return out


class Encoder:
    """Token ids of pre-tokens by the tokenizers library, each distinct pre-token once while it is remembered."""

    def __init__(self, path: str, limit: int = 1_500_000) -> None:
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_file(path), Memo(limit)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits: vocabularies of up to 65,536 tokens")
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.ids, self.n, self.top = np.zeros(1 << 16, np.uint16), 0, 0
        self.at = np.zeros(1 << 15, np.int64)

    def learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of new pre-tokens. Words without white space but a leading blank go through the library many at once,
        a line feed between them: its pattern splits just there, and no such word has the line feed's id."""
        word = lambda i: buf[starts[i] : ends[i]].tobytes().decode()
        is_plain, head = buf[ends - 1] > 32, buf[starts]
        # white space beyond ASCII begins with one of four bytes
        for i in np.flatnonzero((buf[ends - 1] > 127) & ((head <= 32) | np.isin(head, WHITE_HEADS))).tolist():
            is_plain[i] = not word(i).isspace()
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        sizes = np.zeros(len(starts), np.int64)
        ids = np.zeros(0, np.uint16)
        if len(plain):
            # each word with the byte after it, which becomes the line feed
            spans = ends[plain] - starts[plain] + 1
            tops = np.cumsum(spans)
            lines = np.append(buf, np.uint8(10))[np.repeat(starts[plain] - (tops - spans), spans) + np.arange(tops[-1])]
            lines[tops - 1] = 10
            # without the places in the text, which take the library a third of its time
            ids = np.array(self.library.encode_batch_fast([lines[:-1].tobytes().decode()], add_special_tokens=False)[0].ids, dtype=np.uint16)
            stops = np.append(np.flatnonzero(ids == self.line), len(ids))
            sizes[plain] = np.diff(stops, prepend=-1) - 1
            ids = ids[ids != self.line]
        if len(other):
            parts = [e.ids for e in self.library.encode_batch_fast([word(i) for i in other.tolist()], add_special_tokens=False)]
            sizes[other] = [len(p) for p in parts]
            ids = np.concatenate([ids, np.array([x for p in parts for x in p], dtype=np.uint16)])
        codes = np.empty(len(starts), np.int64)
        order = np.concatenate([plain, other])
        codes[order] = self.n + np.arange(len(starts))
        self.append(ids, sizes[order])
        return codes

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        def room(have: np.ndarray, n: int) -> np.ndarray:
            if n <= len(have):
                return have
            more = np.zeros(max(n, len(have) * 3 // 2), have.dtype)
            more[: len(have)] = have
            return more

        self.ids, self.at = room(self.ids, self.top + len(ids)), room(self.at, self.n + len(sizes) + 1)
        self.ids[self.top : self.top + len(ids)] = ids
        self.at[self.n + 1 : self.n + len(sizes) + 1] = self.top + np.cumsum(sizes)
        self.n, self.top = self.n + len(sizes), self.top + len(ids)

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens one after another, the number of ids of each pre-token)."""
        keys, first, number = np.unique(T.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if self.known.full():
            self.reset()
        code = self.known.get(keys)
        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = self.learn(buf, starts[first[new]], ends[first[new]])
            self.known.put(keys[new], code[new])
        code = code[number]
        sizes = self.at[code + 1] - self.at[code]
        shift = self.at[code] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def slices(buf: np.ndarray, offs: np.ndarray, size: int = 1 << 20):
    """Ranges of documents of about ``size`` bytes each: (first, end, bytes, offsets)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
