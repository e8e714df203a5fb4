"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are a fixed vector of shares and lengths, computed on its bytes
with vectorised numpy. Each feature is cut into at most 64 bins; trees grow level
by level from histograms of gradients over the bins, with a Newton step at the leaves.
The fitted forest is flattened into arrays (feature, threshold, left child, value),
and a batch of documents walks all trees at once, one vectorised step a level.

Labelled rows are read through a sample of at most ``max_rows`` (documented
parameter, 20,000 by default), chosen by a hash of the id; fitting is on the driver
within that bound. Scoring is one pass over the texts without a shuffle; the
flattened forest (some tens of kB, by its parameters) goes with the task.

Null or empty text: the statistics of an empty text, scored like any other. Without
labels of both classes the score is the smoothed share of label 1. Labels that are null
are left out; an id that is labelled twice counts twice. Rows keep their repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from fragspark.llm import text as T

BYTE_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123)],
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "marks": [ord(c) for c in "!?"],
    "stops": [ord(c) for c in ".,;:"],
    "symbols": [ord(c) for c in "#*$%&|<>"],
    "brackets": [ord(c) for c in "(){}[]=/\\_@+"],
    "high": [*range(128, 256)],
    "control": [*range(0, 9), *range(14, 32), 127],
}
CLASS_OF = np.zeros((len(BYTE_CLASSES), 256), dtype=np.uint8)
for _i, _bytes in enumerate(BYTE_CLASSES.values()):
    CLASS_OF[_i, _bytes] = 1
NAMES = (
    "log_words", "log_lines", "word_length", "line_words", "max_word", *(f"{c}_share" for c in BYTE_CLASSES),
    "distinct_words", "same_as_last", "top_word", "pairs_repeated", "triples_repeated", "lines_repeated", "capital_words", "spread_of_lengths",
)


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many of its keys are distinct, and the count of its most frequent."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(k)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], runs)
    return np.bincount(d[at], minlength=n), top


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for every document of the buffer."""
    n = len(offs) - 1
    starts, ends, firsts = T.split_words(buf, offs)
    words = np.diff(firsts)
    w = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    lengths = ends - starts
    hashes = T.span_hashes(buf, starts, ends)
    size = np.maximum(np.diff(offs), 1)
    out = []
    feeds = np.concatenate([[0], np.cumsum(buf == 10)])
    lines = feeds[offs[1:]] - feeds[offs[:-1]] + 1
    total = np.bincount(doc, lengths, n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, lengths)
    out += [np.log1p(words), np.log1p(lines), total / w, words / lines, longest]
    for row in CLASS_OF:
        sums = np.concatenate([[0], np.cumsum(row[buf], dtype=np.int64)])
        out.append((sums[offs[1:]] - sums[offs[:-1]]) / size)
    distinct, top = _repeats(hashes, doc, n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out += [distinct / w, np.bincount(doc, same, n) / w, top / w]
    for width in (2, 3):
        at = T.windows_inside(firsts, width)
        keys = T.fold(hashes, width, 0x2545F4914F6CDD1D)[at] if len(at) else np.zeros(0, np.uint64)
        kinds, _ = _repeats(keys, doc[at], n)
        out.append(1 - kinds / np.maximum(np.bincount(doc[at], minlength=n), 1))
    # lines as runs of word hashes: a line's key is the sum of its words' hashes by place
    line_of = feeds[starts] if len(starts) else np.zeros(0, np.int64)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    if len(at):
        place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
        keys = np.add.reduceat(hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at)
        kinds, _ = _repeats(keys, doc[at], n)
        many = np.bincount(doc[at], minlength=n)
        out.append(1 - kinds / np.maximum(many, 1))
    else:
        out.append(np.zeros(n))
    capital = (buf[starts] >= 65) & (buf[starts] <= 90) if len(starts) else np.zeros(0)
    out.append(np.bincount(doc, capital, n) / w)
    mean = total / w
    out.append(np.sqrt(np.maximum(np.bincount(doc, lengths.astype(float) ** 2, n) / w - mean**2, 0)))
    return np.column_stack(out).astype(np.float64)


def slices(buf: np.ndarray, offs: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """The statistics of a batch, some megabyte of documents at a time."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, statistics(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Forest:
    """Trees of equal depth in arrays: node k of a tree has children 2k + 1 and 2k + 2; leaves hold log-odds."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] >= self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: float = 2.0) -> Forest:
    """Boosts the log loss; classes weigh the same in sum, so that a rare class is learnt too."""
    good = float(y.sum())
    base = np.log((good + 1) / (len(y) - good + 1))
    inner, leaves = 2**depth - 1, 2**depth
    empty = Forest(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or good in (0, len(y)):
        return empty
    weight = np.where(y == 1, len(y) / (2 * good), len(y) / (2 * (len(y) - good)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)])
    n_features = x.shape[1]
    odds = np.zeros(len(y))
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            # one histogram over (node, feature, bin)
            cell = (local[:, None] * n_features + np.arange(n_features)) * bins + codes
            gs = np.bincount(cell.ravel(), np.repeat(g, n_features), n * n_features * bins).reshape(n, n_features, bins)
            hs = np.bincount(cell.ravel(), np.repeat(h, n_features), n * n_features * bins).reshape(n, n_features, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in range(n):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] >= threshold[node])
        leaf = node - inner
        step = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        odds += step[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(step)
    return Forest(0.0, depth, np.array(features), np.array(thresholds), np.array(values))


STATS_SQL = "id bigint, good int, stats array<double>"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, x in slices(*T.buffers(batch.column(2))):
            stats = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], stats], names=["id", "good", "stats"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fits on at most ``max_rows`` labelled rows outside the held-out third."""
    marks = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("good"))
    marks = marks.where(F.col("good").isin(0, 1) & ~held_out("id")).orderBy(F.xxhash64("id"), "id", "good").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # at most max_rows rows of twelve bytes are broadcast
    found = texts.join(F.broadcast(marks), "id").select("id", "good", "text").mapInArrow(_statistics, STATS_SQL)
    rows = found.orderBy("id", "good").limit(max_rows).collect()
    if not rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.array([r["stats"] for r in rows]), np.array([r["good"] for r in rows], dtype=float))


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, x in slices(*T.buffers(batch.column(1))):
                score[i:j] = forest.score(x)
            columns = [batch.column(0), pa.array(score), *batch.columns[2:]]
            yield pa.record_batch(columns, names=["doc_id", "score", *batch.schema.names[2:]])

    return run


def classify(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted[, row]) for every row; ``row`` holds the carried columns."""
    cols = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))
    rows = docs.select(*cols)
    schema = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("score", S.DoubleType()), *([rows.schema["row"]] if carry else [])])
    scored = rows.mapInArrow(_score(forest), schema)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["row"] if carry else []))
