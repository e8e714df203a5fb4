"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are one class, with as many of its smallest ids as an answer may need.
The trees are grown on a sample of at most ``sample`` classes (documented bound): a node
splits its points at the median of their projections on a random direction. Every class,
in the sample or not, then falls through all trees into a leaf of each.

A query walks all trees with one priority queue: nodes wait by the smallest margin
by which the query was on their side, and the best goes first, whatever tree it is in.
It stops when the leaves it has taken cover a set share of the sample. That share
is tuned on the sample: the one at which probe queries find ``recall`` of their exact
neighbours there. Leaves and the queries that take them meet by leaf; a leaf of more than CELL
classes is dealt over as many parts. Candidates come from leaves alone. Their inner products
are computed exactly, in double precision, on the original vectors; the k-th best of the sample's members of
the leaves that a query takes, which are among its candidates, is the bar that others must reach, so that
few results travel. The best are scored once more in one fixed order of addition, as are copies of
the query, so that equal products are equal numbers.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Null ids take no part. An id that occurs twice counts as two rows
with one id. An empty input gives an empty result; fewer than k candidates give all there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragspark.llm import text as T
from fragspark.llm.shared import stored


#: As many classes of a leaf are compared in one task.
CELL = 4096
#: So many more than asked for are scored once more: what rounding could have put in another order.
SPARE = 8


@dataclass
class Forest:
    """All trees in arrays; a child below 0 is leaf -child - 1. ``members``: sample rows by leaf."""

    direction: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    roots: list[int]
    members: list[np.ndarray]
    sample: np.ndarray
    sample_ids: np.ndarray
    cover: float = 1.0
    parts: np.ndarray | None = None

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                at = node[live]
                side = (np.einsum("ij,ij->i", x[live], self.direction[at]) >= self.threshold[at]).astype(np.int64)
                node[live] = self.child[at, side]
                live = live[node[live] >= 0]
            out[:, t] = -node - 1
        return out

    def search(self, q: np.ndarray, cover: float) -> Iterator[int]:
        """Leaves for the query, best first, until they cover that share of the sample."""
        margins = (self.direction @ q - self.threshold).tolist() if len(self.direction) else []
        child, queue = self.child, [(0.0, r) for r in self.roots]
        heapq.heapify(queue)
        got, n, goal = np.zeros(len(self.sample), dtype=bool), 0, cover * len(self.sample)
        while queue and n < goal:
            worst, node = heapq.heappop(queue)
            if node < 0:
                rows = self.members[-node - 1]
                n += int((~got[rows]).sum())
                got[rows] = True
                yield -node - 1
            else:
                m = margins[node]
                heapq.heappush(queue, (max(worst, m), int(child[node, 0])))
                heapq.heappush(queue, (max(worst, -m), int(child[node, 1])))


def grow(sample: np.ndarray, ids: np.ndarray, trees: int, leaf: int, seed: int, k: int, recall: float) -> Forest:
    rng = np.random.Generator(np.random.PCG64(seed))
    directions, thresholds, children, roots, members = [], [], [], [], []

    def split(rows: np.ndarray) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            d = rng.normal(size=sample.shape[1])
            d /= np.linalg.norm(d)
            p = np.einsum("ij,j->i", sample[rows], d)
            cut = float(np.median(p))
            right = p >= cut
            if right.any() and not right.all():
                me = len(directions)
                directions.append(d)
                thresholds.append(cut)
                children.append([0, 0])
                children[me] = [split(rows[~right]), split(rows[right])]
                return me
        members.append(rows)
        return -len(members)

    for _ in range(trees):
        roots.append(split(np.arange(len(sample))))
    dim = sample.shape[1] if len(sample) else 1
    forest = Forest(np.array(directions).reshape(-1, dim), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2), roots, members, sample, ids)
    forest.cover = _tuned(forest, k, recall, rng)
    return forest


def _tuned(forest: Forest, k: int, recall: float, rng: np.random.Generator, probes: int = 100) -> float:
    """The share of the sample that probe queries must cover to find ``recall`` of their exact neighbours."""
    n = len(forest.sample)
    if n <= k + 1:
        return 1.0
    shares = []
    for p in rng.choice(n, min(probes, n), replace=False):
        s = forest.sample @ forest.sample[p]
        s[p] = -np.inf
        near = np.argpartition(-s, k)[:k]
        when, got, seen = np.ones(n), np.zeros(n, dtype=bool), 0
        for leaf in forest.search(forest.sample[p], 1.0):
            rows = forest.members[leaf]
            fresh = rows[~got[rows]]
            got[fresh] = True
            seen += len(fresh)
            when[fresh] = seen / n
        shares.append(when[near])
    return float(min(1.0, np.quantile(np.concatenate(shares), recall)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


POST_SQL = "cell bigint, ids binary, vecs binary"
TAKE_SQL = "cell bigint, ids binary, vecs binary, bars binary"
FOUND_SQL = "query bigint, candidate bigint, score double"
PARTS = 20


def _post(forest: Forest, dtype: str):
    """Rows of (part of a leaf, packed ids, packed vectors) for a batch of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1)).astype(dtype)
            if not len(ids):
                continue
            leaf = forest.leaves_of(x.astype(np.float64)).ravel()
            row = np.repeat(np.arange(len(ids)), len(forest.roots))
            part = T.mix(ids.view(np.uint64), 5)[row] % forest.parts[leaf].astype(np.uint64)
            cell = leaf << PARTS | part.astype(np.int64)
            by = np.argsort(cell, kind="stable")
            cell, row = cell[by], row[by]
            cut = np.flatnonzero(np.diff(cell, prepend=-1))
            parts = np.split(row, cut[1:])
            yield pa.record_batch([pa.array(cell[cut]), pa.array([ids[p].tobytes() for p in parts], pa.binary()), pa.array([x[p].tobytes() for p in parts], pa.binary())], names=["cell", "ids", "vecs"])

    return run


def _search(forest: Forest, k: int, dtype: str):
    """The leaves that each query takes, and the bar that the sample's members of these leaves set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TAKE_SQL.split(", ")]
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1)).astype(dtype)
            for low in range(0, len(ids), 256):
                own, y = ids[low : low + 256], x[low : low + 256]
                q, bars = y.astype(np.float64), np.full(len(own), -np.inf)
                takes: dict[int, list[int]] = {}
                for i in range(len(own)):
                    seen = np.zeros(len(forest.sample), dtype=bool)
                    for leaf in forest.search(q[i], forest.cover):
                        seen[forest.members[leaf]] = True
                        takes.setdefault(leaf, []).append(i)
                    rows = np.flatnonzero(seen)
                    rows = rows[forest.sample_ids[rows] != own[i]]
                    if len(rows) >= k:
                        bars[i] = np.partition(forest.sample[rows] @ q[i], len(rows) - k)[len(rows) - k]
                cells = [(leaf << PARTS | p, leaf) for leaf in sorted(takes) for p in range(int(forest.parts[leaf]))]
                rows = [np.array(takes[leaf]) for _, leaf in cells]
                columns = [[c for c, _ in cells], [own[r].tobytes() for r in rows], [y[r].tobytes() for r in rows], [bars[r].tobytes() for r in rows]]
                yield pa.record_batch([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=names)

    return run


def _unpack(column: pa.ChunkedArray, dtype: type | str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _rerank(dim: int, dtype: str):
    """Exact inner products of a leaf's classes with the queries that took it, as far as they reach the query's bar."""

    def run(posts: pa.Table, takes: pa.Table) -> pa.Table:
        q, c, s = [], [], []
        if posts.num_rows and takes.num_rows:
            ids, x = _unpack(posts.column("ids"), np.int64), _unpack(posts.column("vecs"), dtype).reshape(-1, dim).astype(np.float64)
            queries, y, bars = _unpack(takes.column("ids"), np.int64), _unpack(takes.column("vecs"), dtype).reshape(-1, dim), _unpack(takes.column("bars"), np.float64)
            for i in range(0, len(queries), 256):
                part = y[i : i + 256].astype(np.float64)
                low = bars[i : i + 256, None]
                for j in range(0, len(ids), CELL):
                    score = part @ x[j : j + CELL].T
                    # the bar was added up in another order; what is below it by rounding only stays in
                    a, b = np.nonzero(score >= low - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(low), low, 0))))
                    q.append(queries[i + a])
                    c.append(ids[j + b])
                    s.append(score[a, b])
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"query": cat(q, pa.int64()), "candidate": cat(c, pa.int64()), "score": cat(s, pa.float64())})

    return run


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 8, leaf: int = 256, sample: int = 16_384, recall: float = 0.96, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id is divisible by ``every``."""
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype = "float32" if narrow else "float64"
    v = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<float>" if narrow else "array<double>").alias("vec")).where(
        "id is not null and vec is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(vec, x -> x <> 0)"
    )
    common = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = int(common["d"])
    v = v.where(F.size("vec") == dim)
    # of each class, the ids that can be among k answers: its k + 1 smallest
    numbered = v.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= k + 1)
    members = stored(numbered, "ann")
    classes = members.where("nth = 1").select(F.col("id").alias("class"), "vec")
    n = classes.count()
    taken = classes.orderBy(F.xxhash64("class"), "class").limit(sample).collect()  # the documented bound
    points = np.array([r["vec"] for r in taken], dtype=dtype).astype(np.float64)
    small = max(4, leaf * len(taken) // max(n, 1))
    forest = grow(points, np.array([r["class"] for r in taken], dtype=np.int64), trees, small, seed, k + 1, recall)

    # a leaf's share of the sample tells its size
    forest.parts = np.array([max(1, -(-len(m) * n // (max(1, len(taken)) * CELL))) for m in forest.members], dtype=np.int64)

    member_of = members.select("vec", "id").join(classes, "vec").select("class", F.col("id").alias("vec_id"))
    asking = v.where(F.col("id") % every == 0).join(classes, "vec").select(F.col("id").alias("query_id"), "class", "vec")
    queries = stored(asking.select("class", "vec").dropDuplicates(["class"]), "ann-queries")
    tasks = max(8, -(-queries.count() // 256))
    posts = classes.mapInArrow(_post(forest, dtype), POST_SQL)
    takes = queries.repartition(tasks).mapInArrow(_search(forest, k + 1, dtype), TAKE_SQL)
    found = posts.groupBy("cell").cogroup(takes.groupBy("cell")).applyInArrow(_rerank(dim, dtype), FOUND_SQL)
    found = found.groupBy("query", "candidate").agg(F.max("score").alias("score")).where("query <> candidate")
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "candidate")
    best = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1 + SPARE).select("query", "candidate")
    # copies of the query itself are as near as its own product
    best = best.unionByName(queries.select(F.col("class").alias("query"), F.col("class").alias("candidate")))
    product = F.expr("aggregate(zip_with(x, y, (a, b) -> cast(a as double) * cast(b as double)), 0D, (s, p) -> s + p)")
    best = best.join(queries.select(F.col("class").alias("query"), F.col("vec").alias("x")), "query").join(classes.select(F.col("class").alias("candidate"), F.col("vec").alias("y")), "candidate")
    best = best.select("query", "candidate", product.alias("score"))
    pairs = asking.select("query_id", F.col("class").alias("query")).join(best, "query").join(member_of, F.col("candidate") == F.col("class")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
