"""Blocks of documents, and messages between blocks and key shards.

An operator that must know which keys occur in several places works in rounds:
every block of documents sends its sorted distinct keys to the shards that own
them, a shard answers each block about just the keys that it sent, and blocks
combine the answers. A key held by any number of documents costs a shard at
most one entry a block, which is the pre-aggregation that defuses hot keys.
Messages are rows (dst, src, kind, data); dst and src number blocks or shards, and data is compressed. A message
without keys isn't sent. There are fewer shards than blocks, as many as the load of keys needs.

The documents are dealt to blocks by one exchange on their id and text, which later
passes reuse; so rows that share an id, or have none, spread over the blocks. Losing an executor recomputes blocks from the same rows: inside a
block documents are ordered by (id, text), so every pass sees the same order.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragspark.llm import text as T

MESSAGE = pa.schema([("dst", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
MESSAGE_SQL = "dst int, src int, kind int, data binary"
NO_MESSAGES = MESSAGE.empty_table()
CODEC = pa.Codec("zstd", compression_level=1)


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    if not rows:
        return NO_MESSAGES
    columns = [*list(zip(*rows))[:3], [len(d).to_bytes(8, "little") + CODEC.compress(d, asbytes=True) for *_, d in rows]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, MESSAGE.types)], schema=MESSAGE)


def read(table: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
    """The messages of a group, in one fixed order."""
    cols = [table.column(i).to_pylist() for i in range(3)]
    order = sorted(range(table.num_rows), key=lambda i: (cols[2][i], cols[1][i]))
    data = table.column(3)
    for i in order:
        body = data[i].as_py()
        yield cols[0][i], cols[1][i], cols[2][i], CODEC.decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)


def block_count(docs: DataFrame, block_bytes: int, text_col: str = "text") -> tuple[int, int, int]:
    """(blocks, documents, bytes of text): one narrow aggregate."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b")).first()
    n, b = int(row["n"] or 0), int(row["b"] or 0)
    return max(8, -(-b // block_bytes), -(-n // 200_000)), n, b


def to_blocks(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(block, id, text[, row]): the rows dealt by a hash of id and text; ``row`` holds the carried columns."""
    cols = [
        F.expr(f"cast(pmod(xxhash64(`{id_col}`, `{text_col}`), {blocks}) as int)").alias("block"),
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ]
    if carry is not None:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))
    return docs.select(*cols)


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a block in the order (id, text), nulls first."""
    order = pa.compute.sort_indices(
        table.select(["id", "text"]), sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start"
    )
    return table.take(order)


def release() -> None:
    """Gives back to the system what this process has freed; Python workers outlive their tasks, beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        release()
        out = fn(table)
        release()
        return out

    return run


def releasing_both(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        out = fn(table, answers)
        release()
        return out

    return run


def by_block(blocks: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(releasing(fn), schema)


def with_answers(blocks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(block's documents, messages to it); blocks without messages get an empty table."""
    return blocks.groupBy("block").cogroup(answers.groupBy("dst")).applyInArrow(releasing_both(fn), schema)


def by_shard(sent: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return sent.groupBy("dst").applyInArrow(releasing(fn), MESSAGE_SQL)


def shard_count(blocks: int, blocks_each: int) -> int:
    """As many shards as the keys of so many blocks each need."""
    return max(8, -(-blocks // blocks_each))


def shard_bounds(sorted_keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Cuts sorted keys below 2**bits into ``shards`` equal ranges of key space: shards + 1 positions."""
    edges = [min((i << bits) // shards, (1 << 64) - 1) for i in range(shards)]
    cuts = np.searchsorted(sorted_keys, np.array(edges, dtype=np.uint64))
    return np.append(cuts, len(sorted_keys))


def ids_of(table: pa.Table) -> np.ndarray:
    """The ids as int64; a null id counts as the smallest."""
    return pa.compute.fill_null(table.column("id"), -(2**63)).to_numpy()


def shared_keys(table: pa.Table) -> pa.Table:
    """A shard's answers about packed sorted keys, each kind for itself: a bit for every key sent, whether another block has it too."""
    out, sent = [], list(read(table))
    for kind in sorted({m[2] for m in sent}):
        rows = [(src, T.unpack_sorted(data)) for _, src, k, data in sent if k == kind]
        keys, counts = np.unique(np.concatenate([own for _, own in rows]), return_counts=True)
        shared = keys[counts > 1]
        for src, own in rows:
            out.append((src, sent[0][0], kind, np.packbits(is_in(own, shared)).tobytes()))
    return messages(out)


def is_in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)
