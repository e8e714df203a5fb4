"""Concatenate and cut: documents become one run of token ids, cut into sequences of equal length.

Pass one tokenises each document once, by the library, ends it with an end id,
and writes its ids with their place in their partition to a table in the shared
folder. The totals of all partitions (a number each) are summed up to the global
offset of every partition. Pass two reads the table, adds the offset, and cuts at
the sequence bounds; a document that crosses a bound becomes several pieces.
Every id lies in just one piece, and only the last sequence is not full.

Null or empty text: the end id alone. Repeated rows are packed each for itself.
An empty input gives an empty result. A task that runs again writes the same rows, and
pass two reads only what was committed, so lost executors change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragspark.llm import text as T
from fragspark.llm import tokenizer as K
from fragspark.llm.shared import stored

IDS = "part int, place bigint, doc_id bigint, size bigint, ids binary"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = K.Encoder(path), 0
        for batch in batches:
            buf, offs = T.buffers(batch.column(2))
            parts, doc_ids = batch.column(0), batch.column(1)
            for i, j, part, cuts in K.slices(buf, offs):
                starts, ends, special = K.pretokens(part, cuts)
                ids, sizes = encoder.encode(part, starts, ends, special) if len(starts) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
                sums = np.concatenate([[0], np.cumsum(sizes)])
                edges = sums[np.searchsorted(starts, cuts)]
                ids = np.insert(ids, edges[1:], end_id)
                lengths = np.diff(edges) + 1
                tops = np.concatenate([[0], np.cumsum(lengths)])
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((tops * 2).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
                yield pa.record_batch([parts[i:j], pa.array(place + tops[:-1]), doc_ids[i:j], pa.array(lengths), data], names=["part", "place", "doc_id", "size", "ids"])
                place += int(tops[-1])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0).to_numpy()
            sizes = batch.column(2).to_numpy()
            pieces = (first + sizes - 1) // length - first // length + 1
            doc = np.repeat(np.arange(len(first)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[doc] // length + nth
            begin = np.maximum(sequence * length, first[doc])
            end = np.minimum((sequence + 1) * length, first[doc] + sizes[doc])
            start = begin - first[doc]
            data, offs = T.buffers(batch.column(3))
            crc = []
            for d, s, n in zip(doc.tolist(), start.tolist(), (end - begin).tolist()):
                at = int(offs[d]) + 2 * s
                crc.append(zlib.crc32(data[at : at + 2 * n].view("<u2").astype("<u4").tobytes()))
            yield pa.record_batch(
                [batch.column(1).take(pa.array(doc)), pa.array(start), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(sequence), pa.array(begin - sequence * length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, with the sequence and the offset there."""
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = stored(rows.mapInArrow(_encode(vocabulary_path, end_id), IDS), "pack")
    totals = ids.groupBy("part").agg(F.sum("size").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # a row of twelve bytes for every partition of the input: the bound of what is broadcast
    placed = ids.join(F.broadcast(bases), "part").select((F.col("base") + F.col("place")).alias("first"), "doc_id", "size", "ids")
    return placed.mapInArrow(_cut(length), SCHEMA)
