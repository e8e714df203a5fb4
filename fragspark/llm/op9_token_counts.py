"""Token counts by compiled finite-state transducers (see tokenizer.py); no shuffle, one pass over the texts.

Null or empty text: no bytes, no tokens. The special string inside a text is one
token, as the library has it by default. Rows keep their order and repeats;
columns other than id and text are ignored. Texts are read in slices of about a
megabyte of whole documents; what a worker remembers between slices is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragspark.llm import text as T
from fragspark.llm import tokenizer as K

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = K.Counter(path)
        for batch in batches:
            buf, offs = T.buffers(batch.column(1))
            totals = np.zeros(len(offs) - 1, dtype=np.int64)
            for i, j, part, cuts in K.slices(buf, offs):
                starts, ends, special = K.pretokens(part, cuts)
                sums = np.concatenate([[0], np.cumsum(counter.counts(part, starts, ends, special))])
                edges = sums[np.searchsorted(starts, cuts)]
                totals[i:j] = edges[1:] - edges[:-1]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offs)), pa.array(totals), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_count(vocabulary_path, limit), SCHEMA)
