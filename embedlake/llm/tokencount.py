"""Operator 7: token counts.

Arrow functions get batches balanced by bytes, cut long texts at boundaries that the model cannot join
across, encode each distinct part once and return lengths only. One narrow pass, no shuffle.

Cases: null or empty text counts 0 tokens and 0 bytes; null ids are kept; repeated rows are counted each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embedlake.llm import _segments as S
from embedlake.llm import _text as T


def token_counts(
    docs: DataFrame, model: str, kind: str = "sentencepiece", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``). ``kind``: "sentencepiece", "tokenizers" or "tiktoken"."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = S.coder(kind, model)
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(1), S.SLICE):
                n = coder.count(data, offsets) if coder.counts else np.diff(coder.tokens(data, offsets)[1])
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
