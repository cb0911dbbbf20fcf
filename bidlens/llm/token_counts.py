"""Token counts per document: batches balanced by bytes, encoded in an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from bidlens.llm.common import BATCH_BYTES, documents, rows_of
from bidlens.llm.encoding import encoder

OVER_LIMIT = 512
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row per input row.

    ``vocabulary`` is a file of the tokenizers (.json) or sentencepiece (.model) library
    that every executor can read. No begin, end or padding tokens are added, nothing is
    truncated; special strings inside a text count as the library takes them by default.
    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are
    counted each; an empty table gives an empty one; other columns do not matter.

    A run of rows is bounded by bytes, not by rows, and a long text is cut where no token
    can span, so memory does not follow the longest text's token list.
    """

    def count(batches):
        lengths = encoder(vocabulary, len, "lengths")
        for ids, texts in rows_of(batches, BATCH_BYTES):
            counts = [sum(v) for v in lengths.values(texts)]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents(docs, id_col, text_col).mapInArrow(count, SCHEMA)
