"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import common, tokens

LIMIT = 512


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and rows without doc_id stay, each with its own
    counts; other columns are ignored; an empty table gives no rows. Very long texts are cut at safe boundaries and
    their lengths added up. Nothing is shuffled.
    """

    def count(batches):
        import pyarrow as pa

        enc = tokens.encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [0] * len(texts)
            for i, ids in tokens.by_bytes(texts, enc):
                n[i] = len(ids) >> 2
            size = [len(x.encode()) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return common.documents(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
