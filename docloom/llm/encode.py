"""Problem 8: the whole corpus as token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe import DEFAULT_VOCAB, ByteBpe, model_from_file
from docloom.plans.runtime import spread, table, type_of


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col, ids array<int>): one row per input row, the ids of its text without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text; repeated rows
    are encoded each; an empty table gives an empty one. No shuffle: the model (fixed size, that of the vocabulary
    file) is broadcast and every partition is encoded where it is read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_from_file(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe.of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, sizes = encoder.encode_batch(part.column(1).to_pylist())
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, ids array<int>")


def decode_corpus(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col, text): the texts of id lists; an empty list or null gives the empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(model_from_file(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe.of(model.value)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {type_of(encoded, id_col)}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
