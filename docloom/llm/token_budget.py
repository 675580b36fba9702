"""Problem 5: exact token counts and the usable tokens of each slice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bpe import DEFAULT_VOCAB, ByteBpe, independent_pieces, model_from_file
from docloom.plans.runtime import spread, table, type_of

#: Texts longer than this many characters are cut at independent boundaries and their pieces spread over the workers.
LONG_CHARS = 4096


def count_tokens(df: DataFrame, *, text_col: str = "text", keep: list[str], vocab: str = DEFAULT_VOCAB, long_chars: int = LONG_CHARS, count_col: str = "token_count") -> DataFrame:
    """(keep..., count_col): the number of tokens of each row's text; 0 for null and empty texts.

    Texts up to long_chars are counted where they are read. Longer ones are cut only where the tokenizer is proven to
    work independently on both sides, their pieces are salted over all workers by a hash of row and piece number, and
    the exact piece counts are summed per row (repeated rows are told apart by their place in the input).
    """
    model = df.sparkSession.sparkContext.broadcast(model_from_file(vocab))
    carried = ", ".join(f"`{c}` {type_of(df, c)}" for c in keep)
    text = F.col(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe.of(model.value)
        for batch in batches:
            n = encoder.count_batch(batch.column(batch.num_columns - 1).to_pylist())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*names, count_col])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, pieces = [], [], []
            for i, whole in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = independent_pieces(whole, long_chars)
                rows += [i] * len(own)
                numbers += range(len(own))
                pieces += own
            taken = batch.take(pa.array(rows, pa.int64()))
            arrays = [*taken.columns[:-1], pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "_piece", text_col])

    short = spread(df.where(text.isNull() | (F.length(text) <= long_chars)).select(*keep, text_col)).mapInArrow(count, f"{carried}, {count_col} long")
    long = df.where(F.length(text) > long_chars).select(*keep, F.monotonically_increasing_id().alias("_row"), text_col)
    pieces = long.mapInArrow(cut, f"{carried}, _row long, _piece int, `{text_col}` string")
    counted = pieces.repartition("_row", "_piece").mapInArrow(count, f"{carried}, _row long, _piece int, {count_col} long")
    summed = counted.groupBy("_row").agg(*(F.first(c).alias(c) for c in keep), F.sum(count_col).alias(count_col)).drop("_row")
    return short.unionByName(summed)


def not_blank(text: F.Column | str) -> F.Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"(?U)\S")), F.lit(False))


def wrong_counts(chunks: DataFrame, *, id_col: str = "chunk_no", stated_col: str = "n_tokens", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col): rows with a non-blank text whose stated count is null, not positive, or off by more than a factor 2."""
    counted = count_tokens(chunks.where(not_blank(F.col(text_col))), text_col=text_col, keep=[id_col, stated_col], vocab=vocab)
    stated, n = F.col(stated_col).cast("long"), F.col("token_count")
    return counted.where(stated.isNull() | (stated <= 0) | (stated > 2 * n) | (2 * stated < n)).select(id_col)


def slice_totals(chunks: DataFrame, *, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(level, jurisdiction, issuing_body, document_type, n_chunks, n_tokens): token totals rolled up.

    Each chunk_id counts once, by its latest row (ingested_at, then chunk_no); rows without chunk_id count each.
    Jurisdictions INT-... are International; bodies are trimmed and lower-cased. level 0 is a full slice, 1 drops the
    type, 3 also the body, 7 is the total; a null in a column within its level stands for missing values.
    """
    body = F.nullif(F.lower(F.trim("issuing_body")), F.lit(""))
    area = F.when(F.col("jurisdiction").startswith("INT-"), "International").otherwise(F.trim("jurisdiction"))
    keyed = chunks.select(
        F.coalesce("chunk_id", F.concat(F.lit("row "), F.col("chunk_no").cast("string"))).alias("_key"),
        F.struct("ingested_at", "chunk_no").alias("_at"), area.alias("jurisdiction"), body.alias("issuing_body"), "document_type", "text",
    )
    counted = count_tokens(keyed, keep=["_key", "_at", "jurisdiction", "issuing_body", "document_type"], vocab=vocab)
    once = counted.groupBy("_key").agg(F.max_by(F.struct("jurisdiction", "issuing_body", "document_type", "token_count"), "_at").alias("r")).select("r.*")
    return once.rollup("jurisdiction", "issuing_body", "document_type").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens")
    ).select("level", "jurisdiction", "issuing_body", "document_type", "n_chunks", "n_tokens")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_counts(table(spark, sf_dir, "chunks"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_totals(table(spark, sf_dir, "chunks"))
