"""Near vectors: a stated query set against all rows, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.runtime import cut_lineage

#: Query vectors in one block: each block is broadcast and takes one pass over the rows.
BLOCK_ROWS = 4096


def near_vectors(rows: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, cosine): rows within a cosine of `least` of a query, the query itself left out.

    Null and zero vectors match nothing. A block of queries (bounded by block_rows) is multiplied with each batch of rows
    where it lies: no shuffle.
    """
    sc = rows.sparkSession.sparkContext
    asked = queries.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(vector_col).alias("v"))
    blocks = math.ceil(asked.count() / block_rows)
    schema, parts = "query_id long, id long, cosine double", []

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()
        held = sc.broadcast((np.array([r["q"] for r in block], np.int64), unit(np.array([r["v"] for r in block], np.float64).reshape(len(block), -1))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, vectors = held.value
            for batch in batches:
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                if not len(ids) or not len(names):
                    continue
                near = unit(np.array(batch.column(1).to_pylist(), np.float64)) @ vectors.T
                i, j = np.nonzero((near >= least) & (ids[:, None] != names[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(names[j]), pa.array(ids[i]), pa.array(near[i, j])], ["query_id", "id", "cosine"])

        parts.append(rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(run, schema))
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], schema)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def collapse(rows: DataFrame, pairs: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """(id_col, class_id): the smallest id among the rows that pairs (query_id, id) link, directly or through others.

    A row in no pair is a class of its own; a null id has none. Every round takes the smallest class among a row's
    neighbours and then that class's own class, so that the rounds grow with the logarithm of the longest chain.
    """
    links = cut_lineage(pairs.select(F.explode(F.array(F.struct(F.col("query_id").alias("u"), F.col("id").alias("v")), F.struct(F.col("id").alias("u"), F.col("query_id").alias("v")))).alias("l")).select("l.*").where("u <> v").distinct())
    classes = cut_lineage(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("u")).distinct().withColumn("c", F.col("u")))
    while True:
        near = links.join(classes.select(F.col("u").alias("v"), F.col("c").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = classes.join(near, "u", "left").select("u", "c", F.least("c", F.coalesce("near", "c")).alias("n"))
        # the class's own class: one row per row that is a class's name
        jumped = lower.join(lower.select(F.col("u").alias("n"), F.col("n").alias("top")), "n")
        jumped = cut_lineage(jumped.select("u", F.col("top").alias("n"), F.col("c").alias("was")))
        classes = jumped.select("u", F.col("n").alias("c"))
        if not jumped.where("n <> was").head(1):
            return classes.select(F.col("u").alias(id_col), F.col("c").alias("class_id"))
