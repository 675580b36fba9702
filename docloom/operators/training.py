"""Around model training: packing evidence into a joint budget, and the relational part of the training logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.schemas import CONFLICT_TYPES

JOINT_BUDGET = 509


def joint_pack(a: list[int], b: list[int], budget: int = JOINT_BUDGET) -> tuple[int, int, int, int, bool, bool, bool, bool]:
    """Sizes of two lists of chunks packed into one budget: (chunks used a, b, tokens a, b, cut short a, b, mid-cut a, b).

    A side whose first chunk alone exceeds the budget keeps half a budget of it and takes no more. Otherwise the shorter
    side (a on ties) takes its next chunk while it fits, else the other side its own; packing ends when neither fits.
    """
    sizes, used, tokens, short, mid = (a, b), [0, 0], [0, 0], [False, False], [False, False]
    for s in (0, 1):
        if sizes[s] and sizes[s][0] > budget:
            used[s], tokens[s], mid[s], short[s] = 1, budget // 2, True, len(sizes[s]) > 1
    while True:
        waiting = [s for s in (0, 1) if not mid[s] and used[s] < len(sizes[s])]
        room = budget - sum(tokens)
        if not waiting:
            break
        fits = lambda s: 0 < room and sizes[s][used[s]] <= room
        turn = sorted(waiting, key=lambda s: (tokens[s], s))
        choice = next((s for s in turn if fits(s)), None)
        for s in turn[: turn.index(choice)] if choice is not None else turn:
            short[s] = True
        if choice is None:
            break
        tokens[choice] += sizes[choice][used[choice]]
        used[choice] += 1
    return used[0], used[1], tokens[0], tokens[1], short[0], short[1], mid[0], mid[1]


def joint_budget(records: DataFrame, count: Callable[[str], int], *, id_col: str = "record_no", budget: int = JOINT_BUDGET) -> DataFrame:
    """(id_col, chunks_a, chunks_b, total_a, total_b, tokens_a, tokens_b, length, truncated_a/b, mid_a/b) per record.

    Blank passages count as none; `count` is the tokenizer's length of a text; length includes three special tokens.
    """
    rows = records.select(id_col, *(F.expr(f"filter(transform(evidence_{s}, x -> trim(x.passage)), x -> x <> '')").alias(s) for s in "ab"))
    names = ["used_a", "used_b", "tokens_a", "tokens_b", "truncated_a", "truncated_b", "mid_a", "mid_b", "total_a", "total_b", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sizes = [count(t) for t in a or []], [count(t) for t in b or []]
                packed = joint_pack(*sizes, budget)
                out.append((*packed, len(sizes[0]), len(sizes[1]), packed[2] + packed[3] + 3))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.bool_() if n[:3] in ("tru", "mid") else pa.int32()) for c, n in zip(columns, names))], [id_col, *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {'boolean' if n[:3] in ('tru', 'mid') else 'int'}" for n in names))


def truncation_statistics(packed: DataFrame) -> DataFrame:
    """One row: how many records are cut short, and their lengths: upper median and p90 are exact elements, found from the
    counts per length (there are at most as many lengths as the budget)."""
    any_side, any_mid = F.col("truncated_a") | F.col("truncated_b"), F.col("mid_a") | F.col("mid_b")
    flags = packed.agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated_a").alias("truncated_a"), F.count_if("truncated_b").alias("truncated_b"), F.count_if(any_side).alias("truncated_any"),
                       F.count_if(any_mid).alias("mid_any"), F.min("length").alias("least"), F.max("length").alias("most"), F.round(F.avg("length"), 6).alias("mean"))
    lengths = packed.groupBy("length").agg(F.count(F.lit(1)).alias("k"))
    placed = lengths.select("length", F.sum("k").over(Window.orderBy("length")).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("n"))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(share)), F.col("length")))
    both_rows = flags.unionByName(placed.agg(at(0.5).alias("median"), at(0.9).alias("p90")), allowMissingColumns=True)
    return both_rows.agg(*(F.max(c).alias(c) for c in both_rows.columns))


def learning_rate(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Linear warm-up, then linear decay to 0."""
    down = F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(down) * peak


def early_stop(epochs: DataFrame, by: list[str], *, order: str = "epoch", score: str = "score", patience: int = 3) -> DataFrame:
    """(by..., best_epoch, best_score, stopped_at): a strict improvement resets the patience; null if it never ran out."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = epochs.withColumn("_up", before.isNull() | (F.col(score) > before))
    since = better.withColumn("_last", F.max(F.when(F.col("_up"), F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = since.withColumn("_stop", F.when(F.col(order) - F.col("_last") >= patience, F.col(order)))
    ended = stop.withColumn("_end", F.min("_stop").over(Window.partitionBy(*by)))
    lived = ended.where(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return lived.groupBy(*by).agg(F.max(F.when(F.col("_up"), F.col(order))).alias("best_epoch"), F.max(score).alias("best_score"), F.first("_end").alias("stopped_at"))


def overfit(epochs: DataFrame) -> DataFrame:
    """Epochs from the third on with a training F1 of .95 or more and a validation F1 under .4."""
    return epochs.where((F.col("epoch") >= 3) & (F.col("train_f1") >= 0.95) & (F.col("val_f1") < 0.4))


def sweep_winner(runs: DataFrame, scores: list[str], order: str) -> DataFrame:
    """The run with the highest scores in turn, nulls as lowest; the first of equals."""
    keys = [F.desc_nulls_last(s) for s in scores]
    return runs.orderBy(*keys, order).limit(1)


def softmax_confidence(logits: str) -> Column:
    """The probability of the second class."""
    a, b = F.get(F.col(logits), F.lit(0)), F.get(F.col(logits), F.lit(1))
    return 1 / (1 + F.exp(a - b))


def argmax(values: str) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def build_example(a: list[list[int]], b: list[list[int]], *, cls: int, sep: int, budget: int = JOINT_BUDGET) -> tuple[list[int], list[int]]:
    """(token ids, segment ids) of [CLS] A [SEP] B [SEP] under the joint budget."""
    used_a, used_b, n_a, n_b, *_ = joint_pack([len(x) for x in a], [len(x) for x in b], budget)
    left, right = sum(a[:used_a], [])[:n_a], sum(b[:used_b], [])[:n_b]
    return [cls, *left, sep, *right, sep], [0] * (len(left) + 2) + [1] * (len(right) + 1)


def encoder_examples(records: DataFrame, encode: Callable[[str], list[int]], *, cls: int = 1, sep: int = 2, id_col: str = "record_no", budget: int = JOINT_BUDGET) -> DataFrame:
    """(id_col, input_ids, token_type_ids, binary_label, typology_label) per record; the type's label is -100 where there
    is no conflict or its type is none of the four."""
    kinds = F.array(*map(F.lit, CONFLICT_TYPES))
    y = F.coalesce(F.col("record_type") == "conflict", F.lit(False))
    at = F.array_position(kinds, F.coalesce("conflict_type", F.lit("")))
    rows = records.select(id_col, y.cast("int").alias("binary_label"), F.when(y & (at > 0), (at - 1).cast("int")).otherwise(-100).alias("typology_label"), *(F.expr(f"filter(transform(evidence_{s}, x -> trim(x.passage)), x -> x <> '')").alias(s) for s in "ab"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build_example([encode(t) for t in a or []], [encode(t) for t in b or []], cls=cls, sep=sep, budget=budget) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            ids, types = ([m[k] for m in made] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(types, pa.list_(pa.int32())), batch.column(1), batch.column(2)], [id_col, "input_ids", "token_type_ids", "binary_label", "typology_label"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, input_ids array<int>, token_type_ids array<int>, binary_label int, typology_label int")


def pad(ids: list[list[int]], filler: int) -> tuple[list[list[int]], list[list[int]]]:
    """(padded ids, attention masks) of a batch, filled on the right to its longest."""
    most = max(map(len, ids), default=0)
    return [x + [filler] * (most - len(x)) for x in ids], [[1] * len(x) + [0] * (most - len(x)) for x in ids]
