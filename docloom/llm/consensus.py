"""Problem 3: consensus from several annotators' labels, by spectral reliability.

Model: an annotator knows the label with some competence, else guesses by habit. The expected agreement of two annotators
beyond what their label habits would give by chance is then the product of their competences, so the chance-centred
agreement matrix, corrected for how often each pair met, has one leading eigenvector: the competences. It is found by
power iteration over the sparse votes: each step sums the weighted, centred votes per item and hands them back to the
annotators; the matrix itself, with its pairs within an item, is never formed. Competences weight the votes of a first
consensus; the label habits of each annotator against that consensus then weight the votes label by label.

The votes are brought together by item once. With up to MOST_PEOPLE annotators every step is one pass over the items where
they lie: it gets the annotators' numbers by broadcast and gives back sums per annotator. With more, the annotators' numbers
are joined to the votes in every step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.runtime import cut_lineage, table
from docloom.schemas import CONFLICT_TYPES as CLASSES

STEPS, ROUNDS = 8, 3

#: Annotators whose numbers (24 each) are broadcast; of more, they are joined.
MOST_PEOPLE = 20_000

#: Votes that the model's own expectation counts for in an annotator's habits.
PRIOR = 6.0


def clean_label(column: str) -> F.Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-_]+", "_"))
    return F.when(plain.isin(CLASSES), plain)


def clean_person(column: str) -> F.Column:
    return F.nullif(F.upper(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))


def votes(passes: DataFrame) -> DataFrame:
    """(item, person, label): usable labels of annotators and reviewers, each once per item.

    Of an annotator's passes over an item only the highest revision counts (of equal ones the latest loaded, then the
    highest pass_no). Without review, or with an unknown decision, the annotator chose conflict_type; accept: both chose
    it; revise: the annotator original_conflict_type, the reviewer conflict_type; reject: the annotator
    original_conflict_type. Passes without pair_id are no item's; labels of an unnamed person share one person.
    """
    own = passes.where("pair_id is not null").select(
        F.col("pair_id").alias("item"), F.coalesce(clean_person("annotator_id"), F.lit("?")).alias("person"), F.coalesce(clean_person("review.reviewer_id"), F.lit("?")).alias("reviewer"),
        F.lower(F.trim("review.decision")).alias("decision"), clean_label("conflict_type").alias("now"), clean_label("review.original_conflict_type").alias("was"),
        F.struct("revision", "loaded_at", "pass_no").alias("at"))
    last = own.groupBy("item", "person").agg(F.max_by(F.struct("reviewer", "decision", "now", "was"), "at").alias("r")).select("item", "person", "r.*")
    changed = F.coalesce(F.col("decision").isin("revise", "reject"), F.lit(False))
    by_annotator = F.struct("person", F.when(changed, F.col("was")).otherwise(F.col("now")).alias("label"))
    by_reviewer = F.struct(F.col("reviewer").alias("person"), F.when(F.col("decision").isin("accept", "revise"), F.col("now")).alias("label"))
    return last.select("item", F.explode(F.array(by_annotator, by_reviewer)).alias("v")).select("item", "v.*").where("label is not null").distinct()


def _sums(values: list[F.Column], names: list[str]) -> list[F.Column]:
    return [F.sum(v).alias(n) for v, n in zip(values, names)]


def competences(cast: DataFrame, steps: int = STEPS) -> DataFrame:
    """(person, n, habit array<double>, r): leading eigenvector of the chance-centred, overlap-corrected agreement.

    One step: r_i becomes sum_j C_ij r_j / sum_j n_ij r_j^2 over the others j who met i, with C_ij the centred agreement
    and n_ij the items in common; both sums are taken through the items.
    """
    k = len(CLASSES)
    people = cast.groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.array(*((F.count_if(F.col("label") == c) + 1) / (F.count(F.lit(1)) + k) for c in CLASSES)).alias("habit"))
    people = cut_lineage(people.withColumn("r", F.lit(0.5)))
    hit = [(F.col("label") == c).cast("double") - F.col("habit")[i] for i, c in enumerate(CLASSES)]
    centred = cut_lineage(cast.join(people.select("person", "habit"), "person").select("item", "person", *(h.alias(f"e{i}") for i, h in enumerate(hit))))
    for _ in range(steps):
        weighted = centred.join(people.select("person", "r"), "person")
        items = weighted.groupBy("item").agg(*_sums([F.col(f"e{i}") * F.col("r") for i in range(k)], [f"s{i}" for i in range(k)]), F.sum(F.col("r") * F.col("r")).alias("m"))
        back = weighted.join(items, "item").groupBy("person").agg(
            F.sum(sum((F.col(f"e{i}") * (F.col(f"s{i}") - F.col(f"e{i}") * F.col("r")) for i in range(k)), F.lit(0.0))).alias("up"),
            F.sum(F.col("m") - F.col("r") * F.col("r")).alias("down"))
        step = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.coalesce(F.try_divide("up", F.when(F.col("down") > 1e-9, F.col("down"))), F.lit(0.3))))
        # half a step: with few items in common a whole one can swing between two states
        people = cut_lineage(people.join(back, "person", "left").select("person", "n", "habit", ((F.col("r") + step) / 2).alias("r")))
    return people


def _decide(cast: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, c0..c3): probability of each label; weights (person, label, w0..w3) are the votes' log-weights."""
    k = len(CLASSES)
    total = cast.join(weights, ["person", "label"]).groupBy("item").agg(*_sums([F.col(f"w{i}") for i in range(k)], [f"t{i}" for i in range(k)]))
    top = F.greatest(*(F.col(f"t{i}") for i in range(k)))
    shares = [F.exp(F.col(f"t{i}") - top) for i in range(k)]
    return total.select("item", *((x / sum(shares[1:], shares[0])).alias(f"c{i}") for i, x in enumerate(shares)))


def _by_joins(cast: DataFrame, steps: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    k = len(CLASSES)
    people = competences(cast, steps)
    each_label = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.lit(i).alias("i")) for i, c in enumerate(CLASSES)))).alias("l")
    # four numbers: the labels' shares; what is left of perfect agreement when chance is taken away scales the vector
    counts = cast.agg(*(F.count_if(F.col("label") == c) for c in CLASSES)).first()
    reach = max(0.05, 1 - sum((n / max(1, sum(counts))) ** 2 for n in counts)) ** 0.5
    skilled = cut_lineage(people.withColumn("competence", F.least(F.lit(0.97), F.greatest(F.lit(0.02), F.col("r") / reach))))
    # one weight for every label: the log odds of a right vote
    right = F.col("competence") + (1 - F.col("competence")) / k
    odds = F.log(right * (k - 1) / (1 - right))
    cells = skilled.select("person", "competence", "habit", each_label).select("person", "competence", "habit", "l.*")
    weights = cells.select("person", "label", *(F.when(F.col("i") == i, odds).otherwise(0.0).alias(f"w{i}") for i in range(k)))
    belief = cut_lineage(_decide(cast, weights))
    for _ in range(rounds):
        # habits: how often each person gives a label where the consensus says another, drawn to the model's expectation
        seen = cast.join(belief, "item").groupBy("person", "label").agg(*_sums([F.col(f"c{i}") for i in range(k)], [f"n{i}" for i in range(k)]))
        base = belief.agg(*(F.sum(f"c{i}") for i in range(k)), F.count(F.lit(1))).first()
        full = cells.join(seen, ["person", "label"], "left").fillna(0.0, [f"n{i}" for i in range(k)])
        sums = seen.groupBy("person").agg(*_sums([F.col(f"n{i}") for i in range(k)], [f"a{i}" for i in range(k)]))
        guess = (1 - F.col("competence")) * F.expr("habit[i]")
        chance = [((F.col(f"n{i}") + PRIOR * (guess + F.when(F.col("i") == i, F.col("competence")).otherwise(0.0))) / (F.col(f"a{i}") + PRIOR)) for i in range(k)]
        prior = [math.log(((b or 0) + 1) / (base[k] + k)) for b in base[:k]]
        weights = full.join(sums, "person").select("person", "label", *(F.log(c).alias(f"w{i}") for i, c in enumerate(chance)))
        scores = cast.join(weights, ["person", "label"]).groupBy("item").agg(*_sums([F.col(f"w{i}") for i in range(k)], [f"t{i}" for i in range(k)]))
        scores = scores.select("item", *((F.col(f"t{i}") + prior[i]).alias(f"t{i}") for i in range(k)))
        top = F.greatest(*(F.col(f"t{i}") for i in range(k)))
        parts = [F.exp(F.col(f"t{i}") - top) for i in range(k)]
        belief = cut_lineage(scores.select("item", *((x / sum(parts[1:], parts[0])).alias(f"c{i}") for i, x in enumerate(parts))))
    best = F.greatest(*(F.col(f"c{i}") for i in range(k)))
    name = F.coalesce(*(F.when(F.col(f"c{i}") == best, F.lit(c)) for i, c in enumerate(CLASSES)))
    items = cast.join(belief.select("item", name.alias("best"), best.alias("confidence")), "item").groupBy("item").agg(
        F.first("best").alias("label"), F.first("confidence").alias("confidence"), F.count(F.lit(1)).alias("votes"), F.avg((F.col("label") == F.col("best")).cast("double")).alias("agreement"))
    own = cast.join(belief, "item").groupBy("person").agg(F.avg(sum((F.when(F.col("label") == c, F.col(f"c{i}")).otherwise(0.0) for i, c in enumerate(CLASSES)), F.lit(0.0))).alias("reliability"))
    pairs = cast.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("item").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return items.join(pairs, "item"), skilled.join(own, "person").select("person", F.col("n").alias("n_votes"), "competence", "reliability")


def _gathered(cast: DataFrame, names: list[str]) -> DataFrame:
    """(item, votes array<int>): the votes of each item, as 4 * annotator + label; an annotator has few per item."""
    spark, k = cast.sparkSession, len(CLASSES)
    numbers = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "person string, p int"))  # MOST_PEOPLE at most
    label = F.coalesce(*(F.when(F.col("label") == c, F.lit(i)) for i, c in enumerate(CLASSES)))
    return cut_lineage(cast.join(numbers, "person").select("item", (F.col("p") * k + label).alias("v")).groupBy("item").agg(F.sort_array(F.collect_list("v")).alias("votes")))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """(votes, the item of each, number of items) of a batch."""
    lists = batch.column(batch.schema.get_field_index("votes"))
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), len(lists)


def _summed(items: DataFrame, size: int, numbers: np.ndarray, add: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """One pass over the items: `size` sums of what add(numbers, votes, item of each, items) gives for each batch."""
    sent = items.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += add(sent.value, *_flat(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "x"])

    out = np.zeros(size)
    for r in items.mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    sent.unpersist()
    return out


def _beliefs(weights: np.ndarray, v: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """The probability of each label for each item: weights has a row of log-weights per vote kind, and the prior last."""
    k = len(CLASSES)
    t = np.stack([np.bincount(item, weights[v, i], n) for i in range(k)], axis=1) + weights[-1]
    t = np.exp(t - t.max(axis=1, keepdims=True))
    return t / t.sum(axis=1, keepdims=True)


def _by_passes(cast: DataFrame, counts: list[tuple[str, list[int]]], steps: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    k, spark = len(CLASSES), cast.sparkSession
    names, said = [name for name, _ in counts], np.array([c for _, c in counts], float).reshape(-1, k)
    people, n = len(names), said.sum(axis=1)
    items = _gathered(cast, names)
    habit = (said + 1) / (n + k)[:, None]

    def agreed(numbers: np.ndarray, v: np.ndarray, item: np.ndarray, m: int) -> np.ndarray:
        p, own = v // k, numbers[v // k, 0]
        e = (v % k)[:, None] == np.arange(k)
        e = e - numbers[p, 1:]
        s = np.stack([np.bincount(item, e[:, i] * own, m) for i in range(k)], axis=1)
        up = (e * (s[item] - e * own[:, None])).sum(axis=1)
        down = np.bincount(item, own * own, m)[item] - own * own
        return np.concatenate([np.bincount(p, up, people), np.bincount(p, down, people)])

    r = np.full(people, 0.5)
    for _ in range(steps if people else 0):
        sums = _summed(items, 2 * people, np.column_stack([r, habit]), agreed)
        step = np.divide(sums[:people], sums[people:], out=np.full(people, 0.3), where=sums[people:] > 1e-9)
        r = (r + np.clip(step, -0.99, 0.99)) / 2  # half a step: with few items in common a whole one can swing between two states
    # what is left of perfect agreement when chance is taken away scales the vector
    reach = max(0.05, 1 - float(((said.sum(axis=0) / max(1.0, n.sum())) ** 2).sum())) ** 0.5
    competence = np.clip(r / reach, 0.02, 0.97)
    # one weight for every label: the log odds of a right vote
    right = competence + (1 - competence) / k
    weights = np.vstack([np.kron(np.log(right * (k - 1) / (1 - right))[:, None], np.eye(k)), np.zeros(k)])

    def seen(numbers: np.ndarray, v: np.ndarray, item: np.ndarray, m: int) -> np.ndarray:
        belief = _beliefs(numbers, v, item, m)
        by_vote = [np.bincount(v, belief[item, i], people * k) for i in range(k)]
        return np.concatenate([np.stack(by_vote, axis=1).ravel(), belief.sum(axis=0)])

    expected = competence[:, None, None] * np.eye(k) + (1 - competence)[:, None, None] * habit[:, :, None]
    for _ in range(rounds if people else 0):
        # habits: how often each person gives a label where the consensus says another, drawn to the model's expectation
        sums = _summed(items, people * k * k + k, weights, seen)
        shown, base = sums[: people * k * k].reshape(people, k, k), sums[people * k * k :]
        chance = (shown + PRIOR * expected) / (shown.sum(axis=1, keepdims=True) + PRIOR)
        weights = np.vstack([np.log(chance).reshape(people * k, k), np.log((base + 1) / (base.sum() + k))])
    shown = _summed(items, people * k * k + k, weights, seen)[: people * k * k].reshape(people, k, k) if people else np.zeros((0, k, k))
    reliability = np.einsum("pkk->p", shown) / np.maximum(1, n)
    sent = spark.sparkContext.broadcast(weights)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, item, m = _flat(batch)
            belief = _beliefs(sent.value, v, item, m)
            best, each = belief.argmax(axis=1), np.bincount(item * k + v % k, minlength=m * k).reshape(m, k)
            total = each.sum(axis=1)
            arrays = [batch.column(0), pa.array([CLASSES[i] for i in best], pa.string()), pa.array(belief.max(axis=1)), pa.array(total), pa.array(each[np.arange(m), best] / total), pa.array((each * (each - 1)).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "label", "confidence", "votes", "agreement", "same"])

    found = items.mapInArrow(decide, "item string, label string, confidence double, votes long, agreement double, same long")
    rows = [(names[i], int(n[i]), float(competence[i]), float(reliability[i])) for i in range(people)]
    return found, spark.createDataFrame(rows, "person string, n_votes long, competence double, reliability double")


def consensus(passes: DataFrame, *, steps: int = STEPS, rounds: int = ROUNDS, most_people: int = MOST_PEOPLE) -> tuple[DataFrame, DataFrame]:
    """(items, people).

    items (item, label, confidence, votes, agreement, same): the consensus, its probability, the number of votes, the
    share of them that chose it and the ordered pairs of them that agree; one row per item with a usable label, ties go to
    the first label in the fixed order. people (person, n_votes, competence, reliability): competence is the eigenvector's
    entry, reliability the expected share of right labels. Null and unusable labels count nowhere; an empty table gives
    empty results.
    """
    cast = cut_lineage(votes(passes).withColumn("item", F.col("item").cast("string")))
    counts = cast.groupBy("person").agg(*(F.count_if(F.col("label") == c).alias(f"c{i}") for i, c in enumerate(CLASSES)))
    few = sorted((r[0], list(r[1:])) for r in counts.limit(most_people + 1).collect())
    return _by_passes(cast, few, steps, rounds) if len(few) <= most_people else _by_joins(cast, steps, rounds)


def chance_corrected(same: F.Column, votes_: F.Column, chance: F.Column) -> F.Column:
    """(observed - chance) / (1 - chance) agreement of pairs of votes; null for a single vote or where chance is complete."""
    observed = same / F.nullif(votes_ * (votes_ - 1), F.lit(0))
    return (observed - chance) / F.nullif(1 - chance, F.lit(0.0))


def overall_agreement(passes: DataFrame) -> DataFrame:
    """One row (n_items, n_votes, observed, chance, alpha): agreement of all items with two votes or more.

    observed is the share of agreeing pairs, every vote counting alike; chance that of any two of these votes, without
    replacement; alpha is what observed exceeds chance by, as a share of what is left. Null without two votes.
    """
    each = votes(passes).groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = each.groupBy("item").agg(F.sum("c").alias("m"), *(F.coalesce(F.sum(F.when(F.col("label") == c, F.col("c"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(CLASSES)), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m >= 2")
    k = range(len(CLASSES))
    sums = items.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_votes"), F.sum(F.col("same") / (F.col("m") - 1)).alias("a"), *(F.sum(f"c{i}").alias(f"t{i}") for i in k))
    n = F.col("n_votes")
    sums = sums.select("n_items", "n_votes", (F.col("a") / n).alias("observed"), (sum((F.col(f"t{i}") * (F.col(f"t{i}") - 1) for i in k), F.lit(0)) / F.nullif(n * (n - 1), F.lit(0))).alias("chance"))
    alpha = (F.col("observed") - F.col("chance")) / F.nullif(1 - F.col("chance"), F.lit(0.0))
    return sums.select("n_items", "n_votes", *(F.round(c, 9).alias(c) for c in ("observed", "chance")), F.round(alpha, 9).alias("alpha"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus(table(spark, sf_dir, "annotation_passes"))
    return items.select(F.col("item").alias("pair_id"), F.col("label").alias("conflict_type"))


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the consensus, its probability, the share of votes for it, and the votes' agreement beyond chance."""
    passes = table(spark, sf_dir, "annotation_passes")
    items, _ = consensus(passes)
    kappa = chance_corrected(F.col("same"), F.col("votes"), F.lit(overall_agreement(passes).first()["chance"]).cast("double"))
    return items.select(F.col("item").alias("pair_id"), F.col("label").alias("conflict_type"), F.round("confidence", 6).alias("confidence"), "votes", F.round("agreement", 6).alias("agreement"), F.round(kappa, 6).alias("beyond_chance"))


def p3_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_agreement(table(spark, sf_dir, "annotation_passes"))


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, people = consensus(table(spark, sf_dir, "annotation_passes"))
    return people.select(F.col("person").alias("annotator_id"), "n_votes", F.round("competence", 6).alias("competence"), F.round("reliability", 6).alias("reliability"))


def _label_sql(x: str) -> str:
    plain = rf"lower(regexp_replace(trim({x}), '[\s\-_]+', '_', 'g'))"
    return f"CASE WHEN {plain} IN ({', '.join(map(repr, CLASSES))}) THEN {plain} END"


SQL = {
    "p3_overall": f"""WITH own AS (SELECT pair_id AS item, coalesce(nullif(upper(trim(annotator_id)), ''), '?') AS person, coalesce(nullif(upper(trim(review.reviewer_id)), ''), '?') AS reviewer, lower(trim(review.decision)) AS decision,
  {_label_sql('conflict_type')} AS now, {_label_sql('review.original_conflict_type')} AS was, revision, loaded_at, pass_no FROM annotation_passes WHERE pair_id IS NOT NULL),
last AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY item, person ORDER BY revision DESC NULLS LAST, loaded_at DESC NULLS LAST, pass_no DESC) = 1),
votes AS (SELECT DISTINCT * FROM (SELECT item, person, CASE WHEN coalesce(decision IN ('revise', 'reject'), FALSE) THEN was ELSE now END AS label FROM last UNION ALL SELECT item, reviewer, CASE WHEN decision IN ('accept', 'revise') THEN now END FROM last) WHERE label IS NOT NULL),
c AS (SELECT item, label, count(*) AS c FROM votes GROUP BY ALL), i AS (SELECT item, sum(c) AS m, sum(c * (c - 1)) AS same FROM c GROUP BY item HAVING sum(c) >= 2),
t AS (SELECT label, sum(c) AS t FROM c SEMI JOIN i USING (item) GROUP BY label), n AS (SELECT count(*) AS n_items, coalesce(sum(m), 0)::BIGINT AS n_votes, sum(same::DOUBLE / (m - 1)) / sum(m) AS observed FROM i),
x AS (SELECT *, (SELECT sum(t * (t - 1))::DOUBLE FROM t) / nullif(n_votes::DOUBLE * (n_votes - 1), 0) AS chance FROM n)
SELECT n_items, n_votes, round(observed, 9) AS observed, round(chance, 9) AS chance, round((observed - chance) / nullif(1 - chance, 0), 9) AS alpha FROM x"""
}
