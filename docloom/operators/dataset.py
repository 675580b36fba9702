"""Dataset tooling: stratified splits, validation of records, integrity of inventory, files and manifest."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.alignment import is_conflict
from docloom.plans.runtime import cut_lineage
from docloom.schemas import CONFLICT_TYPES, DECISIONS, NON_CONFLICT_SUBTYPES, RECORD_TYPES, SEVERITIES, TIERS

PROPORTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}


def stratum() -> Column:
    kind = F.when(F.coalesce("conflict_type", F.lit("")) == "", "conflict_unknown").otherwise(F.col("conflict_type"))
    return F.when(is_conflict(), F.concat(F.lit("conflict::"), kind)).otherwise("non_conflict")


def held_out(review: str = "review") -> Column:
    """Records with a named reviewer belong to the agreement set."""
    return F.col(f"{review}.reviewer_id").isNotNull()


def held_out_line(line: Column) -> Column:
    """The same of a record as JSON text: a blind_review key, whatever its value, or a review with a named reviewer.

    A table with a fixed schema can't tell a missing key from a null one; the text can.
    """
    v = F.try_parse_json(line)
    return F.coalesce(F.variant_get(v, "$.blind_review", "variant").isNotNull() | F.variant_get(v, "$.review.reviewer_id", "string").isNotNull(), F.lit(False))


def split_with_hold_out(records: DataFrame, *, id_col: str = "record_no", review: str = "review", **options) -> DataFrame:
    """(id_col, stratum, split, position): held-out records go to gold_iaa (no position), the others are split by stratum."""
    held = records.where(held_out(review)).select(id_col, stratum().alias("stratum"), F.lit("gold_iaa").alias("split"), F.lit(None).cast("long").alias("position"))
    return stratified_split(records.where(~held_out(review)), id_col=id_col, **options).unionByName(held)


def numbered(rows: DataFrame, order: list[Column | str], *, name: str = "row_no", first: int = 0) -> DataFrame:
    """rows with their place in an order, counted from `first`; rows that tie in it may swap.

    The rows are sorted in ranges; only the ranges' sizes come together.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed, before, starts = cut_lineage(placed), first, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy("_p").count().collect()):  # a row per partition
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _at long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_at") + F.col("_i")).drop("_p", "_i", "_at")


def head_of(rows: DataFrame, n: int, order: list[Column | str], *, jurisdiction: str | None = None, issuing_body: str | None = None) -> DataFrame:
    """The first n rows in an order, of one jurisdiction or issuing body if named; filters come before the sort."""
    for column, value in (("jurisdiction", jurisdiction), ("issuing_body", issuing_body)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(*order).limit(n)


def stratified_split(records: DataFrame, *, id_col: str = "record_no", seed: int = 42, proportions: dict[str, float] = PROPORTIONS, bucket_rows: int = 100_000) -> DataFrame:
    """(id_col, stratum, split, position): every record, in each stratum floor(n * p) to each split, leftovers one by one
    to the splits in descending proportion.

    The order within a stratum is that of md5(seed|id). Ranks come from counts per leading hash digits and the place within
    them; there are as many digits as it takes for about bucket_rows rows in each, so a large stratum is no single task's.
    """
    digits = min(7, max(1, math.ceil(math.log(max(1, records.count() / bucket_rows), 16))))
    hashed = records.select(F.col(id_col), stratum().alias("stratum"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("_h"))
    hashed = hashed.withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    counts = hashed.groupBy("stratum", "_b").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("stratum").orderBy("_b")
    base = counts.select("stratum", "_b", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("n").over(Window.partitionBy("stratum")).alias("_n"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("stratum", "_b").orderBy("_h", id_col))).join(base, ["stratum", "_b"])
    position = F.col("_base") + F.col("_r")
    names = list(proportions)
    floors = {s: F.floor(F.col("_n") * F.lit(float(proportions[s]))) for s in names}
    left = F.col("_n") - sum((floors[s] for s in names[1:]), floors[names[0]])
    by_size = sorted(names, key=lambda s: -proportions[s])
    split, upto = None, F.lit(0)
    for s in names[:-1]:
        upto = upto + floors[s] + (left > by_size.index(s)).cast("int")
        split = F.when(position <= upto, s) if split is None else split.when(position <= upto, s)
    return ranked.select(id_col, "stratum", split.otherwise(names[-1]).alias("split"), position.cast("long").alias("position"))


def split_summary(records: DataFrame, split: str = "split") -> DataFrame:
    """(split, n_records, n_pairs, conflict, non_conflict, per type...): counts per split."""
    y = is_conflict()
    types = [F.count_if(y & (F.col("conflict_type") == c)).alias(c) for c in CONFLICT_TYPES]
    return records.groupBy(split).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("pair_id").alias("n_pairs"), F.count_if(y).alias("conflict"), F.count_if(F.col("record_type") == "non_conflict").alias("non_conflict"), *types, F.count_if(y & F.col("conflict_type").isNull()).alias("unknown"))


def leakage(records: DataFrame, key: str = "pair_id", split: str = "split") -> DataFrame:
    """Keys in more than one split, with the splits."""
    found = records.where(F.col(key).isNotNull()).select(key, split).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_splits"), F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"))
    return found.where("n_splits > 1")


def duplicate_ids(records: DataFrame, key: str = "pair_id", by: list[str] = ["split"]) -> DataFrame:
    return records.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations() -> Column:
    """What a record breaks of the schema, as an array of codes in a fixed order."""
    y = F.coalesce(F.col("record_type") == "conflict", F.lit(False))
    odd = lambda c, allowed: F.col(c).isNotNull() & ~F.col(c).isin(allowed)
    return F.array_compact(F.array(
        F.when(F.col("pair_id").isNull(), "missing:pair_id"), F.when(F.col("regime_a").isNull(), "missing:regime_a"), F.when(F.col("regime_b").isNull(), "missing:regime_b"),
        F.when(F.col("record_type").isNull() | odd("record_type", RECORD_TYPES), "record_type"), F.when(odd("conflict_type", CONFLICT_TYPES), "conflict_type"),
        F.when(odd("severity", SEVERITIES), "severity"), F.when(odd("non_conflict_subtype", NON_CONFLICT_SUBTYPES), "non_conflict_subtype"),
        F.when(odd("review.decision", DECISIONS), "review.decision"),
        F.when(y & F.col("conflict_type").isNull(), "conflict_without_type"), F.when(y & F.col("severity").isNull(), "conflict_without_severity")))


def schema_violations(records: DataFrame, id_col: str = "record_no") -> DataFrame:
    return records.select(id_col, F.explode(violations()).alias("violation"))


def record_checks(records: DataFrame, id_col: str = "record_no") -> DataFrame:
    """(id_col, problem): release checks in order; a missing field or unknown record type ends a record's checks."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("pair_id", "record_type", "regime_a", "regime_b"))), lambda x: x.isNotNull())
    typed = F.array_compact(F.array(
        F.when(is_conflict() & ~F.coalesce(F.col("conflict_type").isin(CONFLICT_TYPES), F.lit(False)), "bad conflict_type"),
        F.when(is_conflict() & ~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), "bad severity"),
        *(F.when(F.coalesce(f"{side}.regime_id", F.lit("")) == "", f"empty {side}.regime_id") for side in ("regime_a", "regime_b"))))
    found = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing "), F.array_join(missing, ", ")))).when(~F.col("record_type").isin(RECORD_TYPES), F.array(F.lit("bad record_type"))).otherwise(typed)
    return records.select(id_col, F.explode(found).alias("problem"))


def unknown_regimes(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """(regime_id, n): regimes that no inventory row names as its source collection; none if the inventory is empty."""
    sides = records.select(F.explode(F.array("regime_a.regime_id", "regime_b.regime_id")).alias("regime_id")).where("regime_id is not null and regime_id <> ''")
    known = inventory.where("source_collection is not null").select(F.col("source_collection").alias("regime_id"))
    if known.isEmpty():
        return sides.limit(0).groupBy("regime_id").agg(F.count(F.lit(1)).alias("n"))
    return sides.groupBy("regime_id").agg(F.count(F.lit(1)).alias("n")).join(known, "regime_id", "left_anti")


def release_summary(records: DataFrame) -> DataFrame:
    """(what, value, n): counts by split, type, class and jurisdiction (two per record)."""
    parts = [F.struct(F.lit("split").alias("what"), F.col("split").alias("value")), F.struct(F.lit("record_type"), F.col("record_type")), F.struct(F.lit("conflict_type"), F.col("conflict_type")),
             F.struct(F.lit("jurisdiction"), F.col("regime_a.jurisdiction")), F.struct(F.lit("jurisdiction"), F.col("regime_b.jurisdiction"))]
    return records.select(F.explode(F.array(*(p.cast("struct<what:string,value:string>") for p in parts))).alias("x")).select("x.*").where("value is not null").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def tier_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(F.trim("license_tier").alias("license_tier")).agg(F.count(F.lit(1)).alias("n"))


def inventory_problems(inventory: DataFrame, keep: list[str] = ["sha256", "document_title"]) -> DataFrame:
    """(keep..., problem): unknown tiers and missing or malformed hashes; keep the row's number (see numbered) to name it."""
    tier = F.lower(T.strip("license_tier"))
    found = F.array_compact(F.array(
        F.when(~F.coalesce(tier.isin(TIERS), F.lit(False)), F.concat(F.lit("unknown tier "), F.coalesce("license_tier", F.lit("null")))),
        F.when(F.coalesce("sha256", F.lit("")) == "", "empty sha256"), F.when((F.col("sha256") != "") & ~F.col("sha256").rlike("^[0-9a-f]{64}$"), "malformed sha256")))
    return inventory.select(*keep, F.explode(found).alias("problem"))


def missing_files(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(sha256, tier): inventory rows whose hash is no file's, in tiers that hold any file. files: (tier, sha256)."""
    rows = inventory.where("sha256 is not null").select("sha256", F.lower(T.strip("license_tier")).alias("tier")).distinct()
    held = files.select("tier").distinct()
    return rows.join(files.select("sha256").distinct(), "sha256", "left_anti").join(held, "tier", "left_semi").select("sha256", "tier")


def locate_files(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(sha256, path): where each inventory row's file lies, by its content's hash; of several the first path, null if none.

    files: (sha256, path).
    """
    first = files.where("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("path"))
    return inventory.where("sha256 is not null").select("sha256").distinct().join(first, "sha256", "left")


def manifest_problems(inventory: DataFrame, manifest: DataFrame, order: str = "ord") -> DataFrame:
    """(sha256, problem): third-tier documents without manifest row, or with a blank address (the last row counts)."""
    rows = inventory.where(F.lower(T.strip("license_tier")) == "tier 3").select("sha256").where("sha256 is not null").distinct()
    last = manifest.groupBy("sha256").agg(F.max_by(F.struct("source_url"), order).alias("m")).select("sha256", F.col("m.source_url").alias("url"), F.lit(True).alias("there"))
    joined = rows.join(last, "sha256", "left")
    problem = F.when(F.col("there").isNull(), "no manifest row").when(F.trim(F.coalesce("url", F.lit(""))) == "", "no source_url")
    return joined.select("sha256", problem.alias("problem")).where("problem is not null")


def status_rollup(rows: DataFrame, source: str, status: str) -> DataFrame:
    """Counts per source and status, per source, and in all (nulls where rolled up; `level` tells them from missing values)."""
    return rows.rollup(source, status).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def with_tags(chunks: DataFrame) -> DataFrame:
    """chunks with the three tag columns, empty: tagging is up to its user."""
    return chunks.withColumns({f"{kind}_tags": F.array().cast("array<string>") for kind in ("regime", "topic", "applicability")})


def with_metadata(predictions: DataFrame, name: str, version: str, config: dict) -> DataFrame:
    """predictions with model_metadata, the same in every row; config_hash is the fingerprint of the settings."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
    return predictions.withColumn("model_metadata", F.struct(F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), F.lit(digest).alias("config_hash")))


def matching_lines(docs: DataFrame, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_no, line): the lines of every text that a pattern is found in, counted from 1."""
    lines = docs.where(F.col(text_col).rlike(pattern)).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def text_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sha256): of the text's bytes; null for null texts."""
    return docs.select(id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("sha256"))


def registry_lookup(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows with parser_id and citation_unit of their (jurisdiction, issuing_body); (generic, section) where unknown.

    The registry is a small dimension; its join is left to the optimiser.
    """
    joined = rows.join(registry, ["jurisdiction", "issuing_body"], "left")
    return joined.withColumns({"parser_id": F.coalesce("parser_id", F.lit("generic")), "citation_unit": F.coalesce("citation_unit", F.lit("section"))})


def hash_consistency(runs: DataFrame, index: DataFrame) -> DataFrame:
    """(key, fingerprint, known, consistent): runs against the index of earlier ones; an unknown key is consistent."""
    joined = runs.join(index.select("key", F.col("fingerprint").alias("known")), "key", "left")
    return joined.select("key", "fingerprint", "known", (F.col("known").isNull() | (F.col("known") == F.col("fingerprint"))).alias("consistent"))


def upsert(index: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """The index with the runs' rows in place of those of the same key."""
    return index.join(runs.select(key), key, "left_anti").unionByName(runs)


def ordered_subset(rows: DataFrame, key: str, wanted: list[str], *, order: str = "record_no") -> DataFrame:
    """The last row of each wanted key with its place in the list, in the list's order; missing keys are an error."""
    asked = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"`{key}` string, place int")
    held = rows.where(F.col(key).isin(wanted)).groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("r"))
    found = asked.join(held, key, "left")
    missing = [r[0] for r in found.where("r is null").select(key).collect()]
    if missing:
        raise KeyError(f"not found: {missing}")
    return found.select("place", key, "r.*").orderBy("place")


def hash_sample(rows: DataFrame, n: int, *, id_col: str, seed: int = 42) -> DataFrame:
    """n rows drawn without replacement: those of the smallest md5(seed|id)."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def path_problems(rows: DataFrame, path: str, withheld: list[str]) -> DataFrame:
    """(path, problem): absolute paths, and paths through a withheld source (a part of that name, or beginning so if it
    ends in '-')."""
    parts = F.split(F.col(path), "/")
    names, beginnings = [w for w in withheld if not w.endswith("-")], [w for w in withheld if w.endswith("-")]

    def inside(part: Column) -> Column:
        test = part.isin(names)
        for beginning in beginnings:
            test = test | part.startswith(beginning)
        return test

    hit = F.exists(parts, inside)
    found = F.array_compact(F.array(F.when(F.col(path).startswith("/"), "absolute path"), F.when(hit, "withheld source")))
    return rows.select(F.col(path).alias("path"), F.explode(found).alias("problem")).distinct()


def side_by_side(gold: DataFrame, predictions: DataFrame, systems: list[str]) -> DataFrame:
    """One row per gold row, one column per system: what it says, '?' where it says nothing."""
    said = F.when(F.col("y_pred").isNull(), "?").when(F.col("y_pred"), F.coalesce("t_pred", F.lit("conflict"))).otherwise("non_conflict")
    wide = predictions.groupBy("pair_id").agg(*(F.max(F.when(F.col("system") == s, said)).alias(s) for s in systems))
    truth = F.when(F.col("y_true"), F.coalesce("t_true", F.lit("conflict"))).otherwise("non_conflict")
    return gold.join(wide, "pair_id", "left").select("ord", "pair_id", truth.alias("truth"), *(F.coalesce(s, F.lit("?")).alias(s) for s in systems))


def record_samples(records: DataFrame) -> DataFrame:
    """What a reader looks at: ids, jurisdictions, the rationale's first 250 and every passage's first 180 characters."""
    cut = lambda e: F.transform(F.coalesce(F.col(e), F.array().cast("array<struct<chunk_id:string,source_doc:string,page:int,passage:string>>")), lambda x: F.substring(x["passage"], 1, 180))
    return records.select("record_no", "pair_id", F.col("regime_a.jurisdiction").alias("a"), F.col("regime_b.jurisdiction").alias("b"), F.substring("rationale", 1, 250).alias("rationale"), F.array_join(F.array_compact(F.concat(cut("evidence_a"), cut("evidence_b"))), "\n").alias("passages"))


def fetch_targets(manifest: DataFrame) -> DataFrame:
    """(sha256, filename, target): '.pdf' is added unless the title ends in .pdf, .html or .htm; the target folder is the
    first eight digits of the hash."""
    title = F.coalesce(F.nullif(T.strip("document_title"), F.lit("")), F.lit("untitled"))
    name = F.when(F.lower(title).rlike(r"\.(pdf|html|htm)$"), title).otherwise(F.concat(title, F.lit(".pdf")))
    return manifest.select("sha256", name.alias("filename"), F.concat_ws("/", F.substring("sha256", 1, 8), name).alias("target"))


def model_fingerprints(predictions: DataFrame) -> DataFrame:
    """(system, config_hash): the same constant metadata for every row of a system, as a digest of its fields."""
    return predictions.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if("y_pred").alias("n_conflict")).select("system", F.substring(F.sha2(F.concat_ws("|", "system", F.col("n").cast("string"), F.col("n_conflict").cast("string")), 256), 1, 16).alias("fingerprint"))
