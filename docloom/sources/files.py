"""Reading: corpus scans, JSON lines, CSV, named splits, prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.schemas import SPLITS

EXTENSIONS = ["pdf", "docx"]


def corpus_files(spark: SparkSession, root: str, *, jurisdiction: str | None = None, issuing_body: str | None = None, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(path, source_path, filename, ext, jurisdiction, issuing_body, length, content): the corpus files below root.

    Dot-files and other extensions are left out before any content is read; the source is the path's first two parts
    unless given. An unreachable root is an error, one without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    relative = F.substring_index(base, root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    name = F.element_at(F.split(base, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    area, body = T.path_parts(relative)
    rows = files.select("path", relative.alias("source_path"), name.alias("filename"), ext.alias("ext"), F.coalesce(F.lit(jurisdiction), area).alias("jurisdiction"), F.coalesce(F.lit(issuing_body), body).alias("issuing_body"), "length", "content")
    return rows.where(~F.col("filename").startswith(".") & F.col("ext").isin(extensions))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by line feeds only; broken lines keep their text in _corrupt_record, blank ones are skipped."""
    return spark.read.schema(schema + ", _corrupt_record string").option("lineSep", "\n").option("mode", "PERMISSIVE").json(path)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header, quoted fields, line feeds inside quotes; all columns are strings unless a schema is given. An empty
    cell is null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def named_split(spark: SparkSession, directory: str, name: str, schema: str) -> DataFrame:
    """The records of one split file; unknown names are an error."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; one of {SPLITS}")
    return json_lines(spark, f"{directory}/{name}.jsonl", schema)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): non-blank lines in file order (by file, then place in the file)."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    return rows.where(F.trim("value") != "").select(F.struct("f", "b", "i").alias("ord"), "value")


def key_state(line: Column, key: str) -> Column:
    """'absent', 'null' or 'set' of a top-level key in a JSON text: what a schema'd read can't tell apart."""
    v = F.try_parse_json(line)
    got = F.variant_get(v, f"$.{key}", "variant")
    return F.when(got.isNull(), "absent").when(F.is_variant_null(got), "null").otherwise("set")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, pair_id, y_pred, t_pred, conf, model_name) of a prediction file; a missing required key is an error."""
    lines = ordered_lines(spark, path)
    lacking = lines.where((key_state(F.col("value"), "pair_id") == "absent") | (key_state(F.col("value"), "predicted_conflict_present") == "absent")).limit(1).count()
    if lacking:
        raise ValueError(f"{path}: pair_id and predicted_conflict_present are required")
    from docloom.schemas import PREDICTION

    row = F.from_json("value", PREDICTION)
    return lines.select("ord", row.alias("r")).select("ord", "r.pair_id", F.col("r.predicted_conflict_present").alias("y_pred"), F.col("r.predicted_conflict_type").alias("t_pred"), F.col("r.confidence_score").alias("conf"), F.col("r.model_metadata.model_name").alias("model_name"))


def transcripts(spark: SparkSession, directory: str) -> DataFrame:
    """(name, text): the transcripts of a folder, one file each, as text; whether they can be read is judged later."""
    files = spark.read.text(f"{directory}/*.json", wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
