"""Further queries: sources and sinks by round trips through the shared folder, splits, transcripts, prompts, training."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import prompts as P
from docloom.functions import replies
from docloom.operators import alignment, dataset, evaluation, ingestion, training, vectors
from docloom.plans import views as V
from docloom.plans.queries import _CHECKS, _OUTCOMES, _SIGNS, _SPLIT, _outcomes, query
from docloom.plans.runtime import scratch, table
from docloom.sources import extract, files, sinks

# -- sources and sinks -------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "trip")


@query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in ("sha256", "license_tier", "source_collection", "document_title", "filename")) + " FROM inventory")
def csv_round_trip(spark, d):
    """An empty cell is read as null."""
    path, names = _folder(spark), ["sha256", "license_tier", "source_collection", "document_title", "filename"]
    sinks.write_csv(table(spark, d, "inventory").select(*names), path)
    return files.csv_table(spark, path)


@query("SELECT pair_id, record_type, regime_a.regime_id AS regime_a, coalesce(len(evidence_a), 0) AS n_evidence, review.decision AS decision, rationale FROM labelled_pairs")
def json_lines_scan(spark, d):
    path = _folder(spark)
    V.records(spark, d).write.json(path)
    rows = files.json_lines(spark, path, schemas.LABELLED_PAIR).where("pair_id is not null or _corrupt_record is null")
    return rows.select("pair_id", "record_type", F.col("regime_a.regime_id").alias("regime_a"), F.coalesce(F.size("evidence_a"), F.lit(0)).cast("long").alias("n_evidence"), F.col("review.decision").alias("decision"), "rationale")


@query("SELECT pair_id, record_type, conflict_type FROM labelled_pairs WHERE split = 'val'")
def named_split_scan(spark, d):
    path = _folder(spark)
    for split in ("train", "val"):
        V.records(spark, d).where(F.col("split") == split).write.json(f"{path}/{split}.jsonl")
    return files.named_split(spark, path, "val", schemas.LABELLED_PAIR).select("pair_id", "record_type", "conflict_type")


@query(f"WITH {V.predictions_sql()} SELECT pair_id, y_pred, t_pred, conf, 'made-up' AS model_name FROM pred")
def predictions_scan(spark, d):
    path = _folder(spark)
    said = V.predictions(spark, d).select("pair_id", F.col("y_pred").alias("predicted_conflict_present"), F.col("t_pred").alias("predicted_conflict_type"), F.col("conf").alias("confidence_score"))
    dataset.with_metadata(said, "made-up", "1", {}).write.json(path)
    return alignment.require_predictions(files.predictions(spark, path)).drop("ord")


@query("SELECT nullif(jurisdiction, '') AS jurisdiction, nullif(issuing_body, '') AS issuing_body, count(*) AS n, count(text) AS n_texts, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1, 2")
def chunk_sink(spark, d):
    """Chunks written below their jurisdiction and body, and read back."""
    path = _folder(spark)
    sinks.write_by_source(table(spark, d, "chunks").select("jurisdiction", "issuing_body", "chunk_id", "text"), path)
    rows = spark.read.schema("chunk_id string, text string, jurisdiction string, issuing_body string").json(path)
    return rows.groupBy("jurisdiction", "issuing_body").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_texts"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_CHECKS.replace('{signs}', _SIGNS)} SELECT doc_id, extractor, needs_reextraction, nullif(reason, '') AS reason FROM verdicts")
def quality_sink(spark, d):
    """The quality table through its CSV sink."""
    path = _folder(spark)
    checks = ingestion.with_verdict(ingestion.document_checks(table(spark, d, "extracted")))
    sinks.write_csv(checks.select("doc_id", "extractor", "needs_reextraction", F.nullif("reason", F.lit("")).alias("reason")), path)
    return files.csv_table(spark, path, "doc_id string, extractor string, needs_reextraction boolean, reason string")


@query(f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS t, CASE {V.h_sql('ext', 'doc_id')} % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'xls' END AS ext FROM documents), n AS (SELECT *, len(string_split(t, chr(10) || chr(10))) AS parts FROM f),
o AS (SELECT *, CASE ext WHEN 'pdf' THEN CASE WHEN (length(t) - 2 * (parts - 1))::DOUBLE / parts >= 50 THEN 'paragraphs' ELSE 'whole' END WHEN 'docx' THEN CASE WHEN length(t) % 2 = 1 THEN 'failed' ELSE 'whole' END ELSE '' END AS extractor FROM n)
SELECT substr(sha256(t), 1, 16) AS doc_id, ext, extractor, CASE extractor WHEN 'paragraphs' THEN parts WHEN 'whole' THEN 1 ELSE 0 END::INT AS page_count, CASE WHEN ext = 'xls' THEN 'unsupported extension: xls' WHEN extractor = 'failed' THEN 'whole: odd' END AS error FROM o""")
def extraction_tiers(spark, d):
    """Texts as files of three kinds: two tiers for one, one that fails on some for the next, none for the last."""
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "xls"))), (V.h("ext", "doc_id") % 3 + 1).cast("int"))
    name = F.col("doc_id").cast("string")
    given = table(spark, d, "documents").select(name.alias("source_path"), F.lit("EU").alias("jurisdiction"), F.lit("x").alias("issuing_body"), name.alias("filename"), ext.alias("ext"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def odd(content: bytes) -> list[str]:
        text = content.decode()
        if len(text) % 2:
            raise ValueError("odd")
        return [text]

    tiers = {"pdf": [("paragraphs", lambda c: c.decode().split("\n\n")), ("whole", lambda c: [c.decode()])], "docx": [("whole", odd)]}
    return extract.extract_documents(given, tiers).select("doc_id", "ext", "extractor", "page_count", F.get("extraction_errors", F.lit(0)).alias("error"))


_URL = f"CASE WHEN {V.h_sql('url', 'sha256')} % 5 = 0 THEN ' ' ELSE 'https://example.org/' || sha256 END"


@query(f"""WITH m AS (SELECT sha256, {_URL} AS url FROM (SELECT DISTINCT sha256 FROM inventory WHERE sha256 IS NOT NULL)), k AS (SELECT sha256, trim(url) AS url, ('0x' || substr(md5(url), 1, 8))::BIGINT % 4 AS k FROM m)
SELECT sha256, CASE WHEN url = '' THEN 'no_url' ELSE ['network_error', 'http_error', 'network_error', 'sha256_mismatch'][k + 1] END AS status, CASE WHEN url <> '' THEN ['down', 'HTTP 404', 'HTTP 503', 'content has another hash'][k + 1] END AS error FROM k""")
def fetch_log(spark, d):
    """Outcomes of fetching from a made-up server, stored with the mismatched contents apart, by the log."""
    keys = table(spark, d, "inventory").where("sha256 is not null").select("sha256").distinct()
    url = F.when(V.h("url", "sha256") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("https://example.org/"), F.col("sha256")))

    def server(url: str) -> tuple[int, bytes]:
        kind = int(hashlib.md5(url.encode()).hexdigest()[:8], 16) % 4
        if not kind:
            raise OSError("down")
        return (0, 404, 503, 200)[kind], b"x" if kind == 3 else b""

    path = _folder(spark)
    sinks.store_fetched(extract.fetch_documents(keys.withColumn("source_url", url), server, wait=lambda seconds: None), path)
    return spark.read.schema("sha256 string, status string, error string").json(f"{path}/log")


_SAYS = "(('0x' || substr(md5(pair_id || '|' || {n}), 1, 8))::BIGINT % 3)"


@query(f"""WITH p AS (SELECT DISTINCT pair_id FROM labelled_pairs WHERE pair_id IS NOT NULL), s AS (SELECT pair_id, [{', '.join(_SAYS.format(n=repr(t)) for t in ('0.0', '0.3', '0.7'))}] AS k FROM p),
a AS (SELECT pair_id, unnest(range(3))::INT AS attempt_n, k FROM s) SELECT pair_id, attempt_n, [0.0, 0.3, 0.7][attempt_n + 1]::DOUBLE AS temperature, CASE k[attempt_n + 1] WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END AS content, CASE k[attempt_n + 1] WHEN 0 THEN 'down' END AS client_error
FROM a WHERE NOT list_contains(k[:attempt_n], 2)""")
def chat_attempts(spark, d):
    """A made-up client that fails, declines or answers, asked again at the next temperature until it answers."""

    def client(system: str, user: str, temperature: float) -> dict:
        kind = int(hashlib.md5(f"{user}|{temperature}".encode()).hexdigest()[:8], 16) % 3
        if not kind:
            raise OSError("down")
        return {"content": ("", "no", "yes")[kind], "finish_reason": "stop"}

    asked = V.records(spark, d).where("pair_id is not null").select("pair_id", F.lit("s").alias("system"), F.col("pair_id").alias("user")).distinct()
    return extract.chat(asked, client, keys=["pair_id"], succeeded=lambda text: text == "yes").select("pair_id", "attempt_n", "temperature", "content", "client_error")


# -- records, files, order ---------------------------------------------------------------------------------------------


@query(f"SELECT record_no, {V.h_sql('blind', 'record_no')} % 7 = 0 OR review.reviewer_id IS NOT NULL AS held_out FROM labelled_pairs")
def held_out_lines(spark, d):
    """Records as text; some have a blind_review key whose value is null."""
    reviewer = F.when(F.col("review.reviewer_id").isNotNull(), F.lit(', "review": {"reviewer_id": "r"}')).when(F.col("review").isNotNull(), F.lit(', "review": {"reviewer_id": null}')).otherwise("")
    blind = F.when(V.h("blind", "record_no") % 7 == 0, F.lit(', "blind_review": null')).otherwise("")
    line = F.concat(F.lit('{"record_no": '), F.col("record_no").cast("string"), blind, reviewer, F.lit("}"))
    return V.records(spark, d).select("record_no", dataset.held_out_line(line).alias("held_out"))


@query(f"WITH {_SPLIT.replace('FROM labelled_pairs', 'FROM labelled_pairs WHERE review.reviewer_id IS NULL')} SELECT * FROM sp UNION ALL SELECT record_no, CASE WHEN record_type = 'conflict' THEN 'conflict::' || coalesce(nullif(conflict_type, ''), 'conflict_unknown') ELSE 'non_conflict' END, 'gold_iaa', NULL FROM labelled_pairs WHERE review.reviewer_id IS NOT NULL")
def split_with_hold_out(spark, d):
    return dataset.split_with_hold_out(V.records(spark, d))


_ORDER = ["loaded_at", "sha256", "license_tier", "source_collection", "document_title", "filename"]
_ROWS = f"rows_ AS (SELECT *, row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _ORDER)}) + 1 AS row_no FROM inventory)"
_TROUBLE = "p AS (SELECT row_no, sha256, unnest([CASE WHEN coalesce(lower(trim(license_tier)) NOT IN ('tier 1', 'tier 2', 'tier 3'), TRUE) THEN 'unknown tier ' || coalesce(license_tier, 'null') END, CASE WHEN coalesce(sha256, '') = '' THEN 'empty sha256' END, CASE WHEN sha256 <> '' AND NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'malformed sha256' END]) AS problem FROM rows_)"


def _numbered_problems(spark, d) -> DataFrame:
    rows = dataset.numbered(table(spark, d, "inventory"), [F.asc_nulls_first(c) for c in _ORDER], first=2)
    return dataset.inventory_problems(rows, ["row_no", "sha256"])


@query(f"WITH {_ROWS}, {_TROUBLE} SELECT row_no, sha256, problem FROM p WHERE problem IS NOT NULL")
def inventory_rows(spark, d):
    """Problems with the row they stand in, the header being row 1."""
    return _numbered_problems(spark, d)


@query(f"WITH {_ROWS}, {_TROUBLE} SELECT row_no, sha256, problem FROM p WHERE problem IS NOT NULL ORDER BY row_no, problem LIMIT 25")
def first_problems(spark, d):
    """What a report shows: the first 25 problems."""
    return dataset.head_of(_numbered_problems(spark, d), 25, ["row_no", "problem"])


@query("SELECT doc_id, source_path FROM extracted WHERE jurisdiction = 'EU' ORDER BY source_path NULLS FIRST, doc_id, extracted_at LIMIT 10")
def corpus_head(spark, d):
    """The first ten documents of one jurisdiction, in the order of their paths."""
    return dataset.head_of(table(spark, d, "extracted"), 10, ["source_path", "doc_id", "extracted_at"], jurisdiction="EU").select("doc_id", "source_path")


@query(f"WITH {V.aligned_sql()}, c AS (SELECT jurisdictions, count(*) AS support FROM aligned GROUP BY jurisdictions) SELECT row_number() OVER (ORDER BY support DESC, jurisdictions) AS place, jurisdictions, support FROM c")
def pairs_by_support(spark, d):
    counts = evaluation.per_jurisdiction_pair(V.aligned(spark, d)).select("jurisdictions", "support")
    return dataset.numbered(counts, [F.desc("support"), F.asc("jurisdictions")], name="place", first=1)


@query("SELECT DISTINCT i.sha256, f.path FROM inventory i LEFT JOIN (SELECT doc_id, min(source_path) AS path FROM extracted GROUP BY doc_id) f ON f.doc_id = substr(i.sha256, 1, 16) WHERE i.sha256 IS NOT NULL")
def file_locations(spark, d):
    """The extracted documents stand for the files; their ids are the first digits of the hashes."""
    rows = table(spark, d, "inventory")
    held = table(spark, d, "extracted").select("doc_id", F.col("source_path").alias("path"))
    known = rows.where("sha256 is not null").select("sha256", F.substring("sha256", 1, 16).alias("doc_id")).distinct().join(held, "doc_id").select("sha256", "path")
    return dataset.locate_files(rows, known)


@query(f"""WITH {_CHECKS.replace('{signs}', _SIGNS)}, e AS (SELECT coalesce(extractor, '') AS extractor, count(*) AS n_documents, sum(coalesce(len(pages), 0))::BIGINT AS n_pages, count(*) FILTER (coalesce(len(pages), 0) = 0 AND coalesce(len(extraction_errors), 0) > 0) AS n_failures FROM extracted GROUP BY 1),
n AS (SELECT coalesce(extractor, '') AS extractor, count(*) FILTER (needs_reextraction) AS needs_reextraction FROM verdicts GROUP BY 1), own AS (SELECT doc_id, min(coalesce(extractor, '')) AS extractor FROM extracted GROUP BY doc_id),
ch AS (SELECT extractor, count(*) AS n_chunks FROM pg JOIN own USING (doc_id) WHERE p.text <> '' GROUP BY extractor)
SELECT extractor, n_documents, n_pages, coalesce(n_chunks, 0) AS n_chunks, needs_reextraction, n_failures FROM e JOIN n USING (extractor) LEFT JOIN ch USING (extractor)""")
def run_totals(spark, d):
    """Every page with text stands for a chunk."""
    rows = table(spark, d, "extracted")
    return ingestion.run_totals(rows, ingestion.pages_of(rows).where("text <> ''").select("doc_id"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM documents) SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '\bshall\b.*[0-9]')")
def matching_lines(spark, d):
    return dataset.matching_lines(table(spark, d, "documents"), r"\bshall\b.*[0-9]")


@query("SELECT chunk_no, 0 AS regime_tags, 0 AS topic_tags, 0 AS applicability_tags FROM chunks")
def empty_tags(spark, d):
    rows = dataset.with_tags(table(spark, d, "chunks").select("chunk_no"))
    return rows.select("chunk_no", *(F.size(c).alias(c) for c in rows.columns[1:]))


@query(f"WITH {V.predictions_sql()} SELECT ord, 'majority' AS model_name, '1.0' AS model_version, substr(sha256('{{\"seed\": 42}}'), 1, 12) AS config_hash FROM pred")
def metadata_rows(spark, d):
    return dataset.with_metadata(V.predictions(spark, d), "majority", "1.0", {"seed": 42}).select("ord", "model_metadata.*")


@query(f"WITH {V.predictions_sql()}, m AS (SELECT ord, CASE {V.h_sql('name', 'ord')} % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'model-' || (ord % 5)::VARCHAR END AS n FROM pred) SELECT coalesce(arg_min(n, ord) FILTER (n <> ''), 'unknown_model') AS model_name FROM m")
def resolved_model_name(spark, d):
    k = V.h("name", "ord") % 3
    return alignment.model_name(V.predictions(spark, d).withColumn("model_name", F.when(k == 1, F.lit("")).when(k == 2, F.concat(F.lit("model-"), (F.col("ord") % 5).cast("string")))))


@query(f"""WITH k AS (SELECT DISTINCT sha256 AS key FROM inventory WHERE sha256 IS NOT NULL), runs AS (SELECT key, 'new' AS fingerprint FROM k WHERE {V.h_sql('run', 'key')} % 2 = 0), idx AS (SELECT key, 'old' AS fingerprint FROM k WHERE {V.h_sql('idx', 'key')} % 3 <> 0)
SELECT * FROM idx ANTI JOIN runs USING (key) UNION ALL SELECT * FROM runs""")
def index_upsert(spark, d):
    keys = table(spark, d, "inventory").where("sha256 is not null").select(F.col("sha256").alias("key")).distinct()
    runs = keys.where(V.h("run", "key") % 2 == 0).withColumn("fingerprint", F.lit("new"))
    return dataset.upsert(keys.where(V.h("idx", "key") % 3 != 0).withColumn("fingerprint", F.lit("old")), runs)


# -- prompts and transcripts -------------------------------------------------------------------------------------------


def _template_sql(template: str) -> str:
    from docloom.plans.queries import _passage_sql

    fields = {f"jurisdiction_{s}": f"coalesce(regime_{s}.jurisdiction, '?')" for s in "ab"} | {f"regime_{s}": f"coalesce(regime_{s}.regime_id, '?')" for s in "ab"} | {f"passage_{s}": _passage_sql(f"evidence_{s}") for s in "ab"}
    out = "'" + template.replace("'", "''") + "'"
    for name, sql in fields.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


@query(" UNION ALL ".join(f"SELECT record_no, '{v}' AS variant, '{s}' AS system, {_template_sql(t)} AS \"user\" FROM labelled_pairs" for v, (s, t) in P.VARIANTS.items()))
def prompt_variants(spark, d):
    return P.rendered(V.records(spark, d))


@query("""WITH g AS (SELECT * FROM (VALUES (0, 'small'), (1, 'org/large')) m(i, model), (VALUES (0, 'A'), (1, 'B'), (2, 'C')) v(j, variant), (VALUES (0, 'val'), (1, 'test')) s(k, split))
SELECT (row_number() OVER (ORDER BY i, j, k) - 1)::INT AS cell, model, variant, split, replace(model, '/', '_') || '_' || variant || '_' || split AS run_name, TRUE AS partial FROM g WHERE variant <> 'B'""")
def run_grid(spark, d):
    """Two models, two of three variants, two splits; needs no table."""
    return P.grid(spark, ["small", "org/large"], ["val", "test"], only_variants=["A", "C"])


@query(f"WITH {V.ATTEMPTS} SELECT pair_id, arg_min(temperature, attempt_n) AS first_temperature, arg_max(temperature, attempt_n) AS last_temperature, arg_min(latency, attempt_n) AS first_latency_seconds, arg_max(latency, attempt_n) AS last_latency_seconds FROM parsed GROUP BY pair_id")
def attempt_ends(spark, d):
    return replies.attempt_ends(V.attempts(spark, d), ["pair_id"], ["temperature", "latency_seconds"])


@query("SELECT DISTINCT pair_id, replace(replace(pair_id, ':', '_'), '/', '_') || '.json' AS name FROM labelled_pairs WHERE pair_id IS NOT NULL")
def transcript_names(spark, d):
    return V.records(spark, d).where("pair_id is not null").select("pair_id", replies.transcript_name("pair_id").alias("name")).distinct()


_KEPT = V.h_sql("kept", "pair_id") + " % 6"


def _transcripts(spark, d) -> DataFrame:
    """Transcripts of some pairs; of those some are broken or empty."""
    parsed = replies.parse_replies(V.attempts(spark, d))
    each = F.struct("attempt_n", F.struct("temperature", F.struct("success", "conflict_present", "conflict_type").alias("parsed")).alias("a"))
    whole = parsed.groupBy("pair_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["a"]).alias("attempts"))).alias("text"))
    k = V.h("kept", "pair_id") % 6
    return whole.where(k != 0).withColumn("text", F.when(k == 1, F.lit('{"attempts": [')).when(k == 2, F.lit("{}")).when(k == 3, F.lit("[1]")).otherwise(F.col("text")))


@query(f"WITH {V.ATTEMPTS} SELECT DISTINCT pair_id FROM parsed WHERE {_KEPT} IN (0, 1, 3)")
def still_to_ask(spark, d):
    return replies.still_to_ask(V.attempts(spark, d).select("pair_id").distinct(), _transcripts(spark, d))


@query(f"""WITH {V.ATTEMPTS}, own AS (SELECT * FROM parsed WHERE {_KEPT} > 3), n AS (SELECT pair_id, count(*) AS n_attempts, min(attempt_n) FILTER (success) AS hit FROM own GROUP BY pair_id)
SELECT pair_id, n_attempts::INT AS n_attempts, coalesce(hit, n_attempts - 1)::INT AS n_retries, temperature AS succeeded_at, coalesce(present, FALSE) AS y_pred, ctype AS t_pred FROM n LEFT JOIN own o USING (pair_id) WHERE o.attempt_n = hit
UNION ALL SELECT pair_id, n_attempts::INT, (n_attempts - 1)::INT, NULL, FALSE, NULL FROM n WHERE hit IS NULL UNION ALL SELECT DISTINCT pair_id, 0, -1, NULL::DOUBLE, FALSE, NULL FROM parsed WHERE {_KEPT} = 2""")
def resumed_runs(spark, d):
    return replies.resumed(_transcripts(spark, d))


# -- training ----------------------------------------------------------------------------------------------------------


@query("SELECT s::INT AS step, round(CASE WHEN s < 20 THEN s / 20.0::DOUBLE ELSE greatest(0.0, (200 - s) / 180.0::DOUBLE) END * 2e-5, 12) AS rate FROM range(221) r(s)")
def learning_rates(spark, d):
    """Two hundred steps and some beyond; needs no table."""
    steps = spark.range(221).select(F.col("id").cast("int").alias("step"))
    return steps.select("step", F.round(training.learning_rate(F.col("step"), 20, 200, 2e-5), 12).alias("rate"))


_RUNS = f"epochs AS (SELECT run::INT AS run, epoch::INT AS epoch, 0.9::DOUBLE + {V.h_sql('tr', 'run', 'epoch')} % 10 / 100.0::DOUBLE AS train_f1, {V.h_sql('val', 'run', 'epoch')} % 100 / 100.0::DOUBLE AS val_f1 FROM range(40) r(run), range(1, 13) e(epoch))"


def _epochs(spark) -> DataFrame:
    runs = spark.range(40).select(F.col("id").cast("int").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("epoch"))
    return runs.withColumns({"train_f1": F.lit(0.9) + V.h("tr", "run", "epoch") % 10 / F.lit(100.0), "val_f1": V.h("val", "run", "epoch") % 100 / F.lit(100.0)})


@query(f"WITH {_RUNS} SELECT * FROM epochs WHERE epoch >= 3 AND train_f1 >= 0.95::DOUBLE AND val_f1 < 0.4::DOUBLE")
def overfit_alarms(spark, d):
    return training.overfit(_epochs(spark))


@query(f"WITH {_RUNS}, best AS (SELECT run, floor(max(val_f1) * 20) AS f1, CASE WHEN run % 3 = 0 THEN NULL ELSE floor(max(train_f1) * 50) END AS macro FROM epochs GROUP BY run) SELECT * FROM best ORDER BY f1 DESC NULLS LAST, macro DESC NULLS LAST, run LIMIT 1")
def sweep_winner(spark, d):
    best = _epochs(spark).groupBy("run").agg(F.floor(F.max("val_f1") * 20).cast("double").alias("f1"), F.floor(F.max("train_f1") * 50).cast("double").alias("m"))
    return training.sweep_winner(best.select("run", "f1", F.when(F.col("run") % 3 != 0, F.col("m")).alias("macro")), ["f1", "macro"], "run")


@query(f"WITH l AS (SELECT record_no, {V.h_sql('l0', 'record_no')} % 1000 / 100.0::DOUBLE AS a, {V.h_sql('l1', 'record_no')} % 1000 / 100.0::DOUBLE AS b FROM labelled_pairs) SELECT record_no, round(1 / (1 + exp(a - b)), 9) AS confidence, CASE WHEN a >= b THEN 0 ELSE 1 END::BIGINT AS label FROM l")
def head_outputs(spark, d):
    """Confidence and label of made-up two-class outputs."""
    rows = V.records(spark, d).select("record_no", F.array(*(V.h(f"l{i}", "record_no") % 1000 / F.lit(100.0) for i in range(2))).alias("logits"))
    return rows.select("record_no", F.round(training.softmax_confidence("logits"), 9).alias("confidence"), training.argmax("logits").cast("long").alias("label"))


@query(r"""WITH w AS (SELECT record_no, list_transform([list_aggregate(list_transform(coalesce(e, []), lambda x: len(regexp_extract_all(coalesce(x.passage, ''), '[^\s\x0B]+'))), 'sum') FOR e IN [evidence_a, evidence_b]], lambda n: coalesce(n, 0)) AS n FROM labelled_pairs),
p AS (SELECT n[1] > 240 AS ta, n[2] > 240 AS tb, least(n[1], 240) + least(n[2], 240) + 3 AS length FROM w), o AS (SELECT length, row_number() OVER (ORDER BY length) AS i, count(*) OVER () AS n FROM p)
SELECT count(*) AS n, count(*) FILTER (ta) AS truncated_a, count(*) FILTER (tb) AS truncated_b, count(*) FILTER (ta OR tb) AS truncated_any, count(*) FILTER (ta OR tb) AS mid_any, min(length)::INT AS least, max(length)::INT AS most, round(avg(length), 6) AS mean,
 (SELECT min(length) FROM o WHERE i > floor(n * 0.5::DOUBLE))::INT AS median, (SELECT min(length) FROM o WHERE i > floor(n * 0.9::DOUBLE))::INT AS p90 FROM p""")
def truncation_by_side(spark, d):
    """A cap of 240 words on either side instead of a joint budget."""
    count = lambda e: F.coalesce(F.aggregate(F.transform(e, lambda x: F.regexp_count(F.coalesce(x["passage"], F.lit("")), F.lit(r"[^\s]+"))), F.lit(0), lambda a, n: a + n), F.lit(0))
    sides = V.records(spark, d).select(count("evidence_a").alias("a"), count("evidence_b").alias("b"))
    flags = {f"{kind}_{s}": F.col(s) > 240 for kind in ("truncated", "mid") for s in "ab"}
    return training.truncation_statistics(sides.withColumns(flags | {"length": (F.least("a", F.lit(240)) + F.least("b", F.lit(240)) + 3).cast("int")}))


@query(f"WITH {_RUNS} SELECT run, epoch, train_f1, val_f1 FROM epochs")
def training_log(spark, d):
    """Two halves of the epochs appended to one log, and read back."""
    path, rows = _folder(spark), _epochs(spark)
    for half in (rows.where("epoch <= 6"), rows.where("epoch > 6")):
        sinks.append_training_log(half, path)
    return spark.read.schema("run int, epoch int, train_f1 double, val_f1 double").json(path)


@query(f"""WITH {_OUTCOMES}, g AS (SELECT pair_id, n_attempts, total_latency FROM outcomes), w AS (SELECT n_attempts, pair_id, (row_number() OVER x)::INT AS done, count(*) OVER (PARTITION BY n_attempts) AS total, (sum(round(total_latency * 1000000)::BIGINT) OVER x)::DOUBLE / row_number() OVER x / 1000000 AS m FROM g WINDOW x AS (PARTITION BY n_attempts ORDER BY pair_id ROWS UNBOUNDED PRECEDING))
SELECT n_attempts, pair_id, done, total, round(m, 6) AS mean_seconds, round(m * (total - done), 6) AS seconds_left FROM w""")
def run_progress(spark, d):
    return replies.progress(_outcomes(spark, d), ["n_attempts"], "pair_id")


@query("""WITH RECURSIVE p AS (SELECT q.vec_id AS u, r.vec_id AS v FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) >= 0.25),
l AS (SELECT u, v FROM p UNION SELECT v, u FROM p), reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN l ON r.v = l.u) SELECT u AS vec_id, min(v) AS class_id FROM reach GROUP BY u""")
def collapsed_vectors(spark, d):
    """The links of near_vectors (ids divisible by 50 against all), collapsed to classes."""
    rows = table(spark, d, "embeddings")
    return vectors.collapse(rows, vectors.near_vectors(rows, rows.where(F.col("vec_id") % 50 == 0), least=0.25))
