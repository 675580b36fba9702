"""Readers, extraction, fetching, sinks and incremental runs, with made-up files and transports."""

import hashlib
import json

import pytest

from docloom.schemas import EXTRACTED
from docloom.sources import extract, files, sinks
from docloom.streaming import incremental


def test_corpus_scan_and_extraction(spark, tmp_path):
    for name, content in (("EU/Body/a.pdf", b"good"), ("EU/Body/b.docx", b"doc"), ("SG/X/c.pdf", b"thin"), ("EU/Body/.d.pdf", b"hidden"), ("EU/Body/e.txt", b"no"), ("SG/X/f.pdf", b"bad")):
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    def first(content):
        if content == b"bad":
            raise ValueError("broken")
        return ["x" * 80] if content == b"good" else ["thin"]

    def last(content):
        if content == b"bad":
            raise ValueError("broken too")
        return ["scanned"]

    scan = files.corpus_files(spark, str(tmp_path / "corpus"))
    assert scan.count() == 4
    docs = {r["filename"]: r for r in extract.extract_documents(scan, {"pdf": [("text", first), ("ocr", last)], "docx": [("docx", lambda c: ["p"])]}).collect()}
    assert docs["a.pdf"]["extractor"] == "text" and docs["c.pdf"]["extractor"] == "ocr" and docs["b.docx"]["page_count"] == 1
    assert docs["f.pdf"]["extractor"] == "failed" and len(docs["f.pdf"]["extraction_errors"]) == 2
    assert docs["a.pdf"]["doc_id"] == hashlib.sha256(b"good").hexdigest()[:16]
    assert (docs["c.pdf"]["jurisdiction"], docs["c.pdf"]["issuing_body"]) == ("SG", "X")
    assert extract.extract_bytes(b"", "txt", {})[2] == ["unsupported extension: txt"]


def test_fetching():
    good = b"content"
    sha = hashlib.sha256(good).hexdigest()
    row = {"sha256": sha, "source_url": "u"}
    run = lambda fetch, **k: extract.fetch_one(row, fetch, wait=lambda s: None, **k)["status"]
    assert run(lambda u: (200, good)) == "ok"
    assert run(lambda u: (200, b"x")) == "sha256_mismatch"
    assert run(lambda u: (404, b"")) == "http_error"
    assert run(lambda u: (503, b"")) == "network_error"
    assert run(lambda u: (429, b"")) == "network_error"
    assert run(None, held=lambda s: good) == "skipped"
    assert run(None, dry_run=True) == "dry_run"
    assert extract.fetch_one({"sha256": sha, "source_url": " "}, None)["status"] == "no_url"
    waits, answers = [], iter([OSError("down"), (500, b""), (200, good)])

    def flaky(url):
        answer = next(answers)
        if isinstance(answer, OSError):
            raise answer
        return answer

    assert extract.fetch_one(row, flaky, wait=waits.append)["status"] == "ok" and waits == [1.0, 2.0]


def test_fetch_and_chat_as_tables(spark):
    manifest = spark.createDataFrame([("x", "u"), ("y", "")], "sha256 string, source_url string")
    got = {r["sha256"]: r["status"] for r in extract.fetch_documents(manifest, lambda u: (404, b""), concurrency=2).collect()}
    assert got == {"x": "http_error", "y": "no_url"}
    prompts = spark.createDataFrame([("p", "s", "ok"), ("q", "s", "late"), ("r", "s", "down")], "pair_id string, system string, user string")

    def client(system, user, temperature):
        if user == "down":
            raise OSError("no server")
        return {"content": "yes" if user == "ok" or temperature > 0.5 else "", "finish_reason": "stop"}

    rows = extract.chat(prompts, client, keys=["pair_id"], succeeded=lambda t: t == "yes").collect()
    tries = {}
    for r in rows:
        tries[r["pair_id"]] = tries.get(r["pair_id"], 0) + 1
    assert tries == {"p": 1, "q": 3, "r": 3}
    assert all(r["client_error"] == "no server" for r in rows if r["pair_id"] == "r")


def test_json_lines_and_predictions(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"pair_id": "a", "predicted_conflict_present": true}\n\n{"pair_id": "b c", "predicted_conflict_present": null, "model_metadata": {"model_name": "m"}}\n')
    rows = files.predictions(spark, str(path)).orderBy("ord").collect()
    assert [r["pair_id"] for r in rows] == ["a", "b c"] and rows[1]["model_name"] == "m"
    path.write_text('{"pair_id": "a"}\n')
    with pytest.raises(ValueError, match="required"):
        files.predictions(spark, str(path))
    broken = tmp_path / "train.jsonl"
    broken.write_text('{"a": 1}\n{oops\n')
    got = files.named_split(spark, str(tmp_path), "train", "a int").collect()
    assert [r["a"] for r in got] == [1, None] and got[1]["_corrupt_record"] == "{oops"
    with pytest.raises(ValueError, match="unknown split"):
        files.named_split(spark, str(tmp_path), "all", "a int")


def test_key_state(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"review": null}',), ("{}",), ('{"review": {"x": 1}}',)], "j string")
    assert [r[0] for r in df.select(files.key_state(F.col("j"), "review")).collect()] == ["null", "absent", "set"]


def test_csv_with_quotes_and_line_feeds(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('sha256,document_title\nx,"a ""b"", c\nd"\n')
    assert files.csv_table(spark, str(path)).first()["document_title"] == 'a "b", c\nd'


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("EU", "B", "x ü"), ("SG", "C", "y")], "jurisdiction string, issuing_body string, text string")
    sinks.write_by_source(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/jurisdiction=EU/issuing_body=B").exists()
    assert sinks.not_yet_written(rows, rows.limit(1), ["text"]).count() == 1
    directory = sinks.bundle_dir(str(tmp_path), "a/b c", "test")
    assert directory.parent.name == "a_b_c"
    sinks.write_bundle(directory, {"metrics": rows}, {"seed": 1})
    assert len(json.loads((directory / "metrics.json").read_text())) == 2
    report = sinks.upsert_section("head\n\n## S\nold\n## after", "## S", sinks.markdown_table([{"a": 1.0, "b": None}]))
    assert report.startswith("head\n\n## S\n| a | b |") and "old" not in report and "after" not in report


def test_incremental_run_takes_only_new_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: incremental.catch_up(spark, str(source), EXTRACTED, lambda df: df.select("doc_id"), str(tmp_path / "out"), str(tmp_path / "mark"))
    (source / "1.json").write_text('{"doc_id": "a"}\n')
    run()
    (source / "2.json").write_text('{"doc_id": "b"}\n')
    run()
    run()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_windows_are_the_same_for_streams_and_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from conftest import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    want = sorted(map(tuple, incremental.windowed_counts(events, keys=["event_type"]).select(F.date_format("window_start", "HH:mm dd"), "event_type", "n").collect()))
    source = tmp_path / "events"
    events.orderBy("ts").coalesce(1).write.parquet(str(source))
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(str(source)), keys=["event_type"])
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(tuple, spark.table("windows").select(F.date_format("window_start", "HH:mm dd"), "event_type", "n").collect()))
    assert got == want


def test_plans_prune_and_do_not_shuffle(spark):
    """What the scans read, and which queries move nothing."""
    from conftest import DATA

    from docloom.plans import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(queries.QUERIES["binary_metrics"](spark, DATA))
    assert "ReadSchema" in text and "passage" not in text and "IsNotNull(pair_id)" in text
    for name in ("parse_blocks", "chunk_documents", "prompts", "joint_budget", "page_checks"):
        assert "Exchange hashpartitioning" not in plan(queries.QUERIES[name](spark, DATA)) or name == "parse_blocks", name
    for name, query in queries.QUERIES.items():
        if name not in ("clean_text",):
            assert "CartesianProduct" not in plan(query(spark, DATA)), name


def test_config_files(tmp_path):
    from docloom.sources.config import load_config

    (tmp_path / "a.json").write_text('{"seed": 42}')
    (tmp_path / "b.yaml").write_text("")
    (tmp_path / "c.json").write_text("[1]")
    assert load_config(tmp_path / "a.json") == {"seed": 42}
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.json")
    with pytest.raises(ValueError):
        load_config(tmp_path / "a.json").get("x") or load_config(__file__)
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            load_config(tmp_path / "b.yaml")
    else:
        assert load_config(tmp_path / "b.yaml") == {}


def test_transcripts_folder(spark, tmp_path):
    from docloom.functions import replies

    (tmp_path / "a_1.json").write_text('{"attempts": [{"temperature": 0.0, "parsed": {"success": false}},\n {"temperature": 0.3, "parsed": {"success": true, "conflict_present": true, "conflict_type": "recurring_friction"}}]}')
    (tmp_path / "b_2.json").write_text('{"attempts": [')
    rows = files.transcripts(spark, str(tmp_path)).withColumnRenamed("name", "pair_id")
    assert [tuple(r) for r in replies.resumed(rows).collect()] == [("a_1.json", 2, 1, 0.3, True, "recurring_friction")]
    pairs = spark.createDataFrame([("a:1",), ("b/2",), ("c",)], "pair_id string").select(replies.transcript_name("pair_id").alias("pair_id"))
    assert {r[0] for r in replies.still_to_ask(pairs, rows).collect()} == {"b_2.json", "c.json"}


def test_mismatched_contents_lie_apart(spark, tmp_path):
    rows = [("a", "u", "ok", 1, None, b"x"), ("b", "v", "sha256_mismatch", 1, "content has another hash", b"y"), ("c", "w", "http_error", 0, "HTTP 404", None)]
    sinks.store_fetched(spark.createDataFrame(rows, "sha256 string, source_url string, status string, bytes long, error string, content binary"), str(tmp_path / "out"))
    assert {(r["sha256"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out/contents")).collect()} == {("a", "ok"), ("b", "sha256_mismatch")}
    assert spark.read.json(str(tmp_path / "out/log")).count() == 3
