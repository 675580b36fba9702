"""Extraction of pages from files, with extractors tried in turn, and verified fetching. Both take their libraries and
transport as plain functions: none of them is needed to use the rest."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.schemas import PAGE

#: bytes -> page texts
Extractor = Callable[[bytes], list[str]]
#: url -> (status code, content); raises OSError on network trouble
Fetcher = Callable[[str], tuple[int, bytes]]

LEAST_CHARS = 50


def extract_bytes(content: bytes, ext: str, tiers: dict[str, list[tuple[str, Extractor]]], least: float = LEAST_CHARS) -> tuple[str, list[str], list[str]]:
    """(extractor, pages, errors): the first tier with enough characters per page; the last one is taken as it is."""
    if ext not in tiers:
        return "", [], [f"unsupported extension: {ext}"]
    errors = []
    for k, (name, extract) in enumerate(tiers[ext], 1):
        try:
            pages = extract(content)
        except Exception as e:  # noqa: BLE001 - a broken file must not end the job
            errors.append(f"{name}: {e}")
            continue
        if k == len(tiers[ext]) or pages and sum(map(len, pages)) / len(pages) >= least:
            return name, pages, errors
    return "failed", [], errors


def extract_documents(files: DataFrame, tiers: dict[str, list[tuple[str, Extractor]]]) -> DataFrame:
    """Extracted documents of corpus_files: doc_id is the first 16 hex digits of the content's SHA-256."""
    keep = ["source_path", "jurisdiction", "issuing_body", "filename", "ext"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ext, content in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                name, pages, errors = extract_bytes(content or b"", ext, tiers)
                out.append((hashlib.sha256(content or b"").hexdigest()[:16], name, len(pages), [{"page": i, "text": t} for i, t in enumerate(pages, 1)], errors))
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())])), pa.list_(pa.string())]
            own = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([own[0], *batch.columns[:5], *own[1:]], ["doc_id", *keep, "extractor", "page_count", "pages", "extraction_errors"])

    return files.select(*keep, "content").mapInArrow(run, "doc_id string, " + ", ".join(f"{k} string" for k in keep) + f", extractor string, page_count int, pages array<{PAGE}>, extraction_errors array<string>")


def fetch_one(row: dict, fetch: Fetcher, *, held: Callable[[str], bytes | None] = lambda sha: None, retries: int = 3, wait: Callable[[float], None] = time.sleep, dry_run: bool = False) -> dict:
    """The outcome of fetching one manifest row: no_url, skipped, dry_run, ok, sha256_mismatch, http_error, network_error.

    A held copy with the right hash is not fetched again. Client errors other than 429 end it; other trouble is tried
    again after a doubled wait.
    """
    sha, url = (row.get("sha256") or "").strip().lower(), (row.get("source_url") or "").strip()
    out = {"sha256": sha, "source_url": url, "status": "no_url", "bytes": 0, "error": None, "content": None}
    if not url:
        return out
    copy = held(sha)
    if copy is not None and hashlib.sha256(copy).hexdigest() == sha:
        return out | {"status": "skipped", "bytes": len(copy)}
    if dry_run:
        return out | {"status": "dry_run"}
    pause = 1.0
    for k in range(retries):
        if k:
            wait(pause)
            pause *= 2
        try:
            code, content = fetch(url)
        except OSError as e:
            out |= {"status": "network_error", "error": str(e)}
            continue
        if code < 400:
            same = hashlib.sha256(content).hexdigest() == sha
            return out | {"status": "ok" if same else "sha256_mismatch", "bytes": len(content), "content": content, "error": None if same else "content has another hash"}
        out |= {"status": "network_error", "error": f"HTTP {code}"}
        if code < 500 and code != 429:
            return out | {"status": "http_error"}
    return out


def fetch_documents(manifest: DataFrame, fetch: Fetcher, *, concurrency: int = 4, **options) -> DataFrame:
    """Outcomes of all manifest rows, `concurrency` of them at a time (one per task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sha256", pa.string()), ("source_url", pa.string()), ("status", pa.string()), ("bytes", pa.int64()), ("error", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([fetch_one(row, fetch, **options)], schema)

    return manifest.select("sha256", "source_url").repartition(concurrency).mapInArrow(run, "sha256 string, source_url string, status string, bytes long, error string, content binary")


def chat(prompts: DataFrame, client: Callable[[str, str, float], dict], *, keys: list[str], temperatures: tuple[float, ...] = (0.0, 0.3, 0.7), succeeded: Callable[[str], bool], concurrency: int = 2) -> DataFrame:
    """(keys..., attempt_n, temperature, latency_seconds, finish_reason, content, client_error): the attempts per prompt.

    The next temperature is tried only if the answer could not be used; a client's error is a failed attempt. The client
    gets system, user and temperature and returns a dict with content, finish_reason.
    """
    fields = [("attempt_n", pa.int32()), ("temperature", pa.float64()), ("latency_seconds", pa.float64()), ("finish_reason", pa.string()), ("content", pa.string()), ("client_error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (system, user) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                for k, temperature in enumerate(temperatures):
                    began = time.monotonic()
                    try:
                        said, error = client(system, user, temperature), None
                    except Exception as e:  # noqa: BLE001 - transport trouble is an outcome
                        said, error = {}, str(e)
                    at.append(i)
                    out.append((k, temperature, time.monotonic() - began, said.get("finish_reason"), said.get("content"), error))
                    if said.get("content") and succeeded(said["content"]):
                        break
            columns = list(zip(*out)) if out else [()] * len(fields)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[: len(keys)], *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields))], [*keys, *(n for n, _ in fields)])

    own = ", ".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, "system", "user").repartition(concurrency).mapInArrow(run, f"{own}, attempt_n int, temperature double, latency_seconds double, finish_reason string, content string, client_error string")
