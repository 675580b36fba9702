"""Queries against their SQL on the smallest tables, and those without SQL against plain Python over the same rows."""

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import DATA, ROOT, same_rows

from docloom.llm import bpe, entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", ["p1_spans", "p3_agreement", "p3_annotators", "p6_text"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.fixture(scope="module")
def reference():
    """The public encoder itself."""
    import base64

    import tiktoken

    with open(bpe.DEFAULT_VOCAB, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def fetch(sql):
    return duckdb.connect().execute(sql.replace("FROM ", f"FROM '{DATA}/", 1).replace("/documents", "/documents.parquet'").replace("/chunks", "/chunks.parquet'")).fetchall()


def test_p8_ids(spark, reference):
    want = {d: reference(t or "") for d, t in fetch("SELECT doc_id, text FROM documents")}
    got = {r["doc_id"]: list(r["ids"]) for r in QUERIES["p8_ids"](spark, DATA).collect()}
    assert got == want


def test_p5_found(spark, reference):
    want = set()
    for no, text, n in fetch("SELECT chunk_no, text, n_tokens FROM chunks"):
        if text and text.strip():
            k = len(reference(text))
            if n is None or n <= 0 or n > 2 * k or n * 2 < k:
                want.add(no)
    assert {r[0] for r in QUERIES["p5_found"](spark, DATA).collect()} == want


def test_p5_totals(spark, reference):
    latest = {}
    for no, key, text, at in fetch("SELECT chunk_no, chunk_id, text, ingested_at FROM chunks"):
        if key not in latest or (at, no) > latest[key][:2]:
            latest[key] = (at, no, text)
    total = [r for r in QUERIES["p5_totals"](spark, DATA).collect() if r["level"] == 7]
    assert [(r["n_chunks"], r["n_tokens"]) for r in total] == [(len(latest), sum(len(reference(t or "")) for *_, t in latest.values()))]


def test_p7(spark, reference):
    texts = dict(fetch("SELECT chunk_no, text FROM chunks"))
    big = {no: t for no, t in texts.items() if t and len(reference(t)) > 400}
    want = {no: "forced" if max(len(reference(s)) for s in re.split(r"[\r\n]+|(?<=[.!?])\s+", t)) > 400 else "natural" for no, t in big.items()}
    assert {r["chunk_no"]: r["cut"] for r in QUERIES["p7_found"](spark, DATA).collect()} == want
    pieces = defaultdict(list)
    for r in QUERIES["p7_pieces"](spark, DATA).orderBy("chunk_no", "piece_no").collect():
        pieces[r["chunk_no"]].append(r)
    assert pieces.keys() == big.keys()
    for no, own in pieces.items():
        assert "".join(p["piece"][p["shared_chars"] :] for p in own) == big[no]
        assert all(p["n_tokens"] == len(reference(p["piece"])) <= 400 for p in own)
        for before, p in zip(own, own[1:]):
            shared = p["piece"][: p["shared_chars"]]
            assert before["piece"].endswith(shared) and (38 <= len(reference(shared)) <= 42 or shared == before["piece"])


def test_p2_splits_keep_groups_and_proportions(spark):
    rows = QUERIES["p2_splits"](spark, DATA).collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for g, s in homes.items() if g is not None)
    assert len(rows) == len({r["record_no"] for r in rows})


def test_p3_found_has_every_item_with_a_label(spark):
    rows = QUERIES["p3_found"](spark, DATA).collect()
    assert len(rows) == len({r["pair_id"] for r in rows}) and all(r["conflict_type"] for r in rows)


def test_p6_found_is_once_per_document(spark):
    rows = [tuple(r) for r in QUERIES["p6_found"](spark, DATA).collect()]
    assert len(rows) == len(set(rows)) and {r[3] for r in rows} == {"header", "pageno", "hyphen", "char"}
    both = Counter(r[:3] for r in rows)
    assert not any(both[r[:3]] > 1 for r in rows if r[3] in ("header", "pageno"))


def test_order_of_input_does_not_matter(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    random.Random(1).shuffle(rows)
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    spark.createDataFrame(rows, schema).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    want, got = (sorted(map(tuple, QUERIES["p10_found"](spark, d).collect())) for d in (DATA, str(tmp_path)))
    assert want == got


@pytest.mark.parametrize("name, moves", [("p8_ids", 0), ("p7_found", 0), ("p7_pieces", 0), ("p9_found", 1), ("p5_found", 2)])
def test_texts_stay_where_they_are(spark, tmp_path, name, moves):
    """Exchanges in the plan over an input with many partitions: none for texts but the salted pieces of long ones."""
    for table in ("documents", "chunks", "eval_items"):
        spark.read.parquet(f"{DATA}/{table}.parquet").repartition(8).write.parquet(str(tmp_path / f"{table}.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # one partition a file
    try:
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert plan.count("Exchange hashpartitioning") == moves and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("library, lost", [("sentencepiece", {"p5_found", "p7_found", "p8_ids"}), ("regex", {"p5_found", "p7_found", "p8_ids"}), ("tiktoken", set())])
def test_a_missing_library_costs_only_its_own_queries(library, lost):
    code = f"import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{library!r}] = None; import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120, capture_output=True, text=True).stdout.split()
    assert {"binary_metrics", "p1_found", "p2_found", "p10_found"} <= {*said}
    assert {q for q in QUERIES if q.split("_")[0] in {x.split("_")[0] for x in lost}} == {*QUERIES} - {*said}
