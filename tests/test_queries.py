"""Every query of the engine against its SQL, on the smallest tables; those without SQL must run."""

import subprocess
import sys

import pytest
from conftest import DATA, ROOT, same_rows

from docloom.operators import structure, training
from docloom.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(core.QUERIES[name](spark, DATA), duck, core.SQL[name])


def rows_of(spark, name):
    return [r.asDict() for r in core.QUERIES[name](spark, DATA).collect()]


def test_parsed_blocks_are_parts_of_their_texts(spark):
    texts = {r["chunk_no"]: r["text"] for r in spark.read.parquet(f"{DATA}/chunks.parquet").collect()}
    squeezed = {no: "".join((t or "").split()) for no, t in texts.items()}
    blocks = rows_of(spark, "parse_blocks")
    assert {b["chunk_no"] for b in blocks} == {no for no, t in squeezed.items() if t}
    assert all("".join(b["text"].split()) in squeezed[b["chunk_no"]] for b in blocks)
    assert all((b["page_start"] is None) == (b["page_end"] is None) and (b["page_start"] or 0) <= (b["page_end"] or 0) for b in blocks)


def test_chunks_hold_every_word_within_the_limit(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    chunks, said = rows_of(spark, "chunk_documents"), {}
    for c in sorted(chunks, key=lambda c: (c["doc_id"], c["position"])):
        said.setdefault(c["doc_id"], []).append(c["text"])
        assert 0 < c["n_tokens"] <= 400 and c["n_tokens"] == structure.count_words(c["text"])
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)
    assert {d: "".join("".join(t).split()) for d, t in said.items()} == {d: "".join(t.split()) for d, t in texts.items() if t and t.strip()}
    kinds = {}
    for c in chunks:
        kinds.setdefault(c["kind"], []).append(c["n_tokens"])
    for r in rows_of(spark, "chunk_statistics"):
        own = kinds.pop(r["kind"])
        assert (r["n_chunks"], r["least"], r["most"]) == (len(own), min(own), max(own)) and r["mean"] == pytest.approx(sum(own) / len(own), abs=1e-5)
    assert not kinds


def test_packed_records(spark):
    packed = {r["record_no"]: r for r in rows_of(spark, "joint_budget")}
    for r in spark.read.parquet(f"{DATA}/labelled_pairs.parquet").collect():
        sizes = [[structure.count_words(x["passage"].strip(" ")) for x in r[f"evidence_{s}"] or [] if x["passage"] and x["passage"].strip(" ")] for s in "ab"]
        own, got = training.joint_pack(*sizes), packed.pop(r["record_no"])
        assert (got["used_a"], got["used_b"], got["tokens_a"], got["tokens_b"], got["truncated_a"], got["truncated_b"], got["mid_a"], got["mid_b"]) == own
        assert got["length"] == own[2] + own[3] + 3 <= 512
    assert not packed
    rows, (stats,) = rows_of(spark, "joint_budget"), rows_of(spark, "truncation_statistics")
    lengths = sorted(r["length"] for r in rows)
    assert (stats["n"], stats["least"], stats["most"]) == (len(rows), lengths[0], lengths[-1])
    assert (stats["median"], stats["p90"]) == (lengths[int(len(rows) * 0.5)], lengths[int(len(rows) * 0.9)])
    assert stats["truncated_any"] == sum(r["truncated_a"] or r["truncated_b"] for r in rows)


def test_encoder_examples_are_well_formed(spark):
    rows = rows_of(spark, "encoder_examples")
    assert rows and all(len(r["input_ids"]) == len(r["token_type_ids"]) <= 512 and r["input_ids"][0] == 1 and r["input_ids"][-1] == 2 for r in rows)
    assert all(r["typology_label"] in (-100, 0, 1, 2, 3) and (r["binary_label"] or r["typology_label"] == -100) for r in rows)


def test_clean_text_of_plain_pages_is_the_plain_text(spark):
    pages = {r["doc_id"]: all((p["text"] or "").isascii() and p["page"] is not None for p in r["pages"] or []) for r in spark.read.parquet(f"{DATA}/extracted.parquet").collect()}
    clean = {(r["doc_id"], r["text"]) for r in rows_of(spark, "clean_text")}
    plain = {(r["doc_id"], r["text"]) for r in rows_of(spark, "plain_text") if pages[r["doc_id"]]}
    assert plain <= clean and len({d for d, _ in clean}) >= len({d for d, _ in plain})


def test_intervals_hold_their_means(spark):
    rows = rows_of(spark, "seed_intervals")
    assert len({r["seed"] for r in rows}) == 100 and {r["n"] for r in rows} == {100, 1000}
    assert all(r["low"] <= r["mean"] + 1e-9 and r["mean"] <= r["high"] + 1e-9 for r in rows)


def test_queries_without_sql_are_those_above():
    assert set(core.QUERIES) - set(core.SQL) == {"parse_blocks", "chunk_documents", "chunk_statistics", "joint_budget", "truncation_statistics", "encoder_examples", "clean_text", "seed_intervals"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_engine_works_without_the_training_data_subpackage():
    code = "import sys; sys.modules['docloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n[0] == 'p' and n[1].isdigit() for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
