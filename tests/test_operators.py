"""Truth tables of single operators: edge cases that the tables do not hold."""

import json
import math
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import replies, scores
from docloom.functions import text as T
from docloom.operators import alignment, dataset, evaluation, ingestion, predictors, statistics, structure, training, vectors
from docloom.schemas import CONFLICT_TYPES, LABELLED_PAIR

ROWS = "ord long, pair_id string, y_true boolean, t_true string, jurisdictions string, rationale string, y_pred boolean, t_pred string, conf double"
A, B, C, D = CONFLICT_TYPES


def rows_of(spark, *cells, conf=None):
    return spark.createDataFrame([(i, f"p{i}", y, t, "EU__EU", None, p, s, None if conf is None else conf[i]) for i, (y, t, p, s) in enumerate(cells)], ROWS)


def one(df):
    return df.first().asDict()


def test_binary_metrics_edges(spark):
    perfect = rows_of(spark, (True, A, True, A), (False, None, False, None))
    assert one(evaluation.binary_metrics(perfect))["macro_f1"] == 1.0
    negative = rows_of(spark, *[(False, None, False, None)] * 3)
    got = one(evaluation.binary_metrics(negative))
    assert (got["f1"], got["macro_f1"], got["accuracy"]) == (0.0, 1.0, 1.0)  # one label present, and it is right
    missed = one(evaluation.binary_metrics(rows_of(spark, *[(True, A, False, None)] * 14, *[(False, None, False, None)] * 93)))
    assert missed["f1"] == 0.0 and missed["n_conflict"] == 14
    empty = one(evaluation.binary_metrics(perfect.limit(0)))
    assert empty["f1"] == 0.0 and empty["n_conflict"] == 0


def auc(pairs):
    pos, neg = [c for y, c in pairs if y], [c for y, c in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_roc_auc(spark):
    rng = random.Random(3)
    pairs = [(rng.random() < 0.4, rng.randrange(12) / 11) for _ in range(60)]
    df = rows_of(spark, *[(y, None, y, None) for y, _ in pairs], conf=[c for _, c in pairs])
    assert one(evaluation.roc_auc(df, buckets=4))["roc_auc"] == pytest.approx(auc(pairs), abs=1e-8)
    assert one(evaluation.roc_auc(df.withColumn("conf", F.when(F.col("ord") > 0, F.col("conf")))))["roc_auc"] is None
    assert one(evaluation.roc_auc(df.where("y_true")))["roc_auc"] is None


def test_typology_counts_missing_predictions_as_wrong(spark):
    df = rows_of(spark, (True, A, True, A), (True, A, False, None), (True, B, True, A), (False, None, True, B))
    got = {r["conflict_type"]: r for r in evaluation.typology_per_class(df).collect()}
    assert (got[A]["precision"], got[A]["recall"], got[A]["support"]) == (0.5, 0.5, 2)
    assert got[C]["support"] == 0 and got[C]["f1"] == 0.0
    assert one(evaluation.typology_macro(df)) == {"macro_f1": pytest.approx(0.125), "accuracy": pytest.approx(1 / 3, abs=1e-8), "n_eval": 3}
    assert one(evaluation.typology_macro(df, present_only=True))["macro_f1"] == pytest.approx(0.25)
    assert one(evaluation.typology_macro(df.where("not y_true")))["macro_f1"] is None
    assert sum(r["n"] for r in evaluation.typology_confusion(df).collect()) == 2


def test_joint_match_needs_no_type_without_conflict(spark):
    df = rows_of(spark, (True, A, True, A), (True, A, True, B), (False, None, False, None), (False, None, False, A))
    assert one(evaluation.joint_exact_match(df)) == {"joint_accuracy": 0.5, "n": 4}
    assert one(evaluation.joint_exact_match(df.limit(0)))["joint_accuracy"] == 0.0


def test_align_keeps_last_prediction_and_repeated_gold(spark):
    gold = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False)], "ord long, pair_id string, y_true boolean")
    pred = spark.createDataFrame([(1, "a", True, A, 0.9), (2, "a", False, None, 0.1), (3, None, True, A, 0.5)], "ord long, pair_id string, y_pred boolean, t_pred string, conf double")
    got = {r["ord"]: (r["y_pred"], r["conf"], r["filled"]) for r in alignment.align(gold, pred).collect()}
    assert got == {1: (False, 0.1, False), 2: (False, 0.1, False), 3: (False, None, True)}


def test_type_id_rejects_unknown(spark):
    df = spark.createDataFrame([(None,), (D,)], "t string")
    assert [r[0] for r in df.select(alignment.type_id("t")).collect()] == [-100, 3]
    with pytest.raises(Exception, match="unknown type"):
        spark.createDataFrame([("x",)], "t string").select(alignment.type_id("t")).collect()


def test_jurisdiction_pair(spark):
    df = spark.createDataFrame([("EU", "AU"), (None, "EU"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(alignment.jurisdiction_pair(F.col("a"), F.col("b"))).collect()] == ["AU__EU", "?__EU", "?__?"]


def test_majority_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, "a"), (5, None)], "record_no long, v string")
    assert one(predictors.majority_class(df, "v")) == {"value": "a", "n": 2}


def test_summary_of_one_value_has_no_spread(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "x double")
    assert one(predictors.summarise(df, "x")) == {"mean": 0.5, "std": 0.0, "min": 0.5, "max": 0.5, "n": 1}


def kappa_of(spark, pairs):
    df = spark.createDataFrame([(f"p{i}", a, b, "both") for i, (a, b) in enumerate(pairs)], "pair_id string, a string, b string, side string")
    return one(statistics.cohen_kappa(df))


def test_kappa(spark):
    assert kappa_of(spark, [(A, A)] * 5 + [(B, B)] * 5)["kappa"] == 1.0
    balanced = [(x, y) for x in CONFLICT_TYPES for y in (A, B)]
    assert kappa_of(spark, balanced)["kappa"] == pytest.approx(0.0)
    assert math.isnan(kappa_of(spark, [(A, A)] * 4)["kappa"])
    assert kappa_of(spark, [(A, "other"), (A, A), (B, B)])["n"] == 2


@pytest.mark.parametrize("value, name", [(-0.1, "poor"), (0.1, "slight"), (0.3, "fair"), (0.5, "moderate"), (0.6, "substantial"), (0.7, "substantial"), (0.9, "almost perfect")])
def test_band(spark, value, name):
    assert spark.range(1).select(statistics.band(F.lit(value))).first()[0] == name


def test_resample_draws_n_rows(spark):
    df = rows_of(spark, *[(True, A, True, A)] * 30, *[(False, None, True, B)] * 10, *[(True, B, False, None)] * 20)
    for slots in (1 << 20, 8):
        drawn = statistics.resample(df, statistics.CELL, order=statistics.CELL, replicates=50, block_slots=slots)
        assert {r["w"] for r in drawn.groupBy("b").agg(F.sum("w").alias("w")).collect()} == {60}
        share = drawn.where("y_true and y_pred").agg(F.sum("w")).first()[0] / (50 * 60)
        assert share == pytest.approx(0.5, abs=0.05)
    got = {r["metric"]: r for r in statistics.bootstrap_intervals(df, replicates=50).collect()}
    assert got["f1"]["low"] <= got["f1"]["mean"] <= got["f1"]["high"] and got["f1"]["n"] == 50


def test_paired_bootstrap_of_equal_systems(spark):
    df = spark.createDataFrame([(i % 3 == 0, i % 2 == 0, i % 2 == 0) for i in range(40)], "y_true boolean, y_a boolean, y_b boolean")
    got = one(statistics.paired_bootstrap(df, replicates=30))
    assert got["observed"] == 0.0 and got["p_value"] == 1.0


def records(spark, rows):
    lines = [json.dumps(r) for r in rows]
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "record_no long, j string").select("record_no", F.from_json("j", LABELLED_PAIR).alias("r")).select("record_no", "r.*")


@pytest.mark.parametrize("sizes", [(1, 5), (90, 170), (0, 3)])
def test_stratified_split_counts(spark, sizes):
    rows = [{"pair_id": f"{t}{i}", "record_type": "conflict" if t else "non_conflict", "conflict_type": A if t else None} for t, n in enumerate(sizes) for i in range(n)]
    got = dataset.stratified_split(records(spark, rows)).groupBy("stratum", "split").count().collect()
    counts = {(r["stratum"], r["split"]): r["count"] for r in got}
    for stratum, n in zip(("non_conflict", f"conflict::{A}"), sizes):
        want = [int(n * p) for p in (0.7, 0.15, 0.15)]
        for k in range(n - sum(want)):
            want[k] += 1
        assert [counts.get((stratum, s), 0) for s in ("train", "val", "test")] == want


def test_record_checks_stop_at_missing_fields(spark):
    regime = {"regime_id": "R", "jurisdiction": "EU"}
    rows = [{"record_type": "conflict"}, {"pair_id": "a", "record_type": "x", "regime_a": regime, "regime_b": regime},
            {"pair_id": "b", "record_type": "conflict", "regime_a": regime, "regime_b": {"regime_id": ""}, "conflict_type": "x", "severity": "low"}, {"pair_id": "c", "record_type": "non_conflict", "regime_a": regime, "regime_b": regime}]
    got = [(r["record_no"], r["problem"]) for r in dataset.record_checks(records(spark, rows)).orderBy("record_no", "problem").collect()]
    assert got == [(0, "missing pair_id, regime_a, regime_b"), (1, "bad record_type"), (2, "bad conflict_type"), (2, "empty regime_b.regime_id")]


def py_clean(text):
    """Python's reading of the cleaning rules, for texts that NFKC leaves alone."""
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return "\n".join(line.rstrip() for line in text.split("\n")).strip()


PIECES = ["a b", "Page 3 of 10", "3/10", " 12 ", "x ", " y", "\r", "", "  two  ", "t\tab", "1234 5", "page 7"]


@settings(max_examples=1, deadline=None)
@given(st.just(0))
def test_generated_pieces_are_fixed(_):
    assert len(PIECES) == 12


def test_cleaning_means_what_it_does_in_python(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    page = re.compile(r"^\s*(?:page\s+)?\d{1,4}(?:\s*/\s*\d{1,4}|\s+of\s+\d{1,4})?\s*$", re.I | re.M)
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", T.drop_page_numbers("t").alias("a"), T.squeeze_space("t").alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (page.sub("", t), py_clean(t)), repr(t)


def test_nfkc_and_signs(spark):
    texts = ["plain", "ﬁne…", "‘q’ “d” – — −", "so­ft", None, "x y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.plain_signs(T.nfkc("t"))).collect()]
    assert got == ["plain", "fine...", "'q' \"d\" - - -", "soft", None, "x y"]
    assert unicodedata.normalize("NFKC", "x y") == "x y"


def test_edge_lines(spark):
    df = spark.createDataFrame([("",), ("one",), ("aaa\nbbb\n\nccc\nddd",), ("\n".join(f"line {i}" for i in range(9)),), ("ab\n" + "x" * 121,)], "t string")
    got = [r[0] for r in df.select(T.edge_lines("t")).collect()]
    assert got == [[], ["one", "one"], ["aaa", "bbb", "ccc", "bbb", "ccc", "ddd"], ["line 0", "line 1", "line 2", "line 6", "line 7", "line 8"], []]


EXTRACTED = "doc_id string, extractor string, page_count int, pages array<struct<page: int, text: string>>, extracted_at timestamp"


def test_quality_reasons(spark):
    long = "x" * 300
    docs = [("a", "failed", 0, [], None), ("b", "ocr", 8, [(i, "" if i < 5 else long) for i in range(8)], None), ("c", "ocr", 1, [(1, long)], None), ("d", "ocr", 1, [(1, "Article 5 " + long)], None), ("e", "ocr", 1, [(1, "Article 5 " + long + "�" * 9)], None), ("f", "ocr", 1, None, None)]
    got = {r["doc_id"]: (r["needs_reextraction"], r["reason"]) for r in ingestion.with_verdict(ingestion.document_checks(spark.createDataFrame(docs, EXTRACTED))).collect()}
    assert got["a"] == (True, "extraction failed; near-empty document")
    assert got["b"] == (True, "62% of sampled pages near-empty")  # half to even; 112 characters a page
    assert got["c"] == (False, "no section markers in sample") and got["d"] == (False, "")
    assert got["e"] == (True, "high suspicious-char rate (OCR garble?)") and got["f"][0]


def test_clean_pages_drops_boilerplate(spark):
    pages = [(i, f"Site header\nBody {i} text here\nmore of {i}\nand more {i}\nand again {i}\nPage {i}") for i in range(1, 5)]
    df = spark.createDataFrame([("d", "x", 4, pages, None)], EXTRACTED)
    got = [r["text"] for r in ingestion.clean_pages(df).orderBy("pos").collect()]
    assert got[0] == "Body 1 text here\nmore of 1\nand more 1\nand again 1"
    joined = ingestion.joined_text(ingestion.clean_pages(df), ["doc_id"]).first()["text"]
    assert joined.startswith("\f<PAGE 1>\f\nBody 1") and "\n\f<PAGE 2>\f\nBody 2" in joined


def cites(blocks):
    return [b["citation"] for b in blocks]


def test_parsers():
    clause = "Intro\n1 Scope\ntext\n2.1 Terms\nmore\n30 June 2025\n2.1.1 Detail\nend"
    blocks = structure.PARSERS["clause"](clause)
    assert cites(blocks) == ["Preamble", "Clause 1 - Scope", "Clause 2.1 - Terms", "Clause 2.1.1 - Detail"]
    assert [b["parent_citation"] for b in blocks] == [None, None, "Clause 2", "Clause 2.1"]
    assert cites(structure.PARSERS["guide"]("RG 1.1 one see RG 1.2 two")) == ["RG 1.1", "RG 1.2"]
    assert cites(structure.PARSERS["act"]("5  Definitions\nx\n12A  Penalties\ny")) == ["s.5 - Definitions", "s.12A - Penalties"]
    regulation = "Title\n(1) Whereas\n(2) Also\nArticle 1\na\nArticle 2a\nb\nANNEX I\nc\nArticle 9\nd"
    assert cites(structure.PARSERS["regulation"](regulation)) == ["Preamble", "Recital 1", "Recital 2", "Article 1", "Article 2a", "Annex I"]
    assert cites(structure.PARSERS["regulation"]("no articles")) == ["(no structure)"]
    assert cites(structure.parse_generic("PART I\nx\nPART II\ny")) == ["PART I", "PART II"]
    assert structure.parse_generic("") == [] and structure.PARSERS["clause"]("\n") == []


def test_pages_of_blocks():
    text = "\f<PAGE 1>\f\nChapter 1\nx\n\f<PAGE 2>\f\nChapter 2\ny"
    blocks = structure.parse_generic(text)
    assert [(b["page_start"], b["page_end"]) for b in blocks if b["citation"].startswith("Chapter")] == [(1, 1), (1, 2)] or [(b["page_start"], b["page_end"]) for b in blocks][-1][1] == 2
    assert structure.Pages(text).at(0) is None and structure.Pages(text).at(len(text)) == 2


def block(n, kind="section", parent=None):
    return {"text": " ".join(["w"] * n), "citation": f"c{n}", "kind": kind, "page_start": 1, "page_end": 1, "parent_citation": parent}


def test_pack_blocks():
    sizes = lambda blocks: [(b["citation"], structure.count_words(t)) for b, t in structure.pack_blocks(blocks)]
    assert sizes([block(50), block(150), block(201)]) == [("c50", 200), ("c201", 201)]
    assert sizes([block(50, parent="a"), block(60, parent="b"), block(60, kind="misc", parent="b")]) == [("c50", 50), ("c60", 60), ("c60", 60)]
    assert [n for _, n in sizes([block(900)])] == [200, 200, 200, 200, 100]
    sentences = " ".join("A" + " b" * 98 + "." for _ in range(5))  # 100 tokens each
    assert [structure.count_words(t) for t in structure.split_block(sentences, 200, 400)] == [200, 200, 100]
    assert structure.pack_blocks([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.sampled_from(["a", "b"]), st.sampled_from([None, "p"])), max_size=12))
def test_packing_keeps_every_word(plan):
    blocks = [block(n, k, p) for n, k, p in plan]
    packed = structure.pack_blocks(blocks)
    assert all(structure.count_words(t) <= 400 for _, t in packed)
    assert sum(structure.count_words(t) for _, t in packed) == sum(n for n, _, _ in plan)


REPLIES = [
    ('```json\n{"conflict_present": true, "conflict_type": "recurring_friction", "rationale": "x"}\n```', "A", (True, D, None)),
    ('\\boxed{{"conflict_present": "FALSE", "conflict_type": "null"}}', "A", (False, None, None)),
    ('text {"conflict_present": true, "conflict_type": "A."} trailing }', "C", (True, A, None)),
    ('{"conflict_present": true, "conflict_type": "A."}', "A", (None, None, "unknown_conflict_type")),
    ('{"conflict_present": true, "conflict_type": "this is A structural thing"}', "C", (True, A, None)),
    ('{"conflict_present": true, "conflict_type": "recurring_friction, structural_unresolved"}', "B", (None, None, "multiple_types_matched")),
    ('{"conflict_present": false, "conflict_type": "recurring_friction"}', "B", (None, None, "type_set_without_conflict")),
    ('{"conflict_present": 1}', "A", (None, None, "schema_wrong_type")),
    ('{"conflict_present": true, "conflict_type": 3}', "A", (None, None, "schema_wrong_type")),
    ('{"x": {"y": "}"}}', "A", (None, None, "schema_missing_fields")),
    ("{nope}", "A", (None, None, "invalid_json")),
    ("", "A", (None, None, "no_json_block_found")),
    (None, "A", (None, None, "no_json_block_found")),
]


def test_reply_parsing(spark):
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(REPLIES)], "i int, content string, v string")
    got = [(r["conflict_present"], r["conflict_type"], r["failure_reason"]) for r in replies.parse_replies(df, variant_col="v").orderBy("i").collect()]
    assert got == [want for _, _, want in REPLIES]


def test_passage_and_prompt(spark):
    df = spark.createDataFrame([([("c", "s", 3, " one ")], None), ([("c", "s", 0, None), ("c", "s", None, "{b}")], [])], "e array<struct<chunk_id:string,source_doc:string,page:int,passage:string>>, f array<struct<chunk_id:string,source_doc:string,page:int,passage:string>>")
    assert [tuple(r) for r in df.select(replies.passage("e"), replies.passage("f")).collect()] == [("[Chunk 1, p.3]\none", ""), ("[Chunk 1]\n\n\n[Chunk 2]\n{b}", "")]
    filled = df.select(replies.render("{a}-{b}", {"a": replies.passage("e"), "b": F.lit("z")})).collect()
    assert filled[1][0] == "[Chunk 1]\n\n\n[Chunk 2]\n{b}-z"


def test_joint_pack():
    assert training.joint_pack([10, 10], [5, 5, 5], 100)[:4] == (2, 3, 20, 15)
    assert training.joint_pack([], [], 100) == (0, 0, 0, 0, False, False, False, False)
    assert training.joint_pack([600, 5], [20], 509) == (1, 1, 254, 20, True, False, True, False)
    used = training.joint_pack([300, 300], [200, 9], 509)
    assert used[:4] == (1, 2, 300, 209) and used[4] and not used[5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=6), st.lists(st.integers(1, 300), max_size=6))
def test_joint_pack_keeps_the_budget(a, b):
    ua, ub, ta, tb, short_a, short_b, _, _ = training.joint_pack(a, b, 509)
    assert ta + tb <= 509 and ta == sum(a[:ua]) and tb == sum(b[:ub])
    assert short_a == (ua < len(a)) and short_b == (ub < len(b))


def test_early_stop_and_winner(spark):
    df = spark.createDataFrame([(1, e, s) for e, s in enumerate([0.1, 0.3, 0.3, 0.2, 0.1, 0.9], 1)] + [(2, 1, 0.5)], "run int, epoch int, score double")
    got = {r["run"]: (r["best_epoch"], r["best_score"], r["stopped_at"]) for r in training.early_stop(df, ["run"]).collect()}
    assert got == {1: (2, 0.3, 5), 2: (1, 0.5, None)}
    runs = spark.createDataFrame([(1, 0.5, None), (2, 0.5, 0.1), (3, 0.4, 0.9)], "i int, f1 double, t double")
    assert training.sweep_winner(runs, ["f1", "t"], "i").first()["i"] == 2


def test_truncation_statistics_take_exact_elements(spark):
    lengths = [5, 7, 7, 9, 30, 31, 32, 33, 34, 35]
    df = spark.createDataFrame([(n, n > 30, False, False, False) for n in lengths], "length int, truncated_a boolean, truncated_b boolean, mid_a boolean, mid_b boolean")
    got = one(training.truncation_statistics(df))
    assert (got["median"], got["p90"], got["least"], got["most"]) == (sorted(lengths)[5], sorted(lengths)[9], 5, 35)


def test_learning_rate(spark):
    got = [r[0] for r in spark.range(0, 11, 5).select(training.learning_rate(F.col("id"), 5, 10, 2.0)).collect()]
    assert got == [0.0, 2.0, 0.0]


def test_ratio_of_nothing(spark):
    assert spark.range(1).select(scores.ratio(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_hash_index(spark):
    runs = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, fingerprint string")
    index = spark.createDataFrame([("a", "0"), ("c", "3")], "key string, fingerprint string")
    assert {r["key"]: r["consistent"] for r in dataset.hash_consistency(runs, index).collect()} == {"a": False, "b": True}
    assert sorted(tuple(r) for r in dataset.upsert(index, runs).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_overfit_alarm_and_softmax(spark):
    df = spark.createDataFrame([(2, 0.99, 0.1), (3, 0.99, 0.1), (4, 0.99, 0.5)], "epoch int, train_f1 double, val_f1 double")
    assert [r["epoch"] for r in training.overfit(df).collect()] == [3]
    got = spark.createDataFrame([([0.0, 0.0],), ([0.0, 3.0],)], "x array<double>").select(training.softmax_confidence("x"), training.argmax("x")).collect()
    assert got[0][0] == 0.5 and got[1][1] == 1


def test_encoder_examples(spark):
    ids, types = training.build_example([[5, 6], [7]], [[8]], cls=1, sep=2)
    assert ids == [1, 5, 6, 7, 2, 8, 2] and types == [0, 0, 0, 0, 0, 1, 1]
    assert training.build_example([[9] * 600], [], cls=1, sep=2)[0] == [1] + [9] * 254 + [2, 2]
    assert training.pad([[1], [1, 2]], 0) == ([[1, 0], [1, 2]], [[1, 0], [1, 1]])
    assert training.pad([], 0) == ([], [])
    rows = [{"pair_id": "a", "record_type": "conflict", "conflict_type": C, "evidence_a": [{"passage": "x y"}, {"passage": " "}]}, {"record_type": "non_conflict", "conflict_type": C}, {"record_type": "conflict", "conflict_type": "odd"}]
    got = training.encoder_examples(records(spark, rows), lambda t: [9] * len(t.split())).orderBy("record_no").collect()
    assert [(r["binary_label"], r["typology_label"]) for r in got] == [(1, 2), (0, -100), (1, -100)] and list(got[0]["input_ids"]) == [1, 9, 9, 2, 2]


@pytest.mark.parametrize("block", [100, 2])
def test_near_vectors(spark, block):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, v) for i, v in enumerate(base)] + [(i + 20, [2 * x + rng.gauss(0, 0.1) for x in v]) for i, v in enumerate(base)] + [(50, None), (51, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * 8) / math.dist(b, [0] * 8)
    want = {(i, j) for (i, a) in rows[:24] for (j, b) in rows[:24] if i % 2 == 0 and i != j and cos(a, b) >= 0.9}
    got = {(r["query_id"], r["id"]) for r in vectors.near_vectors(df, df.where("vec_id % 2 = 0"), block_rows=block).collect()}
    assert got == want and want
    assert vectors.near_vectors(df, df.limit(0)).collect() == []


def test_paths_and_subsets(spark):
    df = spark.createDataFrame([("/a/b", 1), ("x/ATRO/y", 2), ("x/SGMB-Q/y", 3), ("x/ATROX/y", 4), (None, 5)], "source_path string, record_no long")
    got = sorted(tuple(r) for r in dataset.path_problems(df, "source_path", ["ATRO", "SGMB-"]).collect())
    assert got == [("/a/b", "absolute path"), ("x/ATRO/y", "withheld source"), ("x/SGMB-Q/y", "withheld source")]
    picked = dataset.ordered_subset(df, "source_path", ["x/ATROX/y", "/a/b"]).collect()
    assert [(r["place"], r["record_no"]) for r in picked] == [(0, 4), (1, 1)]
    with pytest.raises(KeyError, match="nothing"):
        dataset.ordered_subset(df, "source_path", ["nothing"])
    assert [r["record_no"] for r in dataset.hash_sample(df, 2, id_col="record_no").collect()] == [r["record_no"] for r in dataset.hash_sample(df, 2, id_col="record_no").collect()]


def test_release_paths_and_targets(spark):
    df = spark.createDataFrame([("ab" * 32, " Doc "), ("cd" * 32, "x.HTML"), ("ef" * 32, None)], "sha256 string, document_title string")
    assert [r["target"] for r in dataset.fetch_targets(df).orderBy("sha256").collect()] == ["abababab/Doc.pdf", "cdcdcdcd/x.HTML", "efefefef/untitled.pdf"]


def test_numbered_is_the_place_in_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert {r["x"]: r["row_no"] for r in dataset.numbered(df.repartition(7), ["x"], first=2).collect()} == {i: i + 2 for i in range(1000)}
    assert dataset.numbered(df.limit(0), ["x"]).collect() == []


def test_splits_do_not_depend_on_the_buckets(spark):
    rows = spark.range(500).select(F.col("id").alias("record_no"), F.when(F.col("id") % 3 == 0, "conflict").otherwise("non_conflict").alias("record_type"), F.lit("recurring_friction").alias("conflict_type"))
    a, b = (sorted(tuple(r) for r in dataset.stratified_split(rows, bucket_rows=n).collect()) for n in (100_000, 1))
    assert a == b and len(a) == 500


def test_unknown_prompt_variant(spark):
    from docloom.functions import prompts

    with pytest.raises(ValueError):
        prompts.rendered(spark.range(1), ["Z"])
    assert [r["partial"] for r in prompts.grid(spark, ["m"], ["val"], ["A"]).collect()] == [False]


def test_chunks_by_a_public_vocabulary(spark):
    from docloom.functions import tokenizers

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    own = tokenizers.tokenizer("rank_file", path=path)
    text = "Zürich 😀 rules. " * 300
    assert own.decode(own.encode(text)) == text and "".join(own.pieces(text, 7)) == text and "".join(own.pieces("字😀" * 50, 1)) == "字😀" * 50
    assert "".join(tokenizers.tokenizer().pieces(text, 7)) == text
    docs = spark.createDataFrame([(1, text + "\n\n" + "word " * 900), (2, None)], "doc_id long, text string")
    rows = structure.chunk_documents(docs, tokens="rank_file", path=path).collect()
    assert len(rows) > 5 and all(r["n_tokens"] == own.count(r["text"]) <= 402 for r in rows)
    with pytest.raises(ValueError):
        tokenizers.tokenizer("none")
    tokenizers.register("chars", lambda: type("Chars", (), {"count": staticmethod(len), "pieces": staticmethod(lambda t, n: (t[i : i + n] for i in range(0, len(t), n)))})())
    assert tokenizers.tokenizer("chars").count("abc") == 3


def test_collapse_follows_chains(spark):
    from docloom.operators import vectors

    rows = spark.range(1, 60).withColumnRenamed("id", "vec_id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)][::-1] + [(50, 51), (51, 50), (55, 55), (None, 3)], "query_id long, id long")
    got = {r["vec_id"]: r["class_id"] for r in vectors.collapse(rows, pairs).collect()}
    assert got == {i: 1 if i <= 40 else 50 if i in (50, 51) else i for i in range(1, 60)}
    assert vectors.collapse(rows.limit(0), pairs.limit(0)).collect() == []
