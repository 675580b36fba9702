"""Types of the engine's tables as DDL text (usable without a session), and their vocabularies."""

from __future__ import annotations

# Ordered label vocabulary (it fixes the axes of confusion matrices and the ids 0-3), and other vocabularies.
CONFLICT_TYPES = ["structural_unresolved", "operationally_resolvable", "interpretive_fact_sensitive", "recurring_friction"]
SEVERITIES = ["low", "medium", "high"]
RECORD_TYPES = ["conflict", "non_conflict"]
JURISDICTIONS = ["EU", "Singapore", "Australia", "International"]
NON_CONFLICT_SUBTYPES = ["same_jurisdiction_no_overlap", "cross_jurisdiction_distinct_scope", "aligned_complementary", "temporal_supersession", "topical_mismatch"]
DECISIONS = ["accept", "revise", "reject"]
SPLITS = ["train", "val", "test", "gold_iaa"]
TIERS = ["tier 1", "tier 2", "tier 3"]
NO_TYPE = "__none__"


REGIME = "struct<regime_id: string, jurisdiction: string, issuing_body: string, short_name: string>"
EVIDENCE = "struct<chunk_id: string, source_doc: string, page: int, passage: string>"
REVIEW = "struct<reviewer_id: string, reviewed_at: string, decision: string, notes: string, original_conflict_type: string, original_severity: string, original_review_status: string>"
PAGE = "struct<page: int, text: string>"
BLOCK = "text string, citation string, kind string, page_start int, page_end int, parent_citation string"

LABELLED_PAIR = (
    f"pair_id string, record_type string, label string, regime_a {REGIME}, regime_b {REGIME}, "
    f"evidence_a array<{EVIDENCE}>, evidence_b array<{EVIDENCE}>, rationale string, annotator_id string, annotator_model string, "
    "annotated_at string, revision int, review_status string, human_review_required boolean, confidence double, claude_caveats array<string>, "
    f"conflict_type string, severity string, non_conflict_subtype string, review {REVIEW}"
)
PREDICTION = "pair_id string, predicted_conflict_present boolean, predicted_conflict_type string, confidence_score double, model_metadata struct<model_name: string, model_version: string, config_hash: string>"
EXTRACTED = f"doc_id string, source_path string, jurisdiction string, issuing_body string, filename string, ext string, extractor string, page_count int, pages array<{PAGE}>, extraction_errors array<string>"
CHUNK = (
    "chunk_id string, doc_id string, jurisdiction string, issuing_body string, document_type string, filename string, source_path string, document_hash string, "
    "citation string, parent_citation string, kind string, page_start int, page_end int, retrieval_date string, effective_date string, source_url string, text string, "
    "n_tokens int, regime_tags array<string>, topic_tags array<string>, applicability_tags array<string>"
)
MANIFEST = "sha256 string, document_title string, source_url string, issuing_body string, source_collection string, license_name string"
ATTEMPT = "attempt_n int, temperature double, latency_seconds double, finish_reason string, content string, client_error string"
