"""Schemas of the tables. Period dates stay strings, because labels such as "February 30, 2024" keep their form."""

from __future__ import annotations

# each a DDL text, as readers and createDataFrame take it
DOCUMENTS = "id string, filename string, sha256 string, title string, publisher string, publication_date string, document_type string, page_count int, file_path string, created_at timestamp"
PAGES = "id string, document_id string, pdf_page_number int, printed_page_label string, raw_text string, width double, height double, is_complex boolean, processed_at timestamp"
EVIDENCE = "id string, document_id string, page_id string, evidence_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, artifact_path string, extraction_confidence double, created_at timestamp"
FACTS = "id string, document_id string, subject string, predicate string, raw_value string, raw_unit string, numeric_value double, normalized_value double, normalized_unit string, period_start string, period_end string, period_label string, scope string, status string, qualifiers map<string,string>, evidence_ids array<string>, supporting_quote string, quote_found boolean, extraction_confidence double, retrieval_text string, created_at timestamp"
RELATIONSHIPS = "id string, fact_a_id string, fact_b_id string, relationship_type string, confidence double, context_dimension string, reason string, method string, created_at timestamp"
JOBS = "id string, document_id string, status string, stage string, progress int, pages_total int, pages_done int, facts_extracted int, relationships_found int, error string, created_at timestamp"
ISSUES = "id string, document_id string, page_id string, evidence_id string, issue_type string, description string, confidence double, created_at timestamp"
EXTRACTED_FACT = "struct<subject:string,predicate:string,raw_value:string,raw_unit:string,numeric_value:double,period_label:string,scope:string,status:string,qualifiers:map<string,string>,supporting_quote:string,confidence:double>"
EXTRACTION = f"struct<facts:array<{EXTRACTED_FACT}>>"
RELATIONSHIP_TYPES = ("CORROBORATES", "CONTRADICTS", "LIKELY_CONTRADICTION", "CONTEXT_RECONCILES", "UNRELATED")
