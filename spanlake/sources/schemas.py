"""Explicit schemas of the files read and written, as DDL."""

SPAN = "STRUCT<start: INT, `end`: INT, text: STRING>"
PERSON = "STRUCT<id: STRING, first: STRING, last: STRING, full: STRING>"
HIT = f"STRUCT<document_id: STRING, chunk_number: INT, title: STRING, url: STRING, extraction: ARRAY<{SPAN}>>"
SPAN_ROW = (
    f"query STRING, paper_id STRING, chunk_index INT, chunk STRING, relevance_label STRING, is_relevant BOOLEAN, gold_spans ARRAY<{SPAN}>, gold_spans_raw ARRAY<STRING>, gold_paper_id STRING, gold_chunk_index INT, retrieval_rank INT, baseline_extraction ARRAY<{SPAN}>, source STRING"
)
SILVER_ROW = (
    f"question STRING, paper_id STRING, chunk_index INT, chunk STRING, label INT, answerable BOOLEAN, spans ARRAY<{SPAN}>, source STRING, retrieval_rank INT, gold_paper STRING, gold_chunk INT, predicted_texts ARRAY<STRING>, latency_s FLOAT, err STRING"
)
PREDICTION = f"query STRING, question STRING, paper_id STRING, chunk_index INT, pred_spans ARRAY<{SPAN}>, predicted_texts ARRAY<STRING>, latency_s DOUBLE, error STRING"
RUN = f"query STRING, gold_paper STRING, gold_chunk INT, results ARRAY<{HIT}>, paper_found BOOLEAN, chunk_found BOOLEAN, corr_paper_rank INT, corr_chunk_rank INT"
QUESTIONS = "chunk_index INT, chunk STRING, q_types ARRAY<STRING>, qa ARRAY<STRUCT<q_type: STRING, question: STRING, query: STRING, semantic_question: STRING>>, err STRING"
ANNOTATION = "query STRING, rank STRING, title STRING, url STRING, chunk_number STRING, chunk STRING, relevance_label STRING, extraction_label STRING, gold_extraction STRING"
PAPER = (
    "anthology_id STRING, paper_id STRING, bibkey STRING, bibtype STRING, ingest_date STRING, title STRING, title_html STRING, title_raw STRING, url STRING, pdf STRING, thumbnail STRING, doi STRING, citation STRING, citation_acl STRING, bibtex STRING, "
    f"author ARRAY<{PERSON}>, author_string STRING, editor ARRAY<{PERSON}>, booktitle STRING, parent_volume_id STRING, year STRING, venue ARRAY<STRING>, pages STRING, page_first STRING, page_last STRING, abstract_html STRING, abstract_raw STRING, language STRING, "
    "attachment ARRAY<STRUCT<filename: STRING, type: STRING, url: STRING>>, has_markdown BOOLEAN"
)
