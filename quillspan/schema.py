"""Schemas of the tables that operators take and return."""

from __future__ import annotations

LOCATION = "source_path string, page int, section string, line_start int, line_end int, char_start int, char_end int"
BLOCK = f"kind string, text string, location struct<{', '.join(c.replace(' ', ':') for c in LOCATION.split(', '))}>, attributes map<string,string>"
METADATA = f"{LOCATION}, media_type string, language string, created_at string, attributes map<string,string>"
CHUNK = f"id string, document_id string, ordinal int, text string, metadata struct<{', '.join(c.replace(' ', ':') for c in METADATA.split(', '))}>"
GOLD = "id string, query string, relevant_chunk_ids array<string>, tags array<string>"
RAG_GOLD = "id string, query string, relevant_chunk_ids array<string>, required_facts array<string>"
FILTER = "field string, operator string, value string, source string, evidence string"
CANDIDATE = "qid long, chunk_id string, score double, rank int, source string"
