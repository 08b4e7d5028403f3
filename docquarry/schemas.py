"""Schemas of the tables that the engine passes on, as DDL."""

UPLOAD = "doc_id string, filename string, content binary"
PAGE = "doc_id string, page_number int, text string"
CHUNK = "doc_id string, chunk_id int, page_number int, start int, text string"
HIT = "qid long, rank int, doc_id string, chunk_id int, page_number int, text string, similarity double"
METADATA = "doc_id string, filename string, page_count long, chunk_count long, embedding_dimension int, status string"
ERROR = "doc_id string, stage string, message string"
HISTORY = "session_id string, seq long, question string, answer string, sources array<int>"
