"""Row shapes, as DDL."""

DOCUMENT = "filename string, path string, content string"
MASTER_CHUNK = "master_id bigint, text string, metadata struct<source:string,path:string>"
CHUNK = "chunk_id bigint, text string, size int, original_master_ids array<bigint>, metadata struct<source:string,path:string>"
INDEX = "chunk_id bigint, text string, source string, path string, embedding array<float>, norm_embedding array<float>"
GOLD_FILE = "question_type string, question string, reference_answer string"
QUERY = "query_id bigint, query_type string, query string, answer string"
HIT = "query_id bigint, rank int, score double, chunk_id bigint, text string, source string"
