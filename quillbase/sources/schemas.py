"""Explicit schemas of the engine's tables."""

DOC_CHANGES = "kb_id string, version_id long, pos int, op string, doc_id string, content string"
KBS = "kb_id string, name string, chunk_mode string, window int, overlap int, min_size int, max_size int, avg_bits int, index_type string, similarity string, quantizer string, pq_m int, pq_nbits int, embed struct<service_addr:string,model_id:string>, active_version_id long, status string"
VERSIONS = "kb_id string, version_id long, parent_version_id long, created_at long, data_status string, index_status string, index_ready_nodes array<long>, doc_id_set_hash string, failure_reason string, failure_count int, failure_side string, deleting boolean, request_id string"
DOC_VERSIONS = "kb_id string, doc_id string, version_id long, is_tombstone boolean, content string"
VERSION_DOCS = "kb_id string, version_id long, doc_id string"
CHUNK_DOCS = "kb_id string, chunk_id string, doc_id string"
CHUNK_VECTORS = "kb_id string, chunk_id string, vector array<float>"
INDEX_CHUNKS = "kb_id string, version_id long, chunk_id string, vector array<float>"
DELETED_LOG = "epoch string, seq long, kb_id string, version_id long"
ACCESS_LOG = "kb_id string, version_id long, at timestamp"
CHANGE_LOG = DOC_CHANGES
