"""Versioned knowledge-base tables derived from the plain tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.functions import text

KB, MODEL = "kb-1", "m1"
#: A chain with gaps; version 8 hangs from 5, 9 from 8, 11 stands on another base.
CHAIN = [(1, 0), (2, 1), (3, 2), (5, 3), (8, 5), (9, 8)]
MEMBERS = ["node-a", "node-b", "node-c", "node-d", "node-e"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions: seven tenths added; a tenth updated and a tenth deleted; the rest added."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("doc_id") % 10
    parts = [(1, "ADD", r < 7, F.col("text")), (2, "UPDATE", r == 0, F.concat("text", F.lit(" v2"))), (2, "DELETE", r == 1, F.lit(None).cast("string")), (3, "ADD", r >= 7, F.col("text"))]
    out = None
    for version, op, which, content in parts:
        p = d.where(which).select(F.lit(KB).alias("kb_id"), F.lit(version).cast("long").alias("version_id"), F.col("doc_id").cast("int").alias("pos"), F.lit(op).alias("op"), F.col("doc_id").cast("string").alias("doc_id"), content.alias("content"))
        out = p if out is None else out.unionByName(p)
    return out


def doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return c.select("kb_id", "doc_id", "version_id", (F.col("op") == "DELETE").alias("is_tombstone"), "content")


def version_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_id, version_id, doc_id of the three versions."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"))
    v = spark.range(1, 4).select(F.col("id").alias("version_id"))
    r = F.col("n") % 10
    member = F.when(F.col("version_id") == 1, r < 7).when(F.col("version_id") == 2, (r < 7) & (r != 1)).otherwise(r != 1)
    return d.crossJoin(F.broadcast(v)).where(member).select(F.lit(KB).alias("kb_id"), "version_id", F.col("n").cast("string").alias("doc_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_id, doc_id, version_id, pos, chunk, chunk_id of each content, cut by windows."""
    c = doc_versions(spark, sf_dir).where("not is_tombstone").select("kb_id", "doc_id", "version_id", "content")
    return text.split(c, MODEL, text.ChunkParams("window"))


def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("kb_id", "chunk_id", "doc_id").distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks: chunk_id, doc_id (the label), vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(KB).alias("kb_id"), F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").collect()[0][0]


def chain_versions(spark: SparkSession) -> DataFrame:
    rows = [(KB, v, p, "DURABLE", "READY" if v != 8 else "PENDING", False) for v, p in CHAIN] + [("kb-2", 11, 0, "DURABLE", "READY", False)]
    return spark.createDataFrame(rows, "kb_id string, version_id long, parent_version_id long, data_status string, index_status string, deleting boolean")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(KB).alias("kb_id"), (F.col("user_id") % 5 + 1).alias("version_id"), F.col("ts").cast("timestamp").alias("at"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("success"))


SQL = f"""WITH RECURSIVE changes AS (
  SELECT '{KB}' AS kb_id, 1::BIGINT AS version_id, doc_id AS pos, 'ADD' AS op, doc_id::VARCHAR AS doc_id, text AS content FROM documents WHERE doc_id % 10 < 7
  UNION ALL SELECT '{KB}', 2, doc_id, 'UPDATE', doc_id::VARCHAR, text || ' v2' FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT '{KB}', 2, doc_id, 'DELETE', doc_id::VARCHAR, NULL FROM documents WHERE doc_id % 10 = 1
  UNION ALL SELECT '{KB}', 3, doc_id, 'ADD', doc_id::VARCHAR, text FROM documents WHERE doc_id % 10 >= 7),
doc_versions AS (SELECT kb_id, doc_id, version_id, op = 'DELETE' AS is_tombstone, content FROM changes),
version_docs AS (SELECT '{KB}' AS kb_id, v AS version_id, doc_id::VARCHAR AS doc_id FROM documents, (VALUES (1::BIGINT), (2), (3)) t(v)
  WHERE CASE v WHEN 1 THEN doc_id % 10 < 7 WHEN 2 THEN doc_id % 10 < 7 AND doc_id % 10 <> 1 ELSE doc_id % 10 <> 1 END),
chunk_rows AS (SELECT kb_id, doc_id, version_id, pos::INT AS pos, substring(content, pos * 448 + 1, 512) AS chunk FROM
  (SELECT *, unnest(range(0, greatest(ceil((length(content) - 512) / 448.0), 0)::BIGINT + 1)) AS pos FROM doc_versions WHERE NOT is_tombstone AND length(content) > 0)),
chunks AS (SELECT *, sha256(chunk || '{MODEL}') AS chunk_id FROM chunk_rows),
chunk_docs AS (SELECT DISTINCT kb_id, chunk_id, doc_id FROM chunks),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
vecs AS (SELECT vec_id AS chunk_id, label AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
scores AS (SELECT chunk_id, doc_id, list_inner_product(vecs.v, q.v) AS ip, list_cosine_similarity(vecs.v, q.v) AS cosine, list_distance(vecs.v, q.v) AS l2 FROM vecs, q),
chain(version_id, parent_version_id) AS (VALUES {", ".join(f"({v}::BIGINT, {p}::BIGINT)" for v, p in CHAIN)})
"""
