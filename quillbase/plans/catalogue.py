"""Queries for the engine's operators and the SQL that they are compared with.

A name begins with the survey's row that the query stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.functions import scalars, text
from quillbase.functions import vectors as V
from quillbase.operators import chain, documents, index, search
from quillbase.plans import fixtures as X
from quillbase.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql follows the fixtures' common table expressions."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = X.SQL + sql
        return f

    return add


# sources and scans

for _v in (1, 2, 3):

    def _asof(spark, sf, v=_v):
        out = documents.as_of(X.doc_versions(spark, sf), v)
        return out.select("doc_id", "version_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))

    query(f"a02_as_of_v{_v}", f"SELECT doc_id, version_id, strlen(content)::BIGINT AS n_bytes, sha256(content) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version_id DESC) AS r FROM doc_versions WHERE version_id <= {_v}) WHERE r = 1 AND NOT is_tombstone")(_asof)

    def _set(spark, sf, v=_v):
        ids = X.changes(spark, sf).select("doc_id").limit(0)
        for i in range(1, v + 1):
            ids = documents.next_set(ids, X.changes(spark, sf).where(F.col("version_id") == i))
        return ids

    query(f"g02_doc_set_v{_v}", f"SELECT doc_id FROM version_docs WHERE version_id = {_v}")(_set)


@query("a01_change_batch", "SELECT version_id, op, count(*)::BIGINT AS n FROM changes GROUP BY ALL")
def a01(spark, sf):
    return X.changes(spark, sf).groupBy("version_id", "op").agg(F.count("*").alias("n"))


@query("a03_visible_version", "SELECT doc_id, max(version_id) AS version_id FROM doc_versions WHERE version_id <= 2 GROUP BY 1")
def a03(spark, sf):
    return X.doc_versions(spark, sf).where("version_id <= 2").groupBy("doc_id").agg(F.max("version_id").alias("version_id"))


@query("a05_local_versions", "SELECT DISTINCT kb_id, version_id FROM version_docs")
def a05(spark, sf):
    return X.version_docs(spark, sf).select("kb_id", "version_id").distinct()


@query("a06_docs_of_chunk", "SELECT chunk_id, count(DISTINCT doc_id) AS n FROM chunk_docs GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def a06(spark, sf):
    return X.chunk_docs(spark, sf).groupBy("chunk_id").agg(F.count_distinct("doc_id").alias("n")).where("n > 1")


@query("a08_chunks_of_docs", "SELECT DISTINCT chunk_id FROM chunk_docs WHERE doc_id IN (SELECT doc_id FROM changes WHERE op = 'UPDATE')")
def a08(spark, sf):
    ids = X.changes(spark, sf).where("op = 'UPDATE'").select("doc_id")
    return X.chunk_docs(spark, sf).join(ids, "doc_id", "left_semi").select("chunk_id").distinct()


@query("a09_version_chunks", "SELECT version_id, count(DISTINCT chunk_id) AS n FROM version_docs JOIN chunk_docs USING (kb_id, doc_id) GROUP BY 1")
def a09(spark, sf):
    return documents.chunks_of(X.version_docs(spark, sf), X.chunk_docs(spark, sf)).groupBy("version_id").agg(F.count("*").alias("n"))


@query("a11_multi_get", "SELECT chunk_id, doc_id FROM vecs WHERE chunk_id IN (SELECT o_orderkey FROM orders)")
def a11(spark, sf):
    wanted = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    return X.vectors(spark, sf).join(wanted, "chunk_id", "left_semi").select("chunk_id", "doc_id")


@query("a14_version_range", "SELECT version_id FROM chain WHERE version_id > 2 AND version_id <= 8")
def a14(spark, sf):
    return X.chain_versions(spark).where((F.col("kb_id") == X.KB) & (F.col("version_id") > 2) & (F.col("version_id") <= 8)).select("version_id")


@query("a16_chain_tail", "SELECT max(version_id) AS version_id FROM chain")
def a16(spark, sf):
    return X.chain_versions(spark).where(F.col("kb_id") == X.KB).agg(F.coalesce(F.max("version_id"), F.lit(0)).alias("version_id"))


@query("a17_liveness", "SELECT i AS version_id, EXISTS (SELECT 1 FROM chain WHERE version_id = i) AS alive FROM range(1, 12) t(i)")
def a17(spark, sf):
    return documents.liveness(X.chain_versions(spark).where(F.col("kb_id") == X.KB), 11)


@query("a19_changes_in_range", "SELECT version_id, op, doc_id FROM changes WHERE version_id > 1 AND version_id <= 3")
def a19(spark, sf):
    return X.changes(spark, sf).where("version_id > 1 and version_id <= 3").select("version_id", "op", "doc_id")


def _log(spark, sf):
    """Operations of orders: each begins a version, most commit, some are marked for deletion and most of these complete."""
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"))
    k = F.col("version_id")
    kinds = F.filter(F.array(F.lit("BEGIN"), F.lit("VERSION_ID"), F.when(k % 7 != 0, "COMMIT"), F.when(k % 5 == 0, "VERSION_DELETE_MARK"), F.when(k % 10 == 0, "VERSION_DELETE_COMPLETE")), lambda x: x.isNotNull())
    rows = o.select("version_id", F.posexplode(kinds).alias("i", "kind"))
    return rows.select((k * 8 + F.col("i")).alias("lsn"), F.lit(X.KB).alias("kb_id"), "version_id", "kind")


@query("a20_recovery", "SELECT o_orderkey AS version_id, 'VERSION_ID' AS kind FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'VERSION_DELETE_MARK' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0")
def a20(spark, sf):
    return documents.recovery(_log(spark, sf)).select("version_id", "kind")


@query("a21_cursors", "SELECT 'kb-' || (o_custkey % 10) AS kb_id, max(o_orderkey) AS cursor FROM orders GROUP BY 1")
def a21(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.groupBy(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id")).agg(F.max("o_orderkey").alias("cursor"))


@query("a22_export", "SELECT entry_type, count(*)::BIGINT AS n FROM (SELECT 'DOC_LIST' AS entry_type FROM version_docs WHERE version_id = 2 UNION ALL SELECT 'DOC_BODY' FROM version_docs WHERE version_id = 2 UNION ALL SELECT unnest(['FORWARD_MAP', 'REVERSE_MAP']) FROM chunk_docs WHERE doc_id IN (SELECT doc_id FROM version_docs WHERE version_id = 2)) GROUP BY 1")
def a22(spark, sf):
    none = spark.createDataFrame([], "kb_id string, chunk_id string, vector array<float>")
    return documents.export_state(X.KB, 2, X.version_docs(spark, sf), X.doc_versions(spark, sf), X.chunk_docs(spark, sf), none).groupBy("entry_type").agg(F.count("*").alias("n"))


@query("a23_bodies_with_tombstones", "SELECT doc_id, max(version_id) AS version_id, arg_max(is_tombstone, version_id) AS is_tombstone FROM doc_versions WHERE version_id <= 2 GROUP BY 1")
def a23(spark, sf):
    return documents.records_as_of(X.doc_versions(spark, sf), 2).select("doc_id", "version_id", "is_tombstone")


@query("a26_mock_embedding", "SELECT doc_id, round(sum(x) / sqrt(sum(x * x)), 2) AS total, count(*)::BIGINT AS dim FROM (SELECT doc_id, ('0x' || substring(sha256(doc_id::VARCHAR), ((i + i // 32) % 32 * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE AS x FROM documents, range(64) t(i)) GROUP BY 1")
def a26(spark, sf):
    v = X.table(spark, sf, "documents").select("doc_id", V.mock_embedding(F.col("doc_id").cast("string")).alias("v"))
    return v.select("doc_id", F.round(V.total(F.transform("v", lambda x: x.cast("double"))), 2).alias("total"), F.size("v").cast("long").alias("dim"))


@query("a28_data_missing", "SELECT c.version_id FROM chain c WHERE NOT EXISTS (SELECT 1 FROM version_docs d WHERE d.version_id = c.version_id)")
def a28(spark, sf):
    v = X.chain_versions(spark).where(F.col("kb_id") == X.KB)
    return chain.leftovers(v, X.version_docs(spark, sf)).select("version_id")


@query("a32_last_access", "SELECT user_id % 5 + 1 AS version_id, max(ts) AS at FROM events GROUP BY 1")
def a32(spark, sf):
    return X.accesses(spark, sf).groupBy("version_id").agg(F.max("at").cast("timestamp_ntz").alias("at"))


@query("a35_quorum_durable", "SELECT kb_id, list_sort(list(c), 'DESC')[3] AS version_id FROM (SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_custkey % 50 // 10 AS node, max(o_orderkey) AS c FROM orders GROUP BY ALL) GROUP BY 1")
def a35(spark, sf):
    o = X.table(spark, sf, "orders")
    c = o.groupBy(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.floor(F.col("o_custkey") % 50 / 10).alias("node")).agg(F.max("o_orderkey").alias("cursor"))
    return documents.quorum_durable(c)


# writers


@query("b11_compact", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(['BEGIN', 'VERSION_ID', CASE WHEN o_orderkey % 7 <> 0 THEN 'COMMIT' END, CASE WHEN o_orderkey % 5 = 0 THEN 'VERSION_DELETE_MARK' END, CASE WHEN o_orderkey % 10 = 0 THEN 'VERSION_DELETE_COMPLETE' END], lambda x: x IS NOT NULL)) AS kind, o_orderkey AS k FROM orders) WHERE NOT (kind = 'BEGIN' AND k % 7 <> 0 AND k <= 1000) GROUP BY 1")
def b11(spark, sf):
    keep = spark.createDataFrame([(X.KB, 1000)], "kb_id string, through long")
    return documents.compacted(_log(spark, sf), keep).groupBy("kind").agg(F.count("*").alias("n"))


@query("b18_document_bytes", "SELECT sum(strlen(content))::BIGINT AS n_bytes, count(*)::BIGINT AS n FROM doc_versions")
def b18(spark, sf):
    return X.doc_versions(spark, sf).agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"), F.count("*").alias("n"))


# filters and projections

_SCORE = {"cosine": ("COSINE", False, "cosine"), "ip": ("INNER_PRODUCT", False, "ip"), "l2": ("EUCLIDEAN", False, "-l2"), "l2sq": ("EUCLIDEAN", True, "-l2 * l2")}
for _name, (_metric, _sq, _expr) in _SCORE.items():

    def _topk(spark, sf, metric=_metric, sq=_sq):
        out = search.exact_topk(X.vectors(spark, sf), X.query_vector(spark, sf), 20, metric, sq)
        return out.select("chunk_id", F.round("score", 6).alias("score"))

    query(f"f04_topk_{_name}", f"SELECT chunk_id, round({_expr}, 6) AS score FROM scores ORDER BY {_expr} DESC, chunk_id LIMIT 20")(_topk)


@query("c01_threshold", "SELECT chunk_id FROM scores WHERE cosine >= 0.2")
def c01(spark, sf):
    return search.threshold(search.scored(X.vectors(spark, sf), X.query_vector(spark, sf)), 0.2).select("chunk_id")


@query("c01_threshold_default", "SELECT count(*)::BIGINT AS n FROM scores WHERE cosine >= 0")
def c01_default(spark, sf):
    return search.threshold(search.scored(X.vectors(spark, sf), X.query_vector(spark, sf))).agg(F.count("*").alias("n"))


@query("c02_membership", "SELECT chunk_id FROM vecs WHERE doc_id < 8")
def c02(spark, sf):
    members = spark.range(8).select(F.col("id").cast("int").alias("doc_id"))
    return X.vectors(spark, sf).join(members, "doc_id", "left_semi").select("chunk_id")


_STATES = "(SELECT s_suppkey AS version_id, s_suppkey % 11 = 0 AS deleting, ['PENDING', 'DURABLE', 'FAILED_PERMANENT'][s_suppkey % 3 + 1] AS d, ['PENDING', 'READY', 'FAILED', 'FAILED_PERMANENT'][s_suppkey % 4 + 1] AS i FROM supplier)"
_STAGE = "CASE WHEN deleting THEN 'DELETING' WHEN d = 'FAILED_PERMANENT' THEN 'DATA_FAILED_PERMANENT' WHEN i = 'FAILED_PERMANENT' THEN 'INDEX_FAILED_PERMANENT' WHEN i = 'READY' THEN 'INDEX_READY' WHEN i = 'FAILED' AND d <> 'PENDING' THEN 'INDEX_FAILED' WHEN d = 'DURABLE' THEN 'DATA_DURABLE' ELSE 'DATA_PENDING' END"


def _states(spark, sf):
    s, k = X.table(spark, sf, "supplier"), F.col("s_suppkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return s.select(F.lit(X.KB).alias("kb_id"), k.alias("version_id"), (k % 11 == 0).alias("deleting"), pick(["PENDING", "DURABLE", "FAILED_PERMANENT"], 3).alias("data_status"), pick(["PENDING", "READY", "FAILED", "FAILED_PERMANENT"], 4).alias("index_status"))


@query("c09_stage", f"SELECT version_id, {_STAGE} AS stage FROM {_STATES}")
def c09(spark, sf):
    return _states(spark, sf).select("version_id", scalars.stage(F.col("deleting"), F.col("data_status"), F.col("index_status")).alias("stage"))


@query("c10_await", f"SELECT version_id, stage IN ('DATA_DURABLE', 'INDEX_READY') AS reached, stage IN ('INDEX_FAILED', 'DATA_FAILED_PERMANENT', 'INDEX_FAILED_PERMANENT', 'DELETING') AS terminal FROM (SELECT version_id, {_STAGE} AS stage FROM {_STATES})")
def c10(spark, sf):
    return c09(spark, sf).select("version_id", scalars.reached(F.col("stage")).alias("reached"), scalars.terminal(F.col("stage")).alias("terminal"))


@query("c08_failed", f"SELECT version_id FROM {_STATES} WHERE NOT deleting AND (d = 'FAILED_PERMANENT' OR i = 'FAILED_PERMANENT')")
def c08(spark, sf):
    return chain.failed(_states(spark, sf)).select("version_id")


@query("k08_next_step", f"SELECT version_id, CASE WHEN stage IN ('INDEX_READY', 'DATA_DURABLE') THEN 'DONE' WHEN stage IN ('DATA_FAILED_PERMANENT', 'INDEX_FAILED_PERMANENT') THEN CASE WHEN have THEN 'RESEND' ELSE 'DISCARD' END WHEN stage = 'DELETING' THEN 'DISCARD' WHEN stage = 'DATA_PENDING' AND missing THEN CASE WHEN have THEN 'RESEND' ELSE 'DISCARD' END ELSE 'WAIT' END AS step FROM (SELECT version_id, {_STAGE} AS stage, version_id % 2 = 0 AS have, version_id % 5 = 0 AS missing FROM {_STATES})")
def k08(spark, sf):
    return c09(spark, sf).select("version_id", scalars.next_step(F.col("stage"), F.col("version_id") % 5 == 0, F.col("version_id") % 2 == 0).alias("step"))


# document queries

_DOCS = "SELECT doc_id, round({agg}(s), 6) AS score FROM (SELECT doc_id, {s} AS s, chunk_id FROM (SELECT * FROM scores ORDER BY {s} DESC, chunk_id LIMIT 15) WHERE {s} >= 0) WHERE doc_id < 8 GROUP BY 1 ORDER BY {agg}(s) DESC, doc_id LIMIT 5"
for _method, _agg in (("MEDIAN", "median"), ("MAX", "max"), ("MEAN", "avg")):

    def _docs(spark, sf, method=_method):
        v = X.vectors(spark, sf)
        ids = v.where("doc_id < 8").select("kb_id", "doc_id").distinct()
        bodies = ids.select("doc_id", F.col("doc_id").cast("string").alias("content"))
        out = search.document_query(v.select("chunk_id", "vector"), v.select("kb_id", "chunk_id", "doc_id"), ids, bodies, X.query_vector(spark, sf), 5, method=method)
        return out.select("doc_id", F.round("score", 6).alias("score"))

    query(f"e01_documents_{_agg}", _DOCS.format(agg=_agg, s="cosine"))(_docs)


@query("f12_document_query", _DOCS.format(agg="median", s="cosine"))
def f12(spark, sf):
    return QUERIES["e01_documents_median"](spark, sf)


@query("f12_batch_topk", "SELECT query_id, chunk_id, r::INT AS rank, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE r <= 10")
def f12_batch(spark, sf):
    v = X.vectors(spark, sf)
    q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    return search.batch_topk(v.select("chunk_id", "vector"), q, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("f08_candidates", "SELECT k::INT AS k, least(greatest(8 * k, 16), 4096)::INT AS candidates, least(greatest(3 * k, 10), 1000)::INT AS hits FROM range(1, 1025) t(k)")
def f08(spark, sf):
    return spark.createDataFrame([(k, scalars.candidates_for(k), scalars.hits_for(k)) for k in range(1, 1025)], "k int, candidates int, hits int")


@query("f03_normalise", "SELECT chunk_id, round(sqrt(list_inner_product(v, v)), 4) AS norm FROM vecs")
def f03(spark, sf):
    v = X.vectors(spark, sf).select("chunk_id", V.normalise(F.transform("vector", lambda x: x * 3)).alias("v"))
    return v.select("chunk_id", F.round(V.norm(F.col("v")), 4).alias("norm"))


@query("f19_sq8_ranges", "SELECT i::INT AS dim, round(min(v[i + 1]), 6) AS lo, round(max(v[i + 1]), 6) AS hi FROM vecs, range(64) t(i) GROUP BY 1")
def f19_ranges(spark, sf):
    r = index.ranges(X.vectors(spark, sf))
    return r.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "x")).select("dim", F.round("x.lo", 6).alias("lo"), F.round("x.hi", 6).alias("hi"))


@query("f19_sq8_codes", "SELECT chunk_id, i::INT AS dim, least(greatest(floor((v[i + 1] - lo) / nullif(hi - lo, 0) * 255 + 0.5), 0), 255)::INT AS code FROM vecs, (SELECT i, min(v[i + 1]) AS lo, max(v[i + 1]) AS hi FROM vecs, range(64) t(i) GROUP BY 1)")
def f19_codes(spark, sf):
    return index.sq8(X.vectors(spark, sf)).select("chunk_id", F.posexplode("code").alias("dim", "code"))


@query("f07_rerank", "SELECT chunk_id, round(cosine, 6) AS score FROM scores ORDER BY cosine DESC, chunk_id LIMIT 10")
def f07(spark, sf):
    v = X.vectors(spark, sf)
    coarse = index.unsq8(index.sq8(v), index.ranges(v))
    return index.two_stage(coarse, v, X.query_vector(spark, sf), 10).select("chunk_id", F.round("score", 6).alias("score"))


@query("f20_fp16_search")
def f20(spark, sf):
    v = X.vectors(spark, sf)
    return index.two_stage(index.half(v, "SQ_FP16"), v, X.query_vector(spark, sf), 10).select("chunk_id", F.round("score", 6).alias("score"))


@query("f20_bf16_search")
def f20b(spark, sf):
    v = X.vectors(spark, sf)
    return index.two_stage(index.half(v, "SQ_BF16"), v, X.query_vector(spark, sf), 10).select("chunk_id", F.round("score", 6).alias("score"))


@query("f21_pq_search")
def f21(spark, sf):
    v, q = X.vectors(spark, sf).select("chunk_id", "vector"), X.query_vector(spark, sf)
    books = index.pq_train(v, 64, 8, 4)
    coarse = index.pq_coarse(index.pq_encode(v, books), books, q, scalars.candidates_for(10))
    return search.rerank(coarse, v, q, 10).select("chunk_id", F.round("score", 6).alias("score"))


@query("f06_ivf_search")
def f06(spark, sf):
    v, q = X.vectors(spark, sf).select("chunk_id", "vector"), X.query_vector(spark, sf)
    centres = index.ivf_train(v, 16)
    return index.ivf_search(index.ivf_assign(v, centres), centres, q, 10, 8).select("chunk_id", F.round("score", 6).alias("score"))


@query("f15_append", "SELECT chunk_id FROM vecs WHERE doc_id BETWEEN 2 AND 7")
def f15(spark, sf):
    v = X.vectors(spark, sf).select("chunk_id", "doc_id")
    base, now = v.where("doc_id < 6"), v.where("doc_id between 2 and 7")
    return index.appended(base, v.join(documents.delta(now, base), "chunk_id", "left_semi"), documents.delta(base, now)).select("chunk_id")


@query("e05_dead_share", "SELECT a.n AS n_artifact, b.n AS n_live, (a.n - b.n) / a.n AS dead_share FROM (SELECT count(*) AS n FROM vecs) a, (SELECT count(*) AS n FROM vecs WHERE doc_id < 6) b")
def e05(spark, sf):
    v = X.vectors(spark, sf)
    return index.dead_share(v, v.where("doc_id < 6"))


@query("e06_drift", "SELECT p_partkey, CASE WHEN p_size * 100 >= 1000 THEN (p_partkey - p_size * 100) / (p_size * 100.0) END AS ratio, coalesce(CASE WHEN p_size * 100 >= 1000 THEN (p_partkey - p_size * 100) / (p_size * 100.0) END >= 0.25, false) OR p_size >= 50 AS refresh FROM part")
def e06(spark, sf):
    p = X.table(spark, sf, "part")
    ratio, refresh = index.drift(F.col("p_partkey"), F.col("p_size") * 100, F.col("p_size"))
    return p.select("p_partkey", ratio.alias("ratio"), refresh.alias("refresh"))


@query("e07_append_weight", "SELECT p_partkey, round(greatest(0, p_size * 10 - (p_partkey % 400 - p_size)) / (p_size * 11.0), 9) AS weight FROM part")
def e07(spark, sf):
    w = index.append_weight(F.col("p_size") * 10, F.col("p_partkey") % 400, F.col("p_size"))
    return X.table(spark, sf, "part").select("p_partkey", F.round(w, 9).alias("weight"))


@query("e12_memory", "SELECT count(*)::BIGINT * 64 * 4 + count(*)::BIGINT * (32 * 2 * 4 + 16) AS off, count(*)::BIGINT * 64 + count(*)::BIGINT * (32 * 2 * 4 + 16) AS sq8, count(*)::BIGINT * 128 AS fp16_flat, count(*)::BIGINT * 96 AS pq_flat FROM vecs")
def e12(spark, sf):
    n = X.vectors(spark, sf).count()
    return spark.createDataFrame([tuple(index.memory_estimate(n, 64, q) for q in ("OFF", "SQ8", "SQ_FP16_FLAT", "PQ_FLAT"))], "off long, sq8 long, fp16_flat long, pq_flat long")


@query("e13_percentiles", "SELECT v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95, v[floor(0.99 * (len(v) - 1))::INT + 1] AS p99, round(mean, 6) AS mean FROM (SELECT list_sort(list(value)) AS v, avg(value) AS mean FROM events)")
def e13(spark, sf):
    return chain.percentiles(X.table(spark, sf, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("e14_request_metrics", "SELECT event_type AS method, count(*)::BIGINT AS n, sum(strlen(props))::BIGINT AS n_bytes, count(*) FILTER (value < 10)::BIGINT AS fast FROM events GROUP BY 1")
def e14(spark, sf):
    e = X.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).cast("long").alias("n_bytes"), F.count_if(F.col("value") < 10).alias("fast"))


# document sets and chunks


@query("e02_set_digest", "SELECT version_id, sha256(string_agg(doc_id, chr(10) ORDER BY doc_id)) AS digest, count(*)::BIGINT AS n_docs FROM version_docs GROUP BY 1")
def e02(spark, sf):
    return documents.set_digest(X.version_docs(spark, sf), ["version_id"])


@query("j06_set_equality", "SELECT true AS same")
def j06(spark, sf):
    v = X.version_docs(spark, sf).where("version_id = 3")
    return spark.createDataFrame([(documents.same_set(v, QUERIES["g02_doc_set_v3"](spark, sf)),)], "same boolean")


@query("d06_version_difference", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'ADDED' WHEN b.doc_id IS NULL THEN 'REMOVED' ELSE 'UPDATED' END AS change FROM (SELECT doc_id::VARCHAR AS doc_id, text AS c FROM documents WHERE doc_id % 10 < 7) a FULL JOIN (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' v2' ELSE text END AS c FROM documents WHERE doc_id % 10 <> 1) b ON a.doc_id = b.doc_id WHERE a.c IS DISTINCT FROM b.c OR a.doc_id IS NULL OR b.doc_id IS NULL")
def d06(spark, sf):
    r = X.doc_versions(spark, sf)
    return documents.difference(documents.as_of(r, 1), documents.as_of(r, 3))


@query("d06_chunk_delta", "SELECT DISTINCT chunk_id FROM version_docs JOIN chunk_docs USING (doc_id) WHERE version_id = 3 AND chunk_id NOT IN (SELECT chunk_id FROM version_docs JOIN chunk_docs USING (doc_id) WHERE version_id = 2)")
def d06_chunks(spark, sf):
    c = documents.chunks_of(X.version_docs(spark, sf), X.chunk_docs(spark, sf))
    return documents.delta(c.where("version_id = 3"), c.where("version_id = 2"))


@query("d07_chunk_dead", "SELECT DISTINCT chunk_id FROM version_docs JOIN chunk_docs USING (doc_id) WHERE version_id = 1 AND chunk_id NOT IN (SELECT chunk_id FROM version_docs JOIN chunk_docs USING (doc_id) WHERE version_id = 2)")
def d07(spark, sf):
    c = documents.chunks_of(X.version_docs(spark, sf), X.chunk_docs(spark, sf))
    return documents.delta(c.where("version_id = 1"), c.where("version_id = 2"))


@query("d09_pending_embed", "SELECT DISTINCT chunk_id FROM chunks WHERE version_id = 3 AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE version_id < 3)")
def d09(spark, sf):
    c = X.chunks(spark, sf)
    return documents.pending_embed(c.where("version_id = 3").select("kb_id", "chunk_id"), c.where("version_id < 3")).select("chunk_id")


@query("d10_orphans", "SELECT DISTINCT chunk_id FROM chunk_docs WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_docs WHERE doc_id IN (SELECT doc_id::VARCHAR FROM documents WHERE doc_id % 10 <> 1))")
def d10(spark, sf):
    live = spark.createDataFrame([(X.KB, 3, False)], "kb_id string, version_id long, deleting boolean")
    return documents.orphans(X.chunk_docs(spark, sf), X.doc_versions(spark, sf), live).select("chunk_id")


@query("d11_readable_from_any", "SELECT v AS at, count(*)::BIGINT AS n FROM (SELECT v, doc_id, arg_max(is_tombstone, version_id) AS dead FROM doc_versions, (VALUES (1::BIGINT), (2), (3)) t(v) WHERE version_id <= v GROUP BY 1, 2) WHERE NOT dead GROUP BY 1")
def d11(spark, sf):
    v = spark.createDataFrame([(X.KB, i) for i in (1, 2, 3)], "kb_id string, version_id long")
    return documents.as_of_each(X.doc_versions(spark, sf), v).groupBy("at").agg(F.count("*").alias("n"))


@query("g11_visible_rows", "SELECT doc_id, version_id FROM doc_versions WHERE version_id <> 1 OR doc_id IN (SELECT doc_id FROM (SELECT doc_id, max(version_id) AS m FROM doc_versions WHERE version_id <= 2 GROUP BY 1) WHERE m = 1)")
def g11(spark, sf):
    return documents.kept_rows(X.doc_versions(spark, sf), 1, 2).select("doc_id", "version_id")


@query("h01_window_chunks", "SELECT doc_id, version_id, pos, length(chunk)::BIGINT AS n, chunk_id FROM chunks")
def h01(spark, sf):
    return X.chunks(spark, sf).select("doc_id", "version_id", "pos", F.char_length("chunk").cast("long").alias("n"), "chunk_id")


@query("h02_cdc_chunks")
def h02(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return text.split(d, X.MODEL).select("doc_id", "pos", F.octet_length("chunk").alias("n_bytes"), "chunk_id")


@query("h07_chunk_reuse", "SELECT count(*)::BIGINT AS n, count(DISTINCT chunk_id)::BIGINT AS distinct_chunks FROM chunks")
def h07(spark, sf):
    return X.chunks(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("distinct_chunks"))


# the chain


def _chain(spark):
    return X.chain_versions(spark).where(F.col("kb_id") == X.KB)


@query("d13_descendants", ", w(version_id) AS (SELECT 3::BIGINT UNION SELECT c.version_id FROM chain c JOIN w ON c.parent_version_id = w.version_id) SELECT version_id FROM w")
def d13(spark, sf):
    return chain.descendants(spark, _chain(spark), 3)


@query("d14_ancestors", ", w(version_id) AS (SELECT 5::BIGINT UNION SELECT c.parent_version_id FROM chain c JOIN w ON c.version_id = w.version_id WHERE c.parent_version_id > 0) SELECT version_id FROM w WHERE version_id <> 5")
def d14(spark, sf):
    return chain.ancestors(spark, _chain(spark), 5)


for _mode, _ids in (("SINGLE", "5"), ("SUBTREE", "5, 8, 9"), ("ANCESTORS", "1, 2, 3")):

    def _targets(spark, sf, mode=_mode):
        return chain.delete_targets(spark, _chain(spark), 5, mode)

    query(f"g06_targets_{_mode.lower()}", f"SELECT version_id FROM chain WHERE version_id IN ({_ids})")(_targets)


@query("g07_splice", "SELECT version_id, CASE version_id WHEN 9 THEN 2 ELSE parent_version_id END AS parent_version_id FROM chain WHERE version_id NOT IN (3, 5, 8)")
def g07(spark, sf):
    c = _chain(spark)
    return chain.spliced(c, c.where("version_id in (3, 5, 8)")).select("version_id", "parent_version_id")


@query("g10_anchor", "SELECT 5::BIGINT AS version_id, min(version_id) AS anchor FROM chain WHERE version_id > 5")
def g10(spark, sf):
    return spark.createDataFrame([(5, chain.anchor(_chain(spark), 5))], "version_id long, anchor long")


@query("g15_log_trim", "SELECT o_orderkey AS seq FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def g15(spark, sf):
    return documents.newest(X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq")), 1000)


@query("a18_log_page", "SELECT o_orderkey AS seq FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 512")
def a18(spark, sf):
    log = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("e").alias("epoch"), F.lit(X.KB).alias("kb_id"), F.col("o_orderkey").alias("version_id"))
    return documents.deletions_since(log, 100, feeds.PAGE)[0].select("seq")


@query("g25_retention", "SELECT kb_id, version_id FROM (SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_orderkey AS version_id, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0) WHERE r > 50")
def g25(spark, sf):
    a = X.table(spark, sf, "orders").select(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.col("o_orderkey").alias("version_id"))
    return chain.retention_drops(a, a.where("version_id % 13 = 0"), a.where("version_id % 17 = 0"))


@query("g26_recent_use", "SELECT version_id FROM (SELECT user_id % 5 + 1 AS version_id, max(ts) AS t FROM events GROUP BY 1) WHERE t >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY ORDER BY t DESC, version_id DESC LIMIT 3")
def g26(spark, sf):
    a = X.accesses(spark, sf)
    return chain.recently_used(a, a.select("version_id").distinct(), F.lit("2024-01-30").cast("timestamp"), 86_400, 3)


@query("g29_evictions", "SELECT version_id, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (ORDER BY pinned, t, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY pinned, t, version_id) - 1 AS place, count(*) OVER () AS n, sum(bytes) OVER () AS b FROM (SELECT s_suppkey AS version_id, 1000 + s_suppkey * 10 AS bytes, s_nationkey AS t, s_suppkey % 10 = 0 AS pinned FROM supplier)) WHERE NOT pinned AND (n - place >= 20 OR b - before > 20000)")
def g29(spark, sf):
    s, k = X.table(spark, sf, "supplier"), F.col("s_suppkey")
    return chain.evictions(s.select(k.alias("version_id"), (1000 + k * 10).alias("bytes"), F.col("s_nationkey").alias("last_access"), (k % 10 == 0).alias("pinned")), 20, 20_000)


@query("g36_reconcile", "SELECT version_id, CASE WHEN version_id % 2 = 0 THEN 'PROMOTE' WHEN version_id < 3 THEN 'IGNORE' ELSE 'SCHEDULE' END AS action FROM chain")
def g36(spark, sf):
    c = _chain(spark)
    return chain.reconcile(c, c.where("version_id % 2 = 0"), 3).select("version_id", "action")


@query("g37_retention_cutoff", "SELECT list_sort(list(o_orderkey), 'DESC')[50] AS cutoff FROM orders")
def g37(spark, sf):
    a = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"))
    return spark.createDataFrame([(chain.retention_cutoff(a, 50),)], "cutoff long")


@query("g27_gc_candidates", "SELECT 9::BIGINT AS version_id UNION SELECT 3::BIGINT")
def g27(spark, sf):
    c = _chain(spark)
    kbs = spark.createDataFrame([(X.KB, 3)], "kb_id string, active_version_id long")
    return chain.gc_candidates(kbs, c, c.select("kb_id", "version_id", F.lit(0.5).alias("dead_share"))).select("version_id")


@query("i05_owners", "SELECT n_name AS kb_id, n_nationkey::BIGINT AS version_id, member, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY sha256(unhex(printf('%016x', n_nationkey)) || '\\x00'::BLOB || member::BLOB || '\\x00'::BLOB || n_name::BLOB) DESC, member) AS r FROM nation, (VALUES ('node-a'), ('node-b'), ('node-c'), ('node-d'), ('node-e')) t(member)) WHERE r <= 3")
def i05(spark, sf):
    kbs = X.table(spark, sf, "nation").select(F.col("n_name").alias("kb_id"), F.col("n_nationkey").cast("long").alias("version_id"))
    return chain.owners(kbs, spark.createDataFrame([(m,) for m in X.MEMBERS], "member string"), 3)


# windows and streams


@query("l02_contiguous_cursor", "SELECT kb_id, coalesce(max(k) FILTER (g IS NULL OR k < g), 0)::BIGINT AS cursor FROM (SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_orderkey AS k, min(o_orderkey) FILTER (o_orderkey % 97 = 0) OVER (PARTITION BY o_custkey % 10) AS g FROM orders) GROUP BY 1")
def l02(spark, sf):
    o = X.table(spark, sf, "orders")
    known = o.select(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 97 != 0).alias("held"))
    return documents.contiguous_cursor(known)


@query("l03_marked_handled", "SELECT kb_id, coalesce(max(k) FILTER (g IS NULL OR k < g), 0)::BIGINT AS cursor FROM (SELECT '" + X.KB + "' AS kb_id, o_orderkey AS k, min(o_orderkey) FILTER (o_orderkey % 97 = 0 AND o_orderkey > 500) OVER () AS g FROM orders) GROUP BY 1")
def l03(spark, sf):
    o = X.table(spark, sf, "orders")
    known = o.select(F.lit(X.KB).alias("kb_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 97 != 0).alias("held"))
    return documents.contiguous_cursor(documents.marked_handled(known, X.KB, 0, 500))


@query("l04_previous_version", "SELECT version_id, lag(version_id) OVER (ORDER BY version_id) AS previous FROM chain")
def l04(spark, sf):
    return documents.previous_version(_chain(spark)).select("version_id", "previous")


@query("l06_last_op", "SELECT user_id::VARCHAR AS doc_id, max(event_id)::INT AS pos, arg_max(event_type, event_id) AS op FROM events GROUP BY 1")
def l06(spark, sf):
    e = X.table(spark, sf, "events")
    c = e.select(F.lit(X.KB).alias("kb_id"), F.lit(1).alias("version_id"), F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").cast("int").alias("pos"), F.col("event_type").alias("op"), F.lit("").alias("content"))
    return documents.last_op(c).select("doc_id", "pos", "op")


@query("m06_priority_score", "SELECT user_id % 5 + 1 AS version_id, round(sum(exp(-(epoch(TIMESTAMP '2024-02-01') - epoch_us(ts) / 1e6) / 600)), 9) AS score FROM events GROUP BY 1")
def m06(spark, sf):
    return feeds.score_at(X.accesses(spark, sf), "2024-02-01").select("version_id", F.round("score", 9).alias("score"))


@query("m08_failure_ratio", "SELECT node, start, count(*)::BIGINT AS total, count(*) FILTER (NOT ok)::BIGINT AS failures FROM (SELECT 'node-' || (user_id % 5) AS node, event_type <> 'error' AS ok, to_timestamp(s)::TIMESTAMP AS start FROM (SELECT *, unnest(range(floor(epoch(ts))::BIGINT - 9, floor(epoch(ts))::BIGINT + 1)) AS s FROM events)) GROUP BY ALL")
def m08(spark, sf):
    out = feeds.failure_ratios(X.outcomes(spark, sf))
    return out.select("node", F.col("start").cast("timestamp_ntz").alias("start"), "total", "failures")


@query("m12_watermark", "SELECT kb_id, min(c) AS through FROM (SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_custkey % 50 // 10 AS node, max(o_orderkey) AS c FROM orders GROUP BY ALL) GROUP BY 1")
def m12(spark, sf):
    o = X.table(spark, sf, "orders")
    c = o.groupBy(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.floor(F.col("o_custkey") % 50 / 10).alias("node")).agg(F.max("o_orderkey").alias("cursor"))
    return chain.watermark(c)


@query("m13_failure_budget", "SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_custkey AS version_id, count(*)::BIGINT AS reports, bool_or(o_orderstatus = 'F' AND o_orderkey % 50 = 0) OR count(*) >= 5 AS terminal FROM orders GROUP BY ALL")
def m13(spark, sf):
    o = X.table(spark, sf, "orders")
    r = o.select(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.col("o_custkey").alias("version_id"), F.lit("index").alias("side"), F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 50 == 0), "FATAL_GLOBAL").otherwise("TRANSIENT").alias("class"))
    return feeds.budget_spent(r).drop("side")


@query("m03_deletions", "SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_orderkey AS version_id FROM orders WHERE o_orderkey >= 900 AND o_orderkey % 3 = 0")
def m03(spark, sf):
    o = X.table(spark, sf, "orders").select(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.col("o_orderkey").alias("version_id"))
    log = o.where("version_id % 3 = 0").select(F.lit("e").alias("epoch"), (F.col("version_id") + 1).alias("seq"), "kb_id", "version_id")
    first = log.agg(F.min("seq")).collect()[0][0]
    return feeds.reconcile_deletions(log, {"epoch": "e", "seq": max(first, 900)}, o, o.where("version_id % 3 <> 0"))[0]


@query("m16_full_rejudge", "SELECT 'kb-' || (o_custkey % 10) AS kb_id, o_orderkey AS version_id FROM orders WHERE o_orderkey % 3 = 0")
def m16(spark, sf):
    o = X.table(spark, sf, "orders").select(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.col("o_orderkey").alias("version_id"))
    return chain.leftovers(o, o.where("version_id % 3 <> 0"))


@query("m05_degradation", "SELECT kb_id, count(*)::BIGINT AS required, count(*) FILTER (live)::BIGINT AS live, 2::BIGINT AS quorum, CASE WHEN count(*) FILTER (live) = 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (live) < 2 THEN 'DEGRADED' ELSE 'OK' END AS state FROM (SELECT 'kb-' || k AS kb_id, (k + j) % 5 AS node FROM range(5) a(k), range(3) b(j)) p JOIN (SELECT user_id % 5 AS node, epoch(TIMESTAMP '2024-01-20') - floor(epoch(max(ts))) <= 600 AS live FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1) USING (node) GROUP BY 1")
def m05(spark, sf):
    beats = X.outcomes(spark, sf).where("at <= timestamp'2024-01-20'").select("node", "at")
    placement = spark.createDataFrame([(f"kb-{k}", f"node-{(k + j) % 5}") for k in range(5) for j in range(3)], "kb_id string, node string")
    return chain.degradation(placement, beats, F.lit("2024-01-20").cast("timestamp"), 600)


@query("m14_refused_moves", "SELECT DISTINCT d || '>' || i AS move FROM (SELECT ['PENDING', 'READY', 'FAILED', 'FAILED_PERMANENT'][s_suppkey % 4 + 1] AS d, ['PENDING', 'READY', 'FAILED', 'FAILED_PERMANENT'][s_suppkey // 4 % 4 + 1] AS i FROM supplier) WHERE d || '>' || i NOT IN ('PENDING>READY', 'PENDING>FAILED', 'FAILED>PENDING', 'FAILED>READY', 'PENDING>FAILED_PERMANENT', 'FAILED>FAILED_PERMANENT', 'FAILED_PERMANENT>PENDING', 'READY>PENDING')")
def m14(spark, sf):
    k, names = F.col("s_suppkey"), ["PENDING", "READY", "FAILED", "FAILED_PERMANENT"]
    pick = lambda n: F.element_at(F.array(*map(F.lit, names)), (n % 4 + 1).cast("int"))
    moves = X.table(spark, sf, "supplier").select(F.lit("index").alias("side"), pick(k).alias("old"), pick(F.floor(k / 4)).alias("new"))
    return feeds.refused(moves).select(F.concat_ws(">", "old", "new").alias("move")).distinct()


@query("m15_lag", "SELECT kb_id, behind FROM (SELECT 'kb-' || (o_custkey % 10) AS kb_id, max(o_orderkey) - max(o_orderkey) FILTER (o_orderkey % 2 = 0) AS behind FROM orders GROUP BY 1) WHERE behind >= 1")
def m15(spark, sf):
    o = X.table(spark, sf, "orders").select(F.concat(F.lit("kb-"), (F.col("o_custkey") % 10).cast("string")).alias("kb_id"), F.col("o_orderkey").alias("version_id"))
    return feeds.lag(o, o.where("version_id % 2 = 0").groupBy("kb_id").agg(F.max("version_id").alias("cursor")))


# files


@query("r05_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def r05(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("r04_doc_ids", "SELECT page_id, array_to_string(list_filter(string_split(replace(regexp_replace(url, '[?#].*', ''), chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS doc_id FROM pages")
def r04(spark, sf):
    from quillbase.sources import files

    return X.table(spark, sf, "pages").select("page_id", files.doc_id(F.regexp_replace("url", "[?#].*", "")).alias("doc_id"))


@query("r07_batches")
def r07(spark, sf):
    from quillbase.sources import files

    d = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    return files.batches(d)


@query("r10_chain_tail", f"SELECT version_id, NOT deleting AND d = 'DURABLE' AS ready FROM {_STATES} ORDER BY version_id DESC LIMIT 1")
def r10(spark, sf):
    from quillbase.sources import files

    return files.chain_tail(_states(spark, sf)).select("version_id", "ready")


@query("r11_status_counts", "SELECT status, count(s)::BIGINT AS n FROM (VALUES ('QUEUED'), ('RUNNING'), ('DONE'), ('FAILED'), ('SKIPPED')) t(status) LEFT JOIN (SELECT ['DONE', 'FAILED', 'QUEUED'][(o_orderkey % 3 + 1)] AS s FROM orders) ON s = status GROUP BY 1")
def r11(spark, sf):
    from quillbase.sources import files

    q = X.table(spark, sf, "orders").select(F.element_at(F.array(F.lit("DONE"), F.lit("FAILED"), F.lit("QUEUED")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"))
    return files.status_counts(q)
