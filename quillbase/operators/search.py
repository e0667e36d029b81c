"""Vector search over a version's chunks and the ranking of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.errors import DataIncomplete, InvalidArgument
from quillbase.functions import scalars, vectors
from quillbase.operators import batch
from quillbase.operators.documents import KEY

AGGREGATES = {"MEDIAN": F.median, "MAX": F.max, "MEAN": F.avg}


def scored(table: DataFrame, query, metric: str = "COSINE", squared: bool = False, vector: str = "vector") -> DataFrame:
    """table with score; rows that aren't comparable go."""
    q = query if isinstance(query, Column) else vectors.literal(query)
    return table.withColumn("score", vectors.similarity(F.col(vector), q, metric, squared)).where("score is not null")


def top(table: DataFrame, k: int, tie: str = "chunk_id") -> DataFrame:
    """The k best rows by score, ties by id."""
    return table.orderBy(F.desc("score"), F.asc(tie)).limit(k)


def exact_topk(table: DataFrame, query, k: int, metric: str = "COSINE", squared: bool = False, tie: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """Brute-force search: score everything, keep the k best."""
    return top(scored(table, query, metric, squared, vector).drop(vector), k, tie)


def answered(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """hits; an error that a retry can help where there were candidates but no vector could be read."""
    if hits.limit(1).count() == 0 and candidates.limit(1).count():
        raise DataIncomplete("none of the version's vectors can be read")
    return hits


def batch_topk(table: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", tie: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k best rows for each (query_id, query): blocks of rows meet blocks of queries, each task keeps a query's k best, and only those are shuffled."""
    metric = vectors.metric_name(metric)
    q = queries.select("query_id", "query")
    n = q.count()
    asked = batch.packed(q.repartition(-(-n // batch.ASKED) or 1), "query", "asked")
    both = batch.packed(table.drop("score").sortWithinPartitions(tie), vector, "row").crossJoin(F.broadcast(asked) if n <= batch.ASKED else asked)
    s = batch.best(both, k, metric).select("row.*", "asked.*", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_top_k(k: int) -> None:
    if not 1 <= k <= scalars.MAX_TOP_K:
        raise InvalidArgument(f"top_k must be in 1..{scalars.MAX_TOP_K}")


def threshold(hits: DataFrame, least: float | None = None, metric: str = "COSINE") -> DataFrame:
    """Hits of at least `least`. Unset it is 0, except under Euclidean, where every score would be below."""
    if least is None:
        return hits if vectors.metric_name(metric) == "EUCLIDEAN" else hits.where("score >= 0")
    return hits.where(F.col("score") >= F.lit(float(least)))


def documents_of(hits: DataFrame, chunk_docs: DataFrame, version_docs: DataFrame, method: str = "MEDIAN") -> DataFrame:
    """doc_id and score: a document's hits reduced by method. At most MAX_HITS hits are broadcast."""
    if method not in AGGREGATES:
        raise InvalidArgument(f"no aggregation is called {method}")
    mapped = chunk_docs.join(F.broadcast(hits.select("chunk_id", "score")), "chunk_id").join(version_docs.select("doc_id"), "doc_id", "left_semi")
    return mapped.groupBy("doc_id").agg(AGGREGATES[method](F.col("score").cast("double")).alias("score"))


def ranked(scores: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """The k best documents that have a body; one without is skipped and the next takes its place."""
    return bodies.join(F.broadcast(scores), "doc_id").select("doc_id", "content", "score").orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def document_query(table: DataFrame, chunk_docs: DataFrame, version_docs: DataFrame, bodies: DataFrame, query, k: int, metric: str = "COSINE", method: str = "MEDIAN", least: float | None = None) -> DataFrame:
    """A version's documents by similarity: hits, threshold, documents, membership, aggregation, ranking with bodies."""
    check_top_k(k)
    hits = threshold(exact_topk(table, query, scalars.hits_for(k), metric), least, metric)
    return ranked(documents_of(hits, chunk_docs, version_docs, method), bodies, k)


def rerank(candidates: DataFrame, table: DataFrame, query, k: int, metric: str = "COSINE") -> DataFrame:
    """Exact scores for the candidates of a coarse search; those without a stored vector go."""
    full = table.join(F.broadcast(candidates.select("chunk_id")), "chunk_id", "left_semi")
    return exact_topk(full, query, min(max(k, 0), scalars.MAX_CANDIDATES), metric, squared=True)


def policy(n_chunks: int, has_index: bool, limit: int = 50_000) -> str:
    """How a version is searched: INDEX where one exists, SCAN up to limit chunks, BUILD beyond; NOT_READY for no chunks."""
    return "INDEX" if has_index else "NOT_READY" if n_chunks == 0 else "SCAN" if n_chunks <= limit else "BUILD"


def landing(version_docs: DataFrame, chunk_docs: DataFrame) -> bool:
    """Whether a version has documents but none of their chunks yet, so that an empty answer would be wrong."""
    return version_docs.limit(1).count() > 0 and version_docs.join(chunk_docs, KEY, "left_semi").limit(1).count() == 0
