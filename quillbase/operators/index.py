"""Search tables of a version: quantised codes, coarse search, partitioned lists, upkeep."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbase.errors import InvalidArgument
from quillbase.functions import scalars, vectors
from quillbase.operators import search

#: What each quantiser stores for a dimension, in bytes, and whether it is trained.
QUANTISERS = {"OFF": (4, False), "SQ8": (1, True), "SQ_FP16": (2, False), "SQ_BF16": (2, False), "PQ": (0, True)}
PQ_M, PQ_BITS, LINKS = 96, 8, 32
#: Drift and dead shares at which an index is made anew.
DRIFT, MOST_APPENDS, LEAST_TRAINED, DEAD_WEIGHT, GC_DEAD, GC_REBUILD = 0.25, 50, 1000, 0.2, 0.3, 0.5


def needs_training(quantiser: str) -> bool:
    return QUANTISERS[quantiser.removesuffix("_FLAT")][1]


def graph_free(quantiser: str, flat: bool = True) -> str:
    """The twin of a quantiser that has no graph. Every table here is graph-free; the name is metadata."""
    base = quantiser.removesuffix("_FLAT")
    return base + "_FLAT" if flat else base


def quantiser_for(kb: dict, flat: bool = False) -> tuple[str, int, int]:
    """Quantiser, sub-vectors and bits of a knowledge base, with the defaults."""
    return graph_free(kb.get("quantizer") or "OFF", flat), kb.get("pq_m") or PQ_M, kb.get("pq_nbits") or PQ_BITS


def memory_estimate(n: int, dim: int, quantiser: str = "OFF", m: int = PQ_M, bits: int = PQ_BITS) -> int:
    """Bytes of n codes, and of their links where there is a graph."""
    base = quantiser.removesuffix("_FLAT")
    code = math.ceil(m * bits / 8) if base == "PQ" else dim * QUANTISERS[base][0]
    return n * code + (0 if quantiser.endswith("_FLAT") else n * (LINKS * 2 * 4 + 16))


def checked(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks with each id once, and the dimension that all share."""
    one = chunks.dropDuplicates(["chunk_id"])
    sizes = one.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).collect()[0]
    if sizes["a"] != sizes["b"]:
        raise InvalidArgument(f"vectors have {sizes['a']} to {sizes['b']} dimensions")
    return one, sizes["a"] or 0


def ranges(chunks: DataFrame) -> DataFrame:
    """One row: lo and hi, the least and greatest value of each dimension."""
    each = chunks.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    return each.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("r")).select(F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def sq8(chunks: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """chunk_id, code: each dimension as 0..255 within its trained range."""
    r = F.broadcast(trained if trained is not None else ranges(chunks))  # one row
    step = lambda x, i: F.floor(F.coalesce((x - F.get("lo", i)) / F.nullif(F.get("hi", i) - F.get("lo", i), F.lit(0.0)), F.lit(0.0)) * 255 + 0.5)
    clamped = lambda x, i: F.least(F.greatest(step(x.cast("double"), i), F.lit(0)), F.lit(255)).cast("int")
    return chunks.crossJoin(r).select("chunk_id", F.transform("vector", clamped).alias("code"))


def unsq8(codes: DataFrame, trained: DataFrame) -> DataFrame:
    """chunk_id, vector: what the codes stand for."""
    back = lambda c, i: (F.get("lo", i) + c / 255.0 * (F.get("hi", i) - F.get("lo", i))).cast("float")
    return codes.crossJoin(F.broadcast(trained)).select("chunk_id", F.transform("code", back).alias("vector"))


def _halved(kind: str):
    @F.pandas_udf("array<float>")
    def convert(v):
        def one(x):
            a = np.asarray(x, np.float32)
            if kind == "SQ_FP16":
                return a.astype(np.float16).astype(np.float32)
            return (a.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)

        return v.map(one)

    return convert


def half(chunks: DataFrame, kind: str) -> DataFrame:
    """chunk_id, vector as 16-bit floats hold it: SQ_FP16 rounds, SQ_BF16 cuts the low bits."""
    return chunks.select("chunk_id", _halved(kind)("vector").alias("vector"))


def pq_train(chunks: DataFrame, dim: int, m: int, bits: int, seed: int = 1, iterations: int = 10) -> list[list[list[float]]]:
    """Centroids of each of m sub-vectors: k-means, distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if dim % m or chunks.count() < 1 << bits:
        raise InvalidArgument(f"product quantisation needs {dim} % {m} == 0 and {1 << bits} vectors")
    width, out = dim // m, []
    rows = chunks.select("vector").cache()
    for i in range(m):
        part = rows.select(array_to_vector(F.slice("vector", i * width + 1, width).cast("array<double>")).alias("features"))
        model = KMeans(k=1 << bits, seed=seed, maxIter=iterations).fit(part)
        out.append([c.tolist() for c in model.clusterCenters()])
    rows.unpersist()
    return out


def pq_encode(chunks: DataFrame, centroids: list[list[list[float]]]) -> DataFrame:
    """chunk_id, code: the nearest centroid of each sub-vector."""
    books = [np.array(c, np.float32) for c in centroids]

    @F.pandas_udf("array<int>")
    def nearest(v):
        if not len(v):
            return v
        a = np.stack(v.to_numpy()).astype(np.float32)
        parts = np.split(a, len(books), axis=1)
        codes = [((p[:, None, :] - b[None]) ** 2).sum(-1).argmin(1) for p, b in zip(parts, books, strict=True)]
        return __import__("pandas").Series(list(np.stack(codes, 1).astype(np.int32)))

    return chunks.select("chunk_id", nearest("vector").alias("code"))


def pq_coarse(codes: DataFrame, centroids: list[list[list[float]]], query, n: int, metric: str = "COSINE") -> DataFrame:
    """The n best codes by their sub-vectors' looked-up scores (inner products, or -distance²)."""
    q = np.array(list(query), np.float64)
    width = len(q) // len(centroids)
    table = []
    for i, book in enumerate(centroids):
        b, part = np.array(book), q[i * width : (i + 1) * width]
        table.append((-((b - part) ** 2).sum(1) if vectors.metric_name(metric) == "EUCLIDEAN" else b @ part).tolist())
    looked_up = F.lit(table).cast("array<array<double>>")
    score = vectors.total(F.transform("code", lambda c, i: F.get(F.get(looked_up, i), c)))
    return search.top(codes.select("chunk_id", score.alias("score")), n)


def two_stage(coarse: DataFrame, table: DataFrame, query, k: int, metric: str = "COSINE", candidates: int = 0) -> DataFrame:
    """Best candidates by what the codes stand for, then exact scores."""
    found = search.exact_topk(coarse, query, scalars.candidates_for(k, candidates), metric)
    return search.rerank(found, table, query, k, metric)


def ivf_train(chunks: DataFrame, lists: int, seed: int = 1) -> list[list[float]]:
    """Centres of an inverted-list table, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = chunks.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return [c.tolist() for c in KMeans(k=lists, seed=seed, maxIter=10).fit(rows).clusterCenters()]


def ivf_assign(chunks: DataFrame, centres: list[list[float]]) -> DataFrame:
    """chunks with list, the nearest centre; write it partitioned by list and a search reads few."""
    c = np.array(centres, np.float32)

    @F.pandas_udf("int")
    def nearest(v):
        a = np.stack(v.to_numpy()).astype(np.float32) if len(v) else np.zeros((0, c.shape[1]), np.float32)
        return __import__("pandas").Series((((a[:, None, :] - c[None]) ** 2).sum(-1).argmin(1) if len(a) else np.zeros(0)).astype(np.int32))

    return chunks.withColumn("list", nearest("vector"))


def ivf_search(assigned: DataFrame, centres: list[list[float]], query, k: int, probes: int, metric: str = "COSINE") -> DataFrame:
    """The k best of the probes lists whose centres are nearest to the query; an approximate search with exact scores."""
    d = ((np.array(centres) - np.array(list(query))) ** 2).sum(1)
    return search.exact_topk(assigned.where(F.col("list").isin([int(i) for i in np.argsort(d)[:probes]])), query, k, metric)


def appended(base: DataFrame, delta: DataFrame, dead: DataFrame) -> DataFrame:
    """A parent's table with the delta's rows, without the dead."""
    return base.join(dead.select("chunk_id"), "chunk_id", "left_anti").unionByName(delta.select(*base.columns)).dropDuplicates(["chunk_id"])


def removed(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("chunk_id"), "chunk_id", "left_anti")


def dead_share(artifact: DataFrame, live: DataFrame) -> DataFrame:
    """One row: share of an artifact's chunks that are dead; null (unknown) for an empty artifact or more live chunks than it has."""
    a = artifact.agg(F.count_distinct("chunk_id").alias("n_artifact"))
    b = live.agg(F.count_distinct("chunk_id").alias("n_live"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    share = F.when((F.col("n_artifact") > 0) & (F.col("n_live") <= F.col("n_artifact")), (F.col("n_artifact") - F.col("n_live")) / F.col("n_artifact"))
    return both.select("n_artifact", "n_live", share.alias("dead_share"))


def drift(total: Column, trained: Column, appends: Column) -> tuple[Column, Column]:
    """(ratio, refresh): how far an index has grown beyond what its code book was trained on, and whether that calls for a new one."""
    ratio = F.when(trained >= LEAST_TRAINED, (total - trained) / trained)
    return ratio, F.coalesce((ratio >= DRIFT) | (appends >= MOST_APPENDS), F.lit(False))


def append_weight(base: Column, total: Column, delta: Column) -> Column:
    """Share of dead entries after an append; above DEAD_WEIGHT the index is built in full."""
    return F.greatest(F.lit(0), base - (total - delta)) / F.nullif(base + delta, F.lit(0))


def cold(age_seconds: Column, threshold: float, operator_active: Column) -> Column:
    """Whether a version that is built now is built without a graph."""
    return F.lit(False) if threshold <= 0 else ~operator_active & (age_seconds >= threshold)


def reshape(is_graph_free: Column, age_seconds: Column, threshold: float) -> Column:
    """Whether an artifact should change its shape: hot again within half the threshold, idle beyond all of it."""
    if threshold <= 0:
        return F.lit(False)
    return F.coalesce(F.when(is_graph_free, age_seconds <= threshold / 2).otherwise(age_seconds > threshold), F.lit(False))
