"""Vector expressions: built-in higher-order functions, double arithmetic, float results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the three metrics.
METRICS = {"COSINE": "COSINE", "SIMILARITY_COSINE": "COSINE", "": "COSINE", "INNER_PRODUCT": "INNER_PRODUCT", "SIMILARITY_INNER_PRODUCT": "INNER_PRODUCT", "EUCLIDEAN": "EUCLIDEAN", "SIMILARITY_EUCLIDEAN": "EUCLIDEAN"}


def metric_name(name: str | None) -> str:
    """One of COSINE, INNER_PRODUCT and EUCLIDEAN; enum spellings are read, others are an error."""
    from quillbase.errors import InvalidArgument

    found = METRICS.get((name or "").upper())
    if found is None:
        raise InvalidArgument(f"no metric is called {name}")
    return found


def literal(vector) -> Column:
    """A vector of Python numbers as array<double>."""
    return F.lit([float(x) for x in vector]).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def similarity(a: Column, b: Column, metric: str = "COSINE", squared: bool = False) -> Column:
    """Double score; null (not comparable) where lengths differ or, under cosine, a norm is zero. Euclidean is -distance, or -distance² with squared."""
    metric = metric_name(metric)
    if metric == "INNER_PRODUCT":
        score = dot(a, b)
    elif metric == "EUCLIDEAN":
        d = squared_distance(a, b)
        score = -d if squared else -F.sqrt(d)
    else:
        score = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), score)


def normalise(a: Column) -> Column:
    """a divided by its norm; a zero vector stays."""
    return F.when(norm(a) == 0, a).otherwise(F.transform(a, lambda x: (x.cast("double") / norm(a)).cast("float")))


def mock_embedding(chunk_id: Column, dim: int = 64) -> Column:
    """The offline embedding of a chunk: bytes of SHA-256 of its id, cycled and normalised."""
    digest = F.sha2(chunk_id, 256)
    byte = lambda i: F.conv(F.substring(digest, ((i + F.floor(i / 32)) % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("double") / 255
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), byte)
    length = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.element_at(F.transform(F.array(raw), lambda v: F.element_at(F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n).cast("float"))), 1)), 1)
