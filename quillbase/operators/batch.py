"""Many searches at once: vectors travel in blocks, are compared by matrix products, and what may be among the best is scored exactly.

A product of matrices only says which rows can be among a query's k best, with a bound on its rounding; their scores are
those of functions.vectors to the last bit, sums taken in the vectors' order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Queries that are broadcast, or that are one partition of a larger set.
ASKED = 16_384
#: Bytes of a block of vectors with what else is in their rows, about, and of an Arrow batch of pairs of blocks.
BLOCK = 1 << 20
#: Cells of a product of matrices, and pairs that are scored exactly, at once.
CELLS, PAIRS = 2 << 20, 1 << 14
#: Bytes of rows besides their vectors that a task remembers; then it hands on its best and begins anew.
POOL = 32 << 20
#: Norms whose squares and products are far from the ends of the range of doubles.
LEAST, MOST = 1e-70, 1e70
#: What is kept of a query's best: its place, the score, the row's place.
HELD = [("q", "i8"), ("score", "f8"), ("place", "i8")]


def packed(df: DataFrame, vector: str, name: str) -> DataFrame:
    """df in blocks: the vectors, the other columns as structs called name, and the block's number in its partition and unique id."""
    rest = [c for c in df.columns if c != vector]
    df = df.select(*rest, vector)
    fields = {f"{name}_vectors": T.ArrayType(df.schema[vector].dataType), name: T.ArrayType(T.StructType(df.select(*rest).schema.fields)), f"{name}_block": T.StringType()}
    schema, size = T.StructType([T.StructField(c, t) for c, t in fields.items()]), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in batches:
            step = max(1, b.num_rows * size // max(b.nbytes, 1))
            for at in range(0, b.num_rows, step):
                x = b.slice(at, step)
                structs = pa.StructArray.from_arrays(x.columns[:-1], fields=list(b.schema)[:-1])
                ends = pa.array([0, x.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, x.column(len(rest))), pa.ListArray.from_arrays(ends, structs), pa.array([uuid.uuid4().hex])], names=list(fields))

    return df.mapInArrow(run, schema)


def own(x: pa.Array) -> pa.Array:
    """A copy that holds no other column's memory."""
    return x.take(pa.array(np.arange(len(x))))


def total(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, added in the order of the columns from 0 on, as functions.vectors does."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j]
    return out


class _Vectors:
    """Vectors of one length: their places in the block, values, norms, and kind (0 zero, 1 plain, 2 to be scored with every other)."""

    def __init__(self, at: np.ndarray, values: np.ndarray, metric: str):
        self.at, self.values = at, values
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(total(values * values))
            plain = (self.norm > LEAST) & (self.norm < MOST)
            zero = ~values.any(axis=1)
            if metric == "COSINE":
                self.kind = np.where(plain, 1, np.where(zero, 0, 2))
                self.side = np.where(plain[:, None], values / self.norm[:, None], 0.0)
            else:
                self.kind = np.where(plain | zero, 1, 2)
                self.side = np.where((plain | zero)[:, None], values, 0.0)


def by_length(lists: pa.Array, metric: str) -> dict[int, _Vectors]:
    """The vectors of a block by their length; null ones and those with a null have no score."""
    lengths, out = lists.value_lengths(), {}
    for d in pc.unique(lengths).to_pylist():
        if d is None:
            continue
        at = np.flatnonzero(pc.fill_null(pc.equal(lengths, d), False).to_numpy(zero_copy_only=False))
        flat = lists.take(pa.array(at)).flatten()
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype("f8").reshape(len(at), d)
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), d).any(axis=1)
        out[d] = _Vectors(at[whole], values[whole], metric)
    return out


def _first(x: _Vectors, k: int) -> np.ndarray:
    """Which of the vectors are among the first k of their equals: ties go by place, so later ones are never among the k best."""
    rows = np.ascontiguousarray(x.values)
    if not rows.size:
        return np.arange(len(rows)) < k
    _, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    nth = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    keep = np.empty(len(order), bool)
    keep[order] = nth < k
    return keep


def exact(q: _Vectors, qi: np.ndarray, x: _Vectors, xi: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores of pairs as functions.vectors gives them, and which of them aren't null."""
    out, good = np.empty(len(qi)), np.ones(len(qi), bool)
    with np.errstate(all="ignore"):
        for at in range(0, len(qi), PAIRS):
            i, j, to = qi[at : at + PAIRS], xi[at : at + PAIRS], slice(at, at + PAIRS)
            a, b = x.values[j], q.values[i]
            if metric == "EUCLIDEAN":
                out[to] = -np.sqrt(total((a - b) * (a - b)))
                continue
            out[to] = total(a * b)
            if metric == "COSINE":
                by = x.norm[j] * q.norm[i]
                good[to] = by != 0
                out[to] /= by
    return out, good


class _Asked:
    """A block of queries with the k best of each so far."""

    def __init__(self, lists: pa.Array, structs: pa.Array, k: int, metric: str):
        self.structs, self.k, self.metric, self.groups = own(structs), k, metric, by_length(lists, metric)
        self.begin()

    def begin(self) -> None:
        self.held = {d: np.empty(0, HELD) for d in self.groups}
        self.low = {d: np.full(len(v.at), -np.inf) for d, v in self.groups.items()}

    def meet(self, block: dict[int, tuple[_Vectors, np.ndarray]]) -> None:
        """Takes in a block of rows: for each length its vectors and their places, which grow from block to block."""
        for d, q in self.groups.items():
            if d not in block or not len(q.at):
                continue
            x, places = block[d]
            step = max(1, CELLS // max(len(x.at), 1))
            for at in range(0, len(q.at), step):
                qi, xi = self.candidates(d, at, step, x)
                self.keep(d, qi, xi, x, places)

    def candidates(self, d: int, at: int, step: int, x: _Vectors) -> tuple[np.ndarray, np.ndarray]:
        q, to, k = self.groups[d], slice(at, at + step), self.k
        kinds = q.kind[to]
        near = (8 * d + 128) * 2.0**-52
        with np.errstate(all="ignore"):
            score, low = q.side[to] @ x.side.T, self.low[d][to]
            if self.metric == "COSINE":
                margin = np.full(len(kinds), near)
            else:
                norms = np.where(x.kind == 1, x.norm, 0.0)
                most, own = norms.max(initial=0.0), np.where(kinds == 1, q.norm[to], 0.0)
                margin = near * own * most
                if self.metric == "EUCLIDEAN":
                    score = 2 * score - (norms * norms)[None, :] - (own * own)[:, None]
                    margin = near * (own + most) ** 2
                    low = -low * low
        score[:, x.kind != 1] = -np.inf
        bar = low
        if k < score.shape[1] and (low == -np.inf).any():
            bar = np.maximum(low, np.partition(score, -k, axis=1)[:, -k])
        found = (score >= (bar - margin)[:, None]) & (score > -np.inf) & (kinds == 1)[:, None]
        found[:, x.kind == 2] = True
        found[kinds == 2, :] = True
        qi, xi = np.nonzero(found)
        return qi + at, xi

    def keep(self, d: int, qi: np.ndarray, xi: np.ndarray, x: _Vectors, places: np.ndarray) -> None:
        if not len(qi):
            return
        score, good = exact(self.groups[d], qi, x, xi, self.metric)
        new = np.empty(int(good.sum()), HELD)
        new["q"], new["score"], new["place"] = qi[good], score[good], places[xi[good]]
        held = self.held[d]
        same = np.zeros(len(self.low[d]), bool)
        same[qi] = True
        touched = same[held["q"]]
        rows = np.concatenate([held[touched], new])
        nan = np.isnan(rows["score"])
        rows = rows[np.lexsort((rows["place"], -np.where(nan, 0.0, rows["score"]), ~nan, rows["q"]))]  # NaN before all numbers
        nth = np.arange(len(rows)) - np.searchsorted(rows["q"], rows["q"])
        last = rows[nth == self.k - 1]
        self.low[d][last["q"]] = np.where(np.isnan(last["score"]), np.inf, last["score"])
        self.held[d] = np.concatenate([held[~touched], rows[nth < self.k]])

    def rows(self) -> np.ndarray:
        """What is held, q as a place in the block."""
        out = [np.empty(0, HELD)]
        for d, h in self.held.items():
            h = h.copy()
            h["q"] = self.groups[d].at[h["q"]]
            out.append(h)
        return np.concatenate(out)


class _Task:
    """The blocks of rows that a task has met, and the blocks of queries."""

    def __init__(self, k: int, metric: str):
        self.k, self.metric, self.asked, self.name = k, metric, {}, None
        self.begin()

    def begin(self) -> None:
        self.pool, self.n, self.used = [], 0, 0
        for a in self.asked.values():
            a.begin()

    def enter(self, name: str, lists: pa.Array, structs: pa.Array) -> None:
        places, structs = self.n + np.arange(len(lists)), own(structs)
        self.block = {}
        for d, x in by_length(lists, self.metric).items():
            first = _first(x, self.k)
            x.at, x.values, x.norm, x.kind, x.side = x.at[first], x.values[first], x.norm[first], x.kind[first], x.side[first]
            self.block[d] = x, places[x.at]
        self.pool.append(structs)
        self.name, self.n, self.used = name, self.n + len(lists), self.used + structs.nbytes

    def results(self) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_arrays(self.pool) if self.pool else None
        for a in self.asked.values():
            held = a.rows()
            for at in range(0, len(held), 1 << 14):
                h = held[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(h["place"])), a.structs.take(pa.array(h["q"])), pa.array(h["score"])], names=["row", "asked", "score"])


def best(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """row, asked (structs) and score of each query's k best rows in each task, or more of them; ties by the rows' order.

    pairs has blocks of rows with blocks of queries, a block of rows with all of a task's queries in turn.
    """
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BLOCK))
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    schema = T.StructType([T.StructField("row", kinds["row"].elementType), T.StructField("asked", kinds["asked"].elementType), T.StructField("score", T.DoubleType())])
    most = POOL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(k, metric)
        for b in batches:
            for i in range(b.num_rows):
                of = lambda c: b.column(b.schema.get_field_index(c)).slice(i, 1).flatten()  # noqa: B023, E731
                name, asked = b.column("row_block")[i].as_py(), b.column("asked_block")[i].as_py()
                if name != task.name:
                    if task.used > most:
                        yield from task.results()
                        task.begin()
                    task.enter(name, of("row_vectors"), of("row"))
                if asked not in task.asked:
                    task.asked[asked] = _Asked(of("asked_vectors"), of("asked"), k, metric)
                task.asked[asked].meet(task.block)
        yield from task.results()

    return pairs.mapInArrow(run, schema)
