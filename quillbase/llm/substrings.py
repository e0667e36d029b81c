"""Suffix-array dedup: removes every byte that a repeated 200-byte string covers.

Each window of LENGTH bytes is owned by its leftmost least GRAM-byte gram (a minimiser), so equal
windows have equal grams at equal offsets. Suffixes are taken at these grams alone:
1. A gram that stands once in the corpus owns no repeated window.
2. A span (all bytes of the windows that one gram owns) that comes again is repeated as a whole.
3. What is left, at the edges of repeated passages, is compared suffix by suffix: the distinct
   spans are range-partitioned by the leading bytes of their gram (Spark samples the splitters), and each bucket
   sorts its window suffixes by leading word, then by fingerprint, and compares neighbours byte by byte.
   Grams with more than HOT spans would fill a bucket; their windows are dealt by fingerprint
   instead and compared across buckets by aggregation.
Steps 1 and 2 compare 64 and 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 200, 40
#: Spans of one gram that a bucket takes.
HOT = 500
#: Window suffixes that a bucket sorts at once (whole grams; a gram has HOT spans at most).
SORTED = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


_LETTERS = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; hashes() takes differences of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _grown(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop] for arrays of starts and stops."""
    return common.mix64((sums[stop] - sums[start]) * _grown(len(sums))[1][start])


def owned(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram hash, gram position, first window, window after the last, for each gram that owns windows of a text of LENGTH bytes or more."""
    m = len(sums) - GRAM
    rank = common.mix64((sums[GRAM:] - sums[:-GRAM]) * _grown(len(sums))[1][:m])
    width = LENGTH - GRAM + 1
    value, place, s = rank, np.arange(m, dtype=np.int32), 1
    while 2 * s <= width:  # least of twice as many, the left one of equals
        less = value[s:] < value[:-s]
        place = np.where(less, place[s:], place[:-s])
        value = np.where(less, value[s:], value[:-s])
        s *= 2
    n, d = m - width + 1, width - s
    less = value[d : d + n] < value[:n]
    own = np.where(less, place[d : d + n], place[:n])
    low = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
    return rank[own[low]], own[low], low, np.append(low[1:], n)


ANCHORS = "hk long, hs long, ta long, tb long, lo int, n int, at int"


def anchors(docs: DataFrame) -> DataFrame:
    """For docs (ta, tb, data): each owning gram's hash (hk), its span's hash (hs), first window (lo), windows (n) and place in the span (at)."""
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            out, size = [], 0
            for ta, tb, value in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                if not value.is_valid or len(buffer := value.as_buffer()) < LENGTH:
                    continue
                sums = prefix_sums(np.frombuffer(buffer, np.uint8))
                hk, place, low, high = owned(sums)
                n, at = high - low, place - low
                hs = common.mix64(hashes(sums, low, high - 1 + LENGTH) + (n.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)))
                out.append((hk.view(np.int64), hs.view(np.int64), np.full(len(n), ta), np.full(len(n), tb), low.astype(np.int32), n.astype(np.int32), at.astype(np.int32)))
                if (size := size + len(n)) > 50_000:
                    yield flush(out)
                    out, size = [], 0
            if out:
                yield flush(out)

    return common.in_arrow(docs, run, ANCHORS)


BODIES = "lead long, hk long, ta long, tb long, lo int, at int, body binary"


def _bodies(texts: DataFrame) -> DataFrame:
    """The bytes of wanted spans: texts (ta, tb, data, wanted: array of hk, lo, n, at)."""
    names = [x.split()[0] for x in BODIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ta, tb, value, wanted in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = value.as_buffer().to_pybytes()
                rows = []
                for w in wanted.as_py():
                    lead = int.from_bytes(data[w["lo"] + w["at"] :][:8], "big") - (1 << 63)
                    rows.append((lead, w["hk"], ta.as_py(), tb.as_py(), w["lo"], w["at"], data[w["lo"] : w["lo"] + w["n"] - 1 + LENGTH]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=names)

    return common.in_arrow(texts, run, BODIES)


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the bodies: body number, offset in it, place in the joined bytes, fingerprint; and the joined bytes."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    counts = sizes - LENGTH + 1
    body = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
    return data, body, offset, place


def _prints(data: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Fingerprints of the windows, body by body."""
    out, at = [], 0
    for b in bodies:
        sums = prefix_sums(data[at : at + len(b)])
        n = len(b) - LENGTH + 1
        out.append(common.mix64((sums[LENGTH:] - sums[:-LENGTH]) * _grown(len(sums))[1][:n]))
        at += len(b)
    return np.concatenate(out)


def repeated_windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Body number and offset of each window that comes again among those of the bodies."""
    data, body, offset, place = _windows(bodies)
    word = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))  # the eight bytes from each place on
    prints = _prints(data, bodies)
    order = np.lexsort((prints, word[place].astype(np.uint64)))
    near = np.flatnonzero(prints[order[1:]] == prints[order[:-1]])
    same = np.ones(len(near), bool)
    for d in range(0, LENGTH, 8):
        same &= word[place[order[near]] + d] == word[place[order[near + 1]] + d]
    near = near[same]
    found = np.zeros(len(order), bool)
    found[order[near]] = found[order[near + 1]] = True
    return body[found], offset[found]


def _runs(lo: np.ndarray, offset: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Body, first window and number of windows of each run of repeated windows."""
    order = np.lexsort((offset, body))
    body, offset = body[order], offset[order]
    new = np.concatenate(([True], (np.diff(body) != 0) | (np.diff(offset) != 1))) if len(body) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return body[first], lo[body[first]] + offset[first], np.diff(np.append(first, len(body)))


RUNS = "ta long, tb long, lo int, n int"


def _bucket_runs(bodies: DataFrame) -> DataFrame:
    """Runs of repeated windows among bodies that are sorted by lead and gram, a gram within one partition."""

    def settle(rows: list) -> pa.RecordBatch:
        ta, tb, lo = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        body, offset = repeated_windows([r[6] for r in rows])
        body, first, n = _runs(lo, offset, body)
        return pa.RecordBatch.from_arrays([pa.array(ta[body]), pa.array(tb[body]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["ta", "tb", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED and row[:2] != rows[-1][:2]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6]) - LENGTH + 1
        if rows:
            yield settle(rows)

    return common.in_arrow(bodies, run, RUNS)


#: A window suffix on its way to its slice; known says that it came again among its neighbours.
WINDOW = np.dtype([("h", "<u8"), ("w", "<u8"), ("ta", "<i8"), ("tb", "<i8"), ("p", "<i4"), ("known", "?")])
#: Windows in a slice, about.
SLICE = 50_000


def _equal(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows sorted by fingerprint and leading word, and the first of each run of equal ones."""
    windows = windows[np.lexsort((windows["w"], windows["h"]))]
    new = (windows["h"][1:] != windows["h"][:-1]) | (windows["w"][1:] != windows["w"][:-1])
    return windows, np.concatenate(([0], np.flatnonzero(new) + 1)) if len(windows) else np.zeros(0, int)


def _packed(rows: np.ndarray, slice_of: np.ndarray, slices: int) -> pa.RecordBatch:
    """The rows of each slice as one binary value."""
    order = np.argsort(slice_of, kind="stable")
    rows, edges = rows[order], np.searchsorted(slice_of[order], np.arange(slices + 1))
    used = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array([rows[edges[i] : edges[i + 1]].tobytes() for i in used], pa.binary())], names=["slice", "rows"])


def _by_slice(packed: DataFrame, slices: int, settle, schema: str) -> DataFrame:
    """settle(rows) for the rows of each slice of a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now and parts:
                    yield settle(np.frombuffer(b"".join(parts), WINDOW))
                    parts = []
                now = k
                parts.append(value)
        if parts:
            yield settle(np.frombuffer(b"".join(parts), WINDOW))

    return common.in_arrow(packed.repartition(int(min(slices, 4096)), "slice").sortWithinPartitions("slice"), run, schema)


def _hot_runs(bodies: DataFrame) -> DataFrame:
    """Runs for grams with many spans. Their windows are dealt to slices by fingerprint, packed, and compared there; what comes again goes to slices
    by text, where runs are put together. Of windows that come again among a task's neighbours one is compared further, so
    that a window of very many documents is a row or two of each task."""
    total = bodies.agg(F.sum(F.octet_length("body") - LENGTH + 1)).collect()[0][0] or 0
    slices = max(64, total // SLICE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                parts = batch.column(6).to_pylist()
                data, body, offset, place = _windows(parts)
                rows = np.zeros(len(body), WINDOW)
                rows["h"], rows["w"] = _prints(data, parts), np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[place]
                rows["ta"], rows["tb"] = batch.column(2).to_numpy()[body], batch.column(3).to_numpy()[body]
                rows["p"] = batch.column(4).to_numpy()[body] + offset
                rows, first = _equal(rows)
                size = np.diff(np.append(first, len(rows)))
                rows["known"] = np.repeat(size > 1, size)
                to = (rows["h"] % np.uint64(slices)).astype(np.int64)
                later = np.ones(len(rows), bool)
                later[first] = False
                to[later] = np.arange(int(later.sum())) % slices
                yield _packed(rows, to, slices)

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        rows, first = _equal(rows)
        size = np.diff(np.append(first, len(rows)))
        rows = rows[np.repeat(size > 1, size) | rows["known"]]
        return _packed(rows, (rows["ta"] % slices).astype(np.int64), slices)

    def join(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.lexsort((rows["p"], rows["tb"], rows["ta"]))]
        new = (np.diff(rows["ta"]) != 0) | (np.diff(rows["tb"]) != 0) | (np.diff(rows["p"]) > 1)
        first = np.concatenate(([0], np.flatnonzero(new) + 1))
        last = rows["p"][np.append(first[1:], len(rows)) - 1]
        return pa.RecordBatch.from_arrays([pa.array(rows["ta"][first]), pa.array(rows["tb"][first]), pa.array(rows["p"][first]), pa.array(last - rows["p"][first] + 1)], names=["ta", "tb", "lo", "n"])

    packed = "slice long, rows binary"
    dealt = common.stored(common.in_arrow(bodies, deal, packed), "sub-hot")
    return _by_slice(common.stored(_by_slice(dealt, slices, compare, packed), "sub-hot-again"), slices, join, RUNS)


def repeated_runs(docs: DataFrame, text: str) -> DataFrame:
    """ta, tb (the text's key) and runs: the windows (lo, n) that come again in the corpus, copies of a text included; stored."""
    key = common.content_key(F.col(text))
    texts = docs.select(key["a"].alias("ta"), key["b"].alias("tb"), F.col(text).cast("binary").alias("data"))
    every = common.stored(anchors(texts), "sub-anchors")
    again = common.stored(every.groupBy("hk").agg(F.count("*").alias("c")).where("c > 1").select("hk"), "sub-grams")
    some = common.stored(every.join(common.sized(again, 1_000_000), "hk", "left_semi"), "sub-again")
    common.drop(every)
    spans = common.stored(some.groupBy("hk", "hs").agg(F.count("*").alias("c")), "sub-spans")
    per_gram = spans.groupBy("hk").agg(F.count_if(F.col("c") == 1).alias("single"), F.count("*").alias("spans")).where("single > 0").select("hk", "spans")
    spans = spans.join(per_gram, "hk", "left").select("hk", "hs", "c", F.coalesce("spans", F.lit(0)).alias("spans")).where("c > 1 or spans > 0")
    judged = common.stored(some.join(spans, ["hk", "hs"]), "sub-judged")
    common.drop(some)
    runs = judged.where("c > 1").select("ta", "tb", "lo", "n")
    asked = judged.where("spans > 0")
    asked = asked.where("c = 1").unionByName(asked.where("c > 1").dropDuplicates(["hk", "hs"]))
    wanted = asked.groupBy("ta", "tb").agg(F.collect_list(F.struct("hk", "lo", "n", "at")).alias("wanted"))
    wanted = common.stored(wanted, "sub-wanted")
    names = common.sized(wanted.select("ta", "tb"), 500_000)
    asked_texts = texts.join(names, ["ta", "tb"], "left_semi").dropDuplicates(["ta", "tb"])
    bodies = common.stored(_bodies(asked_texts.join(wanted, ["ta", "tb"])), "sub-bodies")
    hot = common.stored(judged.select("hk", "spans").where(F.col("spans") > HOT).select("hk").distinct(), "sub-hot-grams")
    hot = common.sized(hot)
    parts = max(12, docs.sparkSession.sparkContext.defaultParallelism * 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cold = bodies.join(hot, "hk", "left_anti").select(*bodies.columns).repartitionByRange(parts, "lead", "hk").sortWithinPartitions("lead", "hk")
    runs = runs.unionByName(_bucket_runs(cold)).unionByName(_hot_runs(bodies.join(hot, "hk", "left_semi").select(*bodies.columns)))
    return common.stored(runs.groupBy("ta", "tb").agg(F.collect_set(F.struct("lo", "n")).alias("runs")), "sub-runs")


def without_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with n_bytes, n_removed, n_spans and kept_bytes (binary: what is left of the text in UTF-8).

    Bytes go if a LENGTH-byte string that also starts elsewhere, in any row or the same, covers them. A null or empty text has no bytes; texts under
    LENGTH bytes stay whole. Repeated rows are copies of each other and go whole if long enough. Kept columns that clash with the new ones are an error.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    if clash := {*new, "ta", "tb", "data", "runs"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken")
    runs = repeated_runs(docs, text)
    key = common.content_key(F.col(text))
    rows = docs.select(*keep, key["a"].alias("ta"), key["b"].alias("tb"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    joined = rows.join(runs, ["ta", "tb"], "left").select(*keep, "data", "runs")
    schema = joined.select(*keep).schema
    for name, kind in zip(new, ("long", "long", "long", "binary"), strict=True):
        schema = schema.add(name, kind)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = []
                for value, found in zip(batch.column(width), batch.column(width + 1), strict=True):
                    data = np.frombuffer(value.as_buffer(), np.uint8)
                    if not found.is_valid:
                        out.append((len(data), 0, 0, data.tobytes()))
                        continue
                    lo, n = (found.values.field(i).to_numpy() for i in range(2))
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + n - 1 + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    out.append((len(data), int(gone.sum()), spans, data[~gone].tobytes()))
                more = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=[*batch.schema.names[:width], *new])

    return common.in_arrow(joined, run, schema)
