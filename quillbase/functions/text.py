"""Splitting documents into content-addressed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defaults of the splitters, and the polynomial and window of the rolling hash.
WINDOW, OVERLAP = 512, 64
MIN_SIZE, MAX_SIZE, AVG_BITS = 256, 1536, 9
POLYNOMIAL, ROLLING = 0x3DA3358B4DC173, 64
#: Characters after which a sentence ends, and how far one is looked for, in bytes.
SENTENCE_ENDS, SNAP = "。！？；\n.!?;", 64


@dataclass(frozen=True)
class ChunkParams:
    """mode window cuts by characters; every other mode cuts by content. Values that aren't set take the defaults: sizes of 0 or
    less, an overlap below 0 (0 is a valid overlap)."""

    mode: str = "cdc"
    window: int = 0
    overlap: int = -1
    min_size: int = 0
    max_size: int = 0
    avg_bits: int = 0

    def filled(self) -> ChunkParams:
        pick = lambda x, d: x if x > 0 else d
        return ChunkParams(self.mode, pick(self.window, WINDOW), self.overlap if self.overlap >= 0 else OVERLAP, pick(self.min_size, MIN_SIZE), pick(self.max_size, MAX_SIZE), pick(self.avg_bits, AVG_BITS))


def chunk_id(text: Column, model_id: Column | str) -> Column:
    """Hex SHA-256 of the chunk's text followed by the model's id."""
    return F.sha2(F.concat(text, F.lit(model_id) if isinstance(model_id, str) else model_id), 256)


def window_chunks(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """array<struct<pos, chunk>>: windows of so many characters, each beginning window - overlap after the last; none for an empty or null text.

    A window of 0 or less, or one that the text doesn't exceed, gives the whole text.
    """
    n = F.char_length(text)
    if window <= 0:
        return F.when(n > 0, F.array(F.struct(F.lit(0).alias("pos"), text.alias("chunk")))).otherwise(F.array().cast("array<struct<pos:int,chunk:string>>"))
    step = window - min(max(overlap, 0), window - 1)
    last = F.greatest(F.ceil((n - window) / step), F.lit(0)).cast("int")
    cut = lambda i: F.struct(i.alias("pos"), F.substring(text, i * step + 1, F.lit(window)).alias("chunk"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), cut)).otherwise(F.array().cast("array<struct<pos:int,chunk:string>>"))


class Rolling:
    """Rabin's fingerprint of the last ROLLING bytes modulo a polynomial over GF(2)."""

    def __init__(self, polynomial: int = POLYNOMIAL, window: int = ROLLING):
        self.degree = polynomial.bit_length() - 1
        self.polynomial, self.window = polynomial, window
        self.shift = [self._mod(b << self.degree) for b in range(256)]
        self.out = [self._mod(b << 8 * (window - 1)) for b in range(256)]

    def _mod(self, x: int) -> int:
        while x.bit_length() > self.degree:
            x ^= self.polynomial << (x.bit_length() - 1 - self.degree)
        return x

    def bounds(self, data: bytes, min_size: int, max_size: int, avg_bits: int) -> list[int]:
        """Ends of chunks: where the low avg_bits of the fingerprint are all ones, min_size after the last at least and max_size at most."""
        ends, start, n = [], 0, len(data)
        mask, low, keep = (1 << avg_bits) - 1, self.degree - 8, (1 << self.degree) - 1
        while start < n:
            end, stop = min(start + max_size, n), None
            at = start + max(min_size - self.window, 0)
            value, filled = 0, at
            while at < end:
                if at - filled >= self.window:
                    value ^= self.out[data[at - self.window]]
                value = ((value << 8) & keep | data[at]) ^ self.shift[value >> low]
                at += 1
                if at - start >= min_size and value & mask == mask:
                    stop = at
                    break
            start = stop or end
            ends.append(start)
        return ends


_rolling = Rolling()


def _snapped(data: bytes, end: int, limit: int) -> int:
    """The first place from end that starts a character, moved behind the next end of a sentence if one is near and within limit."""
    n = len(data)
    while end < n and data[end] & 0xC0 == 0x80:
        end += 1
    at = end
    while at < min(end + SNAP, limit, n):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        if data[at : at + size].decode(errors="replace") in SENTENCE_ENDS and at + size <= min(limit, n):
            return at + size
        at += size
    return end


def cdc_split(text: str | None, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, avg_bits: int = AVG_BITS) -> list[str]:
    """Content-defined chunks of a text; together they are the text. None for an empty or null text."""
    data = (text or "").encode()
    ends = _rolling.bounds(data, min_size, max_size, avg_bits)
    cuts, last = [], 0
    for i, end in enumerate(ends):
        end = max(end, last)
        end = len(data) if i + 1 == len(ends) else _snapped(data, end, ends[i + 1])
        if end > last:
            cuts.append(data[last:end].decode())
            last = end
    return cuts


def split(docs: DataFrame, model_id: str, params: ChunkParams | None = None, text: str = "content") -> DataFrame:
    """docs with pos, chunk and chunk_id in place of the text, a row for each chunk. Window mode stays in the JVM; content-defined
    cuts run in Arrow batches, a text at a time."""
    params = (params or ChunkParams()).filled()
    rest = [c for c in docs.columns if c != text]
    if params.mode == "window":
        rows = docs.select(*rest, F.inline(window_chunks(F.col(text), params.window, params.overlap)))
    else:
        schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                cuts = [list(enumerate(cdc_split(t, params.min_size, params.max_size, params.avg_bits))) for t in frame[text]]
                out = frame[rest].assign(cut=cuts).explode("cut").dropna(subset=["cut"])
                yield out.assign(pos=[int(c[0]) for c in out["cut"]], chunk=[c[1] for c in out["cut"]]).drop(columns="cut")

        rows = docs.select(*rest, text).mapInPandas(run, schema)
    return rows.withColumn("chunk_id", chunk_id(F.col("chunk"), model_id))
