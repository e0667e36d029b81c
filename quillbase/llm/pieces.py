"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score. As no
piece of such a vocabulary has a space mark after another character, a merge
never crosses the start of a run of marks, so texts are cut there and a
distinct segment is merged once as long as the partition's worker remembers it. The ids of every Arrow batch's whole texts are
compared with those that the sentencepiece library gives.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Bytes of segments that a worker remembers within a partition, about: half of them lately used ones, which then become the other half.
REMEMBERED = 96 << 20
#: Bytes of a remembered segment besides its characters and ids (two objects and their place), about.
ENTRY = 200
#: Texts that are worked on together hold so many bytes, about; a longer one is taken alone.
STEP = 512 << 10


class Unsupported(ValueError):
    """The model is not of the kind that this encoder reproduces."""


class PieceEncoder:
    """Encodes texts as the library does, for a BPE model with an identity normaliser."""

    def __init__(self, model_path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if sys.byteorder != "little":
            raise Unsupported("ids are kept in the machine's order, which must be little-endian")
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise Unsupported("the vocabulary is not of the merge type")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise Unsupported("the normaliser changes more than spaces")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise Unsupported("the vocabulary has user-defined or unused pieces")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        places = {score: k for k, score in enumerate(sorted({-p.score for p in model.pieces}))}
        self.order = {p: places[-model.pieces[i].score] for p, i in self.ids.items()}  # equal scores, equal place
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        whole = any(x[1] == MARK != x[0] for x in self.pairs)
        self.cut = re.compile(r"(?s).+" if whole else f"{MARK}+[^{MARK}]*")
        self.plain = not whole and not any("\n" in x for x in self.pairs)  # a new line stands alone
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (self.library.bos_id(), self.library.eos_id()))
        self.check, self.known = check, _Memory(self)

    def merge(self, segment: str) -> bytes:
        """Ids of one segment: the pair of the best score is joined first, the leftmost of equals."""
        n, get = len(segment), self.order.get
        symbols, after, before = [*segment, ""], list(range(1, n + 2)), list(range(-1, n))
        agenda = [r << 32 | i for i in range(n - 1) if (r := get(segment[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            top = heappop(agenda)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or not symbols[i] or get(joined := symbols[i] + symbols[j]) != top >> 32:
                continue  # one of the two has been joined since
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            before[k] = i
            if k < n and (r := get(joined + symbols[k])) is not None:
                heappush(agenda, r << 32 | i)
            if (h := before[i]) >= 0 and (r := get(symbols[h] + joined)) is not None:
                heappush(agenda, r << 32 | h)
        ids = array("I")
        for s in symbols:
            if s:
                if (r := self.ids.get(s)) is not None:
                    ids.append(r)
                elif self.bytes:
                    ids.extend([self.bytes[b] for b in s.encode()])
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids.tobytes()

    def parts(self, segment: str) -> bytes:
        """Ids of a segment, which is cut where no piece has the two characters side by side."""
        at, out, pairs = 0, [], self.pairs
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in pairs:
                out.append(self.known[segment[at:i]])
                at = i
        return b"".join((*out, self.known[segment[at:]])) if out else self.merge(segment)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, begin and end included."""
        if not text:
            return self.begin + self.end
        if self.plain and "  " not in text and MARK not in text and text[0] != " ":
            segments = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        else:
            segments = self.cut.findall(MARK + text.replace(" ", MARK))
        return b"".join((self.begin, *map(self.known.__getitem__, segments), self.end))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())

    def settle(self, texts: list[str | None], ids: list[bytes]) -> list[list[int]]:
        """The ids as lists, those of whole texts compared with the library's."""
        if self.check:
            theirs = self.library.encode([x or "" for x in texts], add_bos=True, add_eos=True, num_threads=1)
            for text, x, y in zip(texts, ids, theirs, strict=True):
                if array("I", y).tobytes() != x:
                    raise RuntimeError(f"the agenda and the library differ on {(text or '')[:200]!r}")
            return theirs
        return [array("I", x).tolist() for x in ids]

    def forget(self) -> None:
        self.known = _Memory(self)


class _Memory(dict):
    """Ids of segments. Those used since the last turn are in the dictionary, those of the turn before in old."""

    def __init__(self, owner: PieceEncoder):
        super().__init__()
        self.owner, self.old, self.used = owner, {}, 0

    def __missing__(self, segment: str) -> bytes:
        if (ids := self.old.get(segment)) is None:
            ids = self.owner.parts(segment)
        if len(segment) <= 100:  # a longer one would rarely come again
            self[segment] = ids
            self.used += ENTRY + len(segment) + len(ids)
            if self.used > REMEMBERED / 2:
                self.old, self.used = dict(self), 0
                self.clear()
        return ids


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(model_path: str, check: bool = True) -> PieceEncoder:
    """The process's encoder for a model."""
    if (model_path, check) not in _encoders:
        _encoders[model_path, check] = PieceEncoder(model_path, check)
    return _encoders[model_path, check]


def _steps(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about STEP bytes in the column."""
    size, at = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist(), 1):
        size += n or 0
        if size >= STEP or i == batch.num_rows:
            yield batch.slice(at, i - at)
            size, at = 0, i


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """The kept columns of docs (all but the text, unless named) with token_ids and decoded.

    token_ids holds the ids, begin and end included, as little-endian unsigned 32-bit integers;
    decoded is the library's decode of them. A null or empty text has the begin and end id and
    decodes to ''. Rows stay as they are: repeated rows and null ids are encoded like others, an
    empty table gives an empty one. Kept columns whose names clash with the two new ones are an error.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if clash := {"token_ids", "decoded"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    hidden = common.free_name(docs.select(*keep), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, check)
        try:
            for whole in batches:
                for batch in _steps(whole, len(keep)):
                    texts = batch.column(len(keep)).to_pylist()
                    ids = [own.encode(x) for x in texts]
                    decoded = pa.array(own.library.decode(own.settle(texts, ids), num_threads=1), pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ids, pa.binary()), decoded], names=schema.names)
        finally:
            own.forget()  # an idle worker holds no segments

    return common.in_arrow(docs.select(*keep, F.col(text).alias(hidden)), run, schema)


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode returns."""
    return encoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
