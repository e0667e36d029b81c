"""Scalars of the version lifecycle and of placement."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a query.
MAX_TOP_K, OVER_FETCH, MAX_HITS, MAX_CANDIDATES = 1024, 3, 1000, 4096


def stage(deleting: Column, data_status: Column, index_status: Column) -> Column:
    """The stage of a version; earlier cases win."""
    return (
        F.when(deleting, "DELETING")
        .when(data_status == "FAILED_PERMANENT", "DATA_FAILED_PERMANENT")
        .when(index_status == "FAILED_PERMANENT", "INDEX_FAILED_PERMANENT")
        .when(index_status == "READY", "INDEX_READY")
        .when((index_status == "FAILED") & (data_status != "PENDING"), "INDEX_FAILED")
        .when(data_status == "DURABLE", "DATA_DURABLE")
        .otherwise("DATA_PENDING")
    )


def reached(stage_: Column) -> Column:
    """Whether a version's stage is the one waited for; both targets are reached alike."""
    return stage_.isin("DATA_DURABLE", "INDEX_READY")


def terminal(stage_: Column) -> Column:
    return stage_.isin("INDEX_FAILED", "DATA_FAILED_PERMANENT", "INDEX_FAILED_PERMANENT", "DELETING")


def next_step(stage_: Column, data_missing: Column, have_changes: Column) -> Column:
    """What a writer does after waiting: DONE, WAIT, RESEND or DISCARD."""
    again = F.when(have_changes, "RESEND").otherwise("DISCARD")
    return (
        F.when(stage_.isin("INDEX_READY", "DATA_DURABLE"), "DONE")
        .when(stage_.isin("DATA_FAILED_PERMANENT", "INDEX_FAILED_PERMANENT"), again)
        .when(stage_ == "DELETING", "DISCARD")
        .when((stage_ == "DATA_PENDING") & data_missing, again)
        .otherwise("WAIT")
    )


def hits_for(top_k: int) -> int:
    """Chunk hits that a document query of top_k looks at."""
    return min(max(OVER_FETCH * top_k, 10), MAX_HITS)


def candidates_for(top_k: int, asked: int = 0) -> int:
    """Candidates of the coarse stage that are scored exactly."""
    return min(asked, MAX_CANDIDATES) if asked > 0 else min(max(8 * top_k, 16), MAX_CANDIDATES)


def quorum(n: int) -> int:
    return n // 2 + 1 if n > 0 else 0


def owner_rank(kb_id: Column, version_id: Column, member: Column) -> Column:
    """Rendezvous hash of a member for a version: 16 hex digits, whose order is that of the unsigned number."""
    zero = F.unhex(F.lit("00"))
    big_endian = F.unhex(F.lpad(F.hex(version_id.cast("long")), 16, "0"))
    return F.substring(F.sha2(F.concat(big_endian, zero, member.cast("binary"), zero, kb_id.cast("binary")), 256), 1, 16)


def length_prefixed(text: Column) -> Column:
    """The text's bytes after their number as four bytes, big-endian."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")), text.cast("binary"))


def ordered_version(version_id: Column) -> Column:
    """Eight bytes, big-endian, in the order of the (not negative) ids."""
    return F.unhex(F.lpad(F.hex(version_id.cast("long")), 16, "0"))


def prefix_successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with the prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def fingerprint(ids: list[str]) -> int:
    """FNV-1a, 64 bits, over sorted ids with a zero byte after each."""
    h = 0xCBF29CE484222325
    for b in b"".join(x + b"\0" for x in sorted(i.encode() for i in ids)):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def retry(fn, attempts: int = 8, base_seconds: float = 0.2, sleep=time.sleep):
    """fn(), again after base, 2 base, 4 base ... seconds while it raises an error that a retry can help."""
    for n in range(attempts):
        try:
            return fn()
        except Exception as e:
            if n + 1 == attempts or not getattr(e, "retryable", False):
                raise
            sleep(base_seconds * 2**n)
    return None
