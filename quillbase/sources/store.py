"""A store of knowledge bases: Parquet tables, with the metadata published last.

Data tables are partitioned by base (and version, where a row has one), so that scans prune. The
metadata (bases, versions, deletion log) is small; each change writes it anew under the next number
and then publishes that number, which is the commit. One writer at a time. Readers see durable versions only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase import errors as E
from quillbase.functions import scalars, text, vectors
from quillbase.operators import chain, documents, index, search
from quillbase.sources import schemas

Embed = Callable[[DataFrame], DataFrame]
OPS = ("ADD", "UPDATE", "DELETE")
#: Entries of the deletion log that are kept.
LOG_KEPT = 10_000
#: Transient failures of a version's side that make its verdict final.
FAILURE_BUDGET = 5


def mock_embed(chunks: DataFrame) -> DataFrame:
    """chunk_id, vector by the offline embedding."""
    return chunks.select("chunk_id", vectors.mock_embedding(F.col("chunk_id"), 64).alias("vector"))


def http_embed(url: str, batch: int = 64, timeout: float = 30.0, limit: int = 32 << 20) -> Embed:
    """Embeds by POST of {"chunks": [{"chunk_id", "content"}]} to url, which answers {"vectors": {id: [..]}}. Every id asked for must come back."""

    def embed(chunks: DataFrame) -> DataFrame:
        def run(frames):
            import urllib.request

            import pandas as pd

            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    body = json.dumps({"chunks": [{"chunk_id": i, "content": c} for i, c in zip(part["chunk_id"], part["chunk"], strict=True)]}).encode()
                    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        raw = answer.read(limit + 1)
                    if len(raw) > limit:
                        raise E.InvalidArgument("the embedding service's answer is too large")
                    found = json.loads(raw)["vectors"]
                    if missing := set(part["chunk_id"]) - set(found):
                        raise E.DataIncomplete(f"{len(missing)} chunks came back without a vector")
                    yield pd.DataFrame({"chunk_id": list(part["chunk_id"]), "vector": [found[i] for i in part["chunk_id"]]})

        return chunks.select("chunk_id", "chunk").mapInPandas(run, "chunk_id string, vector array<float>")

    return embed


class Store:
    """The tables under a root path and the commands on them."""

    DATA = {"doc_changes": schemas.DOC_CHANGES, "doc_versions": schemas.DOC_VERSIONS, "version_docs": schemas.VERSION_DOCS, "chunk_docs": schemas.CHUNK_DOCS, "chunk_vectors": schemas.CHUNK_VECTORS, "index_chunks": schemas.INDEX_CHUNKS, "access_log": schemas.ACCESS_LOG}
    META = {"kbs": schemas.KBS, "versions": schemas.VERSIONS, "deleted_log": schemas.DELETED_LOG}

    def __init__(self, spark: SparkSession, root: str, embed: Embed = mock_embed, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.embed, self.clock = spark, root.rstrip("/"), embed, clock
        self.jvm = spark.sparkContext._jvm
        self.meta = self._load()
        self._exchange()

    # files

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _published(self) -> int:
        if not self._exists("_meta"):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("_meta"))]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def _load(self) -> dict:
        n = self._published()
        if not n:
            return {"n": 0, "kbs": {}, "versions": {}, "log": [], "seq": 0, "last_id": 0, "epoch": uuid.uuid4().hex, "requests": {}}
        row = self.spark.read.text(f"{self.root}/_meta/{n}", wholetext=True).collect()[0][0]
        meta = json.loads(row)
        meta["versions"] = {int(k): v for k, v in meta["versions"].items()}
        return meta

    def _publish(self) -> None:
        """Writes the metadata beside and renames it to the next number: readers have the old or the new one."""
        self.meta["n"] += 1
        body = json.dumps(self.meta)
        beside = self._path(f"_meta/.{uuid.uuid4().hex}")
        out = self._fs().create(beside)
        out.write(bytearray(body.encode()))
        out.close()
        if not self._fs().rename(beside, self._path(f"_meta/{self.meta['n']}")):
            raise E.DataIncomplete("another writer has published")

    def table(self, name: str) -> DataFrame:
        """A data or metadata table."""
        if name in self.META:
            rows = {"kbs": list(self.meta["kbs"].values()), "versions": list(self.meta["versions"].values()), "deleted_log": self.meta["log"]}[name]
            return self.spark.createDataFrame(rows, self.META[name])
        if not self._exists(name):
            return self.spark.createDataFrame([], self.DATA[name])
        return self.spark.read.schema(self.DATA[name]).parquet(f"{self.root}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        by = ["kb_id", "version_id"] if name in ("version_docs", "index_chunks", "doc_changes") else ["kb_id"]
        names = [x.split()[0] for x in self.DATA[name].split(", ")]
        df.select(*names).write.mode("append").partitionBy(*by).parquet(f"{self.root}/{name}")

    def _put_version(self, name: str, df: DataFrame, kb_id: str, version_id: int) -> None:
        """Replaces one version's partition, so that a repeated run leaves one copy."""
        df.drop("kb_id", "version_id").write.mode("overwrite").parquet(f"{self.root}/{name}/kb_id={kb_id}/version_id={version_id}")

    def _rewrite(self, name: str, kb_id: str, df: DataFrame) -> None:
        """Replaces a base's partition by df: written beside, announced in the metadata, then exchanged. A store that is opened after a crash finishes the exchange."""
        if not self._exists(f"{name}/kb_id={kb_id}"):
            return
        beside = f"_staging/{uuid.uuid4().hex}"
        df.drop("kb_id").write.parquet(f"{self.root}/{beside}")
        self.meta.setdefault("exchanges", {})[beside] = f"{name}/kb_id={kb_id}"
        self._publish()
        self._exchange()
        self.spark.catalog.refreshByPath(f"{self.root}/{name}")

    def _exchange(self) -> None:
        """Puts announced folders in their places; each step may be repeated."""
        waiting = self.meta.get("exchanges", {})
        for beside, place in list(waiting.items()):
            if self._exists(beside):
                self._fs().delete(self._path(place), True)
                if not self._fs().rename(self._path(beside), self._path(place)):
                    raise E.DataIncomplete(f"{place} can't be replaced")
            del waiting[beside]
            self._publish()

    def _drop_records(self, kb_id: str, version_id: int) -> None:
        """Drops all that a version wrote which never became durable, so that no later version reads it."""
        for name in ("doc_changes", "version_docs", "index_chunks"):
            self._fs().delete(self._path(f"{name}/kb_id={kb_id}/version_id={version_id}"), True)
        self._rewrite("doc_versions", kb_id, self.of("doc_versions", kb_id).where(F.col("version_id") != version_id))

    def of(self, name: str, kb_id: str) -> DataFrame:
        return self.table(name).where(F.col("kb_id") == kb_id)

    # lookups

    def kb(self, kb_id: str, active: bool = False) -> dict:
        found = self.meta["kbs"].get(kb_id)
        if found is None:
            raise E.KnowledgeBaseNotFound(kb_id)
        if active and found["status"] != "ACTIVE":
            raise E.KnowledgeBaseDeleting(kb_id)
        return found

    def version(self, kb_id: str, version_id: int) -> dict:
        found = self.meta["versions"].get(version_id)
        if found is None or found["kb_id"] != kb_id:
            raise E.VersionNotFound(f"{kb_id}/{version_id}")
        return found

    def versions(self, kb_id: str, after: int | None = None, upto: int | None = None) -> DataFrame:
        """Versions of a base with after < id <= upto."""
        rows = self.table("versions").where(F.col("kb_id") == kb_id)
        rows = rows if after is None else rows.where(F.col("version_id") > after)
        return rows if upto is None else rows.where(F.col("version_id") <= upto)

    def last_version(self, kb_id: str) -> int:
        return max((v["version_id"] for v in self.meta["versions"].values() if v["kb_id"] == kb_id), default=0)

    # bases

    def create_kb(self, name: str, model_id: str = "mock", kb_id: str | None = None, similarity: str = "COSINE", quantizer: str = "OFF", index_type: str = "FLAT", params: text.ChunkParams | None = None, pq_m: int = 0, pq_nbits: int = 0, service_addr: str = "") -> str:
        kb_id = kb_id or f"kb-{uuid.uuid4().hex}"
        if kb_id in self.meta["kbs"]:
            raise E.InvalidArgument(f"{kb_id} exists")
        if index_type not in ("HNSW", "FLAT", "IVF") or quantizer.removesuffix("_FLAT") not in index.QUANTISERS:
            raise E.InvalidArgument(f"{index_type}, {quantizer}")
        p = (params or text.ChunkParams()).filled()
        self.meta["kbs"][kb_id] = {"kb_id": kb_id, "name": name, "chunk_mode": p.mode, "window": p.window, "overlap": p.overlap, "min_size": p.min_size, "max_size": p.max_size, "avg_bits": p.avg_bits, "index_type": index_type, "similarity": vectors.metric_name(similarity), "quantizer": quantizer, "pq_m": pq_m or index.PQ_M, "pq_nbits": pq_nbits or index.PQ_BITS, "embed": {"service_addr": service_addr, "model_id": model_id}, "active_version_id": 0, "status": "ACTIVE"}
        self._publish()
        return kb_id

    def delete_kb(self, kb_id: str) -> None:
        """Marks, drops everywhere, then forgets the base; a repeated call finishes what an earlier one began."""
        if kb_id not in self.meta["kbs"]:
            return
        self.kb(kb_id)["status"] = "DELETING"
        self._publish()
        try:
            for name in self.DATA:
                self._fs().delete(self._path(f"{name}/kb_id={kb_id}"), True)
        except Exception:
            self.kb(kb_id)["status"] = "DELETE_FAILED"
            self._publish()
            raise
        self.meta["versions"] = {i: v for i, v in self.meta["versions"].items() if v["kb_id"] != kb_id}
        self.meta["requests"] = {k: v for k, v in self.meta["requests"].items() if not k.startswith(kb_id + "\n")}
        del self.meta["kbs"][kb_id]
        self._log(kb_id, 0)
        self._publish()

    def _log(self, kb_id: str, version_id: int) -> None:
        self.meta["seq"] += 1
        self.meta["log"] = [*self.meta["log"], {"epoch": self.meta["epoch"], "seq": self.meta["seq"], "kb_id": kb_id, "version_id": version_id}][-LOG_KEPT:]

    # versions

    def create_version(self, kb_id: str, changes: list[tuple[str, str, str | None]], parent: int = 0, request_id: str | None = None) -> int:
        """A version from (op, doc_id, content) changes. One request id gives one version; a failed write leaves a version whose verdict says so."""
        kb = self.kb(kb_id, active=True)
        if not changes:
            raise E.InvalidArgument("no changes")
        for op, doc_id, _ in changes:
            if op not in OPS:
                raise E.InvalidArgument(f"no change is called {op}")
            if not doc_id or "\n" in doc_id:
                raise E.InvalidArgument(f"not a document id: {doc_id!r}")
        if request_id and (known := self.meta["requests"].get(f"{kb_id}\n{request_id}")):
            return known
        own = [v for v in self.meta["versions"].values() if v["kb_id"] == kb_id]
        if parent:
            p = self.meta["versions"].get(parent)
            if p is None or p["kb_id"] != kb_id or p["deleting"]:
                raise E.ParentNotFound(f"{kb_id}/{parent}")
            if p["data_status"] != "DURABLE":
                raise E.ParentNotDurable(f"{kb_id}/{parent}")
        if any(v["parent_version_id"] == parent for v in own):  # a second root would break reads by number
            raise E.ParentHasChild(f"{kb_id}/{parent}")
        self.meta["last_id"] += 1
        new = self.meta["last_id"]
        self.meta["versions"][new] = {"kb_id": kb_id, "version_id": new, "parent_version_id": parent, "created_at": int(self.clock()), "data_status": "PENDING", "index_status": "PENDING", "index_ready_nodes": [], "doc_id_set_hash": None, "failure_reason": None, "failure_count": 0, "failure_side": None, "deleting": False, "request_id": request_id}
        if request_id:
            self.meta["requests"][f"{kb_id}\n{request_id}"] = new
        self._publish()
        rows = [(kb_id, new, i, op, d, c if op != "DELETE" else None) for i, (op, d, c) in enumerate(changes)]
        frame = self.spark.createDataFrame(rows, schemas.DOC_CHANGES)
        try:
            digest = self._write_version(kb, new, parent, frame)
        except Exception as e:
            self.report_failure(kb_id, new, "data", E.failure_class(e), str(e)[:500])
            raise
        self.meta["versions"][new] |= {"data_status": "DURABLE", "doc_id_set_hash": digest}
        self._publish()
        return new

    def _write_version(self, kb: dict, version_id: int, parent: int, changes: DataFrame) -> str:
        kb_id = kb["kb_id"]
        self._put_version("doc_changes", changes, kb_id, version_id)
        last = documents.last_op(self.of("doc_changes", kb_id).where(F.col("version_id") == version_id))
        upserts = last.where("op <> 'DELETE'").select("kb_id", "doc_id", F.coalesce("content", F.lit("")).alias("content"))
        p = text.ChunkParams(kb["chunk_mode"], kb["window"], kb["overlap"], kb["min_size"], kb["max_size"], kb["avg_bits"])
        chunks = text.split(upserts, kb["embed"]["model_id"], p)
        new = documents.pending_embed(chunks.select("kb_id", "chunk_id", "chunk"), self.of("chunk_vectors", kb_id))
        self._append("chunk_vectors", self.embed(new).withColumn("kb_id", F.lit(kb_id)))
        self._append("chunk_docs", chunks.select("kb_id", "chunk_id", "doc_id").distinct().join(self.of("chunk_docs", kb_id), ["kb_id", "chunk_id", "doc_id"], "left_anti"))
        body = last.select("kb_id", "doc_id", "version_id", (F.col("op") == "DELETE").alias("is_tombstone"), F.when(F.col("op") != "DELETE", F.coalesce("content", F.lit(""))).alias("content"))
        self._append("doc_versions", body)
        before = self.of("version_docs", kb_id).where(F.col("version_id") == parent)
        if parent and self._digest(before) != self.version(kb_id, parent)["doc_id_set_hash"]:
            raise E.DataIncomplete(f"{kb_id}/{parent}: its document set is incomplete")
        ids = documents.next_set(before, changes)
        self._put_version("version_docs", ids, kb_id, version_id)
        return self._digest(self.of("version_docs", kb_id).where(F.col("version_id") == version_id))

    @staticmethod
    def _digest(ids: DataFrame) -> str:
        return documents.set_digest(ids).collect()[0]["digest"]

    def report_failure(self, kb_id: str, version_id: int, side: str, kind: str, reason: str = "") -> bool:
        """Counts a failure of a side; whether its verdict is final now: at once if fatal, else after a budget. A durable side keeps its state."""
        v = self.version(kb_id, version_id)
        if v[f"{side}_status"] in ("DURABLE", "READY", "FAILED_PERMANENT"):
            return v[f"{side}_status"] == "FAILED_PERMANENT"
        v["failure_count"] = v["failure_count"] + 1 if v["failure_side"] in (None, side) else 1
        v |= {"failure_side": side, "failure_reason": reason}
        final = kind == "FATAL_GLOBAL" or v["failure_count"] >= FAILURE_BUDGET
        if final:
            v[f"{side}_status"] = "FAILED_PERMANENT"
        elif side == "index":
            v["index_status"] = "FAILED"
        self._publish()
        return final

    def retry_version(self, kb_id: str, version_id: int) -> None:
        """Takes back the index side's verdict."""
        v = self.version(kb_id, version_id)
        if v["index_status"] != "FAILED_PERMANENT":
            raise E.InvalidArgument("the index side has no final verdict")
        v |= {"index_status": "PENDING", "failure_count": 0, "failure_reason": None, "failure_side": None}
        self._publish()

    def rollback(self, kb_id: str, version_id: int) -> None:
        v = self.version(kb_id, version_id)
        if v["deleting"]:
            raise E.VersionDeleting(f"{kb_id}/{version_id}")
        if v["data_status"] != "DURABLE":
            raise E.VersionNotDurable(f"{kb_id}/{version_id}")
        self.kb(kb_id)["active_version_id"] = version_id
        self._publish()

    def discard(self, kb_id: str, version_id: int) -> None:
        """Drops the records of a pending version without children and forgets it; its request id is free again. A repeated call finishes an earlier one."""
        v = self.version(kb_id, version_id)
        if v["deleting"]:
            raise E.VersionDeleting(f"{kb_id}/{version_id}")
        if self.kb(kb_id)["active_version_id"] == version_id:
            raise E.VersionActive(f"{kb_id}/{version_id}")
        if v["data_status"] != "PENDING":
            raise E.InvalidArgument(f"{kb_id}/{version_id} isn't pending")
        if any(x["parent_version_id"] == version_id for x in self.meta["versions"].values()):
            raise E.ParentHasChild(f"{kb_id}/{version_id}")
        self._drop_records(kb_id, version_id)
        self._forget(kb_id, version_id)
        self._publish()

    def _forget(self, kb_id: str, version_id: int) -> None:
        if self.meta["versions"].pop(version_id, None) is not None:
            self.meta["requests"] = {k: n for k, n in self.meta["requests"].items() if n != version_id}
            self._log(kb_id, version_id)

    def delete_version(self, kb_id: str, version_id: int, mode: str = "SINGLE") -> list[int]:
        """Marks all targets or none, then drops their data, oldest last, and forgets them."""
        self.version(kb_id, version_id)
        own = self.versions(kb_id)
        gone = sorted(r[0] for r in chain.delete_targets(self.spark, own, version_id, mode).collect())
        if self.kb(kb_id)["active_version_id"] in gone:
            raise E.VersionActive(f"{kb_id}/{self.kb(kb_id)['active_version_id']}")
        for i in gone:
            v = self.meta["versions"][i]
            waits = [c for c in self.meta["versions"].values() if c["parent_version_id"] == i and c["version_id"] not in gone and c["data_status"] == "PENDING"]
            if waits or (v["data_status"] == "PENDING" or v["index_status"] == "PENDING" and v["data_status"] != "DURABLE" and v["data_status"] != "FAILED_PERMANENT"):
                raise E.VersionPending(f"{kb_id}/{i}")
        left = chain.spliced(own, own.where(F.col("version_id").isin(gone))).select("version_id", "parent_version_id").collect()
        for r in left:
            self.meta["versions"][r["version_id"]]["parent_version_id"] = r["parent_version_id"]
        for i in gone:
            self.meta["versions"][i]["deleting"] = True
        self._publish()
        self.sweep(kb_id)
        return gone

    def force_abandon(self, kb_id: str, version_id: int) -> list[int]:
        """Deletes one version that has a final verdict on either side."""
        v = self.version(kb_id, version_id)
        if "FAILED_PERMANENT" not in (v["data_status"], v["index_status"]):
            raise E.InvalidArgument(f"{kb_id}/{version_id} has no final verdict")
        return self.delete_version(kb_id, version_id)

    def sweep(self, kb_id: str) -> int:
        """Finishes deletions: reclaims chunks, drops index, document list and records that no survivor reads, forgets the version."""
        marked = sorted((i for i, v in self.meta["versions"].items() if v["kb_id"] == kb_id and v["deleting"]), reverse=True)
        for i in marked:
            self._fs().delete(self._path(f"index_chunks/kb_id={kb_id}/version_id={i}"), True)
            self._fs().delete(self._path(f"version_docs/kb_id={kb_id}/version_id={i}"), True)
            after = min((n for n, v in self.meta["versions"].items() if v["kb_id"] == kb_id and n > i and not v["deleting"]), default=0)
            if self.meta["versions"][i]["data_status"] == "DURABLE":
                self._rewrite("doc_versions", kb_id, documents.kept_rows(self.of("doc_versions", kb_id), i, after))
            else:
                self._drop_records(kb_id, i)
            self._forget(kb_id, i)
            self._publish()
        if marked:
            self.collect_garbage(kb_id)
        return len(marked)

    def collect_garbage(self, kb_id: str) -> int:
        """Drops chunks that no live version can read: mappings first, then vectors. Returns how many."""
        gone = documents.orphans(self.of("chunk_docs", kb_id), self.of("doc_versions", kb_id), self.versions(kb_id))
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        gone.write.parquet(path)
        gone = self.spark.read.parquet(path)
        n = gone.count()
        if n:
            self._rewrite("chunk_docs", kb_id, documents.without_chunks(self.of("chunk_docs", kb_id), gone))
            self._rewrite("chunk_vectors", kb_id, documents.without_chunks(self.of("chunk_vectors", kb_id), gone))
        self._fs().delete(self.jvm.org.apache.hadoop.fs.Path(path), True)
        return n

    def sweep_staging(self, age_seconds: float = 1800) -> int:
        """Deletes staging folders that nobody has touched for age_seconds."""
        n = 0
        for name in ("_staging",):
            if self._exists(name):
                for s in self._fs().listStatus(self._path(name)):
                    if f"{name}/{s.getPath().getName()}" in self.meta.get("exchanges", {}):
                        continue
                    if self.clock() - s.getModificationTime() / 1000 > age_seconds:
                        n += self._fs().delete(s.getPath(), True)
        return n

    # reading

    def readable(self, kb_id: str, version_id: int | None) -> dict | None:
        """The version that a query reads; None where none was asked for and none is active."""
        kb = self.kb(kb_id)
        version_id = version_id or kb["active_version_id"]
        if not version_id:
            return None
        v = self.version(kb_id, version_id)
        if v["deleting"]:
            raise E.VersionDeleting(f"{kb_id}/{version_id}")
        if v["data_status"] == "FAILED_PERMANENT":
            raise E.VersionFailed(f"{kb_id}/{version_id}")
        if v["data_status"] != "DURABLE":
            raise E.VersionNotDurable(f"{kb_id}/{version_id}")
        return v

    def cursor(self, kb_id: str) -> int:
        """The last version before the first that isn't durable."""
        rows = self.versions(kb_id).select("kb_id", "version_id", (F.col("data_status") == "DURABLE").alias("held"))
        found = documents.contiguous_cursor(rows).collect()
        return found[0]["cursor"] if found else 0

    def documents(self, kb_id: str, version_id: int) -> DataFrame:
        """doc_id and content at a version."""
        ids = self.of("version_docs", kb_id).where(F.col("version_id") == version_id).select("doc_id")
        return documents.as_of(self.of("doc_versions", kb_id), version_id).join(ids, "doc_id", "left_semi").select("doc_id", "content")

    def chunks(self, kb_id: str, version_id: int) -> DataFrame:
        ids = self.of("version_docs", kb_id).where(F.col("version_id") == version_id)
        return documents.chunks_of(ids, self.of("chunk_docs", kb_id))

    def build_index(self, kb_id: str, version_id: int) -> int:
        """Writes the search table of a version, from its parent's where there is one; returns its rows."""
        v = self.readable(kb_id, version_id)
        own = self.chunks(kb_id, version_id)
        base = self.of("index_chunks", kb_id).where(F.col("version_id") == v["parent_version_id"])
        mine = self.of("chunk_vectors", kb_id)
        if v["parent_version_id"] and base.limit(1).count():
            delta = documents.delta(own, base)
            rows = index.appended(base.select("chunk_id", "vector"), mine.join(delta, "chunk_id", "left_semi"), documents.delta(base, own))
        else:
            rows = mine.join(own, "chunk_id", "left_semi").select("chunk_id", "vector").dropDuplicates(["chunk_id"])
        rows, _ = index.checked(rows)
        self._put_version("index_chunks", rows, kb_id, version_id)
        n = self.of("index_chunks", kb_id).where(F.col("version_id") == version_id).count()
        self.version(kb_id, version_id).update(index_status="READY", index_ready_nodes=[1])
        self._publish()
        return n

    def rebuild_index(self, kb_id: str, version_id: int) -> int:
        self.version(kb_id, version_id)["index_status"] = "PENDING"
        self._fs().delete(self._path(f"index_chunks/kb_id={kb_id}/version_id={version_id}"), True)
        return self.build_index(kb_id, version_id)

    def query(self, kb_id: str, vector, top_k: int = 10, version_id: int | None = None, threshold: float | None = None, method: str = "MEDIAN", min_version: int = 0) -> DataFrame:
        """doc_id, content, score: the version's best documents."""
        search.check_top_k(top_k)
        if min_version and self.cursor(kb_id) < min_version:
            raise E.StaleRead(f"{kb_id} is before {min_version}")
        v = self.readable(kb_id, version_id)
        if v is None:
            return self.spark.createDataFrame([], "doc_id string, content string, score double")
        version_id = v["version_id"]
        ids = self.of("version_docs", kb_id).where(F.col("version_id") == version_id)
        if self._digest(ids) != v["doc_id_set_hash"]:
            raise E.DataIncomplete(f"{kb_id}/{version_id}: its document set is incomplete")
        if v["index_status"] == "READY":
            table = self.of("index_chunks", kb_id).where(F.col("version_id") == version_id)
        else:
            if search.landing(ids, self.of("chunk_docs", kb_id)):
                raise E.DataIncomplete(f"{kb_id}/{version_id}: its chunks are still landing")
            table = self.of("chunk_vectors", kb_id).join(self.chunks(kb_id, version_id), ["kb_id", "chunk_id"], "left_semi")
        self._append("access_log", self.spark.createDataFrame([(kb_id, version_id)], "kb_id string, version_id long").withColumn("at", F.lit(self.clock()).cast("timestamp")))
        return search.document_query(table.select("chunk_id", "vector"), self.of("chunk_docs", kb_id), ids, self.documents(kb_id, version_id), vector, top_k, self.kb(kb_id)["similarity"], method, threshold)

    def query_text(self, kb_id: str, words: str, **options) -> DataFrame:
        """query with the vector that the base's embedding gives a text."""
        one = self.spark.createDataFrame([(words,)], "chunk string").withColumn("chunk_id", text.chunk_id(F.col("chunk"), self.kb(kb_id)["embed"]["model_id"]))
        return self.query(kb_id, self.embed(one).collect()[0]["vector"], **options)

    def await_version(self, kb_id: str, version_id: int, wait_seconds: float = 5.0, poll_seconds: float = 0.2) -> dict:
        """stage, reached, terminal and next step of a version, after waiting for it to be reached or terminal."""
        until = time.monotonic() + min(wait_seconds, 5.0)
        while True:
            self.meta = self._load() if self._published() > self.meta["n"] else self.meta
            self.version(kb_id, version_id)
            one = self.versions(kb_id).where(F.col("version_id") == version_id)
            s = one.select(scalars.stage(F.col("deleting"), F.col("data_status"), F.col("index_status")).alias("stage"))
            row = s.select("stage", scalars.reached(F.col("stage")).alias("reached"), scalars.terminal(F.col("stage")).alias("terminal"), scalars.next_step(F.col("stage"), F.lit(False), F.lit(True)).alias("next")).collect()[0].asDict()
            if row["reached"] or row["terminal"] or time.monotonic() >= until:
                return row
            time.sleep(poll_seconds)

    def health(self) -> dict:
        """HEALTHY, or DEGRADED with what is wrong; counts and bytes."""
        bad = [k for k, v in self.meta["kbs"].items() if v["status"] != "ACTIVE"] + [f"{v['kb_id']}/{i}" for i, v in self.meta["versions"].items() if "FAILED_PERMANENT" in (v["data_status"], v["index_status"])]
        used = self.table("doc_versions").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).collect()[0][0]
        return {"status": "DEGRADED" if bad else "HEALTHY", "detail": bad, "bases": len(self.meta["kbs"]), "versions": len(self.meta["versions"]), "document_bytes": used}

    def enforce_retention(self, kb_id: str, keep: int = 50, window_seconds: int = 86_400, most_recent: int = 16) -> list[int]:
        """Drops old index tables; the active and the last version and the recently used stay."""
        stored = self.of("index_chunks", kb_id).select("kb_id", "version_id").distinct()
        safe = self.spark.createDataFrame([(self.kb(kb_id)["active_version_id"],), (self.last_version(kb_id),)], "version_id long")
        recent = chain.recently_used(self.of("access_log", kb_id), stored, F.lit(self.clock()).cast("timestamp"), window_seconds, most_recent)
        gone = sorted(r["version_id"] for r in chain.retention_drops(stored, safe, recent, keep).collect())
        for i in gone:
            self._fs().delete(self._path(f"index_chunks/kb_id={kb_id}/version_id={i}"), True)
            self.version(kb_id, i)["index_status"] = "PENDING"
        if gone:
            self._publish()
        return gone

    def export_version(self, kb_id: str, version_id: int, path: str) -> None:
        """Writes all that a version consists of."""
        self.readable(kb_id, version_id)
        documents.export_state(kb_id, version_id, self.table("version_docs"), self.table("doc_versions"), self.table("chunk_docs"), self.table("chunk_vectors")).write.parquet(path)

    def import_version(self, kb_id: str, path: str, parent: int = 0) -> int:
        """A version from an exported one: its readable bodies become upserts, and known vectors are taken over."""
        kb = self.kb(kb_id, active=True)
        state = self.spark.read.parquet(path)
        vecs = state.where("entry_type = 'VECTOR'").select(F.lit(kb_id).alias("kb_id"), "chunk_id", "vector")
        self._append("chunk_vectors", vecs.join(self.of("chunk_vectors", kb_id).select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_anti"))
        bodies = state.where("entry_type = 'DOC_BODY' and not is_tombstone").select("doc_id", "content").orderBy("doc_id")
        expected = self._digest(state.where("entry_type = 'DOC_LIST'"))
        new = self.create_version(kb["kb_id"], [("UPDATE", r["doc_id"], r["content"]) for r in bodies.toLocalIterator()], parent)
        if not parent and self.version(kb_id, new)["doc_id_set_hash"] != expected:
            raise E.DataIncomplete("the snapshot's documents aren't those of its list")
        return new
