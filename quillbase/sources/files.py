"""Files as whole-text documents, and the planning of their upload."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.errors import KnowledgeError, ParentNotDurable

#: Suffixes that are read as text, and the bytes of a batch.
TEXT = ("txt", "md", "markdown", "csv", "tsv", "json", "jsonl", "log", "yaml", "yml")
BATCH_BYTES = 1 << 20


def suffix(path: Column) -> Column:
    """What follows the last dot of the file's name, in lower case; '' without a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def doc_id(path: Column) -> Column:
    """A path with forward slashes, without empty and '.' segments."""
    return F.array_join(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", ".")), "/")


def docx_text(data: bytes) -> str:
    """The raw text of a docx file: paragraphs two line ends apart, tabs and breaks kept."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    parts = {w + "tab": "\t", w + "br": "\n", w + "cr": "\n"}
    paragraphs = []
    for p in root.iter(w + "p"):
        paragraphs.append("".join(parts.get(x.tag, "") or (x.text or "" if x.tag == w + "t" else "") for x in p.iter()))
    return "\n\n".join(paragraphs) + ("\n\n" if paragraphs else "")


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of the files below a folder: doc_id, content, hash, note; and path, reason. Files are whole texts; line ends become \\n."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = re.sub(r"^file:/*", "/", folder).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base), "")
    files = files.select("path", suffix(F.col("path")).alias("kind"), doc_id(rel).alias("doc_id"), "content")
    plain = files.where(F.col("kind").isin(*TEXT)).select("doc_id", F.regexp_replace(F.regexp_replace(F.decode("content", "utf-8"), "^﻿", ""), "\r\n?", "\n").alias("content"), F.lit(None).cast("string").alias("note"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, data in zip(f["doc_id"], f["content"], strict=True):
                try:
                    out.append((d, docx_text(bytes(data)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((d, None, f"not a docx file: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "content", "note"])

    packed = files.where("kind = 'docx'").select("doc_id", "content").mapInPandas(run, "doc_id string, content string, note string")
    docs = plain.unionByName(packed)
    blank = F.col("content").isNull() | (F.trim(F.regexp_replace("content", r"\s+", " ")) == "")
    rejected = files.where(~F.col("kind").isin(*TEXT, "docx")).select(F.col("doc_id").alias("path"), F.concat(F.lit("unsupported suffix: "), "kind").alias("reason"))
    rejected = rejected.unionByName(docs.where(blank).select(F.col("doc_id").alias("path"), F.coalesce("note", F.lit("no text")).alias("reason")))
    return docs.where(~blank).select("doc_id", "content", F.sha2("content", 256).alias("hash"), "note"), rejected


def changed(docs: DataFrame, submitted: DataFrame, kb_id: str) -> DataFrame:
    """Documents whose hash isn't the one last submitted (kb_id, doc_id, hash) to this base."""
    return docs.join(submitted.where(F.col("kb_id") == kb_id).select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


def batches(docs: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """doc_id, batch: greedy in order of doc_id; a batch closes when the next would exceed limit bytes of UTF-8.

    The running sum begins anew with each batch, which one task has to follow: ids and sizes alone go to it, not contents.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, held, any_yet = 0, 0, False
        for f in frames:
            out = []
            for n in f["n"]:
                if any_yet and held + n > limit:
                    batch, held = batch + 1, 0
                held, any_yet = held + n, True
                out.append(batch)
            yield pd.DataFrame({"doc_id": f["doc_id"], "batch": out})

    narrow = docs.select("doc_id", F.octet_length("content").cast("long").alias("n"))
    return narrow.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").mapInPandas(run, "doc_id string, batch int")


def upload(store, kb_id: str, docs: DataFrame, limit: int = BATCH_BYTES, attempts: int = 8, sleep=None) -> list[dict]:
    """Each batch as a version of UPDATEs on the last that landed; a failed batch is reported and later ones still go."""
    from quillbase.functions.scalars import retry

    plan = docs.join(batches(docs, limit), "doc_id")
    out, parent = [], store.last_version(kb_id)
    for b in sorted(r[0] for r in plan.select("batch").distinct().collect()):
        rows = plan.where(F.col("batch") == b).orderBy("doc_id").select("doc_id", "content").collect()  # limit bytes
        changes = [("UPDATE", r["doc_id"], r["content"]) for r in rows]
        try:
            parent = retry(lambda c=changes, p=parent: store.create_version(kb_id, c, p), attempts, **({"sleep": sleep} if sleep else {}))
            out.append({"batch": b, "status": "DONE", "version_id": parent, "documents": len(rows)})
        except (KnowledgeError, ParentNotDurable) as e:
            out.append({"batch": b, "status": "FAILED", "version_id": None, "documents": len(rows), "error": e.name})
    return out


def chain_tail(versions: DataFrame) -> DataFrame:
    """kb_id, version_id and ready of each base's last version."""
    last = versions.groupBy("kb_id").agg(F.max_by(F.struct("version_id", "deleting", "data_status"), "version_id").alias("x"))
    return last.select("kb_id", "x.version_id", (~F.col("x.deleting") & (F.col("x.data_status") == "DURABLE")).alias("ready"))


def status_counts(queue: DataFrame, domain: tuple[str, ...] = ("QUEUED", "RUNNING", "DONE", "FAILED", "SKIPPED")) -> DataFrame:
    """status, n for every status of the domain."""
    names = queue.sparkSession.createDataFrame([(d,) for d in domain], "status string")
    return F.broadcast(names).join(queue.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
