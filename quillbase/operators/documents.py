"""As-of reads, document sets, chunk maps: the relational operators of versioned documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["kb_id", "doc_id"]


def records_as_of(doc_versions: DataFrame, version_id: int) -> DataFrame:
    """For each document the record of the largest version up to version_id, tombstones included. One aggregation, no sort."""
    seen = doc_versions.where(F.col("version_id") <= version_id)
    best = seen.groupBy(*KEY).agg(F.max_by(F.struct("version_id", "is_tombstone", "content"), "version_id").alias("x"))
    return best.select(*KEY, "x.version_id", "x.is_tombstone", "x.content")


def as_of(doc_versions: DataFrame, version_id: int) -> DataFrame:
    """The documents visible at a version: kb_id, doc_id, version_id (that supplied them), content."""
    return records_as_of(doc_versions, version_id).where("not is_tombstone").drop("is_tombstone")


def as_of_each(doc_versions: DataFrame, versions: DataFrame) -> DataFrame:
    """as_of for each (kb_id, at) of a small table of versions: adds at. A document is joined with the versions of its base, and each keeps its latest."""
    v = F.broadcast(versions.select("kb_id", F.col("version_id").alias("at")))
    seen = doc_versions.join(v, "kb_id").where(F.col("version_id") <= F.col("at"))
    best = seen.groupBy("kb_id", "at", "doc_id").agg(F.max_by(F.struct("version_id", "is_tombstone", "content"), "version_id").alias("x"))
    return best.where("not x.is_tombstone").select("kb_id", "at", "doc_id", "x.version_id", "x.content")


def last_op(changes: DataFrame) -> DataFrame:
    """Of the changes of a version to one document the last in the list."""
    by = ["kb_id", "version_id", "doc_id"]
    best = changes.groupBy(*by).agg(F.max_by(F.struct("pos", "op", "content"), "pos").alias("x"))
    return best.select(*by, "x.pos", "x.op", "x.content")


def next_set(parent: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id of the child version: the parent's set with upserts, without deletes."""
    last = last_op(changes)
    gone, added = last.where("op = 'DELETE'"), last.where("op <> 'DELETE'")
    return parent.select("doc_id").join(gone, "doc_id", "left_anti").union(added.select("doc_id")).distinct()


def set_digest(ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hex SHA-256 of the sorted ids, one a line; that of '' for none (where there is no by)."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set("doc_id")), "\n"), 256).alias("digest")
    return ids.groupBy(*(by or [])).agg(digest, F.count_distinct("doc_id").alias("n_docs"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two doc_id tables hold one set."""
    both = a.select("doc_id").distinct().withColumn("l", F.lit(1)).join(b.select("doc_id").distinct().withColumn("r", F.lit(1)), "doc_id", "full")
    return both.where("l is null or r is null").limit(1).count() == 0


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id and change (ADDED, REMOVED or UPDATED) between two tables of doc_id, content."""
    both = old.select("doc_id", F.col("content").alias("o"), F.lit(True).alias("in_old")).join(new.select("doc_id", F.col("content").alias("n"), F.lit(True).alias("in_new")), "doc_id", "full")
    change = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").when(~F.col("o").eqNullSafe(F.col("n")), "UPDATED")
    return both.select("doc_id", change.alias("change")).where("change is not null")


def chunks_of(version_docs: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """kb_id, version_id, chunk_id: the chunks of the documents of each version. The map isn't versioned: chunks of a document's other revisions count."""
    return version_docs.join(chunk_docs, KEY).select("kb_id", "version_id", "chunk_id").distinct()


def strict_chunks(bodies: DataFrame, split) -> DataFrame:
    """kb_id, version_id, chunk_id of the visible bodies alone; split cuts (kb_id, doc_id, version_id, content)."""
    return split(bodies).select("kb_id", "version_id", "chunk_id").distinct()


def delta(chunks: DataFrame, base: DataFrame) -> DataFrame:
    """chunk_id in chunks but not in base."""
    return chunks.select("chunk_id").distinct().join(base.select("chunk_id").distinct(), "chunk_id", "left_anti")


def pending_embed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a stored vector, each once."""
    return chunks.dropDuplicates(["kb_id", "chunk_id"]).join(vectors.select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_anti")


def orphans(chunk_docs: DataFrame, doc_versions: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks none of whose documents can be read, with content, at any live version; a chunk that no document maps to isn't among them."""
    live = versions.where("not deleting")
    readable = as_of_each(doc_versions, live).where(F.octet_length("content") > 0).select(*KEY).distinct()
    alive = chunk_docs.join(readable, KEY, "left_semi").select("kb_id", "chunk_id").distinct()
    return chunk_docs.select("kb_id", "chunk_id").distinct().join(alive, ["kb_id", "chunk_id"], "left_anti")


def without_chunks(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_anti")


def kept_rows(doc_versions: DataFrame, version_id: int, anchor: int) -> DataFrame:
    """doc_versions of one base after version_id is deleted: its rows stay where the anchor (the least live version above it) reads them; anchor 0 keeps none."""
    if not anchor:
        return doc_versions.where(F.col("version_id") != version_id)
    seen = records_as_of(doc_versions, anchor).where(F.col("version_id") == version_id).select(*KEY)
    own = doc_versions.where(F.col("version_id") == version_id).join(seen, KEY, "left_semi")
    return doc_versions.where(F.col("version_id") != version_id).unionByName(own.select(*doc_versions.columns))


def contiguous_cursor(known: DataFrame) -> DataFrame:
    """kb_id, cursor: the last of the known versions (kb_id, version_id, held) before the first that isn't held; 0 if that is the first."""
    gap = known.where("not held").groupBy("kb_id").agg(F.min("version_id").alias("gap"))
    rows = known.join(gap, "kb_id", "left").where("held and (gap is null or version_id < gap)")
    top = rows.groupBy("kb_id").agg(F.max("version_id").alias("cursor"))
    return known.select("kb_id").distinct().join(top, "kb_id", "left").select("kb_id", F.coalesce("cursor", F.lit(0)).cast("long").alias("cursor"))


def marked_handled(known: DataFrame, kb_id: str, low: int, high: int) -> DataFrame:
    """known with every id of low..high of a base held."""
    return known.withColumn("held", F.col("held") | ((F.col("kb_id") == kb_id) & F.col("version_id").between(low, high)))


def newest(log: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """The newest entries of a log."""
    return log.orderBy(F.desc(order)).limit(limit)


def deletions_since(log: DataFrame, after: int, limit: int) -> tuple[DataFrame, dict]:
    """A page of the deletion log, and latest, oldest and epoch, by which a reader sees that entries are gone."""
    ends = log.agg(F.max("seq").alias("latest"), F.min("seq").alias("oldest"), F.max("epoch").alias("epoch")).collect()[0]
    return log.where(F.col("seq") > after).orderBy("seq").limit(limit), {"latest": ends["latest"] or 0, "oldest": ends["oldest"] or 0, "epoch": ends["epoch"]}


def previous_version(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("kb_id").orderBy("version_id")
    return versions.select("kb_id", "version_id", F.lag("version_id").over(w).alias("previous"))


def recovery(log: DataFrame) -> DataFrame:
    """Unfinished work in an operation log (lsn, kb_id, version_id, kind): a begun version without commit, marks without their completion."""
    unfinished = []
    for began, ended, keys in (("VERSION_ID", "COMMIT", ["kb_id", "version_id"]), ("VERSION_DELETE_MARK", "VERSION_DELETE_COMPLETE", ["kb_id", "version_id"]), ("DELETE_MARK", "DELETE_COMPLETE", ["kb_id"])):
        ends = log.where(F.col("kind") == ended).select(*keys).distinct()
        unfinished.append(log.where(F.col("kind") == began).join(ends, keys, "left_anti").select("lsn", "kb_id", "version_id", "kind"))
    return unfinished[0].unionByName(unfinished[1]).unionByName(unfinished[2])


def compacted(log: DataFrame, keep_through: DataFrame) -> DataFrame:
    """The log without BEGIN entries that are committed and at or below their base's watermark (kb_id, through)."""
    done = log.where("kind = 'COMMIT'").select("kb_id", "version_id").distinct().join(F.broadcast(keep_through), "kb_id").where("version_id <= through").select("kb_id", "version_id", F.lit("BEGIN").alias("kind"))
    return log.join(done, ["kb_id", "version_id", "kind"], "left_anti").select(*log.columns)


def liveness(versions: DataFrame, allocated: int, low: int = 0, high: int | None = None) -> DataFrame:
    """version_id, alive for the ids low < id <= high that were ever given out."""
    spark = versions.sparkSession
    ids = spark.range(low + 1, min(high or allocated, allocated) + 1).select(F.col("id").alias("version_id"))
    return ids.join(versions.select("version_id", F.lit(True).alias("alive")), "version_id", "left").select("version_id", F.coalesce("alive", F.lit(False)).alias("alive"))


def quorum_durable(cursors: DataFrame) -> DataFrame:
    """kb_id, version_id: the q-th largest of the replicas' cursors (kb_id, node, cursor), q a majority."""
    best = cursors.groupBy("kb_id").agg(F.reverse(F.array_sort(F.collect_list("cursor"))).alias("c"))
    return best.select("kb_id", F.element_at("c", (F.floor(F.size("c") / 2) + 1).cast("int")).alias("version_id"))


def export_state(kb_id: str, version_id: int, version_docs: DataFrame, doc_versions: DataFrame, chunk_docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The five kinds of entries of a version: entry_type, doc_id, chunk_id, from_version, is_tombstone, content, vector."""
    of = lambda t: t.where(F.col("kb_id") == kb_id)
    docs = of(version_docs).where(F.col("version_id") == version_id).select("doc_id")
    maps = of(chunk_docs).join(docs, "doc_id", "left_semi")
    empty = {"doc_id": "string", "chunk_id": "string", "from_version": "long", "is_tombstone": "boolean", "content": "string", "vector": "array<float>"}

    def entry(kind: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(kind).alias("entry_type"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    bodies = records_as_of(of(doc_versions), version_id).join(docs, "doc_id", "left_semi").withColumnRenamed("version_id", "from_version")
    parts = [entry("DOC_LIST", docs), entry("DOC_BODY", bodies), entry("REVERSE_MAP", maps.select("doc_id", "chunk_id")), entry("FORWARD_MAP", maps.select("chunk_id", "doc_id")), entry("VECTOR", of(vectors).join(maps.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "vector"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
