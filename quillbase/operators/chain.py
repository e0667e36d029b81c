"""The version chain: walks, delete targets, retention and collection policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbase.functions import scalars



def _parents(versions: DataFrame) -> dict[int, int]:
    """version_id -> parent_version_id. Versions are metadata, which the driver holds; chains of any depth are walked there."""
    return {r[0]: r[1] for r in versions.select("version_id", "parent_version_id").collect()}


def _below(parents: dict[int, int], root: int) -> set[int]:
    children: dict[int, list[int]] = {}
    for i, p in parents.items():
        children.setdefault(p, []).append(i)
    found, todo = set(), [root] if root in parents else []
    while todo:
        if (i := todo.pop()) not in found:
            found.add(i)
            todo += children.get(i, [])
    return found


def _above(parents: dict[int, int], of: int) -> list[int]:
    """Parents have smaller ids, so a damaged chain can't go round."""
    found = []
    while of in parents and parents[of] in parents and parents[of] < of:
        of = parents[of]
        found.append(of)
    return found


def _ids(spark: SparkSession, ids) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in sorted(ids)], "version_id long")


def descendants(spark: SparkSession, versions: DataFrame, root: int) -> DataFrame:
    """version_id of root and all below it."""
    return _ids(spark, _below(_parents(versions), root))


def ancestors(spark: SparkSession, versions: DataFrame, of: int) -> DataFrame:
    """version_id of all above a version."""
    return _ids(spark, _above(_parents(versions), of))


def delete_targets(spark: SparkSession, versions: DataFrame, of: int, mode: str) -> DataFrame:
    """SINGLE: the version. SUBTREE: it and what descends from it. ANCESTORS: what descends from its oldest ancestor, less its own subtree."""
    if mode == "SINGLE":
        return versions.select("version_id").where(F.col("version_id") == of)
    parents = _parents(versions)
    own = _below(parents, of)
    if mode == "SUBTREE":
        return _ids(spark, own)
    if mode != "ANCESTORS":
        raise ValueError(f"no delete mode is called {mode}")
    above = _above(parents, of)
    return _ids(spark, _below(parents, min(above)) - own if above else ())


def blocked(versions: DataFrame) -> DataFrame:
    """versions with pending: a deletion has to wait for it."""
    return versions.withColumn("pending", (F.col("index_status") == "PENDING") & ~F.col("data_status").isin("FAILED_PERMANENT"))


def spliced(versions: DataFrame, gone: DataFrame) -> DataFrame:
    """Survivors of a deletion whose parent goes hang from its nearest surviving ancestor, 0 if there is none. One join, however many versions go."""
    parents, lost = _parents(versions), {r[0] for r in gone.select("version_id").collect()}
    moved = []
    for i in parents.keys() - lost:
        up = parents[i]
        while up in lost and up in parents:
            up = parents[up]
        up = up if up in parents and up not in lost else 0
        if up != parents[i]:
            moved.append((i, up))
    to = versions.sparkSession.createDataFrame(moved, "version_id long, to long")
    left = versions.join(gone.select("version_id"), "version_id", "left_anti").join(to, "version_id", "left")
    return left.withColumn("parent_version_id", F.coalesce("to", "parent_version_id")).drop("to").select(versions.columns)


def anchor(versions: DataFrame, version_id: int) -> int:
    """The least live version above one, 0 if there is none."""
    return versions.where((F.col("version_id") > version_id) & ~F.col("deleting")).agg(F.min("version_id")).collect()[0][0] or 0


def owners(kbs_versions: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(kb_id, version_id, member, place): each version's members by rendezvous hash; all of them where k isn't in 1..their number."""
    both = kbs_versions.crossJoin(F.broadcast(members))  # members are the nodes of a cluster
    w = Window.partitionBy("kb_id", "version_id").orderBy(F.desc("h"), F.asc("member"))
    n = F.count("*").over(Window.partitionBy("kb_id", "version_id"))
    rows = both.withColumn("h", scalars.owner_rank(F.col("kb_id"), F.col("version_id"), F.col("member"))).withColumn("place", F.row_number().over(w)).withColumn("n", n)
    return rows.where((F.lit(k) <= 0) | (F.lit(k) > F.col("n")) | (F.col("place") <= k)).select("kb_id", "version_id", "member", "place")


def recently_used(access: DataFrame, candidates: DataFrame, now: Column, window_seconds: int, most: int) -> DataFrame:
    """version_id of candidates used within the window, the latest `most`."""
    last = access.join(candidates.select("version_id"), "version_id", "left_semi").groupBy("version_id").agg(F.max("at").alias("at"))
    age = F.unix_timestamp(now) - F.unix_timestamp("at")
    return last.where(age <= window_seconds).orderBy(F.desc("at"), F.desc("version_id")).limit(most).select("version_id")


def retention_drops(artifacts: DataFrame, protected: DataFrame, recent: DataFrame, keep: int = 50) -> DataFrame:
    """version_id of artifacts beyond the newest `keep` of those that are neither protected nor recently used, in each base."""
    free = artifacts.join(protected.select("version_id"), "version_id", "left_anti").join(recent.select("version_id"), "version_id", "left_anti")
    w = Window.partitionBy("kb_id").orderBy(F.desc("version_id"))
    return free.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep).select("kb_id", "version_id")


def retention_cutoff(artifacts: DataFrame, keep: int) -> int:
    """Id of the keep-th newest artifact, 0 if there are fewer."""
    ids = [r[0] for r in artifacts.select("version_id").orderBy(F.desc("version_id")).limit(keep).collect()]
    return ids[-1] if keep > 0 and len(ids) == keep else 0


def reconcile(versions: DataFrame, artifacts: DataFrame, cutoff: int) -> DataFrame:
    """version_id and action at start: PROMOTE what has an artifact, IGNORE what retention dropped, SCHEDULE the rest of the durable."""
    has = artifacts.select("version_id", F.lit(True).alias("has"))
    action = F.when(F.col("has"), "PROMOTE").when(F.col("version_id") < cutoff, "IGNORE").otherwise("SCHEDULE")
    return versions.where("not deleting and data_status = 'DURABLE'").join(has, "version_id", "left").select("kb_id", "version_id", action.alias("action"))


def gc_candidates(kbs: DataFrame, versions: DataFrame, shares: DataFrame, least: float = 0.3) -> DataFrame:
    """Active and last versions (each once) whose dead share (kb_id, version_id, dead_share) is above least."""
    live = versions.where("not deleting and data_status <> 'FAILED_PERMANENT'")
    tails = live.groupBy("kb_id").agg(F.max("version_id").alias("version_id"))
    active = kbs.where("active_version_id > 0").select("kb_id", F.col("active_version_id").alias("version_id"))
    return tails.union(active).distinct().join(shares, ["kb_id", "version_id"]).where(F.col("dead_share") > least)


def gc_action(graph_free: Column, share: Column, serving: Column) -> Column:
    """EDIT a graph-free artifact in place, REBUILD a graphed one with a share of half, WAIT while no other replica serves."""
    return F.when(serving < 1, "WAIT").when(graph_free, "EDIT").when(share >= 0.5, "REBUILD").otherwise("SKIP")


def evictions(resident: DataFrame, most: int, budget: int) -> DataFrame:
    """Unpinned residents (version_id, bytes, last_access, pinned), least recently used first, until fewer than `most` and `budget` bytes at most are left."""
    w = Window.orderBy(F.asc("pinned"), F.asc("last_access"), F.asc("version_id"))  # residents of one node, at most `most`
    total = Window.partitionBy()
    rows = resident.withColumn("before", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(w) - 1)
    rows = rows.withColumn("n", F.count("*").over(total)).withColumn("all_bytes", F.sum("bytes").over(total))
    over = (F.col("n") - F.col("place") >= most) | (F.col("all_bytes") - F.col("before") > budget)
    return rows.where(~F.col("pinned") & over).select("version_id", "bytes")


def unfinished(table: DataFrame, status: str | None = None) -> DataFrame:
    """Versions whose deletion, or bases whose DELETING, has to be run again."""
    return table.where("deleting") if status is None else table.where(F.col("status") == status)


def leftovers(local: DataFrame, live: DataFrame) -> DataFrame:
    """Local (kb_id, version_id) that are no longer live."""
    return local.select("kb_id", "version_id").distinct().join(live.select("kb_id", "version_id"), ["kb_id", "version_id"], "left_anti")


def status_lists(versions: DataFrame, version_docs: DataFrame, now: int, age: int = 300) -> DataFrame:
    """list, kb_id, version_id: deleting, failed_permanent, stuck (pending for age seconds) and data_missing (stuck, and no document list anywhere)."""
    stuck = versions.where((F.col("data_status") == "PENDING") & ~F.col("deleting") & (F.lit(now) - F.col("created_at") >= age))
    parts = {"deleting": versions.where("deleting"), "failed_permanent": failed(versions), "stuck": stuck, "data_missing": stuck.join(version_docs.select("kb_id", "version_id").distinct(), ["kb_id", "version_id"], "left_anti")}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("list"), "kb_id", "version_id")
        out = df if out is None else out.unionByName(df)
    return out


def failed(versions: DataFrame) -> DataFrame:
    return versions.where("not deleting and (data_status = 'FAILED_PERMANENT' or index_status = 'FAILED_PERMANENT')")


def degradation(placement: DataFrame, beats: DataFrame, now: Column, window_seconds: int = 15) -> DataFrame:
    """kb_id, required, live, quorum, state: UNKNOWN without heartbeats, UNAVAILABLE with none live, DEGRADED below quorum."""
    last = beats.groupBy("node").agg(F.max("at").alias("at"))
    rows = placement.join(F.broadcast(last), "node", "left").groupBy("kb_id").agg(F.count("*").alias("required"), F.count_if(F.unix_timestamp(now) - F.unix_timestamp("at") <= window_seconds).alias("live"), F.count("at").alias("heard"))
    q = (F.floor(F.col("required") / 2) + 1).cast("long")
    state = F.when(F.col("heard") == 0, "UNKNOWN").when(F.col("live") == 0, "UNAVAILABLE").when(F.col("live") < q, "DEGRADED").otherwise("OK")
    return rows.select("kb_id", "required", "live", q.alias("quorum"), state.alias("state"))


def watermark(cursors: DataFrame) -> DataFrame:
    """kb_id, through: what all replicas hold."""
    return cursors.groupBy("kb_id").agg(F.min("cursor").alias("through"))


def percentiles(values: DataFrame, column: str, q: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: values at place floor(q * (n - 1)) in order, not interpolated, and the mean."""
    ordered = values.agg(F.array_sort(F.collect_list(column)).alias("v"), F.avg(column).alias("mean"))
    return ordered.select(*[F.get("v", F.floor(F.lit(x) * (F.size("v") - 1)).cast("int")).alias(f"p{round(x * 100)}") for x in q], "mean")


def manifest(kb_id: str, active: int, versions: DataFrame) -> DataFrame:
    """One row: a base's ordered versions as JSON and its SHA-256."""
    rows = versions.where(F.col("kb_id") == kb_id).agg(F.array_sort(F.collect_list(F.struct("version_id", "parent_version_id", "data_status"))).alias("versions"))
    body = F.to_json(F.struct(F.lit(kb_id).alias("kb_id"), F.lit(active).alias("active"), "versions"))
    return rows.select(body.alias("manifest"), F.sha2(body, 256).alias("digest"))
