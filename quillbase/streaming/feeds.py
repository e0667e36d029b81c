"""Structured Streaming: change feed, deletion log, and state per key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillbase.operators import chain, documents
from quillbase.sources import schemas

#: Scores at which a tier begins, how far a score may fall before it ends, seconds in which it decays to 1/e.
TIERS, HYSTERESIS, DECAY = (0.0, 4.0, 16.0), 0.7, 600.0
#: Seconds of the breaker's window and cool-down, samples it needs, failures that trip it, probes that close it.
WINDOW, COOLDOWN, LEAST, RATIO, PROBES = 10.0, 5.0, 5, 0.5, 2
PAGE = 512


def change_feed(spark: SparkSession, path: str) -> DataFrame:
    """The change log as a stream of files."""
    return spark.readStream.schema(schemas.DOC_CHANGES).parquet(path)


def replay(changes: DataFrame, held: DataFrame, after: int, upto: int, deleted: DataFrame, versions: DataFrame) -> DataFrame | None:
    """The changes of after < version <= upto; None (take the whole state instead) if one of the versions was deleted or has no changes."""
    span = (F.col("version_id") > after) & (F.col("version_id") <= upto)
    wanted = versions.where(span).select("version_id").distinct()
    found = changes.where(span)
    if deleted.where(span).limit(1).count() or wanted.join(found, "version_id", "left_anti").limit(1).count():
        return None
    return found.join(held.select("version_id").distinct(), "version_id", "left_anti").orderBy("version_id", "pos")


def apply_feed(feed: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands each micro-batch's changes to apply, versions in order; a batch that ran before is run again, so apply must be idempotent."""
    return feed.writeStream.foreachBatch(lambda df, _: apply(df.orderBy("version_id", "pos"))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_deletions(log: DataFrame, mark: dict | None, local: DataFrame, live: DataFrame) -> tuple[DataFrame, dict]:
    """(kb_id, version_id) of local data to drop, and the next mark {epoch, seq}.

    Without a mark, with another epoch or with entries gone from the log, local versions are held against the live chain; a log that is behind the mark
    says nothing. Else the log's entries decide; version 0 stands for a whole base.
    """
    _, ends = documents.deletions_since(log, 0, 1)
    new = {"epoch": ends["epoch"], "seq": ends["latest"]}
    if mark is None or mark["epoch"] != ends["epoch"] or (ends["latest"] > mark["seq"] and (ends["oldest"] == 0 or ends["oldest"] > mark["seq"] + 1)):
        return chain.leftovers(local, live), new
    if ends["latest"] < mark["seq"]:
        return local.select("kb_id", "version_id").limit(0), mark
    keys = ["kb_id", "version_id"]
    gone, mine = log.where(F.col("seq") > mark["seq"]).select(*keys), local.select(*keys)
    bases = F.broadcast(gone.where("version_id = 0").select("kb_id").distinct())
    return mine.join(bases, "kb_id", "left_semi").select(*keys).unionByName(mine.join(gone, keys, "left_semi")).distinct(), new


def tombstones(notes: DataFrame) -> DataFrame:
    """The state of each (kb_id, version_id) from noted entries (state PENDING or DONE): DONE once noted so."""
    return notes.groupBy("kb_id", "version_id").agg(F.when(F.bool_or(F.col("state") == "DONE"), "DONE").otherwise("PENDING").alias("state"))


def tier_for(score: float, tier: int) -> int:
    """Up while the score reaches the next tier's bar, down while it is below HYSTERESIS times its own."""
    tier = min(max(tier, 0), len(TIERS) - 1)
    while tier + 1 < len(TIERS) and score >= TIERS[tier + 1]:
        tier += 1
    while tier and score < TIERS[tier] * HYSTERESIS:
        tier -= 1
    return tier


def tiers(accesses: DataFrame) -> DataFrame:
    """Of a stream or table of accesses (kb_id, version_id, at): after each batch the key's score and tier. An access adds 1 to the decayed score."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, tier, last = state.get if state.exists else (0.0, 0, 0.0)
        for f in frames:
            for at in sorted(t.timestamp() for t in f["at"]):
                score = score * math.exp(-max(at - last, 0.0) / DECAY) + 1 if last else 1.0
                tier, last = tier_for(score, tier), max(at, last)
        state.update((score, tier, last))
        yield pd.DataFrame({"kb_id": [key[0]], "version_id": [key[1]], "score": [score], "tier": [tier]})

    return accesses.groupBy("kb_id", "version_id").applyInPandasWithState(step, "kb_id string, version_id long, score double, tier int", "score double, tier int, last double", "update", GroupStateTimeout.NoTimeout)


def score_at(accesses: DataFrame, end) -> DataFrame:
    """kb_id, version_id, score at a time, in closed form: the order of accesses doesn't matter."""
    age = F.unix_micros(F.lit(end).cast("timestamp")) / 1e6 - F.unix_micros("at") / 1e6
    return accesses.groupBy("kb_id", "version_id").agg(F.sum(F.exp(-age / DECAY)).alias("score"))


def breaker_step(state: tuple, at: float, success: bool) -> tuple:
    """(state, opened, probes, outcomes) after an outcome at a time."""
    kind, opened, probes, outcomes = state
    if kind == "OPEN" and at - opened >= COOLDOWN:
        kind, probes = "HALF_OPEN", 0
    if kind == "OPEN":
        return kind, opened, probes, outcomes
    if kind == "HALF_OPEN":
        if not success:
            return "OPEN", at, 0, []
        probes += 1
        return ("CLOSED", 0.0, 0, []) if probes >= PROBES else (kind, opened, probes, outcomes)
    outcomes = [o for o in [*outcomes, (at, success)] if at - o[0] <= WINDOW]
    failures = sum(not ok for _, ok in outcomes)
    if len(outcomes) >= LEAST and failures / len(outcomes) >= RATIO:
        return "OPEN", at, 0, []
    return kind, opened, probes, outcomes


def breakers(outcomes: DataFrame) -> DataFrame:
    """Of a stream of outcomes (node, at, success): each node's breaker after each batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, opened, probes, times, goods = state.get if state.exists else ("CLOSED", 0.0, 0, [], [])
        now = (kind, opened, probes, list(zip(times, goods, strict=True)))
        for f in frames:
            for t, ok in sorted(zip((x.timestamp() for x in f["at"]), f["success"], strict=True)):
                now = breaker_step(now, t, bool(ok))
        kind, opened, probes, held = now
        state.update((kind, opened, probes, [t for t, _ in held], [ok for _, ok in held]))
        yield pd.DataFrame({"node": [key[0]], "state": [kind]})

    return outcomes.groupBy("node").applyInPandasWithState(step, "node string, state string", "kind string, opened double, probes int, times array<double>, goods array<boolean>", "update", GroupStateTimeout.NoTimeout)


def failure_ratios(outcomes: DataFrame, seconds: int = 10, slide: int = 1) -> DataFrame:
    """node, start, total, failures and ratio of sliding windows of outcomes (node, at, success)."""
    w = F.window("at", f"{seconds} seconds", f"{slide} seconds")
    rows = outcomes.groupBy("node", w).agg(F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failures"))
    return rows.select("node", F.col("window.start").alias("start"), "total", "failures", (F.col("failures") / F.col("total")).alias("ratio"))


def live_nodes(beats: DataFrame, late: str = "30 seconds", silence: str = "15 seconds") -> DataFrame:
    """Of a stream of heartbeats (node, at): windows of the silence interval in which a node was heard."""
    return beats.withWatermark("at", late).groupBy("node", F.window("at", silence)).agg(F.max("at").alias("last"))


#: Allowed changes of a version's data side and index side.
TRANSITIONS = {"data": [("PENDING", "DURABLE"), ("PENDING", "FAILED_PERMANENT")], "index": [("PENDING", "READY"), ("PENDING", "FAILED"), ("FAILED", "PENDING"), ("FAILED", "READY"), ("PENDING", "FAILED_PERMANENT"), ("FAILED", "FAILED_PERMANENT"), ("FAILED_PERMANENT", "PENDING"), ("READY", "PENDING")]}


def refused(moves: DataFrame) -> DataFrame:
    """Moves (side, old, new, ...) that no rule allows."""
    allowed = moves.sparkSession.createDataFrame([(s, a, b) for s, pairs in TRANSITIONS.items() for a, b in pairs], "side string, old string, new string")
    return moves.join(F.broadcast(allowed), ["side", "old", "new"], "left_anti")


def budget_spent(reports: DataFrame, budget: int = 5) -> DataFrame:
    """kb_id, version_id, side and terminal from failure reports (kb_id, version_id, side, class)."""
    return reports.groupBy("kb_id", "version_id", "side").agg(F.count("*").alias("reports"), (F.bool_or(F.col("class") == "FATAL_GLOBAL") | (F.count("*") >= budget)).alias("terminal"))


def lag(versions: DataFrame, cursors: DataFrame, least: int = 1) -> DataFrame:
    """kb_id and behind for bases whose cursor is `least` or more behind the chain's tail."""
    tails = versions.groupBy("kb_id").agg(F.max("version_id").alias("tail"))
    return tails.join(cursors, "kb_id", "left").select("kb_id", (F.col("tail") - F.coalesce("cursor", F.lit(0))).alias("behind")).where(F.col("behind") >= least)
