"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Rows of a source are permuted by a keyed hash whose leading bits are the block. A source's target is made of whole passes over its
blocks and a partial pass, which takes blocks in permuted order up to the one that the target ends in; of this one,
rows are taken up to the place that comes nearest. Each (pass, block) that is taken is one draw, and the number of a source's draws is its quota.
The tree splits all quotas exactly among the output shards. Each shard draws a stretch of a permutation of a source's draws,
disjoint from the others', as long as the tree says: what no shard draws isn't in the mix. Shards shuffle their rows locally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words in a block, about; most blocks of a source, and parts of the block where a pass ends, in powers of two.
BLOCK_WORDS, MOST_BITS, PART_BITS = 1 << 16, 16, 10
#: Words in an output shard, about; least shards; most numbers of the tree's leaves, shards times sources, which the driver holds.
SHARD_WORDS, LEAST_SHARDS, LEAVES = 1 << 22, 16, 1 << 23
#: Bound of the sources, whose sizes the driver holds (not rows or documents).
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source, in order: share of all words by weight, none over most times its size, the excess dealt again by weight."""
    size = np.array(sizes, float)
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    out, left, free = np.zeros(len(sizes)), share * size.sum(), np.ones(len(sizes), bool)
    while free.any():
        out[free] = left * weight[free] / weight[free].sum()
        over = free & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        free &= ~over
        left = share * size.sum() - out[~free].sum()
    return out.tolist()


def _order(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def splitting_tree(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """shards x sources: how many of each source's draws a shard takes; columns add up to the quotas, rows differ by one at most.

    A node's draws are dealt to its two halves by the multivariate hypergeometric distribution, source by source from its marginals; a
    level of the tree is dealt at once.
    """
    counts, low, high = np.array([quotas], np.int64), np.array([0]), np.array([shards])
    rng = np.random.default_rng(seed)
    while (high - low).max() > 1:
        middle = np.where(high - low > 1, (low + high) // 2, high)
        rest = counts.sum(1)
        need = rest * (middle - low) // (high - low)
        taken = np.zeros_like(counts)
        for i in range(counts.shape[1]):
            c = counts[:, i]
            rest = rest - c
            taken[:, i] = rng.hypergeometric(c, rest, need)
            need = need - taken[:, i]
        low, high = np.stack((low, middle), 1).ravel(), np.stack((middle, high), 1).ravel()
        counts = np.stack((taken, counts - taken), 1).reshape(-1, counts.shape[1])
        counts, low, high = (x[high > low] for x in (counts, low, high))
    return counts


class Mix:
    """What a mix takes of docs. The tables are stored; they hold numbers of rows, blocks and sources, no texts.

    rows: doc_id, s (source), key, size and h (place in the permuted order), one for each row of docs.
    known: s with i, source_size, target, bits, and the end of its partial pass (end: h and key of the last row taken of the edge block).
    drawn: i, block and draws (pass, shard, edge: whether only rows up to the end are taken), each shard's by the tree.

    key stands for (doc_id, source, text), see common.content_key; equal rows have one key and are taken alike.
    A null text has no words; a null source is one and comes last. Rows without words are never taken, nor is
    anything of an empty table. Ties in the permuted order are broken by the key.
    """

    def __init__(self, docs: DataFrame, shards: int | None = None, seed: int = 0, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2):
        if most != int(most) or most < 1:
            raise ValueError("most must be a whole number")
        self.seed, self.text, self.source, spark = seed, text, source, docs.sparkSession
        key = self.key(docs)
        self.rows = common.stored(docs.select("doc_id", F.col(source).alias("s"), key.alias("key"), F.size(common.words(F.col(text))).cast("long").alias("size"), self.place(key).alias("h")), "mix-rows")
        found = self.rows.groupBy("s").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found = sorted(((r["s"], r["n"] or 0) for r in found), key=lambda x: (x[0] is None, (x[0] or "").encode()))
        goal = targets([n for _, n in found], weights, share, most)
        listed = []
        for i, ((s, n), t) in enumerate(zip(found, goal, strict=True)):
            whole = min(int(t // n), int(most)) if n else 0
            bits = min(MOST_BITS, max(4, (n // BLOCK_WORDS).bit_length()))
            listed.append((s, i, n, t, bits, whole, max(0.0, t - whole * n) if whole < most else 0.0))
        known = spark.createDataFrame(listed, "s string, i int, source_size long, target double, bits int, whole int, rest double")
        units, ends = self._units(known, most)
        self.known = common.stored(known.join(ends, "i", "left").drop("whole", "rest"), "mix-known")
        quota = {r["i"]: r["n"] for r in units.groupBy("i").agg(F.count("*").alias("n")).collect()}
        self.shards = shards or min(max(LEAST_SHARDS, int(sum(goal) // SHARD_WORDS)), max(1, LEAVES // max(1, len(found))))
        self.tree = splitting_tree([quota.get(i, 0) for i in range(len(found))], self.shards, seed) if found else np.zeros((self.shards, 0), np.int64)
        self.drawn = common.stored(self._draw(spark, units), "mix-drawn")

    def key(self, docs: DataFrame) -> Column:
        return common.content_key(F.col("doc_id"), F.col(self.source), F.col(self.text))

    def place(self, key: Column) -> Column:
        return _order(self.seed, key["a"], key["b"]).bitwiseAND(F.lit((1 << 40) - 1))

    def _units(self, known: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Stored: i, pass, block, edge of all draws, and for each source whose last pass ends within a block the end."""
        part = F.expr(f"shiftright(h, {40 - PART_BITS} - bits) & {(1 << PART_BITS) - 1}")
        rows = self.rows.where("size > 0").withColumnRenamed("s", "rs")
        rows = rows.join(common.sized(known), F.col("rs").eqNullSafe(F.col("s"))).select("i", "key", "size", "h", F.expr("shiftright(h, 40 - bits)").cast("int").alias("block"), part.cast("int").alias("part"))
        parts = common.stored(rows.groupBy("i", "block", "part").agg(F.sum("size").alias("w")), "mix-parts")
        blocks = parts.groupBy("i", "block").agg(F.sum("w").alias("w")).join(common.sized(known), "i").select("i", "block", "w", "whole", "rest")
        passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.least(F.col("whole"), F.lit(int(most) - 1)))))
        w = Window.partitionBy("i", "pass").orderBy(_order(self.seed + 2, F.col("i"), F.col("pass"), F.col("block")), "block")
        passes = passes.withColumn("done", F.sum("w").over(w) - F.col("w"))
        partial = F.col("pass") == F.col("whole")
        passes = passes.where(~partial | (F.col("done") < F.col("rest")))
        units = common.stored(passes.select("i", "pass", "block", (partial & (F.col("done") + F.col("w") > F.col("rest"))).alias("edge"), (F.col("rest") - F.col("done")).alias("left")), "mix-units")
        edge = units.where("edge").select("i", "block", "left")
        w = Window.partitionBy("i").orderBy("part")
        edge = parts.join(common.sized(edge), ["i", "block"]).withColumn("done", F.sum("w").over(w) - F.col("w"))
        edge = edge.where((F.col("done") <= F.col("left")) & (F.col("done") + F.col("w") > F.col("left"))).select("i", "block", "part", "done", "left")
        w = Window.partitionBy("i").orderBy("h", "key")
        last = rows.join(common.sized(edge), ["i", "block", "part"]).groupBy("i", "h", "key", "done", "left").agg(F.sum("size").alias("w"))
        last = last.withColumn("half", F.col("done") + F.sum("w").over(w) - F.col("w") / 2)
        # rows of earlier parts are before the first of this one, also where none of it is taken
        first = F.min(F.struct("h", "key"))
        ends = last.groupBy("i").agg(F.max(F.when(F.col("half") <= F.col("left"), F.struct("h", "key"))).alias("taken"), first.alias("first"))
        before = F.struct((F.col("first.h") - 1).alias("h"), F.col("first.key").alias("key"))
        return units, common.stored(ends.select("i", F.coalesce("taken", before).alias("end")), "mix-ends")

    def _draw(self, spark: SparkSession, units: DataFrame) -> DataFrame:
        """Each shard's stretch of the permuted draws of each source, by block."""
        ends = np.cumsum(self.tree, axis=0)
        shard, i = np.nonzero(self.tree)
        start, n = (ends - self.tree)[shard, i], self.tree[shard, i]
        stretches = spark.createDataFrame(list(zip(i.tolist(), shard.tolist(), start.tolist(), n.tolist(), strict=True)), "i int, shard int, start long, n long")
        ranks = stretches.select("i", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("rank"))
        w = Window.partitionBy("i").orderBy(_order(self.seed + 1, F.col("i"), F.col("pass"), F.col("block")), "pass", "block")
        order = units.withColumn("rank", F.row_number().over(w).cast("long") - 1)
        return order.join(ranks, ["i", "rank"]).groupBy("i", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "edge"))).alias("draws"))

    def draws(self, frame: DataFrame, s: Column, key: Column, h: Column, name: str) -> DataFrame:
        """frame, whose rows have the source s, the key and the place h, with known's columns in a struct (name) and the shards that take the row, one for each copy (name + "_to")."""
        known = self.known.select(F.col("s").alias(name + "_s"), F.struct("i", "source_size", "target", "bits", "end").alias(name))
        out = frame.join(common.sized(known), s.eqNullSafe(F.col(name + "_s"))).drop(name + "_s")
        drawn = self.drawn.select(F.struct("i", "block").alias(name + "_at"), F.col("draws").alias(name + "_draws"))
        at = F.struct(F.col(name)["i"].alias("i"), (h / F.pow(F.lit(2.0), 40 - F.col(name)["bits"])).cast("int").alias("block"))
        out = out.join(common.sized(drawn), at == F.col(name + "_at"), "left").drop(name + "_at")
        inside = F.struct(h.alias("h"), key.alias("key")) <= F.col(name)["end"]
        to = F.transform(F.filter(name + "_draws", lambda x: ~x["edge"] | F.coalesce(inside, F.lit(True))), lambda x: x["shard"])
        return out.withColumn(name + "_to", F.coalesce(to, F.array().cast("array<int>"))).drop(name + "_draws")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the shards take of the row, repeats counted) and shards (those that take it, in the order of
    passes, joined by commas) of every row of docs. See Mix for nulls, ties and repeated rows; other columns of docs are left out."""
    made = Mix(docs, **options)
    out = made.draws(made.rows, F.col("s"), F.col("key"), F.col("h"), "mix")
    to = F.when(F.col("size") > 0, F.col("mix_to")).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("size") * F.size(to)).alias("taken"), F.array_join(to.cast("array<string>"), ",").alias("shards"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them, with their columns: a row stands once for each of its copies,
    each shard is one partition and its rows are shuffled among themselves. See Mix for nulls, ties and repeated rows; columns may have any names."""
    made = Mix(docs, **options)
    name = common.free_name(docs, "mix")
    key = name + "_key"
    marked = docs.withColumn(key, made.key(docs)).where(F.size(common.words(F.col(made.text))) > 0)
    out = made.draws(marked, F.col(made.source), F.col(key), made.place(F.col(key)), name)
    copies = F.transform(name + "_to", lambda s, n: F.struct(s.alias("shard"), n.alias("copy")))
    out = out.withColumn(name + "_x", F.explode(copies))
    at = _order(made.seed + 3, F.col(name + "_x")["copy"], F.col(key)["a"], F.col(key)["b"])
    out = out.withColumn(name + "_shard", F.col(name + "_x")["shard"]).withColumn(name + "_place", at)
    return out.repartitionById(made.shards, name + "_shard").sortWithinPartitions(name + "_place").select(*docs.columns)
