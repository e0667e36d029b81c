"""Near duplicates by bottom-k sketches of word shingles.

One hash function gives every document the set of its shingles' hashes; the k smallest are its sketch.
Documents with one set are one class, and classes are all that is compared.
1. Inverted lists of retained values: a class enters the lists of the rarest values of its sketch, as many as leave no room
   for the overlap that a link needs (prefix filter). Values that one class alone retains make no list.
2. A list's hub is its class that retains the most common values. Each class is tried with that hub with which it shares the most
   lists, which gathers groups of copies into components by as many pairs as there are classes.
3. Lists that still hold several components generate the pairs across them. Within the join, sizes and the parity bits of
   the sets (a lower bound of their difference) leave out what can't be linked, so that rows don't grow with the square of a group.
Of the pairs the union's sketch rejects what is far off, and exact sets confirm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Values in a sketch. Bound of the chance that a link at the threshold is overlooked by the sketches; 0: none is.
K, LOSS = 64, 1e-10
#: 64-bit words of parity bits.
WORDS = 8
ODD = [f"o{i}" for i in range(WORDS)]


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased; of the whole sequence where words are fewer."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    n = len(words)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(width, n)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total = common.mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i])
    return np.unique(total.view(np.int64))


def parity(values: np.ndarray) -> np.ndarray:
    """WORDS words of bits, each the parity of the values that fall on it: two sets differ in as many values as bits at the least."""
    place = (values.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (64 * WORDS - 1)
    return np.packbits((np.bincount(place, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def least_overlap(t: int, k: int, loss: float = LOSS) -> int:
    """Values that the sketches of a linked pair share, but for a chance of loss. Of the union's k least values
    each is shared with a chance of t in 100 or more, so that the binomial distribution bounds the number."""
    below, p = 0.0, t / 100
    for m in range(k + 1):
        below += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if below > loss:
            return max(1, m)
    return k


def _needed(n: Column, t: int, k: int, loss: float) -> Column:
    """The overlap that a class of n shingles has with any that it is linked to, in sketches."""
    return F.least(F.ceil(n * t / 100).cast("int"), F.lit(least_overlap(t, k, loss)))


def sketched(docs: DataFrame, text: str, width: int, k: int) -> DataFrame:
    """Stored: doc_id, text_key, cid (the set's 128-bit hash, null for no shingles), n, sketch and the parity bits."""
    schema = "doc_id long, ta long, tb long, n long, a long, b long, sketch array<long>, " + ", ".join(f"{o} long" for o in ODD)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name, sketch, odd = [], [], [], []
            for value in batch.column(3):
                s = shingle_set(value.as_buffer().to_pybytes() if value.is_valid else None, width)
                u = s.view(np.uint64)
                n.append(len(s))
                name.append((u.sum(dtype=np.uint64), common.mix64(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                sketch.append(s[:k])
                odd.append(parity(s))
            a, b = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*name, strict=True))
            words = [pa.array(x) for x in np.ascontiguousarray(np.array(odd).T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), a, b, pa.array(sketch, pa.list_(pa.int64())), *words], names=names)

    key = common.content_key(F.col(text))
    rows = common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key["a"].alias("ta"), key["b"].alias("tb"), F.col(text).cast("binary").alias("t")), run, schema)
    return common.stored(rows.select("doc_id", F.struct(F.col("ta").alias("a"), F.col("tb").alias("b")).alias("text_key"), F.when(F.col("n") > 0, F.struct("a", "b")).alias("cid"), "n", "sketch", *ODD), "near-docs")


def _entries(classes: DataFrame, t: int, k: int, loss: float) -> DataFrame:
    """Stored: key, id and weight (how often the sketch's values are retained). A class enters the lists of the
    rarest values of its sketch, one more than it can lack of the overlap that a link needs."""
    values = classes.select("id", F.explode("sketch").alias("v"))
    again = common.stored(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "near-again")
    shared = values.join(common.sized(again), "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("shared"))
    rows = classes.select("id", (F.lit(1) - _needed(F.col("n"), t, k, loss)).alias("room")).join(shared, "id")
    room = F.col("room") + F.size("shared")  # of the sketch's values those of this class alone come first
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    rows = rows.where(room > 0).select("id", weight.alias("weight"), F.explode(F.slice("shared", F.lit(1), room)).alias("x"))
    out = common.stored(rows.select(F.col("x.v").alias("key"), "id", "weight"), "near-lists")
    common.drop(again)
    return out


def _hubs(lists: DataFrame) -> DataFrame:
    """Stored: distinct pairs (x, y): each class with that hub of its lists with which it shares the most."""
    hub = lists.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", F.col("hub.id").alias("hub"))
    met = lists.select("key", "id").join(hub, "key").where("id != hub").groupBy("id", "hub").agg(F.count("*").alias("c"))
    return common.stored(_pairs(F.col("id"), F.col("best.hub"), met.groupBy("id").agg(F.max(F.struct("c", "hub")).alias("best"))), "near-tried")


def _pairs(x: Column, y: Column, frame: DataFrame) -> DataFrame:
    return frame.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).distinct()


def _may_link(t: int) -> Column:
    """Whether the sizes and parity bits of two sets, in columns with the prefixes x and y, allow a link; false for no linked pair."""
    nx, ny = F.col("xn"), F.col("yn")
    differ = sum((F.bit_count(F.col("x" + o).bitwiseXOR(F.col("y" + o))) for o in ODD), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * t) & (differ * (100 + t) <= (nx + ny) * (100 - t))


def _across(lists: DataFrame, comp: DataFrame, known: DataFrame, t: int) -> DataFrame:
    """Distinct pairs (x, y) of classes of different components in one list, as far as sizes and parity bits allow a link.

    One side is never of the list's largest component. Sizes are dealt to steps of which a link spans two at the most, so that a list isn't one key.
    """
    now = common.stored(lists.select("key", "id").join(comp.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "near-now")
    each = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    major = each.groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"), F.count("*").alias("comps")).where("comps > 1").select("key", "major")
    held = common.stored(now.join(major, "key"), "near-held")
    step = F.floor(F.log("n") / math.log(100 / t)).cast("int")
    of = held.groupBy("id").agg(F.collect_list("key").alias("keys")).join(known.select("id", "n", *ODD), "id").withColumn("step", step)
    rows = common.stored(held.join(of, "id"), "near-open")
    side = lambda prefix, of: of.select("key", *[F.col(c).alias(prefix + c) for c in ("id", "n", *ODD, "comp", "step", "keys")])
    minor = side("x", rows.where("comp != major")).withColumn("step", F.explode(F.sequence(F.col("xstep") - 1, F.col("xstep") + 1)))
    other = side("y", rows)
    first = minor["key"] == F.array_min(F.array_intersect("xkeys", "ykeys"))  # a pair comes from one of its lists
    met = minor.join(other, (minor["key"] == other["key"]) & (F.col("step") == F.col("ystep")) & (F.col("xcomp") != F.col("ycomp")) & _may_link(t) & first)
    out = common.stored(_pairs(F.col("xid"), F.col("yid"), met), "near-across")
    common.drop(now, held, rows)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """node and comp, the least node of its component, for the nodes of edges (x, y); stored. Labels go to neighbours and through labels until none changes."""
    both = common.stored(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "near-edges")
    labels = common.stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp"), F.lit(True).alias("new")), "near-labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("comp").alias("m"))
        new = labels.join(near, labels["node"] == near["x"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = new.join(jump, new["comp"] == jump["via"], "left").select("node", F.least("comp", "far").alias("comp"), (F.least("comp", "far") != F.col("old")).alias("new"))
        before, labels = labels, common.stored(new, "near-labels")
        common.drop(before)
        if labels.where("new").limit(1).count() == 0:
            common.drop(both)
            return labels


def _texts(docs: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """Stored: text_key and text (t) of the keys."""
    found = docs.select(common.content_key(F.col(text)).alias("text_key"), F.col(text).alias("t")).join(common.sized(keys), "text_key", "left_semi")
    return common.stored(found.dropDuplicates(["text_key"]), "near-texts")


def _confirmed(pairs: DataFrame, known: DataFrame, texts: DataFrame, width: int, t: int, k: int, loss: float) -> DataFrame:
    """Of distinct pairs (x, y) of classes those that are linked; stored. The union's sketch rejects, whole sets confirm."""
    side = lambda c: known.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("text_key").alias(f"k{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    union = F.slice(F.sort_array(F.array_union("sx", "sy")), 1, k)
    shared = common.let(F.array_intersect("sx", "sy"), lambda s: F.when(F.size(s) == 0, 0).otherwise(F.size(F.array_intersect(s, union))))
    # a sketch that is the whole set makes the union's a whole one too
    likely = both.where(shared >= _needed(F.greatest("nx", "ny"), t, k, loss)).select("x", "y", "kx", "ky")
    for c in "xy":
        likely = likely.join(texts.select(F.col("text_key").alias(f"k{c}"), F.col("t").alias(f"t{c}")), f"k{c}").drop(f"k{c}")
    flat = likely.select("x", "y", F.col("tx").cast("binary").alias("tx"), F.col("ty").cast("binary").alias("ty"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            found = []
            for tx, ty in zip(batch.column(2), batch.column(3), strict=True):
                if (now := ty.as_py()) != last:
                    last, last_set = now, shingle_set(now, width)
                other = shingle_set(tx.as_py(), width)
                inter = len(np.intersect1d(other, last_set, assume_unique=True))
                found.append(100 * inter >= t * (len(other) + len(last_set) - inter))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(found, pa.bool_())) for c in batch.columns[:2]], names=["x", "y"])

    return common.stored(common.in_arrow(flat, run, "x long, y long"), "near-links")


def components(docs: DataFrame, text: str = "text", width: int = 5, t: int = 80, k: int = K, loss: float = LOSS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept (doc_id = component_id) for each row of docs.

    A link joins texts whose shingle sets have 100 * intersection >= t * union; all links that are found are exact, and one is overlooked with a chance
    of loss at the most (with loss 0 lists hold whole sketches: a link is lost only where they share no value, (1 - t / 100) ** k).
    Sets of up to k shingles are compared as a whole.
    A null or wordless text has no shingles and is linked with nothing; its component is itself. Equal texts are linked. A row with a null doc_id
    takes part; its component is the least id that isn't null, itself if there is none. Of repeated rows with the least doc_id each is kept.
    Other columns of docs are left out; an empty table gives an empty one.
    """
    rows = _grouped(docs, text, width, t, k, loss)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, text: str, width: int, t: int, k: int, loss: float) -> DataFrame:
    """components() without kept, with text_key and comp, the number of the row's group, which is null where the text has no shingles."""
    sketches = sketched(docs, text, width, k)
    of = sketches.where("cid is not null").groupBy("cid").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sketch", *ODD)])
    classes = common.stored(of.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    rows = common.stored(sketches.select("doc_id", "text_key", "n", "cid"), "near-rows")
    common.drop(sketches)
    lists = _entries(classes, t, k, loss)
    listed = common.stored(lists.select("id").distinct(), "near-listed")
    known = common.stored(classes.select("id", "text_key", "n", "sketch", *ODD).join(common.sized(listed), "id", "left_semi"), "near-known")
    texts = _texts(docs, text, known.select("text_key"))
    tried = _hubs(lists)
    links = _confirmed(tried, known, texts, width, t, k, loss)
    comp = connected(links)
    pairs = _across(lists, comp, known, t)
    more = _confirmed(pairs.join(tried, ["x", "y"], "left_anti"), known, texts, width, t, k, loss)
    common.drop(lists, listed, known, texts, tried, comp, pairs)
    comp = connected(links.union(more))
    groups = classes.select("cid", "id", "least").join(comp.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    names = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = common.stored(groups.join(names, "comp").select("cid", "component_id", "comp"), "near-named")
    common.drop(classes, links, more, comp)
    out = rows.join(named, "cid", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "comp")


def deduplicated(docs: DataFrame, text: str = "text", width: int = 5, t: int = 80, k: int = K, loss: float = LOSS) -> DataFrame:
    """One row of docs for each group of components(), with its columns: a row of the least doc_id, without an id only where the group has none.

    Rows of one doc_id, null too, whose texts aren't in one group are kept apart. Texts without shingles are in no group: one row of each doc_id and text stays.
    """
    rows = _grouped(docs, text, width, t, k, loss)
    alone = F.col("comp").isNull()
    # ids come first in a group and nulls last; a text without shingles is a group with its doc_id
    group = F.struct("comp", F.when(alone, F.col("text_key")).alias("key"), F.when(alone, F.col("doc_id")).alias("id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    kept = rows.groupBy(group.alias("group")).agg(F.min(order).alias("x")).select(F.struct(F.col("x.id").alias("id"), F.col("x.key").alias("key")).alias("row")).distinct()
    times = rows.groupBy(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).alias("row")).agg(F.count("*").alias("times"))
    name = common.free_name(docs, "kept")
    kept = kept.select(F.struct(F.coalesce("row.id", F.lit(0)).alias("id"), F.col("row.id").isNull().alias("none"), F.col("row.key").alias("key")).alias(name))
    times = times.select(F.struct(F.coalesce("row.id", F.lit(0)).alias("id"), F.col("row.id").isNull().alias("none"), F.col("row.key").alias("key")).alias(name), F.col("times").alias(name + "_times"))
    kept = common.shuffled(common.stored(kept.join(times, name), "near-kept"))
    own = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNull().alias("none"), common.content_key(F.col(text)).alias("key"))
    found = docs.withColumn(name, own).join(kept, name)
    # whole rows are shuffled only where one is there several times
    again = found.where(F.col(name + "_times") > 1).dropDuplicates([name])
    return found.where(F.col(name + "_times") == 1).unionByName(again).select(*docs.columns)
