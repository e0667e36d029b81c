import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbase import errors as E
from quillbase.functions import scalars, text, vectors
from quillbase.operators import batch, chain, documents, index, search
from quillbase.sources import files
from quillbase.sources.store import Store
from quillbase.streaming import feeds

WORDS = "ein Satz über 漢字 and plain words that go on for a while".split()


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 16))) + rng.choice([".", "。", "!"]) for _ in range(n))


def test_cdc_chunks_cover_the_text_and_survive_an_edit():
    old = corpus(400)
    new = old[: len(old) // 2] + " An inserted sentence. " + old[len(old) // 2 :]
    a, b = text.cdc_split(old), text.cdc_split(new)
    assert "".join(a) == old and "".join(b) == new
    assert all(len(c.encode()) <= text.MAX_SIZE + text.SNAP + 3 for c in a)
    assert len(set(a) & set(b)) >= 0.8 * len(a)
    assert text.cdc_split("") == text.cdc_split(None) == []


def test_window_chunks(spark):
    def cut(t, window, overlap):
        row = spark.createDataFrame([(t,)], "t string").select(text.window_chunks(F.col("t"), window, overlap).alias("c")).collect()[0]
        return [c["chunk"] for c in row["c"]]

    assert cut("x" * 1000, 200, 50)[-1] == "x" * 100 and len(cut("x" * 1000, 200, 50)) == 7
    assert cut("漢字かな", 3, 1) == ["漢字か", "かな"]
    assert cut("abc", 5, 0) == ["abc"] and cut("abc", 0, 0) == ["abc"] and cut("", 5, 1) == [] and cut(None, 5, 1) == []
    assert cut("abcdef", 2, 9) == ["ab", "bc", "cd", "de", "ef"]


def test_scores(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (4, [1.0])]
    t = spark.createDataFrame(rows, "chunk_id int, vector array<float>")
    score = lambda m, sq=False: {r[0]: round(r["score"], 6) for r in search.scored(t, [3.0, 4.0], m, sq).collect()}
    assert score("COSINE") == {1: 0.6, 3: 1.0}
    assert score("SIMILARITY_EUCLIDEAN")[1] == round(-math.sqrt(20), 6) and score("EUCLIDEAN", True)[1] == -20
    assert score("INNER_PRODUCT")[2] == 0
    with pytest.raises(E.InvalidArgument):
        vectors.metric_name("HAMMING")


@pytest.mark.parametrize(("values", "median"), [([1, 3, 2], 2), ([1, 4, 2, 3], 2.5), ([7], 7)])
def test_aggregation(spark, values, median):
    hits = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "chunk_id int, score double")
    maps = spark.createDataFrame([("kb", i, "d") for i in range(len(values))], "kb_id string, chunk_id int, doc_id string")
    ids = spark.createDataFrame([("d",)], "doc_id string")
    got = {m: search.documents_of(hits, maps, ids, m).collect()[0]["score"] for m in search.AGGREGATES}
    assert got == {"MEDIAN": median, "MAX": max(values), "MEAN": sum(values) / len(values)}


def test_store_life(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kb", clock=lambda: 1000.0)
    kb = s.create_kb("notes", kb_id="kb-a", params=text.ChunkParams("window", 40, 8))
    with pytest.raises(E.InvalidArgument):
        s.create_version(kb, [])
    with pytest.raises(E.InvalidArgument):
        s.create_version(kb, [("PUT", "a", "x")])
    assert s.query(kb, [0.1] * 64).count() == 0  # nothing is published
    v1 = s.create_version(kb, [("ADD", "a", "alpha " * 20), ("ADD", "b", "beta " * 20), ("ADD", "e", "")], request_id="r1")
    assert s.create_version(kb, [("ADD", "z", "z")], request_id="r1") == v1
    v2 = s.create_version(kb, [("UPDATE", "a", "gamma " * 20), ("DELETE", "b", None)], v1)
    with pytest.raises(E.ParentHasChild):
        s.create_version(kb, [("ADD", "c", "x")], v1)
    v3 = s.create_version(kb, [("ADD", "c", "delta " * 20)], v2)
    docs = lambda v: {r["doc_id"]: r["content"][:5] for r in s.documents(kb, v).collect()}
    assert docs(v1) == {"a": "alpha", "b": "beta ", "e": ""} and docs(v2) == {"a": "gamma", "e": ""} and docs(v3) == {"a": "gamma", "c": "delta", "e": ""}
    s.rollback(kb, v3)
    assert s.build_index(kb, v3) > 0
    hit = s.query_text(kb, ("delta " * 20)[:40], top_k=1).collect()
    assert hit[0]["doc_id"] == "c" and s.cursor(kb) == v3
    with pytest.raises(E.VersionActive):
        s.delete_version(kb, v2, "SUBTREE")
    assert s.delete_version(kb, v1) == [v1]
    assert docs(v2) == {"a": "gamma", "e": ""}
    assert s.versions(kb).where(F.col("version_id") == v2).collect()[0]["parent_version_id"] == 0
    left = {r[0] for r in s.of("chunk_docs", kb).select("doc_id").distinct().collect()}
    assert "b" not in left and {r["version_id"] for r in s.table("deleted_log").collect()} == {v1}
    assert s.await_version(kb, v3)["next"] == "DONE" and s.health()["status"] == "HEALTHY"
    s.export_version(kb, v3, f"file://{tmp_path}/snap")
    other = s.create_kb("copy", kb_id="kb-b", params=text.ChunkParams("window", 40, 8))
    assert {r[0] for r in s.documents(other, s.import_version(other, f"file://{tmp_path}/snap")).select("doc_id").collect()} == {"a", "c", "e"}
    assert Store(spark, f"file://{tmp_path}/kb").meta["kbs"].keys() == {"kb-a", "kb-b"}
    s.delete_kb(other)
    with pytest.raises(E.KnowledgeBaseNotFound):
        s.kb(other)


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.TXT").write_bytes("one\r\ntwo\rthree".encode())
    (tmp_path / "in/b.md").write_text("   \n")
    (tmp_path / "in/c.exe").write_text("x")
    docs, rejected = files.read_documents(spark, f"file://{tmp_path}/in")
    assert [(r["doc_id"], r["content"]) for r in docs.collect()] == [("sub/a.TXT", "one\ntwo\nthree")]
    assert {r["path"] for r in rejected.collect()} == {"b.md", "c.exe"}
    rows = spark.createDataFrame([(f"{i:02}", "x" * n) for i, n in enumerate([400, 700, 100, 2000, 5])], "doc_id string, content string")
    assert [r["batch"] for r in files.batches(rows, 1000).orderBy("doc_id").collect()] == [0, 1, 1, 2, 3]
    s = Store(spark, f"file://{tmp_path}/kb")
    kb = s.create_kb("up", kb_id="kb-u", params=text.ChunkParams("window"))
    assert [o["status"] for o in files.upload(s, kb, rows, 1000)] == ["DONE"] * 4
    assert s.documents(kb, s.last_version(kb)).count() == 5


def test_tiers_and_breaker(spark, tmp_path):
    tier, score = 0, 0.0
    for _ in range(16):
        score += 1
        tier = feeds.tier_for(score, tier)
    assert tier == 2 and feeds.tier_for(11.3, 2) == 2 and feeds.tier_for(11.1, 2) == 1 and feeds.tier_for(2.7, 1) == 0
    state = ("CLOSED", 0.0, 0, [])
    for t, ok in [(0, True), (1, False), (2, False), (3, True), (4, False)]:
        state = feeds.breaker_step(state, t, ok)
    assert state[0] == "OPEN"
    for t in (10, 11):
        state = feeds.breaker_step(state, t, True)
    assert state[0] == "CLOSED"
    spark.createDataFrame([("kb", 1)] * 5, "kb_id string, version_id long").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = feeds.tiers(spark.readStream.schema("kb_id string, version_id long, at timestamp").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("tiers").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("tiers").collect()[-1]
    assert (round(row["score"], 6), row["tier"]) == (5.0, 1)


def test_quantised_searches_find_the_neighbours(spark):
    rng = np.random.default_rng(42)
    centres = rng.uniform(-8, 8, (8, 16))
    data = [(i, (centres[i % 8] + rng.normal(0, 1, 16)).tolist()) for i in range(500)]
    t = spark.createDataFrame(data, "chunk_id long, vector array<float>").cache()
    q = data[7][1]
    want = {r[0] for r in search.exact_topk(t, q, 10).collect()}
    coarse = index.unsq8(index.sq8(t), index.ranges(t))
    assert {r[0] for r in index.two_stage(coarse, t, q, 10).collect()} == want
    books = index.pq_train(t, 16, 4, 4)
    found = search.rerank(index.pq_coarse(index.pq_encode(t, books), books, q, 80), t, q, 10)
    assert len({r[0] for r in found.collect()} & want) >= 9
    lists = index.ivf_train(t, 8)
    assert len({r[0] for r in index.ivf_search(index.ivf_assign(t, lists), lists, q, 10, 4).collect()} & want) >= 9


def test_small_functions(spark):
    assert scalars.prefix_successor(b"a\xff") == b"b" and scalars.prefix_successor(b"\xff") is None
    assert scalars.fingerprint(["b", "a"]) == scalars.fingerprint(["a", "b"]) != scalars.fingerprint(["ab"])
    assert [scalars.quorum(n) for n in (0, 1, 3, 4)] == [0, 1, 2, 3]
    assert search.policy(0, False) == "NOT_READY" and search.policy(60_000, False) == "BUILD"
    empty = spark.createDataFrame([], "doc_id string")
    assert documents.set_digest(empty).collect()[0]["digest"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    c = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "version_id long, parent_version_id long")
    assert sorted(r[0] for r in chain.delete_targets(spark, c, 2, "ANCESTORS").collect()) == [1]


def test_discarded_and_failed_versions_are_never_read(spark, tmp_path):
    def fails(chunks):
        raise RuntimeError("no service")

    store = Store(spark, f"file://{tmp_path}/kb")
    kb = store.create_kb("notes")
    v1 = store.create_version(kb, [("ADD", "a", "good text")])
    write = store._put_version

    def broken(name, *rest):
        if name == "version_docs":
            raise RuntimeError("lost")  # after the records are written
        return write(name, *rest)

    store._put_version = broken
    with pytest.raises(RuntimeError):
        store.create_version(kb, [("UPDATE", "a", "DISCARDED text")], v1)
    store._put_version = write
    v2 = max(store.meta["versions"])
    store.discard(kb, v2)
    v3 = store.create_version(kb, [("ADD", "b", "more")], v1)
    assert {r["doc_id"]: r["content"] for r in store.documents(kb, v3).collect()} == {"a": "good text", "b": "more"}
    with pytest.raises(E.InvalidArgument):
        store.discard(kb, v3)


def test_an_interrupted_exchange_is_finished(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb")
    kb = store.create_kb("notes")
    v1 = store.create_version(kb, [("ADD", "a", "text"), ("ADD", "b", "more")])
    real = store._exchange

    def crash():
        for place in store.meta["exchanges"].values():
            store._fs().delete(store._path(place), True)
        raise KeyboardInterrupt

    store._exchange = crash
    with pytest.raises(KeyboardInterrupt):
        store._rewrite("doc_versions", kb, store.of("doc_versions", kb))
    again = Store(spark, f"file://{tmp_path}/kb")
    assert again.documents(kb, v1).count() == 2 and not again.meta["exchanges"]


def test_chains_of_any_depth(spark):
    n = 1000
    versions = spark.createDataFrame([(i, i - 1) for i in range(1, n + 1)] + [(n + 1, 500)], "version_id long, parent_version_id long")
    ids = lambda frame: {r[0] for r in frame.select("version_id").collect()}
    assert ids(chain.descendants(spark, versions, 1)) == set(range(1, n + 2))
    assert ids(chain.ancestors(spark, versions, n)) == set(range(1, n))
    assert ids(chain.delete_targets(spark, versions, 600, "SINGLE")) == {600}
    assert ids(chain.delete_targets(spark, versions, 600, "SUBTREE")) == set(range(600, n + 1))
    assert ids(chain.delete_targets(spark, versions, 600, "ANCESTORS")) == {*range(1, 600), n + 1}
    left = chain.spliced(versions, versions.where("version_id between 400 and 800"))
    assert {r[0]: r[1] for r in left.where("version_id > 800").collect()} == {i: 399 if i in (801, n + 1) else i - 1 for i in range(801, n + 2)}


def test_deletions_are_joined_by_both_keys(spark):
    local = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 2), ("c", 1), (None, 1), ("b", None), ("d", None)], "kb_id string, version_id long")
    log = spark.createDataFrame([("e", 1, "a", 1), ("e", 2, "a", 1), ("e", 3, "a", 2), ("e", 4, "b", 0), ("e", 5, "b", 1), ("e", 6, None, 1), ("e", 7, "d", None), ("e", 8, "c", 2)], "epoch string, seq long, kb_id string, version_id long")
    found, mark = feeds.reconcile_deletions(log, {"epoch": "e", "seq": 1}, local, local)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", None)] and mark == {"epoch": "e", "seq": 8}
    # 40,000 versions of one base, all deleted: joined by the base alone they would be 1.6 billion pairs
    many = spark.range(1, 40_001).select(F.lit("a").alias("kb_id"), F.col("id").alias("version_id"))
    found, _ = feeds.reconcile_deletions(many.select(F.lit("e").alias("epoch"), F.col("version_id").alias("seq"), "kb_id", "version_id"), {"epoch": "e", "seq": 1}, many, many)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("LeftSemi" in x and " OR " not in x for x in joins)
    assert found.count() == 39_999


@pytest.mark.parametrize("metric", ["COSINE", "INNER_PRODUCT", "EUCLIDEAN"])
def test_many_searches_give_the_scores_and_ties_of_single_ones(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    table = [(f"r{i:03}", i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)]
    table += [(f"c{i:03}", i, [1.0, 2.0, 0.0, 1.0, -1.0, 0.5]) for i in range(120)]  # equal rows: ties go by id
    table += [("z", 0, [0.0] * 6), ("n", 0, None), ("h", 0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("e", 0, []), ("x", 0, [math.nan] + [1.0] * 5), ("i", 0, [math.inf] + [1.0] * 5), ("s", 0, [1e-30] * 6), ("b", 0, [1e30] * 6), (None, 0, [1.0, 2.0, 0.0, 1.0, -1.0, 0.5])]
    table += [(f"d{i}", i, [1.0 + i, 2.0]) for i in range(15)]
    t = spark.createDataFrame(table, "chunk_id string, n int, vector array<float>").repartition(3)
    q = t.where("n % 20 = 0").select(F.concat(F.coalesce("chunk_id", F.lit("")), F.lit("?")).alias("query_id"), F.col("vector").alias("query"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    plain = t.crossJoin(q).withColumn("score", vectors.similarity(F.col("vector"), F.col("query"), metric)).where("score is not null")
    plain = plain.withColumn("rank", F.row_number().over(w)).where("rank <= 7").select("query_id", "rank", "chunk_id", "n", "score")
    want = sorted(map(repr, plain.collect()))
    for asked, block, pool in ((16_384, 1 << 20, 1 << 20), (10, 1 << 9, 1 << 9)):  # broadcast and dealt queries, whole and small blocks
        monkeypatch.setattr(batch, "ASKED", asked), monkeypatch.setattr(batch, "BLOCK", block), monkeypatch.setattr(batch, "POOL", pool)
        found = search.batch_topk(t, q, 7, metric)
        assert sorted(map(repr, found.select("query_id", "rank", "chunk_id", "n", "score").collect())) == want
        assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no score a pair in expressions
