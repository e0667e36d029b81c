import hashlib
import os
import re
import sys
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
import corpus_pipeline

import quillbase.llm.substrings as substrings
from quillbase.llm import common, licenses, lines, media, mixing, neardup, pieces, pii, quality, queries, warc

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
BASE = " ".join(f"tok{i}" for i in range(80))
TEXTS = ["", None, "one", "one two", "a b c", "A B C", LONG, LONG + " end", PASSAGE, "x " + PASSAGE + " y", PASSAGE + PASSAGE, BASE, BASE.replace("tok40", "other"), "aaaa" * 100, "漢字 " * 90, "\n\n", " lead  and  trail "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "s1", "s2"][i % 3], "x") for i, t in enumerate(TEXTS)]
    rows += [rows[9], rows[9], (None, PASSAGE, None, None, None)]  # repeated rows and a null id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_pieces(docs, empty):
    out = pieces.encode_decode(docs, queries.model_path()).collect()
    library = pieces.encoder(queries.model_path()).library
    want = Counter(np.array(library.encode(r["text"] or "", add_bos=True, add_eos=True), "<u4").tobytes() for r in docs.collect())
    assert Counter(bytes(r["token_ids"]) for r in out) == want
    assert {r["doc_id"]: r["decoded"] for r in out}[9] == TEXTS[9]
    assert pieces.token_digests(pieces.encode_decode(empty, queries.model_path())).count() == 0
    with pytest.raises(ValueError, match="taken"):
        pieces.encode_decode(docs.withColumnRenamed("lang", "decoded"), queries.model_path())


@pytest.mark.parametrize("text", [" a  b", "  ", "\n", "a\n\nb", "▁x", "😀 é\0z", "a\n▁ b", "<s>x</s>", "\t\t a"])
def test_pieces_odd_texts(text):
    e = pieces.encoder(queries.model_path())
    ids = e.encode(text)
    assert ids == np.array(e.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
    e.settle([text], [ids])


def test_warc(spark, tmp_path):
    big = "é" * 400_000
    rows = [(1, "http://a/\r\nx: y", "same"), (5, "b", "same"), (3, None, "same"), (2, "c", None), (4, "d", ""), (6, "e", big), (7, "f", big + "!"), (7, "f", big + "!"), (None, "g", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("none", "none")
    got = sorted(map(str, warc.archived(pages, f"file://{tmp_path}/w").collect()))
    first = defaultdict(list)
    for i, _, h in rows:
        first[h or ""].append(-1 if i is None else i)
    import base64

    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), max(first[h or ""])
        r = i != top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if r else "response", top if r else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(names, w, strict=True)))) for w in want)
    assert warc.archived(pages.limit(0), f"file://{tmp_path}/e").count() == 0
    chunks = warc.read(warc.write(warc.chunk_rows(pages), f"file://{tmp_path}/c")).where("page_id = 6").orderBy("chunk_no").collect()
    assert len(chunks) == 4 and b"".join(bytes(c["data"]) for c in chunks) == big.encode() and chunks[-1]["running_digest"] == chunks[0]["payload_digest"]
    assert chunks[0]["running_digest"] != chunks[1]["running_digest"]
    assert {r["url"] for r in warc.read(warc.write(warc.chunk_rows(pages), f"file://{tmp_path}/u")).where("page_id = 1").collect()} == {"http://a/\r\nx: y"}


def test_warc_headers_are_as_other_readers_expect_them(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/b%20c", "same"), (2, "http://d/%", "same")], "page_id long, url string, html string")
    warc.write(warc.chunk_rows(pages).coalesce(1), f"file://{tmp_path}/h").collect()
    plain = "".join(gzip.open(tmp_path / "h" / f, "rt", newline="").read() for f in os.listdir(tmp_path / "h"))
    heads = [dict(x.split(": ", 1) for x in part.split("\r\n\r\n")[0].split("\r\n")[1:]) for part in plain.split("WARC/1.1")[1:]]
    by = {h["WARC-Target-URI"]: h for h in heads}
    assert set(by) == {"http://a/b%20c", "http://d/%"}
    revisit, response = by["http://a/b%20c"], by["http://d/%"]
    assert revisit["WARC-Type"] == "revisit" and revisit["WARC-Refers-To"] == response["WARC-Record-ID"] and revisit["WARC-Refers-To-Target-URI"] == "http://d/%"


@pytest.mark.parametrize("op", ["lines", "quality", "cleaned", "mixing", "near"])
def test_columns_of_any_names_pass(spark, op):
    """Columns that clash with names used inside stay as they are."""
    odd = ["text_key", "text_key_at", "quality_key", "quality_key_text", "judged_key", "judged_key_at", "mix", "mix_key", "mix_key_s", "mix_to", "kept_row", "key", "line", "cid", "n", "comp", "i", "h", "s", "at"]
    text = " ".join(f"tok{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"{text} {i}", "s", *range(len(odd))) for i in range(3)], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in odd))
    run = {"lines": lines.without_boilerplate, "quality": lambda d: quality.judge(d, keep=("doc_id", *odd)), "cleaned": quality.cleaned, "mixing": mixing.mixed, "near": neardup.deduplicated}[op]
    out = run(docs).collect()
    assert out and all([r[c] for c in odd] == list(range(len(odd))) for r in out)


def test_lines(spark, empty):
    rows = [(i, "both  ways\nown " + str(i) + "\n\n both ways", f"s{i}") for i in range(12)] + [(99, None, "s1"), (98, "", None), (97, "few\nx", "s1"), (96, "both ways", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.without_boilerplate(docs).collect()}
    assert got[3] == ("own 3\n", 4, 2) and got[99] == (None, 0, 0) and got[98] == ("", 1, 0) and got[97] == ("few\nx", 2, 0) and got[96] == ("", 1, 1)
    assert lines.without_boilerplate(empty).count() == 0


def test_line_sites_are_exact_near_the_threshold(spark):
    rows = [(i, f"line{n}", f"s{i}") for n in (8, 9, 10, 11, 12) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r["text"] for r in lines.without_boilerplate(docs).collect()}
    assert gone == {"line8", "line9", ""}


def test_quality(spark, docs, empty):
    got = quality.judge(docs).collect()
    assert len(got) == docs.count() and quality.judge(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert not by[1]["kept"] and by[1]["n_words"] == 0 and by[11]["kept"]
    for i, t in enumerate(TEXTS):
        w = brute.words(t)
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        assert (by[i]["n_words"], by[i]["word_chars"], by[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
    assert quality.passing(docs).columns == docs.columns


def test_quality_rejects_depleted_documents(spark):
    banner = " ".join(f"b{i}" for i in range(40))
    rows = [(i, banner + "\n" + f"only {i}", "h") for i in range(30)] + [(100, banner + "\n" + BASE, "h"), (101, banner, "other")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[3] and got[100] and got[101]


def test_quality_removes_frequent_lines(spark, tmp_path):
    banner = " ".join(f"b{i}" for i in range(6))
    body = lambda i: " ".join(f"tok{i}x{j}" for j in range(40))
    rows = [(i, f"{banner}\n{body(i)}\n\n  {banner} \nend {i}", "en", "h", 0) for i in range(30)] + [(30, f"{banner}\n{body(30)}", "en", "other", 0), (31, f"{banner}\nfew", "en", "h", 0), (32, f"{banner}\n{body(32)}", "en", None, 0), (0, f"{banner}\n{body(0)}\n\n  {banner} \nend 0", "en", "h", 0)]
    want = Counter((i, f"{body(i)}\n\nend {i}" if h == "h" else t) for i, t, _, h, _ in rows if i != 31)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)


PII = ["", None, "a@b.c_d@e.f and x@y", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 010.0.0.255", "card 4111 1111-1111 1111 and 4111111111111112", "+1 (555) 010-9999, +12, +49 30 1234567890123456", "é+1 555 0109 99é 10.0.0.1@x.yz", "a" * 5000 + "@", "1" * 5000, "1." * 3000, "x@" + "a." * 2000]


def test_pii(spark, empty):
    docs = spark.createDataFrame(list(enumerate(PII)) + [(2, PII[2])], "doc_id long, text string")
    got = pii.find(docs).collect()
    assert len(got) == len(PII) + 1 and pii.find(empty).count() == 0
    for r in got:
        want = brute.pii(PII[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k in brute.KINDS for a, b in want[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"] == base


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"note {i} of zebedee wrote from zed@corp.example about thing{i} then") for i in range(8)] + [(100 + i, f"note {i} of others about thing{i} then") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    got = pii.find(docs, keep=("doc_id",))
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    text = rows[0][1]
    terms = {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in spans[0].split(",")) if k == "term"}
    assert terms == {"zebedee", "wrote", "from"} and spans[100] == ""
    clean = docs.join(got.select("doc_id", "spans"), "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("spans")).alias("t")).where("doc_id = 0").collect()[0]["t"]
    assert clean == "note 0 of <TERM> <TERM> <TERM> <EMAIL> about thing0 then"


def _terms(rows, got, i):
    text = rows[i][1]
    return [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k == "term"]


def test_pii_terms_of_the_whole_text(spark):
    far = "filler " * 60
    rows = [(i, f"Zebedee signs. {far}{i} understanding write to zed@corp.example {far} said zebedee, ZEBEDEE zebedees") for i in range(8)] + [(8 + i, f"{far}{i} understanding write to said zebedees signs") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert _terms(rows, got, 3) == ["Zebedee", "zebedee", "ZEBEDEE"] and got[20] == ""


def test_pii_terms_of_rare_entities(spark):
    rows = [(0, "Xylophon tells all to one@corp.example for nothing"), (1, "Xylophon tells all to one@corp.example for nothing"), (2, "quagga tells two@corp.example"), (3, "quagga writes all two@corp.example")]
    rows += [(4 + i, f"{i} tells all for nothing and writes") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [_terms(rows, got, i) for i in range(5)] == [["Xylophon"], ["Xylophon"], ["quagga"], ["quagga"], []]


def test_pii_terms_are_those_of_every_pair(spark):
    rng = np.random.default_rng(3)
    names = ["".join("abcdefgh"[int(c)] for c in np.base_repr(512 + i, 8)) for i in range(3000)]
    rows = []
    for i in range(400):
        words = [names[int(3000 * rng.random() ** 2)] for _ in range(12)]
        rows.append((i, " ".join([*words, *(f"+1 555 0100 {100 + int(rng.zipf(1.5)) % 300}" for _ in range(int(rng.integers(0, 3)) * (i % 4 == 0)))])))
    texts = {t for _, t in rows}
    has = {t: ({t[a:b] for a, b in brute.pii(t)["phone"]}, set(re.findall("[a-z]{3,}", t))) for t in texts}
    n_e, n_t, n_both = (Counter(x for e, w in has.values() for x in pick(e, w)) for pick in (lambda e, w: e, lambda e, w: w, lambda e, w: [(x, y) for x in e for y in w]))
    n = len(texts)
    close = lambda e, t: (n_both[e, t] * n / n_e[e] + pii.PRIOR) / (n_t[t] + pii.PRIOR) >= (n / n_e[e]) ** pii.ALPHA
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: {w for w in has[t][1] if any(close(e, w) for e in has[t][0])} for i, t in rows}
    assert {i: set(_terms(rows, got, i)) for i, _ in rows} == want and sum(map(len, want.values())) > 50


def test_licenses(docs, empty):
    s = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT-permission"]
    text = "é prefix " + mit.replace("Software", "Program").replace("publish, ", "") + " suffix. Released under the MIT License."
    found = {m[0]: m for m in s.scan(text)}
    assert set(found) == {"MIT", "MIT-permission"} and text[found["MIT"][1] : found["MIT"][2]] == "Released under the MIT License"
    assert text[found["MIT-permission"][1] :].startswith("Permission is") and 0.8 < found["MIT-permission"][5] < 1
    wide = licenses.align([1, 2, 9, 3, 4], [1, 2, 3, 4], -10, 10)
    assert wide == (7, 0, 5, 4)
    assert s.scan(None) == s.scan("") == s.scan("MIT") == []
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


SHORT = ["Released under MIT License", "Released under the terms of the MIT License", "Licensed under CC BY-NC version 4.0", "Licensed under the Apache Licence, Version 2.0", "work is licensed by a Creative Commons Attribution 4.0 Internal License"]


@pytest.mark.parametrize("text", [*SHORT, "Released under the BSD License", "the license is under the sea", "under the " * 40, *licenses.TEMPLATES.values()])
def test_licenses_of_few_words(text):
    """As the alignment of every short template with the whole text."""
    s = licenses.Scanner(licenses.TEMPLATES)
    words = [s.ids.get(w, 0) for w in licenses.WORD.findall(text.lower().encode())]
    want = set()
    for name, t in zip(s.names, s.templates, strict=True):
        _, _, _, same = licenses.align(words, t, -len(t), len(words))
        if len(t) < licenses.SHORT and same >= licenses.COVERAGE * len(t):
            want.add((name, same))
    padded = "filler " * 50 + text + " filler" * 50
    assert {(m[0], m[3]) for m in s.scan(padded) if m[4] < licenses.SHORT} == want == {(m[0], m[3]) for m in s.scan(text) if m[4] < licenses.SHORT}
    assert want or text not in SHORT
    assert [m[0] for m in s.scan((text + " x" * 80 + " ") * 3)] == [m[0] for m in s.scan(text) for _ in range(3)] or len(s.scan(text)) != 1


@pytest.mark.parametrize("hot", [500, 2])
def test_substrings(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = docs.collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in substrings.without_repeats(docs).collect())
    assert got == Counter((r["doc_id"], *w) for r, w in zip(rows, brute.repeats([r["text"] for r in rows]), strict=True))
    assert substrings.without_repeats(empty).count() == 0


def test_near(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").distinct().collect()]
    for width, t in ((3, 85), (5, 80)):
        want = brute.near(rows, width, t)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(docs, width=width, t=t).collect() if r["doc_id"] is not None}
        assert got == want
    assert neardup.components(empty).count() == 0
    kept = [r["doc_id"] for r in neardup.deduplicated(docs).collect()]
    assert len(kept) == len(set(kept)) and 8 in kept and 9 not in kept


def test_near_dedup_keeps_texts_of_null_and_shared_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (None, text("c")), (None, ""), (1, text("c") + " end"), (2, text("d")), (2, text("e")), (3, text("e")), (3, text("c")), (4, ""), (4, "")]
    got = Counter((r["doc_id"], r["text"]) for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one = [x for x in got if x[1] in (text("b"), text("b") + " end")]
    assert len(one) == 1 and got == Counter([(None, text("a")), one[0], (None, ""), (1, text("c") + " end"), (2, text("d")), (2, text("e")), (4, "")])


def test_near_groups_of_many(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            words[j] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    want = brute.near(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, t=85).collect()}
    assert got == want


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == pytest.approx([0, 15])
    tree = mixing.splitting_tree([10, 0, 7, 100], 7, 1)
    assert tree.sum(0).tolist() == [10, 0, 7, 100] and tree.sum(1).max() - tree.sum(1).min() <= 1


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "b", "a", "é"][int(rng.choice(4, p=[0.1, 0.6, 0.2, 0.1]))]) for i in range(3000)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(t).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.taken_words(t).collect()))
    by, goal = Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[source[r["doc_id"]]] += r["taken"]
        goal[source[r["doc_id"]]] = r["target"]
    assert all(abs(by[s] - goal[s]) <= 60 for s in goal)
    out = mixing.mixed(t)
    assert out.columns == t.columns and sum(len((r["text"] or "").split()) for r in out.collect()) == sum(by.values())
    assert len(mixing.taken_words(docs).collect()) == docs.count() and mixing.taken_words(empty).count() == 0


def test_mixing_takes_what_the_tree_deals(spark, monkeypatch):
    """Held against a plain version: each shard's stretches of the permuted draws, row by row."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "ab"[int(rng.random() < 0.7)]) for i in range(900)] + [(5, "w w", "a")] * 2 + [(None, None, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.Mix(t, shards=5)
    known = {r["i"]: r for r in made.known.collect()}
    units = [(r["i"], r["block"], d["pass"], d["shard"], d["edge"]) for r in made.drawn.collect() for d in r["draws"]]
    tree = Counter((s, i) for i, _, _, s, _ in units)
    assert all(made.tree[s, i] == tree[s, i] for s in range(5) for i in known) and len({u[:3] for u in units}) == len(units)
    taken = defaultdict(lambda: [0, 0])
    source = {r["s"]: i for i, r in known.items()}
    for r in made.rows.collect():
        i = source[r["s"]]
        place = (r["h"], r["key"]["a"], r["key"]["b"])
        end = known[i]["end"]
        for u in units:
            if u[0] == i and r["h"] >> (40 - known[i]["bits"]) == u[1] and r["size"] and (not u[4] or end is None or place <= (end["h"], end["key"]["a"], end["key"]["b"])):
                taken[r["doc_id"]][0] += r["size"]
                taken[r["doc_id"]][1] += 1 << (4 * u[3])
    got = defaultdict(lambda: [0, 0])
    for r in mixing.taken_words(t, shards=5).collect():
        got[r["doc_id"]][0] += r["taken"]
        got[r["doc_id"]][1] += sum(1 << (4 * int(x)) for x in r["shards"].split(",") if x)
    assert {k: v for k, v in got.items() if v[0]} == dict(taken)
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, shards, seed: np.zeros((shards, len(quotas)), np.int64) + (np.arange(shards) == 0)[:, None] * np.array(quotas) // 2)
    assert sum(r["taken"] for r in mixing.taken_words(t, shards=5).collect()) < 0.8 * sum(v[0] for v in got.values())


def test_media(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/m"
    got = media.media_columns(docs, folder=folder).collect()
    assert len(got) == docs.count() and media.media_columns(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = media.padded(b)
        assert len(p) % 64 == 0 and p
        assert (by[i]["n_bytes"], by[i]["payload_bytes"], by[i]["payload_sha256"], by[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert by[i]["width"] * by[i]["height"] == len(p) and media.from_png(media.to_png(p)) == p
    assert by[0]["media_sha256"] == by[1]["media_sha256"]
    members = [m for f in os.listdir(tmp_path / "m") for m in tarfile.open(tmp_path / "m" / f).getmembers()]
    assert {m.size for m in members} >= {r["media_bytes"] for r in got}
    assert any(m.offset_data == by[5]["offset"] for m in members) if "offset" in by[5] else True


def test_keys_tell_nulls_apart(spark):
    t = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None)], "x string, y string")
    assert t.select(common.content_key(t["x"], t["y"]).alias("k")).distinct().count() == 3


def test_line_dedup_hashes_the_texts_once(spark, monkeypatch):
    made, plain = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or plain(df, name))
    rows = [(i, f"s{i}" if i else None, f"shared\nown {i}\n\n shared ") for i in range(11)] + [(11, None, None), (12, "s1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.without_boilerplate(docs).collect()}
    assert got == {i: (f"own {i}\n", 4, 2) for i in range(11)} | {11: (None, 0, 0), 12: ("", 1, 0)}
    assert [name for name, plan in made if "regexp_replace" in plan] == ["lines-hashed"]
