"""Quality rules from DataFrame functions alone.

Base rules look at a document by itself. The method across documents hashes normalised
lines, counts for each host the distinct documents (by content) that have a line, removes lines above
the limits, and rejects documents that lose too large a share of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .lines import normalised

#: A line is above the limits when more documents of the host than this have it, and more than SHARE of them.
LEAST_DOCS, SHARE = 20, 0.01
#: A document is depleted when fewer than so many hundredths of its words are left.
LEFT = 25
#: Words in a window of the repetition rule; words that a document needs; most hundredths in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many of the words lie in windows of width words that are found twice or more in the array, the first included.

    Windows are compared by 64-bit hashes. They are sorted only where a hash comes twice.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - v, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return common.let(common.let(pairs, places), total)

    def judged(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(windows)).otherwise(F.lit(0).cast("long"))

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(common.let(common.let(F.transform(words, lambda w: F.xxhash64(w)), hashed), judged))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """n_words and the four base metrics of a text whose words are given; a null text has none."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n", -1), lambda x: x.rlike(common.WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(filled, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": common.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(words),
    }


def _hashed_lines(text: str, host: str) -> Column:
    """For each line its hash with the host (line) and its words, null for blank ones."""
    host_col = F.col(host)

    def one(line: Column) -> Column:
        norm = normalised(line)
        seen = F.struct(F.xxhash64(host_col.isNull(), host_col, norm).alias("a"), F.xxhash64(F.lit("b"), host_col.isNull(), host_col, norm).alias("b"))
        return F.when(norm != "", F.struct(seen.alias("line"), (F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).alias("words")))

    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), one)


def _host_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """key, host, lines: each distinct non-blank line of a row as its hash with the host (line) and how many words of the row stand in it (words)."""
    lines = F.filter(_hashed_lines(text, host), lambda x: x.isNotNull())
    return docs.select(common.content_key(F.col(host), F.col(text)).alias("key"), F.col(host).alias("host"), lines.alias("lines"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """Hashes of (host, line) above the limits, stored. Exact copies of a text within a host are one document; null is a host of its own."""
    rows = _host_lines(docs, text, host).withColumn("lines", F.array_distinct(F.transform("lines", lambda x: x["line"])))
    once = rows.groupBy("key").agg(F.first("host").alias("host"), F.first("lines").alias("lines"))
    once = common.stored(once.withColumn("host", F.xxhash64(F.col("host").isNull(), "host")), "quality-lines")
    sizes = once.groupBy("host").agg(F.count("*").alias("docs"))
    counted = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    counted = counted.join(sizes, "host").where(F.col("n") > F.col("docs") * share)
    return common.stored(counted.select("line"), "quality-frequent")


def _hits(docs: DataFrame, text: str, host: str, found: DataFrame) -> DataFrame:
    """Stored: key and places (at, words) of the lines in found, for each distinct (host, text) with one; copies have the same places."""
    rows = docs.select(common.content_key(F.col(host), F.col(text)).alias("key"), F.posexplode(_hashed_lines(text, host)).alias("at", "x"))
    rows = rows.select("key", "x.line", F.struct("at", "x.words").alias("place")).where("line is not null")
    rows = rows.join(common.sized(found), "line", "left_semi")
    return common.stored(rows.groupBy("key").agg(F.collect_set("place").alias("places")), "quality-hits")


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",), least_docs: int = LEAST_DOCS, share: float = SHARE, left: int = LEFT, hits: DataFrame | None = None) -> DataFrame:
    """The kept columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept.

    lost_words counts the words of lines that are above their host's limits. A null or empty text has no words and fails.
    Equal rows get equal verdicts; an empty table gives an empty one. Kept columns that clash with the new ones are an error.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"]
    if clash := set(new) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken")
    hits = _hits(docs, text, host, frequent_lines(docs, text, host, least_docs, share)) if hits is None else hits
    lost = hits.select("key", F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("lost"))
    name = common.free_name(docs, "quality_key")
    rows = docs.select(*keep, F.col(text).alias(name + "_text"), common.content_key(F.col(host), F.col(text)).alias(name), common.words(F.col(text)).alias(name + "_words"))
    rows = rows.select(*keep, name, *[c.alias(n) for n, c in base_columns(F.col(name + "_text"), F.col(name + "_words")).items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    rows = rows.join(common.shuffled(lost.withColumnRenamed("key", name)), name, "left").withColumn("lost_words", F.coalesce("lost", F.lit(0)).cast("long"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & ((F.col("n_words") - F.col("lost_words")) * 100 >= F.col("n_words") * left)
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", kept.alias("kept"))


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns and whole texts."""
    name = common.free_name(docs, "judged_key")
    text, host = options.get("text", "text"), options.get("host", "source")
    marked = docs.withColumn(name, common.content_key(F.col(host), F.col(text)))
    verdict = judge(marked, keep=(name,), **options).where("kept").select(name).distinct()
    return marked.join(verdict, name, "left_semi").select(*docs.columns)


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, left: int = LEFT) -> DataFrame:
    """The rows of passing() with their columns, their texts less the lines above their host's limits.

    A text is cut at each newline; removed lines go with one newline each.
    """
    name = common.free_name(docs, "judged_key")
    marked = docs.withColumn(name, common.content_key(F.col(host), F.col(text)))
    hits = _hits(docs, text, host, frequent_lines(docs, text, host, least_docs, share))
    verdict = judge(marked, text, host, (name,), least_docs, share, left, hits).where("kept").select(name).distinct()
    hits = hits.select(F.col("key").alias(name), F.col("places.at").alias(name + "_at"))
    rows = marked.join(common.shuffled(common.stored(verdict.join(common.shuffled(hits), name, "left"), "quality-passed")), name)
    gone = F.col(name + "_at")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rows.select(*[F.when(gone.isNull(), F.col(c)).otherwise(rest).alias(c) if c == text else F.col(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY 1),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
norm AS (SELECT doc_id, source, text, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line FROM raw),
host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
freq AS (SELECT n.source, n.line FROM norm n JOIN host h ON n.source IS NOT DISTINCT FROM h.source WHERE n.line <> ''
         GROUP BY n.source, n.line, h.docs HAVING count(DISTINCT n.text) > {LEAST_DOCS} AND count(DISTINCT n.text) > h.docs * {SHARE}),
lost AS (SELECT n.doc_id, sum(len(string_split(n.line, ' '))) AS n FROM norm n JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY 1),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
                coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
         FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
       NOT base_failed AND (n_words - lost_words) * 100 >= n_words * {LEFT} AS kept FROM failed
"""
