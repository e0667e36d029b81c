"""Personal data: spans of four kinds, and information-theoretic sanitisation of the terms of their texts.

Found values are the protected entities. Over the corpus, the pointwise mutual information
of a term and an entity, log2(p(e|t) / p(e)), says how strongly the term reveals the entity. p(e|t)
is shrunk towards p(e) by PRIOR documents, so that rare entities and terms are judged like others. A
term whose information is at least ALPHA times the entity's own, -log2 p(e), discloses it
and is removed too, wherever it stands in the entity's documents. DataFrame functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Disclosure threshold as a share of the entity's information; documents at the entity's share of all that are added to each term's.
ALPHA, PRIOR = 0.9, 0.5
#: Fixed values. Each says the same as its plain form, in time proportional to the text: a match starts
#: at the start of a run or where the last match ended, and runs don't give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried on it.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{3,}"
SPAN = "struct<s:int,e:int,m:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substring(part(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    return F.length(_digits(m)).between(9, 15)


def _checker(kind: str):
    return lambda x: _valid(kind, x["m"])


def _places(text: Column, pattern: str | Column) -> Column:
    """array<SPAN> of the pattern's matches: the pieces between them give the code points before each."""

    def run(pieces: Column, found: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.char_length(F.get(pieces, i))
            e = s + F.char_length(F.get(found, i))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.get(found, i).alias("m")))).alias("out"))

        return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step)["out"])

    return common.let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f")), lambda x: run(x["p"], x["f"]))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the valid spans of a text that isn't null, leftmost first."""
    none = F.array().cast(f"array<{SPAN}>")
    out = {}
    for kind, pattern in PATTERNS.items():
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
        out[kind] = F.when(hint, F.filter(_places(text, pattern), _checker(kind))).otherwise(none)
    return out


def _entity(kind: str, m: Column) -> Column:
    """A found value in one form, as a hash with its kind."""
    return F.xxhash64(F.lit(kind), F.lower(m) if kind in ("email", "ip") else _digits(m))


def _spelled(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stored: the kept columns, key (of the text), a number of the row, the spans of each kind, entities, the text if it has any, and its distinct terms in one string."""
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, common.content_key(F.col(text)).alias("key"), F.monotonically_increasing_id().alias("row"), filled.alias("text"))
    rows = rows.select(*keep, "key", "row", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    value = lambda kind: lambda x: _entity(kind, x["m"])
    entities = F.array_distinct(F.concat(*[F.transform(k, value(k)) for k in PATTERNS]))
    terms = F.array_join(F.array_distinct(F.transform(_spellings(F.col("text")), F.lower)), " ")
    return common.stored(rows.select(*keep, "key", "row", *PATTERNS, entities.alias("entities"), terms.alias("terms"), F.when(F.size(entities) > 0, F.col("text")).alias("text")), "pii-scan")


def _spellings(text: Column) -> Column:
    """The terms of a text as they are spelled there."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def disclosing_terms(scanned: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """Stored: key (of a text with entities) and told, its terms that disclose one of them.

    Documents are counted by distinct text, so that copies say nothing new. Entities of the same documents are judged as one.
    """
    first = common.stored(scanned.groupBy("key").agg(F.min("row").alias("row")).select("row"), "pii-first")
    n_all = first.count()
    once = lambda rows: rows.join(first.hint("shuffle_hash"), "row", "left_semi")
    split = F.filter(F.split("terms", " "), lambda x: x != "")
    owners = scanned.where(F.size("entities") > 0).select("key", "row", "entities", "terms")
    owners = common.stored(once(owners).select("key", "entities", split.alias("terms")), "pii-owners")
    each = owners.select("key", F.explode("entities").alias("entity"))
    groups = common.stored(each.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor("key.a").alias("a"), F.bit_xor("key.b").alias("b")), "pii-entities")
    groups = groups.where(F.col("n") < n_all)
    owned = common.stored(each.join(common.sized(groups), "entity").select("key", F.struct("n", "a", "b").alias("group")).distinct(), "pii-groups")
    # a term in more documents than this discloses no entity of n documents, even if it is in all of those
    most = lambda n: ((n_all + prior) / F.pow(n_all / n, F.lit(alpha)) - prior) * 1.000001
    largest = groups.agg(F.max("n")).collect()[0][0]
    if largest is None:
        return common.stored(owners.select("key", F.col("terms").alias("told")).limit(0), "pii-told")
    n_term = once(scanned.select("row", "terms")).select(F.explode(split).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    n_term = common.stored(n_term.where(F.col("n_term") <= most(F.lit(largest))), "pii-terms")
    rare = owners.select("key", F.explode("terms").alias("term")).join(common.sized(n_term), "term")
    both = common.stored(rare.join(owned, "key").where(F.col("n_term") <= most(F.col("group.n"))), "pii-both")
    counted = both.groupBy("group", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"))
    known = F.log2((F.col("n_both") * n_all / F.col("group.n") + prior) / (F.col("n_term") + prior))
    own = F.log2(n_all / F.col("group.n"))
    pairs = common.stored(counted.where(known >= own * alpha).select("group", "term"), "pii-pairs")
    told = both.join(common.sized(pairs), ["group", "term"], "left_semi")
    return common.stored(told.groupBy("key").agg(F.collect_set("term").alias("told")), "pii-told")


def _told_places(text: Column, told: Column) -> Column:
    """array<SPAN> of the told terms in a text, in any spelling."""
    spelled = F.filter(F.array_distinct(_spellings(text)), lambda x: F.array_contains(told, F.lower(x)))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(spelled, "|"), F.lit(r")(?!\p{L})"))
    return common.let(pattern, lambda p: _places(text, p))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """The kept columns with n_email, n_ip, n_card, n_phone, base_sha256, spans and term_spans (array of s, e).

    A null or empty text has no spans. Equal texts have equal spans; an empty table gives an empty one.
    Kept columns that clash with the new or the kinds' names are an error.
    """
    taken = {*PATTERNS, "key", "row", "entities", "terms", "told", "text", "spans", "base_sha256", "term_spans", *(f"n_{k}" for k in PATTERNS)}
    if clash := taken & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken")
    scanned = scan(docs, text, keep)
    rows = scanned.drop("entities", "terms").join(common.sized(disclosing_terms(scanned, alpha, prior)), "key", "left")
    base = F.concat(*[_spelled(k, F.col(k)) for k in PATTERNS])
    found = F.transform(_told_places(F.col("text"), F.col("told")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    terms = F.when(F.col("told").isNotNull(), found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    # a term that lies in a base span is covered by it
    apart = lambda k: lambda x: ~F.exists(F.col(k), lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
    outside = reduce(lambda c, k: F.filter(c, apart(k)), PATTERNS, terms)
    rows = rows.withColumn("base", base).withColumn("term_spans", outside)
    return rows.select(
        *keep,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", _spelled("term", F.col("term_spans"))), ",").alias("spans"),
        "term_spans",
    )


def sanitise(text: Column, spans: Column) -> Column:
    """text with the spans of find() as <KIND> in place of what they cover; of overlapping spans the first to start stays."""
    parsed = F.sort_array(F.transform(F.filter(F.split(spans, ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"), F.split(x, ":")[0].alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.upper(x["k"]), F.lit(">"))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), put.alias("out")))

    return F.aggregate(parsed, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
