"""Line dedup: lines that stand on many sites are boilerplate and are removed everywhere.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation. Lines whose
estimate is near the threshold get an exact count of distinct sites; others are
decided by the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Sites on which a line must stand to be removed.
LEAST_SITES = 10
#: Log2 of the sketch's registers; the relative standard error is 1.04 / sqrt(2 ** LG).
LG = 10
#: Standard errors around the threshold within which the count is exact.
BAND = 4


def normalised(line: Column) -> Column:
    """A line without outer white space and with its inner runs as single spaces."""
    return F.trim(F.regexp_replace(line, common.SPACE + "+", " "))


def _line_hash(line: Column) -> Column:
    text = normalised(line)
    return F.when(text != "", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b")))


def _hashes(text: Column) -> Column:
    """Hashes of the lines, null for blank ones."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _line_hash)


def hashed(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """For each row the text's key, the site's hash (null for none) and the hashes of the lines, stored: texts are hashed once."""
    return common.stored(docs.select(common.content_key(F.col(text)).alias("key"), F.when(F.col(site).isNotNull(), F.xxhash64(site)).alias("site"), _hashes(F.col(text)).alias("lines")), "lines-hashed")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", least_sites: int = LEAST_SITES, lg: int = LG) -> DataFrame:
    """The 128-bit hashes (line) and site counts (sites) of lines on at least least_sites distinct sites, stored.

    sites is exact near the threshold and an estimate above it. A null site is no site. Blank lines never count.
    """
    known = hashed(docs, text, site)
    found = _widespread(known, least_sites, lg)
    common.drop(known)
    return found


def _widespread(known: DataFrame, least_sites: int, lg: int) -> DataFrame:
    """What boilerplate returns, from hashed()'s rows."""
    rows = known.where("site is not null").select("site", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null").select("line", "site")
    error = BAND * 1.04 / 2 ** (lg / 2)
    low, high = least_sites * (1 - error) - 1, least_sites * (1 + error) + 1
    # a line's rows must be as many as the sites asked for; that is cheaper to know than the sketch
    often = rows.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least_sites).select("line")
    often = common.stored(often, "lines-often")
    rows = rows.join(common.sized(often), "line", "left_semi")
    sketches = rows.groupBy("line", F.pmod(F.col("site"), F.lit(16)).alias("deal")).agg(F.hll_sketch_agg("site", lg).alias("sketch"))
    found = sketches.groupBy("line").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")).where(F.col("sites") >= low)
    found = common.stored(found, "lines-estimates")
    near = found.where(F.col("sites") <= high).select("line")
    exact = rows.join(common.sized(near), "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= least_sites)
    return common.stored(found.where(F.col("sites") > high).unionByName(exact), "lines-boilerplate")


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", least_sites: int = LEAST_SITES, lg: int = LG) -> DataFrame:
    """docs with text less its boilerplate lines, and n_lines and n_removed; other columns and rows as they are.

    A text is cut at each newline; removed lines go with one newline each. A null text stays null with 0 lines and an empty one
    has one blank line. Repeated rows are treated alike; rows with a null site lose boilerplate too.
    Columns named n_lines or n_removed are an error.
    """
    if clash := {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    known = hashed(docs, text, site)
    found = _widespread(known, least_sites, lg).select("line")
    key = common.free_name(docs, "text_key")
    hits = known.select(F.col("key").alias(key), F.posexplode("lines").alias("at", "line")).where("line is not null")
    hits = hits.join(common.sized(found), "line", "left_semi").groupBy(key).agg(F.collect_set("at").alias(key + "_at"))
    hits = common.stored(hits, "lines-hits")
    common.drop(known)
    out = docs.withColumn(key, common.content_key(F.col(text))).join(common.sized(hits), key, "left")
    gone = F.col(key + "_at")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return out.select(
        *[F.when(gone.isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
