"""The queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, lines, media, mixing, neardup, pii, pieces, quality, substrings, warc


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(pieces.encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model_path()))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("term_spans")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = lambda m: F.concat_ws(":", m["license_id"], m["start"].cast("string"), m["end"].cast("string"), m["matched"].cast("string"), m["words"].cast("string"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform("matches", span), ",").alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, t=85)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("shard", "offset", "digest")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_warc, op3_line_dedup, op4_quality, op5_pii, op6_licenses, op7_substring_dedup, op8_near_dedup, op9_mixing, op10_media)}

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p),
d AS (SELECT *, unhex(sha1(html)) AS b FROM m),
bits AS (SELECT page_id, strlen(html) AS n, first, sha1(html) AS h FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (('0x' || h[1 + 10 * (i // 8) : 10 + 10 * (i // 8)])::BIGINT >> (35 - 5 * (i % 8)) & 31)::INT], '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM bits
""",
    "op3_line_dedup": f"""
WITH raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm FROM raw),
b AS (SELECT norm FROM n WHERE norm <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {lines.LEAST_SITES}),
k AS (SELECT n.*, b.norm IS NOT NULL AS gone FROM n LEFT JOIN b USING (norm))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
""",
    "op4_quality": quality.ORACLE_SQL,
}
