"""The thin queries op1 .. op10, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_groups
from .fingerprints import fingerprint_documents
from .html_extract import extract
from .mixing import BUCKETS, SEED, mix
from .near_dedup import near_duplicates
from .quality import quality_scores
from .segmentation import sample_segmentations
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .url_filter import judge_urls


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays of its group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of near duplicates that it is in."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its tokens."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages judged by the rules."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labels that are not held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with two distinct sampled segmentations, decoded again."""
    return sample_segmentations(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"))


#: A-Z lower-cased in DuckDB.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format('text')}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h)""",
    "op4_url_filter": f"""
        WITH r(kind, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                      ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        m AS (SELECT page_id, h || p AS rule, kind,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, kind DESC) AS n
              FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT s.page_id, host, path, m.rule, coalesce(m.kind, 'allow') AS verdict
        FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.n = 1""",
    "op5_mixing": f"""
        WITH d AS (SELECT doc_id, source,
                          CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS words,
                          substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 12) AS draw FROM documents),
        b AS (SELECT *, cast(('0x' || substr(draw, 1, 3)) AS INTEGER) % {BUCKETS} AS bucket FROM d),
        s AS (SELECT source, sum(words)::BIGINT AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
              FROM b GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY 3 * size / weight, source NULLS LAST) AS n FROM s),
        c AS (SELECT *, sum(size) OVER () - coalesce(sum(3 * size) OVER before, 0) AS rest,
                     sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
              FROM o WINDOW before AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        k AS (SELECT *, rest * weight > 3 * size * open AS clamped FROM c),
        f AS (SELECT rest AS f_rest, open AS f_open FROM k WHERE NOT clamped ORDER BY n LIMIT 1),
        t AS (SELECT source, size AS source_size,
                     CASE WHEN clamped THEN cast(3 * size AS DOUBLE)
                          ELSE cast(weight * (SELECT f_rest FROM f) AS DOUBLE) / (SELECT f_open FROM f) END AS target FROM k),
        p AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket, draw, doc_id, words
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM b),
        e AS (SELECT doc_id, words, source_size, target, ahead,
                     CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
              FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, cast(words AS BIGINT) AS size, source_size, target, cast(g AS BIGINT) AS copies,
               cast(g * words AS BIGINT) AS taken
        FROM (SELECT *, CASE WHEN words > 0 THEN whole + CASE WHEN ahead + words / 2.0 < target - whole * source_size THEN 1 ELSE 0 END
                             ELSE 0 END AS g FROM e)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
