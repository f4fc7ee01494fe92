"""Queries of the operators for training data, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import canonical, mixing, neardup, places, tokens, truth
from millrace.session import table

POSTING_FIELDS = ("title", "company_name", "description_text")
#: One posting: at least half of all three-word sequences are shared.
POSTING = neardup.Similar(words=3, threshold=0.5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(table(spark, sf_dir, "normalized_jobs"), "record_id", POSTING_FIELDS, POSTING, required="description_text")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "normalized_jobs"), "record_id", POSTING_FIELDS, POSTING, required="description_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.resolve(table(spark, sf_dir, "normalized_jobs"), table(spark, sf_dir, "places"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.unmatched(table(spark, sf_dir, "normalized_jobs"), table(spark, sf_dir, "places"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = truth.representatives(table(spark, sf_dir, "job_sources"), table(spark, sf_dir, "feed_sources"))
    return best.select("group_id", "best_source_row_id")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.survivors(table(spark, sf_dir, "job_sources"), table(spark, sf_dir, "feed_sources"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.pairs(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.forms(table(spark, sf_dir, "documents")).select("doc_id", "form")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_unmatched, p3_found, p3_survivors, p7_ids, p8_mix, p8_shares, p9_found, p9_forms, p9_classes)
}

_SHARED_KEYS = """
    keyed AS (
        SELECT source_row_id AS id, 'u' || apply_url_hash AS k FROM job_sources WHERE apply_url_hash IS NOT NULL
        UNION ALL SELECT source_row_id, 'f' || content_fingerprint FROM job_sources WHERE content_fingerprint IS NOT NULL
    ),
    edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keyed a JOIN keyed b USING (k)),
    reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
    member AS (SELECT a AS source_row_id, min(b) AS group_id FROM reach GROUP BY a HAVING count(DISTINCT b) > 1)
"""

_GAPS = ", ".join("'" + w + "'" for w in truth.GAP_WORDS)
_FULL = " + ".join(f"(CASE WHEN lower(trim(coalesce(CAST(s.{f} AS VARCHAR), ''))) NOT IN ({_GAPS}) THEN 1 ELSE 0 END)" for f in truth.FULLNESS_FIELDS)

ORACLE_SQL: dict[str, str] = {
    "p1_found": r"""
        WITH texts AS (
            SELECT record_id, regexp_extract_all(lower(concat_ws(' ', title, company_name, description_text)), '[\p{L}\p{N}]+') AS w
            FROM normalized_jobs WHERE trim(coalesce(description_text, '')) <> ''
        ),
        grams AS (
            SELECT record_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS g FROM texts
        ),
        sizes AS (SELECT record_id, count(*) AS n FROM grams GROUP BY record_id),
        shared AS (
            SELECT a.record_id AS x, b.record_id AS y, count(*) AS n
            FROM grams a JOIN grams b ON a.g = b.g AND a.record_id < b.record_id GROUP BY ALL
        ),
        alike AS (
            SELECT x, y FROM shared JOIN sizes p ON p.record_id = x JOIN sizes q ON q.record_id = y WHERE 2 * shared.n >= p.n + q.n - shared.n
        )
        SELECT x AS record_id_a, y AS record_id_b FROM alike
        UNION SELECT a.record_id, b.record_id FROM texts a JOIN texts b ON a.w = b.w AND a.record_id < b.record_id
    """,
    "p3_found": f"""
        WITH RECURSIVE {_SHARED_KEYS},
        measured AS (
            SELECT m.group_id, s.source_row_id, {_FULL} AS fullness, s.last_updated_at, coalesce(f.trust_rank, 2147483647) AS trust
            FROM job_sources s JOIN member m USING (source_row_id) LEFT JOIN feed_sources f USING (source)
        )
        SELECT group_id, min(source_row_id) AS best_source_row_id FROM measured a
        WHERE NOT EXISTS (
            SELECT 1 FROM measured b WHERE b.group_id = a.group_id AND b.fullness >= a.fullness AND b.last_updated_at >= a.last_updated_at
              AND b.trust <= a.trust AND (b.fullness > a.fullness OR b.last_updated_at > a.last_updated_at OR b.trust < a.trust)
        ) GROUP BY group_id
    """,
}
