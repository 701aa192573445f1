"""Queries of the general problems: hot keys (2) and attributes as of an event (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.ids import canonical_article_id
from quillrank.operators.cut import cut
from quillrank.operators.eventtime import attributes_as_of, facts_as_of, known_facts
from quillrank.operators.keystats import heavy_keys, key_stats
from quillrank.sources.tables import table


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history").withColumn("article_id", canonical_article_id("article_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # one row per article: small against the input, and read twice
    stats = cut(key_stats(_history(spark, d), "article_id", "user_id", "timestamp"))
    return heavy_keys(stats, "article_id", "clicks", 0.01).select("article_id")


def p2_article_clicks(spark: SparkSession, d: str) -> DataFrame:
    return key_stats(_history(spark, d), "article_id", "user_id", "timestamp")


def _as_of(spark: SparkSession, d: str, how: str) -> DataFrame:
    return attributes_as_of(
        table(spark, d, "impressions"), _history(spark, d), table(spark, d, "snapshots"),
        event_time="timestamp", entity="user_id", how=how,
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, "inner").select("impression_id", "article_id")


def p7_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, "left").select("impression_id", "known_version", "article_id", "position", "known_last")


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    return facts_as_of(table(spark, d, "impressions"), _history(spark, d), table(spark, d, "snapshots"), event_time="timestamp", entity="user_id")


def p7_known_history(spark: SparkSession, d: str) -> DataFrame:
    return known_facts(table(spark, d, "impressions"), _history(spark, d), table(spark, d, "snapshots"), event_time="timestamp", entity="user_id")


QUERIES = {"p2_found": p2_found, "p2_article_clicks": p2_article_clicks, "p7_found": p7_found, "p7_attributes": p7_attributes, "p7_history": p7_history,
           "p7_known_history": p7_known_history}

_HISTORY = """
h AS (SELECT DISTINCT user_id, CASE WHEN regexp_matches(article_id, '[0-9]{9}')
        THEN 'N' || regexp_extract(article_id, '([0-9]{9})', 1) END AS article_id, "timestamp", position, snapshot FROM history)
"""
_AS_OF = f"""
WITH {_HISTORY},
v AS (SELECT i.impression_id, i.user_id, i."timestamp" AS at, arg_max(s.snapshot, s.taken_at) AS snapshot
      FROM impressions i LEFT JOIN snapshots s ON s.taken_at <= i."timestamp" GROUP BY ALL),
j AS (SELECT v.impression_id, v.snapshot AS known_version, h.article_id, h.position, h."timestamp" AS t
      FROM v LEFT JOIN h ON h.user_id = v.user_id AND h.snapshot = v.snapshot AND h.article_id IS NOT NULL
        AND (h."timestamp" IS NULL OR h."timestamp" <= v.at)),
r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY position DESC NULLS LAST, article_id DESC) AS rn,
        max(t) OVER (PARTITION BY impression_id) AS known_last FROM j)
"""
ORACLE = {
    "p2_found": f"WITH {_HISTORY} SELECT article_id FROM h WHERE article_id IS NOT NULL GROUP BY article_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM h)",
    "p2_article_clicks": f'WITH {_HISTORY} SELECT article_id, count(*)::BIGINT AS clicks, count(DISTINCT user_id)::BIGINT AS users, max("timestamp") AS last_click FROM h GROUP BY article_id',
    "p7_found": _AS_OF + "SELECT impression_id, article_id FROM r WHERE rn = 1 AND article_id IS NOT NULL",
    "p7_history": _AS_OF + "SELECT impression_id, article_id, position FROM j WHERE article_id IS NOT NULL",
    "p7_known_history": _AS_OF + """, s AS (SELECT snapshot, taken_at, lead(taken_at) OVER (ORDER BY taken_at, snapshot) AS until FROM (SELECT DISTINCT snapshot, taken_at FROM snapshots
    WHERE snapshot IS NOT NULL AND taken_at IS NOT NULL))
SELECT v.impression_id, v.user_id, v.snapshot, v.at AS event_time, count(j.article_id)::BIGINT AS n_known, NULL::TIMESTAMP AS valid_time, NULL::VARCHAR AS article_id, NULL::INT AS position
FROM v LEFT JOIN j USING (impression_id) WHERE v.user_id IS NOT NULL AND v.snapshot IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, h.user_id, h.snapshot, NULL, NULL, h."timestamp", h.article_id, h.position FROM h JOIN s USING (snapshot)
WHERE h.user_id IS NOT NULL AND h.article_id IS NOT NULL AND (until IS NULL OR coalesce(greatest(h."timestamp", taken_at), taken_at) < until)""",
    "p7_attributes": _AS_OF + "SELECT impression_id, known_version, article_id, position, known_last FROM r WHERE rn = 1",
}
