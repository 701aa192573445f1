"""The unified view of a data folder that the named queries start from, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.ids import canonical_article_id
from quillrank.functions.text import STOPWORDS, string_list
from quillrank.operators import features as ft
from quillrank.operators import splits as sp
from quillrank.sources.raw import first_per_key, vector_scan
from quillrank.sources.tables import table

HELD_OUT = "val"
SAMPLE = 20_000
LAST_N = 20
DIM = 64
#: The log's period. A time outside it, from a clock that is off by years, is no time as far as splits are concerned.
PERIOD = ("2023-12-01 00:00:00", "2024-03-01 00:00:00")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """One row per article: the one of the last feature build comes first."""
    rows = table(spark, d, "articles").filter(F.col("article_id").isNotNull())
    order = [F.asc_nulls_last(c) for c in ("popularity_rank", "published_time", "category", "n_tokens", "train_clicks")]
    return first_per_key(rows, ["article_id"], order)


def impressions(spark: SparkSession, d: str) -> DataFrame:
    """All rows with their split; those without a time, or with one outside the period, stay in ``train`` or ``test``."""
    rows = table(spark, d, "impressions")
    rows = rows.withColumn("inview_ids", string_list("inview_ids")).withColumn("clicked_ids", string_list("clicked_ids"))
    return sp.assign_splits(rows, HELD_OUT, val_days=2, period=PERIOD, check=False)


def split_meta(spark: SparkSession, d: str) -> DataFrame:
    return sp.split_meta(impressions(spark, d), PERIOD)


def split(spark: SparkSession, d: str, name: str) -> DataFrame:
    return impressions(spark, d).filter(F.col("split") == name)


def history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history").withColumn("article_id", canonical_article_id("article_id"))
    return rows.filter(F.col("user_id").isNotNull() & F.col("article_id").isNotNull() & F.col("snapshot").isNotNull() & F.col("position").isNotNull()).distinct()


def chosen(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "snapshots").select("snapshot", F.col("taken_at").alias("end_ts"))
    return sp.choose_snapshots(ends, split_meta(spark, d), strict=False)


def popularity(spark: SparkSession, d: str) -> DataFrame:
    return ft.train_popularity(articles(spark, d), split(spark, d, "train"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return ft.article_features(articles(spark, d), split(spark, d, "train"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    from quillrank.functions.text import index_text, tokenize

    return articles(spark, d).select("article_id", tokenize(index_text("title", "abstract")).alias("tokens"))


def units(spark: SparkSession, d: str) -> DataFrame:
    from quillrank.operators.semantic import align_vectors

    return align_vectors(articles(spark, d), vector_scan(table(spark, d, "document_vectors")), DIM)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return ft.history_flags(ft.click_counts(history(spark, d), chosen(spark, d)))


def test_sample(spark: SparkSession, d: str) -> DataFrame:
    return sp.sample_n(split(spark, d, "test"), SAMPLE)


def clicks(spark: SparkSession, d: str, users: DataFrame) -> DataFrame:
    return ft.recent_clicks(history(spark, d), chosen(spark, d), LAST_N, users.select("user_id", "split"))


def scored_lists(spark: SparkSession, d: str) -> DataFrame:
    """The stored candidates, each once, with missing scores as 0."""
    rows = table(spark, d, "per_imp").groupBy("impression_id", "article_id").agg(
        F.min("pos").alias("pos"), F.max("label").alias("label"),
        *[F.coalesce(F.max(F.when(~F.isnan(c), F.col(c))).cast("double"), F.lit(0.0)).alias(c) for c in ("bm25", "semantic", "popularity")])
    return rows.filter(F.col("label").isNotNull())


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS["en"])
_SUM64 = "list_sum(list_transform({v}, lambda x: x * x))"

#: Common table expressions of the same view; unused ones cost nothing.
SQL = rf"""
WITH art AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY popularity_rank NULLS LAST, published_time NULLS LAST,
    category NULLS LAST, n_tokens NULLS LAST, train_clicks NULLS LAST) AS rn FROM articles WHERE article_id IS NOT NULL) WHERE rn = 1),
imp0 AS (SELECT impression_id, source_impression_id, user_id, "timestamp", source_split,
    coalesce(list_filter(inview_ids, lambda x: x IS NOT NULL), []) AS inview_ids, coalesce(list_filter(clicked_ids, lambda x: x IS NOT NULL), []) AS clicked_ids
    FROM impressions),
timed AS (SELECT *, CASE WHEN "timestamp" >= TIMESTAMP '{PERIOD[0]}' AND "timestamp" < TIMESTAMP '{PERIOD[1]}' THEN "timestamp" END AS t FROM imp0),
newest AS (SELECT date_trunc('day', max(t)) - INTERVAL 1 DAY AS c FROM timed WHERE source_split IS DISTINCT FROM 'val'),
imp AS (SELECT timed.*, CASE WHEN source_split = 'val' THEN 'test' WHEN t >= c THEN 'val' ELSE 'train' END AS split FROM timed, newest),
meta AS (SELECT split, min(t) AS t_min, max(t) AS t_max FROM imp GROUP BY 1),
hist AS (SELECT DISTINCT user_id, 'N' || regexp_extract(article_id, '([0-9]{{9}})', 1) AS article_id, "timestamp", position, snapshot FROM history
    WHERE user_id IS NOT NULL AND article_id IS NOT NULL AND snapshot IS NOT NULL AND position IS NOT NULL),
chosen AS (SELECT split, arg_max(snapshot, taken_at) AS snapshot FROM meta JOIN snapshots ON taken_at <= t_min GROUP BY 1),
hs AS (SELECT hist.*, split FROM hist JOIN chosen USING (snapshot)),
pop AS (SELECT art.article_id, coalesce(n, 0) AS train_clicks FROM art LEFT JOIN
    (SELECT a, count(*) AS n FROM (SELECT unnest(clicked_ids) AS a FROM imp WHERE split = 'train') GROUP BY 1) ON a = art.article_id),
prank AS (SELECT *, row_number() OVER (ORDER BY train_clicks DESC, article_id) - 1 AS popularity_rank FROM pop),
head AS (SELECT *, popularity_rank < floor((SELECT count(*) FROM pop WHERE train_clicks > 0) * 0.2) AND train_clicks > 0 AS is_head FROM prank),
tok AS (SELECT article_id, list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{{L}}\p{{Nl}}\p{{No}}]+'),
    lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS tokens FROM art),
prof0 AS (SELECT user_id, split, count(*) AS n_clicks, max("timestamp") AS last_click_time, string_agg(article_id, ',' ORDER BY position, article_id) AS clicked FROM hs GROUP BY 1, 2),
prof AS (SELECT *, n_clicks < 5 AS is_cold, n_clicks <= quantile_cont(n_clicks::DOUBLE, 0.25) OVER (PARTITION BY split) AS is_low_history FROM prof0),
samp AS (SELECT * FROM imp WHERE split = 'test'),
drawn AS (SELECT * FROM samp ORDER BY cast('0x' || substr(md5(impression_id || ':13'), 1, 8) AS BIGINT), impression_id LIMIT {SAMPLE}),
su AS (SELECT DISTINCT user_id, split FROM samp WHERE user_id IS NOT NULL),
clk AS (SELECT user_id, split, article_id, age FROM (SELECT hs.*, row_number() OVER (PARTITION BY user_id, split ORDER BY position DESC, article_id DESC) - 1 AS age
    FROM hs JOIN su USING (user_id, split)) WHERE age < {LAST_N}),
tf AS (SELECT article_id, term, len(tokens) AS dl, count(*) AS tf FROM (SELECT article_id, tokens, unnest(tokens) AS term FROM tok) GROUP BY ALL),
dfr AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM tok) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1),
post AS (SELECT article_id, tf.term, tf, idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avg(len(tokens)) FROM tok))) AS weight FROM tf JOIN dfr USING (term)),
qt AS (SELECT user_id, split, term, count(*) AS qtf FROM (SELECT user_id, split, unnest(tokens) AS term FROM clk JOIN tok USING (article_id)) GROUP BY ALL),
vec0 AS (SELECT article_id, max(document_vector::DOUBLE[]) AS v FROM document_vectors WHERE len(document_vector) = 64
    AND len(list_filter(document_vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 GROUP BY 1),
vec AS (SELECT art.article_id, CASE WHEN v IS NULL THEN list_transform(range(64), lambda x: 0.0::DOUBLE)
    ELSE list_transform(v, lambda x: x / greatest(sqrt({_SUM64.format(v='v')}), 1e-12)) END AS unit,
    coalesce({_SUM64.format(v='v')} > 0, FALSE) AS has_vector FROM art LEFT JOIN vec0 USING (article_id)),
cand AS (SELECT impression_id, user_id, split, pos, article_id, (list_contains(clicked_ids, article_id))::INT AS label FROM
    (SELECT impression_id, user_id, split, clicked_ids, unnest(inview_ids) AS article_id, generate_subscripts(inview_ids, 1)::INT - 1 AS pos FROM samp)),
pairs AS (SELECT DISTINCT user_id, split, article_id FROM cand WHERE user_id IS NOT NULL),
uv0 AS (SELECT user_id, split, i, avg(x) AS m FROM (SELECT user_id, split, unnest(unit) AS x, generate_subscripts(unit, 1) AS i FROM clk JOIN vec USING (article_id)) GROUP BY ALL),
uv AS (SELECT user_id, split, list_transform(m, lambda x: x / greatest(sqrt({_SUM64.format(v='m')}), 1e-12)) AS unit FROM
    (SELECT user_id, split, list(m ORDER BY i) AS m FROM uv0 GROUP BY ALL)),
stored AS (SELECT impression_id, article_id, min(pos) AS pos, max(label) AS label,
    {", ".join(f"coalesce(max(CASE WHEN NOT isnan({c}) THEN {c} END)::DOUBLE, 0) AS {c}" for c in ("bm25", "semantic", "popularity"))}
    FROM per_imp GROUP BY 1, 2 HAVING max(label) IS NOT NULL),
rnd AS (SELECT *, cast('0x' || substr(md5(impression_id || ':' || pos || ':13'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS random FROM stored),
sc AS ({" UNION ALL ".join(f"SELECT impression_id, pos, article_id, label, '{c}' AS scorer, {c} AS score FROM rnd" for c in ("random", "popularity", "bm25", "semantic"))}),
rk AS (SELECT *, row_number() OVER (PARTITION BY scorer, impression_id ORDER BY score DESC, pos) AS rank,
    rank() OVER (PARTITION BY scorer, impression_id ORDER BY score) + (count(*) OVER (PARTITION BY scorer, impression_id, score) - 1) / 2.0 AS up_rank FROM sc),
acc AS (SELECT scorer, impression_id,
    CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(CASE WHEN label = 1 THEN up_rank ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))::DOUBLE END AS auc,
    CASE WHEN sum(label) > 0 THEN sum(label / rank::DOUBLE) / sum(label) ELSE 0 END AS mrr,
    {", ".join(f"CASE WHEN sum(label) > 0 THEN sum(CASE WHEN rank <= {k} THEN label / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(sum(label)::BIGINT, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_{k}" for k in (5, 10))}
    FROM rk GROUP BY ALL),
top AS (SELECT * FROM rk WHERE rank <= 10),
flags AS (SELECT i.impression_id, i.user_id, i.split, coalesce(p.is_low_history, FALSE) AS cold,
    list_has_any(i.clicked_ids, (SELECT coalesce(list(article_id), []) FROM head WHERE is_head)) AS is_head
    FROM imp i LEFT JOIN prof p ON p.user_id = i.user_id AND p.split = i.split)
"""
