"""Named queries of the ranking pipeline, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.text import last_n
from quillrank.functions.vectors import l2_normalize
from quillrank.operators import evaluate as ev
from quillrank.operators import features as ft
from quillrank.operators import hybrid as hy
from quillrank.operators import lexical as lx
from quillrank.operators import metrics as mt
from quillrank.operators import scoring as sc
from quillrank.operators import semantic as sm
from quillrank.operators import splits as sp
from quillrank.operators import submission as sub
from quillrank.operators.cut import cut
from quillrank.plans import base
from quillrank.sources import raw
from quillrank.sources.adapters import adapt_articles
from quillrank.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Coefficients of a fixed combination, where a query must not depend on a fit.
FIXED = {"bm25": 0.767, "semantic": 1.516, "intercept": -0.8}


def query(sql: str | None = None, view: bool = True):
    """Register a query under its function's name; ``sql`` is run over the common view."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (base.SQL + sql) if view else sql
        return f

    return keep


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# scans and adapters ---------------------------------------------------------------------

@query("SELECT article_id, title, abstract, category, published_time, n_tokens, train_clicks, popularity_rank, is_head FROM articles", view=False)
def scan_articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").drop("tokens")


@query("SELECT impression_id, source_impression_id, user_id, source_split, len(inview_ids) AS n_inview, len(clicked_ids) AS n_clicked FROM impressions", view=False)
def scan_impressions(spark: SparkSession, d: str) -> DataFrame:
    from quillrank.schema import validate

    rows = validate(table(spark, d, "impressions"), "impressions")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return rows.select("impression_id", "source_impression_id", "user_id", "source_split", size("inview_ids").alias("n_inview"), size("clicked_ids").alias("n_clicked"))


@query("SELECT article_id, len(document_vector) AS dim FROM document_vectors", view=False)
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = raw.vector_scan(table(spark, d, "document_vectors"))
    return rows.select("article_id", F.when(F.col("vec").isNotNull(), F.size("vec")).cast("bigint").alias("dim"))


@query("SELECT article_id, title, abstract, category, popularity_rank FROM art")
def dedup_articles(spark: SparkSession, d: str) -> DataFrame:
    return base.articles(spark, d).select("article_id", "title", "abstract", "category", "popularity_rank")


@query("""SELECT impression_id, array_to_string(inview_ids, ',') AS shown, array_to_string(list_filter(inview_ids, lambda x: list_contains(clicked_ids, x)), ',') AS clicked FROM imp0""")
def parse_impressions(spark: SparkSession, d: str) -> DataFrame:
    """Lists packed to one text per impression and parsed again."""
    rows = base.impressions(spark, d)
    packed = F.array_join(F.transform("inview_ids", lambda x: F.concat(x, F.when(F.array_contains("clicked_ids", x), "-1").otherwise("-0"))), " ")
    shown, clicked = raw.parse_candidates("_packed")
    return rows.withColumn("_packed", packed).select("impression_id", F.array_join(shown, ",").alias("shown"), F.array_join(clicked, ",").alias("clicked"))


@query("""SELECT impression_id AS source_id, row_number() OVER (ORDER BY source_split, source_impression_id, impression_id) - 1 AS new_id FROM imp0""")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = base.impressions(spark, d).select("source_split", "source_impression_id", F.col("impression_id").alias("source_id"))
    return raw.surrogate_ids(rows, ["source_split", "source_impression_id", "source_id"], "new_id").select("source_id", "new_id")


@query("""SELECT impression_id, user_id, "timestamp", article_id, list_contains(clicked_ids, article_id)::INT AS label FROM (SELECT *, unnest(inview_ids) AS article_id FROM imp0)""")
def explode_candidates(spark: SparkSession, d: str) -> DataFrame:
    return sp.explode_candidates(base.impressions(spark, d)).drop("pos")


@query("""SELECT doc_id::VARCHAR AS article_id, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(source, '') AS category, coalesce(lang, '') AS subcategory, published_time FROM documents""", view=False)
def adapt_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    nested = docs.select(
        F.col("doc_id").alias("article_id"), first_line.alias("title"), F.lit(None).cast("string").alias("subtitle"), F.col("text").alias("body"),
        F.col("source").alias("category_str"), F.array("lang").alias("subcategory"), F.array().cast("array<string>").alias("ner_clusters"), "published_time")
    return adapt_articles(nested).select("article_id", "title", "category", "subcategory", "published_time")


@query("""SELECT user_id, snapshot, article_id, position, "timestamp" FROM (SELECT user_id, snapshot, unnest(ids) AS article_id, unnest(ts) AS "timestamp", generate_subscripts(ids, 1)::INT - 1 AS position
  FROM (SELECT user_id, snapshot, list(article_id ORDER BY position, article_id, "timestamp" NULLS FIRST) AS ids, list("timestamp" ORDER BY position, article_id, "timestamp" NULLS FIRST) AS ts
        FROM hist GROUP BY 1, 2))""")
def history_explode(spark: SparkSession, d: str) -> DataFrame:
    packed = base.history(spark, d).groupBy("user_id", "snapshot").agg(F.array_sort(F.collect_list(F.struct("position", "article_id", "timestamp"))).alias("x"))
    lists = packed.select("user_id", "snapshot", F.col("x.article_id").alias("ids"), F.col("x.timestamp").alias("ts"))
    return raw.history_rows(lists, "user_id", "ids", "ts", F.col("snapshot"))


@query("""SELECT user_id, arg_min(snapshot, (position, snapshot, article_id)) AS snapshot, arg_min(article_id, (position, snapshot, article_id)) AS article_id FROM hist GROUP BY 1""")
def first_history(spark: SparkSession, d: str) -> DataFrame:
    rows = base.history(spark, d).select("user_id", "snapshot", "article_id", "position").distinct()
    return raw.first_per_key(rows, ["user_id"], [F.col("position"), F.col("snapshot"), F.col("article_id")]).select("user_id", "snapshot", "article_id")


@query("""SELECT source, count(*) AS n_ids, round(100.0 * count(a.article_id) / count(*), 6)::DOUBLE AS pct_known FROM (
  SELECT DISTINCT 'inview' AS source, unnest(inview_ids) AS id FROM imp0 UNION ALL SELECT DISTINCT 'clicked', unnest(clicked_ids) FROM imp0
  UNION ALL SELECT DISTINCT 'history', article_id FROM hist) LEFT JOIN art a ON a.article_id = id GROUP BY 1""")
def ref_integrity(spark: SparkSession, d: str) -> DataFrame:
    return sp.reference_report(base.impressions(spark, d), base.history(spark, d), base.articles(spark, d)).withColumn("pct_known", F.round("pct_known", 6))


@query("SELECT impression_id, user_id FROM imp0 ORDER BY impression_id LIMIT 1000")
def limit_impressions(spark: SparkSession, d: str) -> DataFrame:
    return base.impressions(spark, d).orderBy("impression_id").limit(1000).select("impression_id", "user_id")


@query("""SELECT impression_id, date_trunc('second', "timestamp") AS "timestamp" FROM imp0""")
def parse_time(spark: SparkSession, d: str) -> DataFrame:
    """Times written in the log's text format and parsed again."""
    rows = base.impressions(spark, d).withColumn("_text", F.date_format("timestamp", raw.BEHAVIOR_TIME))
    return rows.select("impression_id", raw.parse_time("_text").alias("timestamp"))


@query("SELECT article_id, coalesce(category, '') AS labels FROM art")
def entity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Categories wrapped as JSON entities, once twice and next to broken elements."""
    rows = base.articles(spark, d).select("article_id", F.coalesce("category", F.lit("")).alias("Label"))
    one = F.to_json(F.struct("Label"))
    blob = F.concat(F.lit("["), one, F.lit(", 7, "), one, F.lit("]"))
    return rows.select("article_id", F.array_join(raw.entity_labels(blob, F.lit("bad{")), ",").alias("labels"))


@query("SELECT article_id, coalesce(category, '') AS category FROM art")
def scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Ids and categories written as a headerless TSV file and scanned again."""
    import uuid

    from quillrank.operators.cut import shared_dir

    path = f"{shared_dir(spark)}/quillrank-{uuid.uuid4().hex}"
    base.articles(spark, d).select("article_id", "category").write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return raw.scan_tsv(spark, path, ("article_id", "category")).select("article_id", "category")


# splits ---------------------------------------------------------------------------------

@query("""SELECT impression_id, CASE WHEN source_split = 'val' THEN 'test' WHEN "timestamp" >= TIMESTAMP '2024-01-18' AND "timestamp" < TIMESTAMP '2024-01-20' THEN 'val' ELSE 'train' END AS split FROM imp0""")
def split_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = base.impressions(spark, d).drop("split")
    return sp.assign_splits(rows, "val", val=("2024-01-18", "2024-01-19"), check=False).select("impression_id", "split")


@query("SELECT impression_id, split FROM imp")
def split_val_days(spark: SparkSession, d: str) -> DataFrame:
    return base.impressions(spark, d).select("impression_id", "split")


@query("""SELECT split, count(*) AS n_impressions, count(DISTINCT user_id) AS n_users, sum(len(clicked_ids))::BIGINT AS n_clicks, min(t) AS t_min, max(t) AS t_max,
  string_agg(DISTINCT source_split, ',' ORDER BY source_split) AS sources FROM imp GROUP BY 1""")
def split_meta(spark: SparkSession, d: str) -> DataFrame:
    return base.split_meta(spark, d)


@query("SELECT split, snapshot FROM chosen")
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return base.chosen(spark, d)


@query("SELECT b.split, a.split AS prev_split, a.t_max < b.t_min AS is_disjoint FROM meta a JOIN meta b ON (a.split, b.split) IN (('train', 'val'), ('val', 'test'))")
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return sp.split_order(base.split_meta(spark, d))


# feature store --------------------------------------------------------------------------

@query("SELECT * FROM pop")
def train_popularity(spark: SparkSession, d: str) -> DataFrame:
    return base.popularity(spark, d)


@query("SELECT article_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INT AS n_tokens FROM tok")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return base.tokens(spark, d).select("article_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query("SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl, max(len(tokens))::INT AS max_dl, count(*) FILTER (WHERE len(tokens) = 0) AS n_empty FROM tok")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.size("tokens")
    return base.tokens(spark, d).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(n), 6).alias("avgdl"), F.max(n).alias("max_dl"), F.count_if(n == 0).alias("n_empty"))


@query("SELECT * FROM prank")
def popularity_rank(spark: SparkSession, d: str) -> DataFrame:
    return ft.popularity_rank(base.popularity(spark, d))


@query("SELECT article_id, is_head FROM head")
def head_band(spark: SparkSession, d: str) -> DataFrame:
    return ft.head_band(ft.popularity_rank(base.popularity(spark, d))).select("article_id", "is_head")


@query("SELECT user_id, split, clicked AS clicked_ids, n_clicks::INT AS n_clicks, last_click_time, is_cold, is_low_history FROM prof")
def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    found = ft.user_profiles(base.history(spark, d), base.chosen(spark, d))
    return found.withColumn("clicked_ids", F.array_join("clicked_ids", ","))


@query("SELECT split, is_cold, count(*) AS n_users FROM prof GROUP BY ALL")
def cold_flags(spark: SparkSession, d: str) -> DataFrame:
    return base.profiles(spark, d).groupBy("split", "is_cold").agg(F.count(F.lit(1)).alias("n_users"))


@query("SELECT user_id, split FROM prof WHERE is_low_history")
def low_history(spark: SparkSession, d: str) -> DataFrame:
    return base.profiles(spark, d).filter("is_low_history").select("user_id", "split")


@query("SELECT round((sum(CASE WHEN popularity_rank < greatest(1, (SELECT count(*) FROM pop) // 100) THEN train_clicks ELSE 0 END) / greatest(1, sum(train_clicks)))::DOUBLE, 6) AS top_share FROM prank")
def top1pct_share(spark: SparkSession, d: str) -> DataFrame:
    return ft.top_share(ft.popularity_rank(base.popularity(spark, d))).select(_r("top_share"))


@query("""SELECT 'articles' AS part, count(*) AS n, count(*) FILTER (WHERE train_clicks > 0) AS n_flagged, round(avg(len(tokens)), 6) AS mean_size FROM tok JOIN pop USING (article_id)
  UNION ALL SELECT split, count(*), count(*) FILTER (WHERE is_low_history), round(avg(n_clicks), 6) FROM prof GROUP BY split""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    a = ft.feature_stats(base.features(spark, d)).select(F.lit("articles").alias("part"), F.col("n_articles").alias("n"), F.col("n_clicked").alias("n_flagged"), F.round("mean_tokens", 6).alias("mean_size"))
    p = ft.profile_stats(base.profiles(spark, d)).select(F.col("split").alias("part"), F.col("n_users").alias("n"), F.col("n_low_history").alias("n_flagged"), F.round("mean_clicks", 6).alias("mean_size"))
    return a.unionByName(p)


@query("SELECT user_id, n_clicks::INT AS n_clicks FROM prof JOIN su USING (user_id, split)")
def profiles_semi(spark: SparkSession, d: str) -> DataFrame:
    users = base.split(spark, d, "test").select("user_id", "split").distinct()
    return base.profiles(spark, d).join(users, ["user_id", "split"], "left_semi").select("user_id", "n_clicks")


@query("SELECT impression_id FROM drawn")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return base.test_sample(spark, d).select("impression_id")


# pools and lexical retrieval ------------------------------------------------------------

@query("SELECT article_id FROM art WHERE article_id IN (SELECT unnest(inview_ids) FROM samp)")
def pool_circulating(spark: SparkSession, d: str) -> DataFrame:
    return ft.build_pool(base.articles(spark, d), base.split(spark, d, "test"), "circulating")[0]


@query("""SELECT article_id FROM art WHERE published_time <= (SELECT max(t) FROM samp)""")
def pool_fresh(spark: SparkSession, d: str) -> DataFrame:
    test = base.split(spark, d, "test").withColumn("timestamp", sp.within(F.col("timestamp"), base.PERIOD))
    return ft.build_pool(base.articles(spark, d), test, "fresh")[0]


@query("SELECT article_id, term, tf, round(weight, 6) AS weight FROM post")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return lx.postings(base.tokens(spark, d)).select("article_id", "term", "tf", _r("weight"))


@query("SELECT term, df, round(idf, 6) AS idf FROM dfr")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return lx.document_frequencies(base.tokens(spark, d)).select("term", "df", _r("idf"))


@query("SELECT * FROM qt")
def bm25_queries(spark: SparkSession, d: str) -> DataFrame:
    return lx.query_terms(base.clicks(spark, d, base.split(spark, d, "test")), base.tokens(spark, d))


_BM25_TOP = """SELECT user_id, split, article_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, split ORDER BY score DESC, article_id) AS rank FROM
  (SELECT user_id, split, article_id, round(sum(qtf * weight), 9) AS score FROM qt JOIN post USING (term) {where} GROUP BY ALL)) WHERE rank <= {k}"""


def _retrieve(spark: SparkSession, d: str, impressions: DataFrame, k: int, pool: str = "all") -> DataFrame:
    features = cut(base.tokens(spark, d))
    ids = ft.build_pool(base.articles(spark, d), impressions, pool)[0]
    return lx.retrieve_clicked(base.clicks(spark, d, impressions), features, ids, k)


@query("SELECT user_id, article_id, round(score, 6) AS score, rank::INT AS rank FROM (" + _BM25_TOP.format(where="", k=50) + ")")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _retrieve(spark, d, base.split(spark, d, "test"), 50).select("user_id", "article_id", _r("score"), "rank")


@query("SELECT user_id, article_id, round(coalesce(s, 0), 6) AS bm25 FROM pairs LEFT JOIN (SELECT user_id, split, article_id, sum(qtf * weight) AS s FROM pairs JOIN post USING (article_id) JOIN qt USING (user_id, split, term) GROUP BY ALL) USING (user_id, split, article_id)")
def bm25_score_pairs(spark: SparkSession, d: str) -> DataFrame:
    features, test = cut(base.tokens(spark, d)), base.split(spark, d, "test")
    pairs = _pairs(test)
    return lx.score_pairs(pairs, lx.query_terms(base.clicks(spark, d, test), features), lx.postings(features)).select("user_id", "article_id", _r("bm25"))


_RECALL = """, got AS ({top}), c AS (SELECT user_id, split, unnest(clicked_ids) AS article_id FROM drawn JOIN (SELECT user_id, split FROM prof) USING (user_id, split))
SELECT count(*) AS n_clicks, round(count(*) FILTER (WHERE rank <= 50) / count(*)::DOUBLE, 6) AS recall_50, round(count(*) FILTER (WHERE rank <= 100) / count(*)::DOUBLE, 6) AS recall_100,
  round(count(*) FILTER (WHERE rank <= 200) / count(*)::DOUBLE, 6) AS recall_200 FROM c LEFT JOIN got USING (user_id, split, article_id)"""


def _recall(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    out = lx.recall_at(base.test_sample(spark, d), found, base.profiles(spark, d))
    return out.select("n_clicks", *[_r(f"recall_{k}") for k in (50, 100, 200)])


@query(_RECALL.format(top=_BM25_TOP.format(where="WHERE article_id IN (SELECT unnest(inview_ids) FROM drawn)", k=200)))
def recall_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, _retrieve(spark, d, base.test_sample(spark, d), 200, "circulating"))


# vectors --------------------------------------------------------------------------------

@query("SELECT article_id, i::INT AS i, round(x, 6) AS x FROM (SELECT article_id, unnest(unit) AS x, generate_subscripts(unit, 1) - 1 AS i FROM vec WHERE has_vector)")
def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return base.units(spark, d).filter("has_vector").select("article_id", F.posexplode(l2_normalize("unit")).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("SELECT has_vector, count(*) AS n FROM vec GROUP BY 1")
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return base.units(spark, d).groupBy("has_vector").agg(F.count(F.lit(1)).alias("n"))


def _user_vector_cells(users: DataFrame) -> DataFrame:
    return users.select("user_id", F.posexplode("unit").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("SELECT user_id, generate_subscripts(unit, 1)::INT - 1 AS i, round(unnest(unit), 6) AS x FROM uv")
def user_vec_mean(spark: SparkSession, d: str) -> DataFrame:
    return _user_vector_cells(sm.user_vectors(base.clicks(spark, d, base.split(spark, d, "test")), base.units(spark, d), base.DIM))


@query(""", kc AS (SELECT user_id, split, unit, row_number() OVER (PARTITION BY user_id, split ORDER BY age) - 1 AS k FROM clk JOIN vec USING (article_id)),
  e AS (SELECT user_id, split, power(0.5, k / 5.0) AS w, unnest(unit) AS x, generate_subscripts(unit, 1) AS i FROM kc),
  m AS (SELECT user_id, split, i, sum(w * x) / sum(w) AS m FROM e GROUP BY ALL), l AS (SELECT user_id, split, list(m ORDER BY i) AS m FROM m GROUP BY ALL)
SELECT user_id, generate_subscripts(m, 1)::INT - 1 AS i, round(unnest(m) / greatest(sqrt(list_sum(list_transform(m, lambda x: x * x))), 1e-12), 6) AS x FROM l""")
def user_vec_recency(spark: SparkSession, d: str) -> DataFrame:
    return _user_vector_cells(sm.user_vectors(base.clicks(spark, d, base.split(spark, d, "test")), base.units(spark, d), base.DIM, half_life=5.0))


_SEM_TOP = """SELECT user_id, split, article_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, split ORDER BY score DESC, article_id) AS rank FROM
  (SELECT uv.user_id, uv.split, vec.article_id, round(list_dot_product(uv.unit, vec.unit), 9) AS score FROM uv JOIN vec ON has_vector AND list_sum(list_transform(uv.unit, lambda x: x * x)) > 1e-24 {where})) WHERE rank <= {k}"""


def _sem_inputs(spark: SparkSession, d: str, impressions: DataFrame, pool: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = cut(base.units(spark, d))
    ids = ft.build_pool(base.articles(spark, d), impressions, pool)[0]
    return sm.click_vectors(base.clicks(spark, d, impressions), units), units, ids


def _sem(spark: SparkSession, d: str, impressions: DataFrame, k: int, pool: str) -> DataFrame:
    return sm.retrieve_vectors(*_sem_inputs(spark, d, impressions, pool), k)


@query("SELECT user_id, article_id, round(score, 6) AS score, rank::INT AS rank FROM (" + _SEM_TOP.format(where="", k=10) + ")")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sem(spark, d, base.split(spark, d, "test"), 10, "all").select("user_id", "article_id", _r("score"), "rank")


@query(_RECALL.format(top=_SEM_TOP.format(where="AND vec.article_id IN (SELECT unnest(inview_ids) FROM drawn)", k=200)))
def recall_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, _sem(spark, d, base.test_sample(spark, d), 200, "circulating"))


@query()
def ann_agreement(spark: SparkSession, d: str) -> DataFrame:
    users, units, ids = _sem_inputs(spark, d, base.split(spark, d, "test"), "all")
    users, items = cut(users), cut(sm.searchable(units, ids))
    return sm.agreement(sm.retrieve_vectors(users, items, None, 20), sm.retrieve_approximate(users, items, None, 20))


def _pairs(impressions: DataFrame) -> DataFrame:
    long = sp.explode_candidates(impressions, ("split",))
    return long.select("user_id", "split", "article_id").filter(F.col("user_id").isNotNull()).distinct()


@query(""", s AS (SELECT p.user_id, p.split, p.article_id, list_dot_product(a.unit, b.unit) AS s FROM pairs p JOIN clk USING (user_id, split) JOIN vec a ON a.article_id = clk.article_id JOIN vec b ON b.article_id = p.article_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, split, article_id ORDER BY s DESC) AS rn FROM s),
  m AS (SELECT user_id, split, article_id, avg(s) AS s FROM r WHERE rn <= 5 GROUP BY ALL)
SELECT user_id, article_id, round(coalesce(s, 0), 6) AS semantic FROM pairs LEFT JOIN m USING (user_id, split, article_id)""")
def semantic_topk_pool(spark: SparkSession, d: str) -> DataFrame:
    test = base.split(spark, d, "test")
    return sm.topk_pair_scores(_pairs(test), base.clicks(spark, d, test), base.units(spark, d)).select("user_id", "article_id", _r("semantic"))


@query("SELECT p.user_id, p.article_id, round(coalesce(list_dot_product(uv.unit, vec.unit), 0), 6) AS semantic FROM pairs p LEFT JOIN uv USING (user_id, split) LEFT JOIN vec ON vec.article_id = p.article_id")
def semantic_mean_pairs(spark: SparkSession, d: str) -> DataFrame:
    test, units = base.split(spark, d, "test"), base.units(spark, d)
    return sm.mean_pair_scores(_pairs(test), sm.user_vectors(base.clicks(spark, d, test), units, base.DIM), units).select("user_id", "article_id", _r("semantic"))


# scorers --------------------------------------------------------------------------------

@query("SELECT impression_id, pos, random FROM rnd")
def score_random(spark: SparkSession, d: str) -> DataFrame:
    return sc.score_random(base.scored_lists(spark, d)).select("impression_id", "pos", "random")


@query("SELECT impression_id, pos, coalesce(train_clicks, 0)::DOUBLE AS popularity FROM cand LEFT JOIN pop USING (article_id)")
def score_popularity(spark: SparkSession, d: str) -> DataFrame:
    candidates = sp.explode_candidates(base.split(spark, d, "test"))
    return sc.score_popularity(candidates, base.popularity(spark, d)).select("impression_id", "pos", "popularity")


@query("SELECT * FROM pop WHERE article_id IN (SELECT unnest(inview_ids) FROM samp) ORDER BY train_clicks DESC, article_id LIMIT 100")
def popularity_topk(spark: SparkSession, d: str) -> DataFrame:
    pool = ft.build_pool(base.articles(spark, d), base.split(spark, d, "test"), "circulating")[0]
    return sc.popularity_topk(base.popularity(spark, d), 100, pool)


_MINMAX = ", ".join(
    f"CASE WHEN max({c}) OVER g - min({c}) OVER g < 1e-12 THEN 0 ELSE ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) END AS x_{c}" for c in ("bm25", "semantic"))


@query(f", x AS (SELECT *, {_MINMAX} FROM stored WINDOW g AS (PARTITION BY impression_id)) SELECT impression_id, pos, round(x_bm25, 6) + 0 AS bm25, round(x_semantic, 6) + 0 AS semantic FROM x")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = hy.minmax(hy.minmax(base.scored_lists(spark, d), "bm25", "x_bm25"), "semantic", "x_semantic")
    return rows.select("impression_id", "pos", F.round("x_bm25", 6).alias("bm25"), F.round("x_semantic", 6).alias("semantic"))


@query()
def hybrid_fit(spark: SparkSession, d: str) -> DataFrame:
    found = hy.fit_hybrid(cut(base.scored_lists(spark, d)))
    return spark.createDataFrame([(k, float(round(v, 6))) for k, v in found.items()], "name string, value double")


@query(f", x AS (SELECT *, {_MINMAX} FROM stored WINDOW g AS (PARTITION BY impression_id)) SELECT impression_id, pos, round(1 / (1 + exp(-({FIXED['bm25']}::DOUBLE * x_bm25 + {FIXED['semantic']}::DOUBLE * x_semantic + {FIXED['intercept']}::DOUBLE))), 6) AS hybrid FROM x")
def hybrid_apply(spark: SparkSession, d: str) -> DataFrame:
    return hy.apply_hybrid(base.scored_lists(spark, d), FIXED).select("impression_id", "pos", _r("hybrid"))


@query(""", b AS (SELECT user_id, split, article_id, sum(qtf * weight) AS bm25 FROM pairs JOIN post USING (article_id) JOIN qt USING (user_id, split, term) GROUP BY ALL)
SELECT c.impression_id, c.pos, c.label, cast('0x' || substr(md5(c.impression_id || ':' || c.pos || ':13'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS random,
  coalesce(train_clicks, 0)::DOUBLE AS popularity, round(coalesce(bm25, 0), 6) AS bm25, round(coalesce(list_dot_product(uv.unit, vec.unit), 0), 6) AS semantic
FROM cand c LEFT JOIN pop USING (article_id) LEFT JOIN b ON b.user_id = c.user_id AND b.split = c.split AND b.article_id = c.article_id
  LEFT JOIN uv ON uv.user_id = c.user_id AND uv.split = c.split LEFT JOIN vec ON vec.article_id = c.article_id""")
def score_split(spark: SparkSession, d: str) -> DataFrame:
    scored = _score_all(spark, d)
    return scored.select("impression_id", "pos", "label", "random", "popularity", _r("bm25"), _r("semantic"))


def _score_all(spark: SparkSession, d: str, pooling: str = "mean") -> DataFrame:
    test, features = cut(base.split(spark, d, "test")), cut(base.tokens(spark, d))
    clicks = cut(base.clicks(spark, d, test))
    return sc.score_candidates(
        sp.explode_candidates(test, ("split",)), popularity=base.popularity(spark, d), clicks=clicks,
        queries=lx.query_terms(clicks, features), index=lx.postings(features), units=base.units(spark, d), dim=base.DIM, pooling=pooling)


@query(""", leaky AS (SELECT a, count(*)::DOUBLE AS n FROM (SELECT unnest(clicked_ids) AS a FROM imp) GROUP BY 1),
  s AS (SELECT r.impression_id, r.pos, r.label, coalesce(leaky.n, 0) AS lk, coalesce(pop.train_clicks, 0)::DOUBLE AS hn FROM stored r LEFT JOIN leaky ON a = article_id LEFT JOIN pop USING (article_id)),
  u AS (SELECT impression_id, pos, label, 'popularity_leaky' AS scorer, lk AS score FROM s UNION ALL SELECT impression_id, pos, label, 'popularity', hn FROM s),
  r AS (SELECT *, rank() OVER (PARTITION BY scorer, impression_id ORDER BY score) + (count(*) OVER (PARTITION BY scorer, impression_id, score) - 1) / 2.0 AS up FROM u),
  m AS (SELECT scorer, impression_id, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(CASE WHEN label = 1 THEN up ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))::DOUBLE END AS auc FROM r GROUP BY ALL)
SELECT scorer, round(avg(auc), 6) AS auc, count(auc) AS n FROM m GROUP BY 1""")
def leaky_ablation(spark: SparkSession, d: str) -> DataFrame:
    lists = base.scored_lists(spark, d).drop("popularity", "bm25", "semantic")
    counts = base.impressions(spark, d).select(F.explode("clicked_ids").alias("article_id")).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    wide = sc.score_leaky(sc.score_popularity(lists, base.popularity(spark, d)), counts, "n", declared=True)
    auc = mt.accuracy(mt.ranked(sc.long_scores(wide, ("popularity", "popularity_leaky"))))
    return auc.groupBy("scorer").agg(F.round(F.avg("auc"), 6).alias("auc"), F.count("auc").alias("n"))


# metrics --------------------------------------------------------------------------------

def _scores(spark: SparkSession, d: str) -> DataFrame:
    wide = sc.score_random(base.scored_lists(spark, d))
    return sc.long_scores(wide, ("random", "popularity", "bm25", "semantic"))


def _accuracy(spark: SparkSession, d: str) -> DataFrame:
    return mt.accuracy(mt.ranked(_scores(spark, d)))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return mt.top_k(_scores(spark, d))


@query("SELECT scorer, impression_id, round(auc, 6) AS auc FROM acc")
def metric_auc(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d).select("scorer", "impression_id", _r("auc"))


@query("SELECT scorer, impression_id, round(mrr, 6) AS mrr FROM acc")
def metric_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d).select("scorer", "impression_id", _r("mrr"))


@query("SELECT scorer, impression_id, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10 FROM acc")
def metric_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d).select("scorer", "impression_id", _r("ndcg_5"), _r("ndcg_10"))


@query("SELECT scorer, impression_id, article_id, rank::INT AS rank FROM top")
def top10(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("scorer", "impression_id", "article_id", "rank")


_DIVERSITY = """e AS (SELECT scorer, impression_id, unnest(unit) AS x, generate_subscripts(unit, 1) AS i FROM top JOIN vec USING (article_id)),
  s AS (SELECT scorer, impression_id, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM e GROUP BY ALL),
  dv AS (SELECT scorer, impression_id, CASE WHEN max(n) >= 2 THEN 1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) END AS diversity FROM s GROUP BY ALL)"""
_ENTROPY = """ce AS (SELECT scorer, impression_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS cat_entropy FROM
  (SELECT scorer, impression_id, coalesce(category, '') AS c, count(*) AS n FROM top LEFT JOIN art USING (article_id) GROUP BY ALL) GROUP BY ALL)"""
_NOVELTY = """nv AS (SELECT scorer, impression_id, avg(-log2((coalesce(train_clicks, 0) + 1) / ((SELECT sum(train_clicks) FROM pop) + 1)::DOUBLE)) AS novelty FROM top LEFT JOIN pop USING (article_id) GROUP BY ALL)"""


@query(f", {_DIVERSITY} SELECT scorer, impression_id, round(diversity, 6) AS diversity FROM (SELECT DISTINCT scorer, impression_id FROM top) LEFT JOIN dv USING (scorer, impression_id)")
def metric_diversity(spark: SparkSession, d: str) -> DataFrame:
    return mt.diversity(_top(spark, d), base.units(spark, d), base.DIM).select("scorer", "impression_id", _r("diversity"))


@query(f", {_ENTROPY} SELECT scorer, impression_id, round(cat_entropy, 6) AS cat_entropy FROM ce")
def metric_cat_entropy(spark: SparkSession, d: str) -> DataFrame:
    return mt.category_entropy(_top(spark, d), base.articles(spark, d)).select("scorer", "impression_id", _r("cat_entropy"))


@query(f", {_NOVELTY} SELECT scorer, impression_id, round(novelty, 6) AS novelty FROM nv")
def metric_novelty(spark: SparkSession, d: str) -> DataFrame:
    return mt.novelty(_top(spark, d), base.popularity(spark, d)).select("scorer", "impression_id", _r("novelty"))


@query("SELECT scorer, count(DISTINCT article_id) AS n_recommended, round(count(DISTINCT article_id) / (SELECT count(*) FROM art)::DOUBLE, 6) AS coverage FROM top GROUP BY 1")
def metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    return mt.coverage(_top(spark, d), base.articles(spark, d)).select("scorer", "n_recommended", _r("coverage"))


# evaluation -----------------------------------------------------------------------------

def _slices(spark: SparkSession, d: str) -> DataFrame:
    return ev.slice_flags(base.impressions(spark, d), base.profiles(spark, d), ft.head_band(ft.popularity_rank(base.popularity(spark, d))))


_SLICES = """sl AS (SELECT impression_id, unnest(['all', CASE WHEN cold THEN 'cold_users' ELSE 'warm_users' END, CASE WHEN is_head THEN 'head_clicks' ELSE 'tail_clicks' END]) AS slice FROM flags)"""


@query(f", {_SLICES} SELECT impression_id, slice FROM sl")
def slices(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d)


_LONG = "lm AS (" + " UNION ALL ".join(f"SELECT scorer, impression_id, '{m}' AS metric, {m} AS value FROM acc" for m in ("auc", "mrr", "ndcg_5", "ndcg_10")) + ")"
_SUMMARY = "SELECT scorer, slice, metric, round(avg(value), 6) AS value, count(value) AS n, count(*) - count(value) AS n_undefined FROM lm JOIN sl USING (impression_id) GROUP BY ALL"


@query(f", {_SLICES}, {_LONG} {_SUMMARY}")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summaries(_accuracy(spark, d), _slices(spark, d)).withColumn("value", F.round("value", 6))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    accuracy, slices = cut(_accuracy(spark, d)), _slices(spark, d)
    # of the lists that have scores and a slice
    lists = accuracy.select("impression_id").distinct().join(slices, "impression_id", "left_semi")
    sampled = sp.sample_n(lists, base.SAMPLE)
    found = ev.intervals(accuracy.join(sampled, "impression_id", "left_semi"), slices)
    return found.select("scorer", "slice", "metric", _r("value"), _r("ci_low"), _r("ci_high"), "n")


@query()
def poisson_ci(spark: SparkSession, d: str) -> DataFrame:
    found = ev.poisson_intervals(_accuracy(spark, d), _slices(spark, d))
    return found.select("scorer", "slice", "metric", _r("ci_low"), _r("ci_high"))


_ALL_METRICS = " UNION ALL ".join(
    [f"SELECT scorer, impression_id, '{m}' AS metric, {m} AS value FROM acc" for m in ("auc", "mrr", "ndcg_5", "ndcg_10")]
    + ["SELECT scorer, impression_id, 'diversity', diversity FROM (SELECT DISTINCT scorer, impression_id FROM top) LEFT JOIN dv USING (scorer, impression_id)",
       "SELECT scorer, impression_id, 'cat_entropy', cat_entropy FROM ce", "SELECT scorer, impression_id, 'novelty', novelty FROM nv"])


@query(f", {_DIVERSITY}, {_ENTROPY}, {_NOVELTY}, {_SLICES}, lm AS ({_ALL_METRICS}) {_SUMMARY}")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    found = mt.list_metrics(_scores(spark, d), base.articles(spark, d), base.popularity(spark, d), base.units(spark, d), base.DIM)
    return ev.summaries(found, _slices(spark, d)).withColumn("value", F.round("value", 6))


# submissions ----------------------------------------------------------------------------

def _submission(spark: SparkSession, d: str) -> DataFrame:
    return sub.ranks(base.scored_lists(spark, d), "semantic")


_RANKS = "rs AS (SELECT impression_id, string_agg(rank::VARCHAR, ',' ORDER BY pos) AS ranks FROM rk WHERE scorer = 'semantic' GROUP BY 1)"


@query(f", {_RANKS} SELECT * FROM rs")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    return _submission(spark, d).withColumn("ranks", F.array_join("ranks", ","))


@query("SELECT impression_id, 'missing' AS problem FROM (SELECT DISTINCT impression_id FROM impressions WHERE source_split = 'val') WHERE impression_id NOT IN (SELECT impression_id FROM stored)")
def validate_submission(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "impressions").filter("source_split = 'val'")
    return sub.submission_problems(_submission(spark, d), expected)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    order = table(spark, d, "impressions").filter("source_split = 'val'").select("impression_id", "source_impression_id", F.col("impression_id").alias("row_no"))
    return sub.submission_lines(_submission(spark, d), order)


@query(f", {_RANKS} SELECT impression_id AS row_no, source_impression_id || ' [' || coalesce(ranks, '') || ']' AS line FROM (SELECT * FROM impressions WHERE source_split = 'val') LEFT JOIN rs USING (impression_id)")
def submission_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def _infer(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Ranks per impression row, without labels: the row's user and its last ``n`` clicks."""
    test = base.split(spark, d, "test")
    units = base.units(spark, d)
    clicks = ft.recent_clicks(base.history(spark, d), base.chosen(spark, d), n, test.select("user_id", "split"))
    candidates = sp.explode_candidates(test, ("split",)).drop("label")
    scored = sm.mean_pair_scores(_pairs(test), sm.user_vectors(clicks, units, base.DIM), units)
    wide = candidates.join(scored, ["user_id", "split", "article_id"], "left")
    return wide.withColumn("score", F.round(F.coalesce("semantic", F.lit(0.0)), 9))


_INFER = """, kk AS (SELECT user_id, split, article_id FROM (SELECT hs.*, row_number() OVER (PARTITION BY user_id, split ORDER BY position DESC, article_id DESC) AS rn FROM hs JOIN su USING (user_id, split)) WHERE rn <= {n}),
  k0 AS (SELECT user_id, split, i, avg(x) AS m FROM (SELECT user_id, split, unnest(unit) AS x, generate_subscripts(unit, 1) AS i FROM kk JOIN vec USING (article_id)) GROUP BY ALL),
  k1 AS (SELECT user_id, split, list(m ORDER BY i) AS m FROM k0 GROUP BY ALL),
  k2 AS (SELECT user_id, split, list_transform(m, lambda x: x / greatest(sqrt(list_sum(list_transform(m, lambda y: y * y))), 1e-12)) AS unit FROM k1),
  s AS (SELECT c.impression_id, c.pos, round(coalesce(list_dot_product(k2.unit, vec.unit), 0), 9) AS s FROM cand c LEFT JOIN k2 ON k2.user_id = c.user_id AND k2.split = c.split LEFT JOIN vec ON vec.article_id = c.article_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY s DESC, pos) AS rank FROM s)
SELECT impression_id, string_agg(rank::VARCHAR, ',' ORDER BY pos) AS ranks FROM r GROUP BY 1"""


@query(_INFER.format(n=50))
def infer_raw(spark: SparkSession, d: str) -> DataFrame:
    return sub.ranks(_infer(spark, d, 50)).withColumn("ranks", F.array_join("ranks", ","))


@query(_INFER.format(n=20))
def infer_no_profile(spark: SparkSession, d: str) -> DataFrame:
    return sub.ranks(_infer(spark, d, 20)).withColumn("ranks", F.array_join("ranks", ","))


@query(""", kk AS (SELECT impression_id, article_id FROM (SELECT samp.impression_id, hs.article_id, row_number() OVER (PARTITION BY samp.impression_id ORDER BY position DESC, hs.article_id DESC) AS rn
    FROM samp JOIN hs ON hs.user_id = samp.user_id AND hs.split = samp.split AND (hs."timestamp" IS NULL OR hs."timestamp" <= samp."timestamp")) WHERE rn <= 50),
  m AS (SELECT c.impression_id, c.pos, list_dot_product(a.unit, b.unit) AS s FROM cand c JOIN kk ON kk.impression_id = c.impression_id JOIN vec a ON a.article_id = kk.article_id JOIN vec b ON b.article_id = c.article_id),
  t AS (SELECT impression_id, pos, avg(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY impression_id, pos ORDER BY s DESC) AS rn FROM m) WHERE rn <= 5 GROUP BY ALL),
  r AS (SELECT c.impression_id, c.pos, row_number() OVER (PARTITION BY c.impression_id ORDER BY round(coalesce(t.s, 0), 9) DESC, c.pos) AS rank FROM cand c LEFT JOIN t USING (impression_id, pos))
SELECT impression_id, string_agg(rank::VARCHAR, ',' ORDER BY pos) AS ranks FROM r GROUP BY 1""")
def infer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each impression ranked by its own history, its user's last 50 clicks until then: mean of the five best cosines."""
    test = base.split(spark, d, "test")
    past = base.history(spark, d).join(F.broadcast(base.chosen(spark, d)), "snapshot").select("user_id", "split", "article_id", "position", F.col("timestamp").alias("_clicked"))
    own = test.select("impression_id", "user_id", "split", "timestamp").join(past, ["user_id", "split"]).filter("_clicked IS NULL OR _clicked <= timestamp")
    newest = Window.partitionBy("impression_id").orderBy(F.desc("position"), F.desc("article_id"))
    clicks = own.withColumn("age", F.row_number().over(newest) - 1).filter("age < 50")
    # a row is its own user, as its history is its own
    clicks = cut(clicks.select(F.col("impression_id").cast("string").alias("user_id"), "split", "article_id", "age"))
    rows = cut(test.withColumn("user_id", F.col("impression_id").cast("string")))
    scored = sm.topk_pair_scores(_pairs(rows), clicks, base.units(spark, d), 5)
    wide = sp.explode_candidates(rows, ("split",)).drop("label").join(scored, ["user_id", "split", "article_id"], "left")
    return sub.ranks(wide.withColumn("score", F.round(F.coalesce("semantic", F.lit(0.0)), 9))).withColumn("ranks", F.array_join("ranks", ","))


@query(""", pl AS (SELECT impression_id, label, count(*) OVER (PARTITION BY impression_id) - rank + 1 AS up FROM rk WHERE scorer = 'semantic'),
  ex AS (SELECT impression_id, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(label * up) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))::DOUBLE END AS auc FROM pl GROUP BY 1)
SELECT round(avg(ex.auc), 6) AS auc, round(avg(mrr), 6) AS mrr, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10 FROM acc JOIN ex USING (impression_id) WHERE scorer = 'semantic'""")
def official_score(spark: SparkSession, d: str) -> DataFrame:
    lists = base.scored_lists(spark, d)
    labels = lists.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("x"))
    truth = labels.select(F.col("impression_id").alias("row_no"), F.concat(F.col("impression_id").cast("string"), F.lit(" ["), F.array_join("x.label", ","), F.lit("]")).alias("line"))
    order = labels.select("impression_id", F.col("impression_id").alias("source_impression_id"), F.col("impression_id").alias("row_no"))
    found = sub.external_scores(truth, sub.submission_lines(_submission(spark, d), order))
    return sub.score_summary(found).select(*[_r(c) for c in ("auc", "mrr", "ndcg_5", "ndcg_10")])


@query("SELECT user_id, array_to_string(list(article_id ORDER BY position, article_id)[-5:], ',') AS last_five FROM hs WHERE split = 'test' GROUP BY 1")
def last_clicks(spark: SparkSession, d: str) -> DataFrame:
    found = ft.user_profiles(base.history(spark, d), base.chosen(spark, d)).filter("split = 'test'")
    return found.select("user_id", F.array_join(last_n("clicked_ids", 5), ",").alias("last_five"))
