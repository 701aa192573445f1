"""Queries of the training-data problems over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.cooccur import together
from quillrank.llm.distinctive import count_tokens_column, count_words, one_text_per_record, parsimonious_terms
from quillrank.llm.fuse import borda, outright_winners
from quillrank.llm.langid import fit_on_documents, label_languages, language_of_label
from quillrank.llm.mix import available, mix_sources, source_key
from quillrank.llm.pack import fill_containers
from quillrank.llm.permindex import close_pairs, nearest, usable_vectors
from quillrank.llm.tokens import TOKENIZER, token_counts
from quillrank.llm.topn import top_n_by_bands
from quillrank.operators.cut import cut
from quillrank.sources.tables import table

SCORES = ["bm25", "semantic", "popularity"]
#: Repeated deliveries up to this many (a number each) are broadcast to be left out; more are joined.
MAX_AGAIN = 1_000_000
#: Up to this many impressions (a number each) are broadcast to pick their lists.
MAX_WANTED = 1_000_000


# 1. distinctive terms -------------------------------------------------------------------

def _texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    records = one_text_per_record(table(spark, d, "articles"), "article_id", text)
    return parsimonious_terms(count_words(records, "article_id", "text"), "article_id", background="df")


def marked(terms: DataFrame, most_records: int, least_tf: int) -> DataFrame:
    """Terms that their record's converged model puts above the collection's: more probable in it than in the background.

    The model cannot tell records apart from a collection that they largely make up. A
    term with ``least_tf`` occurrences in at most ``most_records`` records surely is above
    the background, by a factor of four at least, unless the record has more than
    ``least_tf / (8 * most_records)`` of the collection's distinct terms (the optimum of the likelihood
    gives a term ``tf / size - 4 * p_background`` at least, at a record share of 0.2); all terms of such records are kept.
    """
    # df / p_background is the number of distinct terms, summed over all records
    large = 8 * most_records * F.col("record_size") * F.col("p_background") > least_tf * F.col("df")
    return terms.filter((F.col("p_record") > F.col("p_background")) | large)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # the model chooses, counts confirm
    return marked(_texts(spark, d), 5, 3).filter("tf >= 3 AND df BETWEEN 2 AND 5").select("article_id", "term")


def _ranked(terms: DataFrame) -> DataFrame:
    return terms.filter("p_record > 0").select("article_id", "term", "tf", "df", F.round("p_record", 6).alias("p_record"), "term_rank")


def p1_article_terms(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_texts(spark, d))


def p1_token_terms(spark: SparkSession, d: str) -> DataFrame:
    """The same over the stored tokens; of an article's rows the one with the most tokens counts, then the greatest list."""
    rows = table(spark, d, "articles").filter("article_id IS NOT NULL AND size(tokens) > 0")
    last = rows.groupBy("article_id").agg(F.max(F.struct(F.size("tokens").alias("n"), "tokens")).alias("m")).select("article_id", F.col("m.tokens").alias("tokens"))
    return _ranked(parsimonious_terms(count_tokens_column(last, "article_id", "tokens"), "article_id", background="df"))


# 3. articles that appear together -------------------------------------------------------

def _once(spark: SparkSession, d: str) -> DataFrame:
    """Each impression once, however often delivered: deliveries hold the same ids, so only their numbers are compared."""
    rows = table(spark, d, "impressions")
    first = Window.partitionBy("source_split", "source_impression_id").orderBy("impression_id")
    again = rows.select("source_split", "source_impression_id", "impression_id").withColumn("_nth", F.row_number().over(first))
    again = cut(again.filter("_nth > 1").select("impression_id"))
    return rows.join(F.broadcast(again) if again.count() <= MAX_AGAIN else again, "impression_id", "left_anti")


def _pairs(spark: SparkSession, d: str, **limits: float) -> DataFrame:
    once = _once(spark, d)
    each = [together(once, column, **limits).withColumn("list_name", F.lit(name)) for name, column in (("clicked", "clicked_ids"), ("inview", "inview_ids"))]
    return each[0].unionByName(each[1]).withColumnsRenamed({"item_a": "article_a", "item_b": "article_b"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, min_count=5, min_lift=3.0, min_jaccard=0.3).select("list_name", "article_a", "article_b")


def p3_article_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("list_name", "article_a", "article_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


# 4. best candidates of every impression -------------------------------------------------

def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates of the scored impressions with their first place and ``bm25``."""
    scored = table(spark, d, "per_imp").select("impression_id", "article_id", "bm25").filter(F.col("impression_id").isNotNull())
    lists = table(spark, d, "impressions").select("impression_id", "inview_ids")
    wanted = cut(scored.select("impression_id").distinct())
    lists = lists.join(F.broadcast(wanted) if wanted.count() <= MAX_WANTED else wanted, "impression_id", "left_semi")
    shown = lists.select("impression_id", F.posexplode("inview_ids").alias("pos", "article_id")).filter(F.col("article_id").isNotNull())
    best = scored.groupBy("impression_id", "article_id").agg(F.max(F.when(~F.isnan("bm25"), F.col("bm25"))).alias("bm25"))
    return shown.groupBy("impression_id", "article_id").agg(F.min("pos").alias("pos")).join(best, ["impression_id", "article_id"], "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_by_bands(_candidates(spark, d), "impression_id", "bm25", [F.col("pos")], 3).select("impression_id", "article_id")


def p4_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    best = top_n_by_bands(_candidates(spark, d), "impression_id", "bm25", [F.col("pos")], 10)
    return best.select("impression_id", "article_id", "pos", "rank")


# 5. most similar articles ---------------------------------------------------------------

def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return usable_vectors(table(spark, d, "document_vectors"), "article_id", "document_vector", 64)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = close_pairs(_vectors(spark, d), "article_id", 0.95)
    return pairs.select(F.col("item_a").alias("article_a"), F.col("item_b").alias("article_b"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    units = _vectors(spark, d)
    asked = units.select("article_id").filter(F.substring("article_id", 2, 9).cast("long") % 100 == 0)
    found = nearest(asked, units, "article_id", 10)
    return found.select(F.col("query").alias("article_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


# 6. one order from three scores ---------------------------------------------------------

def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return outright_winners(table(spark, d, "per_imp"), "impression_id", "article_id", SCORES)


def p6_fused_order(spark: SparkSession, d: str) -> DataFrame:
    order = borda(table(spark, d, "per_imp"), "impression_id", "article_id", SCORES)
    return order.select("impression_id", "article_id", F.round("borda_points", 4).alias("borda_points"), "borda_rank")


# 8. texts in containers -----------------------------------------------------------------

def p8_containers(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents"), "text", ["doc_id"], tokenizer)
    return fill_containers(sizes, "doc_id", "n_tokens", table(spark, d, "container_sizes"), "container_name", "capacity_tokens")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for ``p8_containers``, counted per kind of container: the last four are 0."""
    got = cut(p8_containers(spark, d))
    tokens = token_counts(table(spark, d, "documents"), "text", ["doc_id"]).withColumnRenamed("n_tokens", "_tokens")
    full = got.filter("container_id IS NOT NULL").groupBy("container_name", "container_id").agg(
        F.sum("piece_size").alias("used"), F.first("container_fill").alias("said"), F.first("capacity").alias("capacity"))
    full = full.groupBy("container_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("too_full"), F.count_if(F.col("used") != F.col("said")).alias("wrong_fill"))
    texts = got.groupBy("container_name", "doc_id", "capacity").agg(F.sum("piece_size").alias("placed"), F.count(F.lit(1)).alias("pieces")).join(tokens, "doc_id")
    texts = texts.groupBy("container_name").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("placed") != F.col("_tokens")).alias("lost"),
        F.count_if((F.col("_tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut_needlessly"))
    return texts.join(full, "container_name").select("container_name", "n_texts", "lost", "cut_needlessly", "too_full", "wrong_fill")


# 9. a mix of sources --------------------------------------------------------------------

def p9_selection(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"], tokenizer)
    return mix_sources(sizes, "doc_id", F.col("source"), "n_tokens", table(spark, d, "mix_targets"))


def p9_tempered(spark: SparkSession, d: str, tokenizer: str = TOKENIZER, share: float = 0.9) -> DataFrame:
    """A mix of ``share`` of what all sources with a target can give within their limits.

    That is more than the targets can be met with, so the weights are tempered: the
    exponent is bisected until small sources stay within their limits, and comes out between 0 and 1.
    """
    sizes = cut(token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"], tokenizer))
    targets = table(spark, d, "mix_targets")
    return mix_sources(sizes, "doc_id", F.col("source"), "n_tokens", targets, budget=share * available(sizes, F.col("source"), "n_tokens", targets))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for ``p9_selection``, in one row: the last three numbers are 0."""
    got, limits = cut(p9_selection(spark, d)), table(spark, d, "mix_targets").select(source_key("source").alias("source"), "max_repeats")
    limits = limits.groupBy("source").agg(F.max("max_repeats").alias("_most"))
    whole = got.agg(F.sum(F.col("size") * F.col("times")).alias("_whole"), F.max("size").alias("_largest"))  # one row
    rows = got.join(limits, "source").join(F.broadcast(whole))
    # a source's budget ends inside one text, and every source's end moves the whole
    off = F.abs(F.col("reached_share") - F.col("planned_share")) * F.col("_whole") > 2 * F.col("_largest")
    return rows.agg(
        (F.count(F.lit(1)) > 0).alias("has_rows"), F.count_if(F.col("times") > F.col("_most")).alias("too_often"),
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated_rows"), F.count_if(off).alias("off_target"))


# 10. languages --------------------------------------------------------------------------

def _languages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = fit_on_documents(documents, "doc_id", "text", "lang", table(spark, d, "lang_samples"), "lang", "sample_text")
    return label_languages(documents.withColumn("_id", F.struct("doc_id", "lang")), "_id", "text", model).select(
        "_id.doc_id", language_of_label("_id.lang").alias("label"), "para_no", "lang_code", "confidence")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("label").isNull() | ((F.col("label") != F.col("lang_code")) & (F.col("confidence") >= 0.8))
    found = _languages(spark, d).filter(F.col("lang_code").isNotNull() & ((F.col("para_no") > 0) | wrong))
    return found.select("doc_id", "para_no", "lang_code")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "para_no", "lang_code", F.round("confidence", 4).alias("confidence"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_article_terms, p1_token_terms, p3_found, p3_article_pairs, p4_found, p4_top_candidates, p5_found, p5_neighbours,
    p6_found, p6_fused_order, p8_containers, p8_checks, p9_selection, p9_tempered, p9_checks, p10_found, p10_languages,
)}

_PAIRS = """
WITH d AS (SELECT source_split, source_impression_id, arg_min(inview_ids, impression_id) AS inview, arg_min(clicked_ids, impression_id) AS clicked
           FROM impressions GROUP BY ALL),
k AS (SELECT row_number() OVER () AS k, inview, clicked FROM d),
l AS (SELECT DISTINCT 'inview' AS list_name, k, unnest(inview) AS a FROM k UNION ALL SELECT DISTINCT 'clicked', k, unnest(clicked) FROM k),
i AS (SELECT * FROM l WHERE a IS NOT NULL),
n AS (SELECT list_name, count(DISTINCT k) AS n FROM i GROUP BY 1),
s AS (SELECT list_name, a, count(*) AS n FROM i GROUP BY 1, 2),
p AS (SELECT x.list_name, x.a AS article_a, y.a AS article_b, count(*) AS n_ab FROM i x JOIN i y ON x.list_name = y.list_name AND x.k = y.k AND x.a < y.a GROUP BY ALL),
q AS (SELECT p.*, sa.n AS n_a, sb.n AS n_b, n.n AS n FROM p JOIN n USING (list_name) JOIN s sa ON sa.list_name = p.list_name AND sa.a = article_a
      JOIN s sb ON sb.list_name = p.list_name AND sb.a = article_b)
"""
_SHOWN = """
WITH s AS (SELECT impression_id, article_id, max(CASE WHEN NOT isnan(bm25) THEN bm25 END) AS bm25 FROM per_imp GROUP BY ALL),
u AS (SELECT impression_id, unnest(inview_ids) AS article_id, generate_subscripts(inview_ids, 1) - 1 AS pos FROM impressions
      WHERE impression_id IN (SELECT impression_id FROM per_imp)),
c AS (SELECT impression_id, article_id, min(pos)::INT AS pos FROM u WHERE article_id IS NOT NULL GROUP BY ALL),
r AS (SELECT c.*, row_number() OVER (PARTITION BY impression_id ORDER BY coalesce(bm25, 0) DESC, pos)::INT AS rank
      FROM c LEFT JOIN s USING (impression_id, article_id))
"""
_CLEAN = """
WITH c AS (SELECT impression_id, article_id, max(CASE WHEN NOT isnan(bm25) THEN bm25 END)::DOUBLE AS bm25,
             max(CASE WHEN NOT isnan(semantic) THEN semantic END)::DOUBLE AS semantic, max(CASE WHEN NOT isnan(popularity) THEN popularity END)::DOUBLE AS popularity
           FROM per_imp WHERE impression_id IS NOT NULL AND article_id IS NOT NULL GROUP BY ALL)
"""


def _win(a: str, b: str) -> str:
    return " + ".join(f"CASE WHEN {a}.{s} > coalesce({b}.{s}, '-infinity'::DOUBLE) THEN 1 ELSE 0 END" for s in SCORES)


def _points(s: str) -> str:
    return f"""CASE WHEN {s} IS NULL OR count({s}) OVER g = 1 THEN (count(*) OVER g - 1) / 2.0
      ELSE (rank() OVER (PARTITION BY impression_id ORDER BY {s} NULLS FIRST) - 1 - (count(*) OVER g - count({s}) OVER g)
            + (count(*) OVER (PARTITION BY impression_id, {s}) - 1) / 2.0) * (count(*) OVER g - 1) / greatest(count({s}) OVER g - 1, 1) END"""


ORACLE = {
    "p1_found": r"""
WITH a AS (SELECT DISTINCT article_id, lower(nfc_normalize(coalesce(title, '') || ' ' || coalesce(abstract, ''))) AS t FROM articles WHERE article_id IS NOT NULL),
w AS (SELECT article_id, unnest(regexp_extract_all(t, '\p{L}{4,}')) AS term FROM a),
c AS (SELECT article_id, term, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM c)
SELECT article_id, term FROM f WHERE tf >= 3 AND df BETWEEN 2 AND 5""",
    "p3_found": _PAIRS + "SELECT list_name, article_a, article_b FROM q WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b AND n_ab >= 0.3 * (n_a + n_b - n_ab)",
    "p3_article_pairs": _PAIRS + "SELECT list_name, article_a, article_b, n_ab::BIGINT AS n_ab, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift FROM q",
    "p4_found": _SHOWN + "SELECT impression_id, article_id FROM r WHERE rank <= 3",
    "p4_top_candidates": _SHOWN + "SELECT impression_id, article_id, pos, rank FROM r WHERE rank <= 10",
    "p5_found": """
WITH v AS (SELECT DISTINCT article_id, document_vector::DOUBLE[] AS v FROM document_vectors WHERE article_id IS NOT NULL AND len(document_vector) = 64
           AND len(list_filter(document_vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(document_vector, lambda x: x <> 0)) > 0)
SELECT a.article_id AS article_a, b.article_id AS article_b FROM v a JOIN v b ON a.article_id < b.article_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95""",
    "p6_found": _CLEAN + f""", n AS (SELECT impression_id, count(*) AS m FROM c GROUP BY 1 HAVING count(*) >= 2)
SELECT x.impression_id, x.article_id FROM c x JOIN n USING (impression_id) JOIN c y ON x.impression_id = y.impression_id AND x.article_id <> y.article_id
WHERE ({_win("x", "y")}) >= 2 GROUP BY x.impression_id, x.article_id, m HAVING count(*) = m - 1""",
    "p8_checks": """SELECT container_name, (SELECT count(DISTINCT doc_id) FROM documents) AS n_texts, 0::BIGINT AS lost, 0::BIGINT AS cut_needlessly, 0::BIGINT AS too_full,
  0::BIGINT AS wrong_fill FROM container_sizes WHERE container_name IS NOT NULL AND capacity_tokens > 0 GROUP BY ALL""",
    "p9_checks": """SELECT count(*) > 0 AS has_rows, 0::BIGINT AS too_often, 0::BIGINT AS repeated_rows, 0::BIGINT AS off_target
  FROM documents d JOIN mix_targets t ON lower(trim(d.source)) = lower(trim(t.source)) WHERE length(d.text) > 0 AND target_share > 0 AND coalesce(max_repeats, 1) > 0""",
    "p6_fused_order": _CLEAN + f""", p AS (SELECT impression_id, article_id, {" + ".join(_points(s) for s in SCORES)} AS points FROM c WINDOW g AS (PARTITION BY impression_id))
SELECT impression_id, article_id, round(points, 4) AS borda_points, row_number() OVER (PARTITION BY impression_id ORDER BY round(points, 9) DESC, article_id)::INT AS borda_rank FROM p""",
}
