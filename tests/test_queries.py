"""Every registered query against its SQL on the smallest tables."""

import pytest

from quillrank.plans import general, reference
from tests.oracle import assert_same, connect

QUERIES = general.QUERIES | reference.QUERIES
ORACLE = general.ORACLE | reference.ORACLE


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


WHOLE_TEST = (
    "infer_raw infer_no_profile score_split score_popularity bm25_queries bm25_topk bm25_score_pairs user_vec_mean user_vec_recency "
    "semantic_topk semantic_topk_pool semantic_mean_pairs popularity_topk profiles_semi pool_circulating pool_fresh").split()


@pytest.mark.parametrize("name", WHOLE_TEST)
def test_no_sample_of_the_test_split(spark, data, con, name, monkeypatch):
    monkeypatch.setattr(reference.base, "SAMPLE", 3)
    assert reference.sample_n(spark, data).count() == 3
    assert_same(QUERIES[name](spark, data), con, ORACLE[name])


def test_whole_history_as_of(spark, data):
    pairs = QUERIES["p7_history"](spark, data).select("impression_id", "article_id")
    best = QUERIES["p7_found"](spark, data)
    assert best.exceptAll(pairs.distinct()).count() == 0
    assert pairs.count() > QUERIES["p7_attributes"](spark, data).count()


def test_bootstrap_samples_scored_lists(spark, data, monkeypatch):
    scored = reference._accuracy(spark, data).select("impression_id").distinct()
    n = scored.join(reference._slices(spark, data), "impression_id", "left_semi").count()
    monkeypatch.setattr(reference.base, "SAMPLE", n - 1)
    found = {r.n for r in QUERIES["bootstrap_ci"](spark, data).filter("slice = 'all' AND metric = 'mrr'").collect()}
    assert found == {n - 1}


def test_poisson_intervals_take_all_lists(spark, data):
    means = {(r.scorer, r.slice, r.metric): r.value for r in QUERIES["metric_summary"](spark, data).filter("value IS NOT NULL").collect()}
    found = {(r.scorer, r.slice, r.metric): (r.ci_low, r.ci_high) for r in QUERIES["poisson_ci"](spark, data).collect()}
    assert set(found) == set(means)
    assert all(low <= means[k] <= high for k, (low, high) in found.items() if k[1] == "all")


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitioning_does_not_matter(spark, data, con, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("popularity_rank", "p7_attributes", "ranks", "surrogate_ids"):
            assert_same(QUERIES[name](spark, data), con, ORACLE[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
