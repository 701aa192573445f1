"""Schema, adapters, splits, features, metrics, exports and streaming on small cases."""

import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank import schema
from quillrank.config import Config, load_config
from quillrank.operators import evaluate, features, hybrid, lexical, metrics, scoring, semantic, splits, submission
from quillrank.sources import adapters, fetch, raw, sinks

T0 = dt.datetime(2024, 1, 1)
IMP = schema.TABLES["impressions"]


def day(n, h=0):
    return T0 + dt.timedelta(days=n, hours=h)


def scored(spark, rows):
    return spark.createDataFrame([(1, i, f"a{i}", label, "s", float(score)) for i, (label, score) in enumerate(rows)],
                                 "impression_id bigint, pos int, article_id string, label int, scorer string, score double")


# metrics

@pytest.mark.parametrize("rows, auc", [([(0, 5), (1, 5)], 0.5), ([(0, 1), (0, 2)], None), ([(1, 1), (1, 2)], None), ([(1, 2), (0, 1)], 1.0), ([(1, 1), (0, 2)], 0.0)])
def test_auc(spark, rows, auc):
    assert metrics.accuracy(metrics.ranked(scored(spark, rows))).first().auc == auc


@pytest.mark.parametrize("rows, mrr", [([(0, .9), (1, .5), (1, .4)], (1 / 2 + 1 / 3) / 2), ([(0, 1), (0, 2)], 0.0), ([(1, 3), (0, 2)], 1.0)])
def test_mrr(spark, rows, mrr):
    assert metrics.accuracy(metrics.ranked(scored(spark, rows))).first().mrr == pytest.approx(mrr)


def test_ndcg_and_ties(spark):
    best = metrics.accuracy(metrics.ranked(scored(spark, [(1, 4), (1, 3), (0, 2), (0, 1)]))).first()
    assert best.ndcg_5 == pytest.approx(1.0)
    tied = metrics.ranked(scored(spark, [(0, 1), (1, 1)])).orderBy("pos").collect()
    assert [r["rank"] for r in tied] == [1, 2]


def test_diversity_entropy_novelty(spark):
    top = metrics.top_k(scored(spark, [(0, 3), (0, 2), (1, 1)]))
    units = spark.createDataFrame([("a0", [1.0, 0.0]), ("a1", [0.0, 1.0])], "article_id string, unit array<double>")
    assert metrics.diversity(top, units, 2).first().diversity == pytest.approx(1.0)
    assert metrics.diversity(top, units.filter("article_id = 'a0'"), 2).first().diversity is None
    cats = spark.createDataFrame([("a0", "x"), ("a1", "y")], "article_id string, category string")
    assert metrics.category_entropy(top, cats).first().cat_entropy == pytest.approx(np.log2(3))
    pop = spark.createDataFrame([("a0", 3), ("a1", 0)], "article_id string, train_clicks bigint")
    assert metrics.novelty(top, pop).first().novelty == pytest.approx((0 + 2 + 2) / 3)
    assert metrics.novelty(top, pop.withColumn("train_clicks", F.lit(0).cast("bigint"))).first().novelty == 0.0


def test_bootstrap():
    assert evaluate.mean_interval(np.array([1.0, np.nan, 1.0])) == (1.0, 1.0, 1.0)
    assert all(np.isnan(evaluate.mean_interval(np.array([]))))
    assert evaluate.mean_interval(np.array([3.0])) == (3.0, 3.0, 3.0)
    mean, low, high = evaluate.mean_interval(np.arange(200.0))
    assert low < mean < high and mean == 99.5
    whole = np.arange(200.0)[np.random.default_rng(13).integers(0, 200, size=(1000, 200))].mean(axis=1)
    assert (low, high) == tuple(np.percentile(whole, [2.5, 97.5]))  # as if drawn in one go
    old, evaluate.DRAWN = evaluate.DRAWN, 7_000
    try:
        assert evaluate.mean_interval(np.arange(200.0)) == (mean, low, high)
    finally:
        evaluate.DRAWN = old


def test_poisson_intervals_agree(spark):
    values = spark.range(400).select(F.lit("s").alias("scorer"), F.col("id").alias("impression_id"), (F.col("id") % 10).cast("double").alias("auc"))
    slices = values.select("impression_id", F.lit("all").alias("slice"))
    exact = evaluate.intervals(values, slices, ("auc",)).first()
    loose = evaluate.poisson_intervals(values, slices, ("auc",)).first()
    assert exact.ci_low == pytest.approx(loose.ci_low, abs=0.12) and exact.ci_high == pytest.approx(loose.ci_high, abs=0.12)


# splits

def impressions(spark):
    rows = [(i, i, "u", day(i), ["a", "b"], ["a"], "train" if i < 6 else "val") for i in range(8)] + [(8, 8, None, None, [], [], "train")]
    return spark.createDataFrame(rows, IMP)


def test_assign_splits(spark):
    got = {r.impression_id: r.split for r in splits.assign_splits(impressions(spark), "val", val_days=2).collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "train", 4: "val", 5: "val", 6: "test", 7: "test", 8: "train"}
    ranged = {r.impression_id: r.split for r in splits.assign_splits(impressions(spark), "val", val=("2024-01-02", "2024-01-03")).collect()}
    assert [ranged[i] for i in range(4)] == ["train", "val", "val", "train"]
    with pytest.raises(ValueError):
        splits.assign_splits(impressions(spark), "nothing")
    with pytest.raises(ValueError):
        splits.assign_splits(impressions(spark), "")


def test_snapshot_choice(spark):
    meta = spark.createDataFrame([("train", day(5)), ("test", day(10))], "split string, t_min timestamp_ntz")
    hist = spark.createDataFrame([("early", day(4)), ("early", day(5)), ("late", day(9)), ("future", day(20))], "snapshot string, timestamp timestamp_ntz")
    got = {r.split: r.snapshot for r in splits.choose_snapshots(splits.snapshot_ends(hist), meta).collect()}
    assert got == {"train": "early", "test": "late"}
    with pytest.raises(ValueError, match="train"):
        splits.choose_snapshots(splits.snapshot_ends(hist.filter("snapshot != 'early'")), meta)
    untimed = spark.createDataFrame([("all", None), ("b", None)], "snapshot string, end_ts timestamp_ntz")
    with pytest.raises(ValueError, match="without times"):
        splits.choose_snapshots(untimed, meta)
    assert {r.snapshot for r in splits.choose_snapshots(untimed.filter("snapshot = 'all'"), meta).collect()} == {"all"}


def test_disjoint_windows(spark):
    meta = splits.split_meta(splits.assign_splits(impressions(spark), "val"))
    splits.assert_disjoint(meta)
    late = meta.withColumn("t_max", F.lit(day(100)))
    with pytest.raises(AssertionError):
        splits.assert_disjoint(late)


def test_candidates_and_sample(spark):
    long = splits.explode_candidates(impressions(spark)).collect()
    assert len(long) == 16 and {(r.article_id, r.label) for r in long} == {("a", 1), ("b", 0)}
    some = splits.sample_n(impressions(spark), 3)
    again = splits.sample_n(impressions(spark).repartition(7), 3)
    assert sorted(r.impression_id for r in some.collect()) == sorted(r.impression_id for r in again.collect())
    assert splits.sample_n(impressions(spark), 0).count() == 9


def test_no_leakage_in_profiles(spark, data):
    """Snapshots end before their split starts and popularity counts train clicks only."""
    from quillrank.plans import base

    chosen = base.chosen(spark, data).join(base.split_meta(spark, data), "split")
    taken = base.table(spark, data, "snapshots")
    assert chosen.join(taken, "snapshot").filter("taken_at > t_min").count() == 0
    total = base.popularity(spark, data).agg(F.sum("train_clicks")).first()[0]
    known = base.split(spark, data, "train").select(F.explode("clicked_ids").alias("article_id")).join(base.articles(spark, data), "article_id", "left_semi").count()
    assert total == known


# features, retrieval

def test_quantile_and_bands(spark):
    profiles = spark.createDataFrame([(f"u{i}", "test", n) for i, n in enumerate([1, 2, 4, 9])], "user_id string, split string, n_clicks int")
    low = features.history_flags(profiles).filter("is_low_history").collect()
    assert [r.n_clicks for r in low] == [1]  # the exact quantile is 1.75
    pop = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0), ("d", 1), ("e", 2), ("f", 1), ("g", 1)], "article_id string, train_clicks bigint")
    ranked = features.popularity_rank(pop)
    assert [r.article_id for r in ranked.orderBy("popularity_rank").collect()] == ["a", "b", "e", "d", "f", "g", "c"]
    assert [r.article_id for r in features.head_band(ranked).filter("is_head").collect()] == ["a"]


def test_pools(spark):
    arts = spark.createDataFrame([("a", day(0)), ("z", None), ("y", day(50))], "article_id string, published_time timestamp_ntz")
    ids = lambda kind, **k: {r.article_id for r in features.build_pool(arts, impressions(spark), kind, **k)[0].collect()}
    assert ids("all") == {"a", "z", "y"} and ids("circulating") == {"a"} and ids("fresh") == {"a"}
    pool, reason = features.build_pool(arts, impressions(spark), "fresh", can_fresh=False)
    assert pool is None and reason
    with pytest.raises(ValueError):
        features.build_pool(arts, impressions(spark), "other")


def test_retrieval_blocks_do_not_matter(spark, data):
    from quillrank.plans import base

    sample, feats = base.test_sample(spark, data), base.tokens(spark, data)
    q, ix, pool = lexical.query_terms(base.clicks(spark, data, sample), feats), lexical.postings(feats), feats.select("article_id")
    rows = lambda df: sorted(map(tuple, df.select("user_id", "article_id", "score", "rank").collect()))
    assert rows(lexical.retrieve(q, ix, pool, 7)) == rows(lexical.retrieve(q, ix, pool, 7, block_articles=30, block_users=5))


def test_term_search_repeats_no_block(spark, data):
    from quillrank.plans import base

    clicks, feats = base.clicks(spark, data, base.test_sample(spark, data)), base.tokens(spark, data)
    pool = feats.select("article_id").filter("article_id < 'N100500000'")
    long = lexical.retrieve(lexical.query_terms(clicks, feats), lexical.postings(feats), pool, 7, block_articles=300, block_users=50)
    short = lexical.retrieve_clicked(clicks, feats, pool, 7, block_articles=170, block_users=60)
    rows = lambda df: {(r.user_id, r.split, r.article_id, r.score, r["rank"]) for r in df.collect()}
    assert rows(long) == rows(short) and {r[2] for r in rows(short)} <= {r.article_id for r in pool.collect()}
    for found in (long, short):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroups" not in plan and "Generate" not in plan  # one copy of users and articles, whatever the number of blocks


def test_approximate_search_agrees(spark, data):
    from quillrank.plans import base

    units = base.units(spark, data)
    users = semantic.user_vectors(base.clicks(spark, data, base.test_sample(spark, data)), units, base.DIM)
    exact = semantic.retrieve_vectors(users, units, units, 10, block_articles=25, block_users=7)
    near = semantic.retrieve_approximate(users, units, units, 10, cells=8, probe=4, chunk=20)
    assert semantic.agreement(exact, near).first().agreement >= 0.7
    assert semantic.agreement(exact, semantic.retrieve_approximate(users, units, units, 10, cells=8, probe=8)).first().agreement == pytest.approx(1.0)


def test_vector_search_repeats_no_block(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, m = np.round(rng.normal(size=(90, 8)), 1), np.round(rng.normal(size=(300, 8)), 1)
    m[150:] = m[:150]  # ties
    units = spark.createDataFrame([(f"a{i:03d}", [float(c) for c in v], True) for i, v in enumerate(m)], "article_id string, unit array<double>, has_vector boolean")
    users = spark.createDataFrame([(f"u{i:02d}", "test", [float(c) for c in v]) for i, v in enumerate(x)], "user_id string, split string, unit array<double>")
    scores = np.round(x @ m.T, 9)
    want = {(f"u{u:02d}", f"a{a:03d}", r + 1) for u in range(90) for r, a in enumerate(np.lexsort((np.arange(300), -scores[u]))[:7])}
    near = semantic.retrieve_approximate(users, units, units, 7, cells=5, probe=5, chunk=31)
    for found in (semantic.retrieve_vectors(users, units, units, 7, block_articles=40, block_users=10), near):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroups" not in plan and "Generate" not in plan  # one copy of users and articles, whatever the number of blocks
    exact = semantic.retrieve_vectors(users, units, units, 7, block_articles=40, block_users=10)
    assert {(r.user_id, r.article_id, r["rank"]) for r in exact.collect()} == want
    assert semantic.agreement(exact, near).first().agreement > 0.95  # products that differ in their last digit


def test_click_vectors_match_sums(spark, data):
    from quillrank.operators.cut import cut
    from quillrank.plans import base

    units, clicks = cut(base.units(spark, data)), base.clicks(spark, data, base.test_sample(spark, data))
    rows = lambda df: {(r.user_id, r.split): r.unit for r in df.collect()}
    got, want = rows(semantic.click_vectors(clicks, units)), rows(semantic.user_vectors(clicks, units, base.DIM))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_vector_sums_wide_and_exploded(spark, monkeypatch):
    from quillrank.functions import vectors

    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0, 5.0], 2.0), ("b", [1.0, 1.0], 4.0)], "k string, v array<float>, w double")
    run = lambda: sorted((r.k, list(r.total), r.n) for r in vectors.sum_vectors(df, ["k"], "v", 2, F.col("w"), [F.count(F.lit(1)).alias("n")]).collect())
    wide = run()
    monkeypatch.setattr(vectors, "WIDE", 1)
    assert wide == run() == [("a", [7.0, 12.0], 2), ("b", [4.0, 4.0], 1)]


def test_encoder_interface(spark):
    arts = spark.createDataFrame([("a", "t", None)], "article_id string, title string, abstract string")
    got = semantic.encode_texts(arts, lambda: (lambda texts: [[len(t), 0.0] for t in texts]), 2).first()
    assert list(got.vec) == [3.0, 0.0]


def test_hybrid_fit_matches_newton(spark):
    rng = np.random.default_rng(0)
    rows = [(i // 5, i % 5, int(rng.random() < 0.3), float(rng.random()), float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "impression_id bigint, pos int, label int, bm25 double, semantic double")
    got = hybrid.fit_hybrid(df)
    scaled = hybrid.minmax(hybrid.minmax(df, "bm25", "x"), "semantic", "z").select("x", "z", "label").toPandas()
    x, y = np.column_stack([scaled.x, scaled.z, np.ones(len(scaled))]), scaled.label.to_numpy()
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        reg = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + reg, x.T @ (s * (p - y)) + reg @ w)
    assert [got["bm25"], got["semantic"], got["intercept"]] == pytest.approx(w.tolist(), abs=1e-5)
    with pytest.raises(ValueError):
        hybrid.fit_hybrid(df.filter("label = 0"))


def test_leaky_scorer_needs_declaration(spark):
    assert scoring.score_leaky(scored(spark, [(0, 1)]), None, "n", declared=True) is None
    assert scoring.score_leaky(scored(spark, [(0, 1)]), scored(spark, [(0, 1)]), "score", declared=False) is None
    with pytest.raises(ValueError):
        scoring.check_method("magic")


# exports

def test_ranks_lines_and_validation(spark, tmp_path):
    lists = scored(spark, [(0, .5), (1, .9), (0, .5)])
    ranks = submission.ranks(lists)
    assert ranks.first().ranks == [2, 1, 3]
    order = spark.createDataFrame([(1, 77, 0), (2, 78, 1)], "impression_id bigint, source_impression_id bigint, row_no bigint")
    lines = submission.submission_lines(ranks, order)
    assert {r.row_no: r.line for r in lines.collect()} == {0: "77 [2,1,3]", 1: "78 []"}
    out = sinks.write_submission(lines, tmp_path / "p.zip")
    assert zipfile.ZipFile(out).read("prediction.txt").decode() == "77 [2,1,3]\n78 []\n"
    shared = tmp_path / "shared folder"
    many = spark.range(5_000).repartition(7).select(F.col("id").alias("row_no"), F.concat(F.lit("æ"), F.col("id").cast("string")).alias("line"))
    out = sinks.write_submission(many, tmp_path / "q.zip", work=f"file://{shared}")
    assert zipfile.ZipFile(out).read("prediction.txt").decode() == "".join(f"æ{i}\n" for i in range(5_000))
    assert not shared.exists()  # the parts are gone
    assert zipfile.ZipFile(sinks.write_submission(many.limit(0), tmp_path / "r.zip")).read("prediction.txt") == b""
    bad = spark.createDataFrame([(1, [1, 1]), (3, [1]), (3, [1])], "impression_id bigint, ranks array<int>")
    found = {(r.impression_id, r.problem) for r in submission.submission_problems(bad, order).collect()}
    assert found == {(1, "no permutation"), (2, "missing"), (3, "unknown"), (3, "duplicate")}
    allowed = submission.submission_problems(bad, order, on_duplicate="allow").collect()
    assert "duplicate" not in {r.problem for r in allowed}


def test_external_scorer(spark):
    line = "row_no bigint, line string"
    truth = spark.createDataFrame([(0, "5 [0,1,0]"), (1, "6 []"), (2, "7 [1,0]")], line)
    got = {r.row_no: r for r in submission.external_scores(truth, spark.createDataFrame([(0, "5 [2,1,3]"), (1, "6 []")], line)).collect()}
    assert set(got) == {0, 2}
    assert (got[0].auc, got[0].mrr) == (1.0, 1.0)
    assert got[2].auc == 0.5 and got[2].mrr == 0.5
    with pytest.raises(Exception, match="ids differ"):
        submission.external_scores(truth, spark.createDataFrame([(0, "9 [2,1,3]")], line)).collect()


# schema, adapters, config, utilities

def test_schema_validation(spark, tmp_path):
    ok = spark.createDataFrame([], schema.TABLES["history"])
    assert schema.validate(ok.select(*reversed(ok.columns)), "history").columns == ok.columns
    for bad in (ok.drop("position"), ok.withColumn("x", F.lit(1)), ok.withColumn("position", F.col("position").cast("bigint"))):
        with pytest.raises(ValueError):
            schema.validate(bad, "history")
    with pytest.raises(KeyError):
        schema.validate(ok, "nothing")
    sinks.write_table(ok, str(tmp_path / "h"), "history")
    assert sinks.read_table(spark, str(tmp_path / "h"), "history").count() == 0


def test_tsv_adapter(spark, tmp_path):
    news = 'N1\tnews\tworld\tA "quoted\tNA\turl\t[{"Label": "X"}]\t[]\nN2\tsport\tball\tT\t\turl\t\tbad{\n'
    more = "N2\tother\tx\tlater\t\tu\t\t\nN3\tnews\tw\tt3\ta3\tu\t\t\n"
    log = "1\tU1\t11/11/2019 9:05:58 AM\tN1 N2\tN1-1 N2-0\n2\tU2\t11/12/2019 1:00:00 PM\t\tN2-0 N1-0\n"
    files = {"train_news": news, "dev_news": more, "train_behaviors": log, "dev_behaviors": "1\tU1\t11/15/2019 8:00:00 AM\tN9\tN3 N1\n"}
    raw = {}
    for name, text in files.items():
        (tmp_path / f"{name}.tsv").write_text(text, encoding="utf-8")
        raw[name] = str(tmp_path / f"{name}.tsv")
    articles, imps, history = adapters.load_unified(spark, Config("d", raw=raw), "tsv")
    got = {r.article_id: r for r in articles.collect()}
    assert set(got) == {"N1", "N2", "N3"} and got["N2"].category == "sport"
    assert got["N1"].title == 'A "quoted' and got["N1"].abstract == "NA" and got["N1"].entities == ["X"] and got["N2"].abstract == ""
    rows = imps.orderBy("impression_id").collect()
    assert [(r.impression_id, r.source_impression_id, r.source_split) for r in rows] == [(0, 1, "train"), (1, 2, "train"), (2, 1, "dev")]
    assert rows[0].clicked_ids == ["N1"] and rows[2].inview_ids == ["N3", "N1"] and str(rows[1].timestamp) == "2019-11-12 13:00:00"
    assert sorted((r.user_id, r.article_id, r.position) for r in history.collect()) == [("U1", "N1", 0), ("U1", "N2", 1)]
    assert adapters.load_unified(spark, Config("d", raw=raw), "tsv", limit=1)[1].count() == 1
    with pytest.raises(ValueError):
        adapters.load_unified(spark, Config("d"), "tsv")
    with pytest.raises(ValueError):
        adapters.load_unified(spark, Config("d"), "xml")


def test_parquet_adapter(spark, tmp_path):
    save = lambda df, n: df.write.parquet(str(tmp_path / n))
    save(spark.createDataFrame([(7, "t", None, "b", "cat", [1, 2], ["E"], T0)], "article_id bigint, title string, subtitle string, body string, category_str string, subcategory array<int>, ner_clusters array<string>, published_time timestamp_ntz"), "articles")
    for split in ("train", "val"):
        save(spark.createDataFrame([(5, 9, T0, [7, 8], None)], "impression_id bigint, user_id bigint, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>"), f"{split}_behaviors")
        save(spark.createDataFrame([(9, [7, 8], [T0, T0])], "user_id bigint, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>"), f"{split}_history")
    names = ("articles", "train_behaviors", "val_behaviors", "train_history", "val_history")
    articles, imps, history = adapters.load_unified(spark, Config("d", raw={n: str(tmp_path / n) for n in names}), "parquet")
    a = articles.first()
    assert (a.article_id, a.abstract, a.subcategory, a.entities) == ("7", "", "1|2", ["E"])
    assert [(r.impression_id, r.inview_ids, r.clicked_ids, r.source_split) for r in imps.orderBy("impression_id").collect()] == [(0, ["7", "8"], [], "train"), (1, ["7", "8"], [], "val")]
    assert history.count() == 4 and {r.snapshot for r in history.collect()} == {"train", "val"}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("dataset: d\nscale: demo\nraw:\n  articles: x_{scale}/a\ncapabilities:\n  has_body: true\n")
    cfg = load_config(tmp_path / "c.yaml", tmp_path)
    assert cfg.language == "en" and cfg.raw["articles"].endswith("x_demo/a") and cfg.can("has_body") and not cfg.can("other")
    with pytest.raises(ValueError):
        cfg.require("vectors")


def test_rows_of_a_folder_keep_the_order_of_its_files(spark, tmp_path):
    # the later files are the larger ones, which are read first
    for part, n in enumerate((3, 400, 5_000)):
        (tmp_path / f"part-{part}.tsv").write_text("".join(f"{part}-{i:05d}\tx\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = raw.surrogate_ids(raw.scan_tsv(spark, str(tmp_path), ("id", "x")), ["file_no", "row_no"], "no")
        got = [r.id for r in rows.orderBy("no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(got) and len(got) == 5_403


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/x/one.txt", "1")
        z.writestr("top/__MACOSX/junk", "2")
    files = fetch.extract(tmp_path / "a.zip", tmp_path / "out")
    assert [f.name for f in files] == ["one.txt"] and (tmp_path / "out/x/one.txt").exists()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "1")
        z.writestr("ok.txt", "1")
    with pytest.raises(ValueError):
        fetch.extract(tmp_path / "b.zip", tmp_path / "out2")
    assert fetch.write_manifest(tmp_path / "out", files).exists()
    assert fetch.find_folder(tmp_path, ["one.txt"]).name == "x"
    with pytest.raises(FileNotFoundError):
        fetch.find_folder(tmp_path, ["one.txt"], prefer="y")
    sources = [fetch.Source("a", "u", "d"), fetch.Source("b", "u", "e", "optional")]
    assert [s.id for s in fetch.select_sources(sources, group="all", dataset="e")] == ["b"]
    with pytest.raises(SystemExit):
        fetch.select_sources(sources, ids=["zz"])


@pytest.fixture
def server(tmp_path):
    """A local file server that notes who asks, and redirects ``/moved`` to itself and ``/away`` to another name."""
    import functools
    import http.server
    import threading

    asked = []
    folder = tmp_path / "served"
    folder.mkdir()

    class Handler(http.server.SimpleHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("Authorization")))
            if self.path in ("/moved", "/away"):
                self.send_response(302)
                host = "127.0.0.1" if self.path == "/moved" else "localhost"
                self.send_header("Location", f"http://{host}:{self.server.server_port}/a.zip")
                self.end_headers()
            else:
                super().do_GET()

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Handler, directory=folder)) as up:
        threading.Thread(target=up.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{up.server_port}", folder, asked
        up.shutdown()


def test_token_stays_with_its_host(server, tmp_path, monkeypatch):
    url, folder, asked = server
    (folder / "a.zip").write_bytes(b"abc")
    monkeypatch.setenv("SOURCE_TOKEN", "t")
    assert fetch.download(f"{url}/moved", tmp_path / "x", fetch.find_token()).read_bytes() == b"abc"
    assert asked == [("/moved", "Bearer t"), ("/a.zip", "Bearer t")]
    asked.clear()
    fetch.download(f"{url}/away", tmp_path / "y", "t")
    assert asked == [("/away", "Bearer t"), ("/a.zip", None)]
    monkeypatch.delenv("SOURCE_TOKEN")
    (tmp_path / "token").write_text(" file \n")
    assert fetch.find_token(tmp_path / "token") == "file" and fetch.find_token(tmp_path / "none") is None


def test_fetching_sources(server, tmp_path):
    url, folder, asked = server
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("top/x.txt", "1")
    good = fetch.sha256_of(folder / "a.zip")
    source = fetch.Source("a", f"{url}/a.zip", "d", markers=("x.txt",), sha256=good)
    root = tmp_path / "raw"
    first = fetch.fetch_sources([source], root)
    assert [r["status"] for r in first] == ["fetched"] and (root / "d/x.txt").read_text() == "1" and (root / "manifest.json").exists()
    asked.clear()
    assert [r["status"] for r in fetch.fetch_sources([source], root)] == ["ready"] and not asked
    bad = fetch.Source("b", f"{url}/a.zip", "e", markers=("x.txt",), sha256="0" * 64)
    assert [r["status"] for r in fetch.fetch_sources([bad, source], root)] == ["failed: checksum", "ready"]
    assert not (root / "e/x.txt").exists()


def test_vector_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    articles = spark.createDataFrame([("N2", "b", None), ("N1", "a", "x")], "article_id string, title string, abstract string")

    def load():
        calls.add(1)
        return semantic.hashed_encoder(8)

    store = f"file://{tmp_path}/vectors"
    first = {r.article_id: list(r.vec) for r in semantic.cached_vectors(articles, load, 8, store).collect()}
    done = calls.value
    assert done > 0 and set(first) == {"N1", "N2"} and first["N1"] != first["N2"]
    again = {r.article_id: list(r.vec) for r in semantic.cached_vectors(articles, load, 8, store).collect()}
    assert again == first and calls.value == done  # read, not encoded
    more = articles.union(spark.createDataFrame([("N3", None, None)], articles.schema))
    assert semantic.cached_vectors(more, load, 8, store).count() == 3 and calls.value > done
    assert semantic.cached_vectors(more, load, 8, store, refresh=True).count() == 3


def test_streaming_ranks(spark, data, tmp_path):
    from quillrank.streaming.online import click_counts, read_impressions, start_ranking

    folder = tmp_path / "in"
    spark.read.parquet(f"{data}/impressions.parquet").limit(40).repartition(3).write.parquet(str(folder))
    scorer = lambda long: long.withColumn("score", -F.col("pos").cast("double"))
    start_ranking(read_impressions(spark, str(folder), 1), scorer, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("impression_id", "ranks")
    want = spark.read.parquet(str(folder)).filter(F.size("inview_ids") > 0)
    assert got.count() == want.count() and all(r.ranks == sorted(r.ranks) for r in got.collect())
    counts = click_counts(read_impressions(spark, str(folder)))
    q = counts.writeStream.format("memory").queryName("clicks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("clicks").count() > 0
