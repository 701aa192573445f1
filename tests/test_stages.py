"""The stages from raw files to reports and exports, on a small nested Parquet log."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillrank import pipeline
from quillrank.__main__ import parser
from quillrank.config import Config
from quillrank.plans import base


@pytest.fixture(scope="module")
def world(spark, data, tmp_path_factory):
    """The shared tables written in the nested raw layout, cleaned, split and featured."""
    root = tmp_path_factory.mktemp("world")
    save = lambda df, n: df.write.parquet(str(root / n)) or str(root / n)
    number = lambda c: F.substring(c, 2, 9).cast("bigint")
    numbers = lambda c: F.transform(c, lambda x: F.substring(x, F.lit(2), F.lit(9)).cast("bigint"))
    arts = base.articles(spark, data)
    raw = {"articles": save(arts.select(
        number("article_id").alias("article_id"), "title", F.col("abstract").alias("subtitle"), F.lit("").alias("body"), F.col("category").alias("category_str"),
        F.array().cast("array<int>").alias("subcategory"), F.array().cast("array<string>").alias("ner_clusters"), "published_time", F.col("train_clicks").alias("total_pageviews")), "articles")}
    imps = base.impressions(spark, data).filter("user_id IS NOT NULL")
    user = number("user_id").alias("user_id")
    for split, late in (("train", False), ("val", True)):
        mine = imps.filter((F.col("source_split") == "val") == F.lit(late)).filter(F.col("timestamp") > F.lit("2024-01-09" if not late else "2024-01-01").cast("timestamp_ntz"))
        raw[f"{split}_behaviors"] = save(mine.select(F.col("source_impression_id").alias("impression_id"), user, F.col("timestamp").alias("impression_time"),
                                                     numbers("inview_ids").alias("article_ids_inview"), numbers("clicked_ids").alias("article_ids_clicked")), f"{split}_behaviors")
        past = base.history(spark, data).filter(f"snapshot = '{'late_train' if late else 'train'}'").filter(F.col("timestamp") < F.lit("2024-01-15" if late else "2024-01-08").cast("timestamp_ntz"))
        lists = past.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "article_id"))).alias("x"))
        raw[f"{split}_history"] = save(lists.select(user, numbers("x.article_id").alias("article_id_fixed"), F.col("x.timestamp").alias("impression_time_fixed")), f"{split}_history")
    vectors = spark.read.parquet(f"{data}/document_vectors.parquet")
    raw["document_vectors"] = save(vectors.select(number("article_id").alias("id"), "document_vector").filter(F.size("document_vector") == 64), "vectors")
    cfg = Config("d", raw=raw, capabilities={"has_published_time": True, "has_provided_embeddings": True}, split={"held_out_source": "val", "val_days": 2}, serving_time_unavailable=("total_pageviews",))
    folder = str(root / "tables")
    report = pipeline.clean(spark, cfg, "parquet", folder)
    meta = pipeline.split(spark, cfg, folder)
    stats = pipeline.build_features(spark, cfg, folder)
    return cfg, folder, report, meta, stats


def test_stored_tables(world):
    _, _, report, meta, stats = world
    assert report["clicked"]["pct_known"] > 50 and "warning" not in report
    assert {s: m["history_snapshot"] for s, m in meta.items()} == {"train": "train", "val": "val", "test": "val"}
    assert meta["train"]["t_max"] < meta["val"]["t_min"] and meta["val"]["t_max"] < meta["test"]["t_min"]
    assert stats["articles"]["n_articles"] > 0 and set(stats["profiles"]) == {"train", "val", "test"}


def test_recall_reports(spark, world, tmp_path):
    cfg, folder = world[:2]
    lexical = pipeline.recall(spark, cfg, folder, "bm25", out=str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["pools"]["all"]["pool_size"] == lexical["n_articles"]
    for pool in lexical["pools"].values():
        assert 0 <= pool["recall@50"] <= pool["recall@100"] <= pool["recall@200"] <= 1
    dense = pipeline.recall(spark, cfg, folder, "semantic", pools=("circulating",), recency_weighted=True, ann=True)
    assert 0.8 <= dense["pools"]["circulating"]["ann_recall_vs_exact"] <= 1
    old = Config("d", raw=cfg.raw, split=cfg.split)
    assert pipeline.recall(spark, old, folder, "bm25", pools=("fresh",))["pools"]["fresh"]["available"] is False
    with pytest.raises(ValueError):
        pipeline.recall(spark, old, folder, "semantic")
    with pytest.raises(ValueError):
        pipeline.recall(spark, cfg, folder, "other")


@pytest.mark.parametrize("split, pooling", [("test", "topk"), ("val", "mean")])
def test_evaluation_report(spark, world, split, pooling):
    cfg, folder = world[:2]
    report = pipeline.evaluate(spark, cfg, folder, split, n_boot=50, pooling=pooling)
    assert set(report["scorers"]) == {"random", "popularity", "bm25", "semantic", "hybrid", "popularity_leaky"}
    for scorer in report["scorers"].values():
        entry = scorer["slices"]["all"]["auc"]
        assert entry["ci_low"] <= entry["value"] <= entry["ci_high"] and entry["n"] > 0
    assert report["serving_time_ablation"]["available"] and report["params"]["evaluated_on_fit_sample"] is (split == "val")


def test_submissions(spark, world, tmp_path):
    cfg, folder = world[:2]
    for method in ("popularity", "bm25", "semantic", "hybrid"):
        report = pipeline.submit(spark, cfg, folder, str(tmp_path / f"{method}.zip"), method=method, on_duplicate="allow")
        lines = zipfile.ZipFile(report["file"]).read("prediction.txt").decode().splitlines()
        assert len(lines) == report["rows"]
        places = [int(x) for x in lines[0].split("[")[1].rstrip("]").split(",")]
        assert sorted(places) == list(range(1, len(places) + 1))
    assert pipeline.submit(spark, cfg, folder, "", validate_only=True)["file"] is None
    with pytest.raises(ValueError):
        pipeline.submit(spark, cfg, folder, "", method="magic")


def test_inference_without_labels(spark, world, tmp_path):
    cfg, folder = world[:2]
    report = pipeline.infer_parquet(spark, cfg, folder, cfg.raw["val_behaviors"], cfg.raw["val_history"], str(tmp_path / "p.zip"))
    assert len(zipfile.ZipFile(report["file"]).read("predictions.txt").decode().splitlines()) == report["rows"] > 0
    ids = [r.article_id for r in spark.read.parquet(f"{folder}/article_features").select("article_id").limit(5).collect()]
    tsv = tmp_path / "b.tsv"
    tsv.write_text(f"7\tU1\t11/11/2019 9:05:58 AM\t{ids[0]} {ids[1]}\t{ids[2]} {ids[0]} X9\n8\tU1\t11/11/2019 9:06:58 AM\t\t{ids[3]} {ids[4]}\n")
    for method in ("semantic", "bm25", "hybrid"):
        out = pipeline.infer_tsv(spark, cfg, folder, str(tsv), str(tmp_path / f"{method}.zip"), method=method)
        lines = zipfile.ZipFile(out["file"]).read("prediction.txt").decode().splitlines()
        assert [x.split(" ")[0] for x in lines] == ["7", "8"] and lines[1] == "8 [1,2]"
    tsv.write_text(tsv.read_text() * 2)
    with pytest.raises(ValueError, match="more than once"):
        pipeline.infer_tsv(spark, cfg, folder, str(tsv), str(tmp_path / "x.zip"), method="bm25")


def test_external_files(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("1 [0,1,0]\n2 [1,0]\n")
    (tmp_path / "prediction.txt").write_text("1 [2,1,3]\n2 [1,2]\n")
    found = pipeline.score_externally(spark, str(tmp_path / "truth.txt"), str(tmp_path / "prediction.txt"), str(tmp_path / "scores.txt"))
    assert found["auc"] == 1.0 and (tmp_path / "scores.txt").read_text().startswith("AUC:1.0000\nMRR:1.0000")


def test_command_line_options():
    args = vars(parser().parse_args(["recall", "--config", "c.yaml", "--folder", "f", "--k1", "1.5", "--pools", "all", "fresh", "--ann"]))
    assert args["k1"] == 1.5 and args["pools"] == ["all", "fresh"] and args["ann"] is True and args["last_n"] == 20
    assert vars(parser().parse_args(["clean", "--config", "c", "--layout", "tsv", "--out", "o", "--limit", "5"]))["limit"] == 5
