"""Whole stages over folders of tables, from raw files to reports and exports.

Every stage reads what the one before wrote. A data folder holds ``articles``,
``impressions`` and ``history`` after :func:`clean`, ``splits`` and
``split_meta.json`` after :func:`split`, and ``article_features``,
``user_profiles`` and ``stats.json`` after :func:`build_features`.
"""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.config import Config
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
from quillrank.sources import raw
from quillrank.sources.adapters import load_unified
from quillrank.sources.sinks import read_table, write_report, write_splits, write_submission, write_table

KS = (50, 100, 200)
POOLS = ("all", "circulating", "fresh")


def clean(spark: SparkSession, cfg: Config, layout: str, out: str, limit: int | None = None) -> dict:
    """Raw files to the unified tables; returns the share of ids the catalogue knows."""
    tables = dict(zip(("articles", "impressions", "history"), load_unified(spark, cfg, layout, limit), strict=True))
    for name, df in tables.items():
        write_table(df, f"{out}/{name}", name)
    stored = {n: read_table(spark, f"{out}/{n}", n) for n in tables}
    rows = sp.reference_report(stored["impressions"], stored["history"], stored["articles"]).collect()
    report = {r["source"]: {"n_ids": r["n_ids"], "pct_known": r["pct_known"]} for r in rows}
    if report["clicked"]["pct_known"] < 50:
        report["warning"] = "most clicked articles are not in the catalogue"
    return report


def split(spark: SparkSession, cfg: Config, folder: str) -> dict:
    """Label impressions by time, write them by split and pair each split with a safe snapshot."""
    imps, history = (read_table(spark, f"{folder}/{n}", n) for n in ("impressions", "history"))
    val = cfg.split.get("val")
    labelled = sp.assign_splits(imps, cfg.split.get("held_out_source", ""), val=tuple(str(x) for x in val) if val else None, val_days=int(cfg.split.get("val_days", 2)))
    write_splits(labelled, f"{folder}/splits")
    meta = sp.split_meta(spark.read.parquet(f"{folder}/splits"))
    sp.assert_disjoint(meta)
    snapshots = {r["split"]: r["snapshot"] for r in sp.choose_snapshots(sp.snapshot_ends(history), meta).collect()}
    out = {r["split"]: {k: r[k] for k in r.asDict() if k != "split"} | {"history_snapshot": snapshots[r["split"]]} for r in meta.collect()}
    if missing := set(sp.SPLITS) - set(out):
        raise AssertionError(f"empty splits: {sorted(missing)}")
    write_report(out, Path(folder) / "split_meta.json")
    return out


class Store:
    """The tables of a data folder that the later stages share."""

    def __init__(self, spark: SparkSession, cfg: Config, folder: str, vectors: str | None = None):
        self.spark, self.cfg, self.folder, self._vectors = spark, cfg, folder, vectors

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}", name)

    def split(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/splits").filter(F.col("split") == name)

    def chosen(self) -> DataFrame:
        meta = json.loads((Path(self.folder) / "split_meta.json").read_text(encoding="utf-8"))
        return self.spark.createDataFrame([(s, m["history_snapshot"]) for s, m in meta.items()], "split string, snapshot string")

    def history(self) -> DataFrame:
        return self.table("history").filter(F.col("user_id").isNotNull() & F.col("article_id").isNotNull())

    def clicks(self, sample: DataFrame, last_n: int) -> DataFrame:
        return ft.recent_clicks(self.history(), self.chosen(), last_n, sample.select("user_id", "split"))

    def vectors(self) -> tuple[DataFrame, int]:
        """Units of all articles and their dimension."""
        path = self._vectors or (self.cfg.raw.get("document_vectors") if self.cfg.can("has_provided_embeddings") else None)
        if not path:
            raise ValueError("no document vectors: give a vector table, for example one written by semantic.encode_texts with an encoder of your choice")
        rows = raw.vector_scan(self.spark.read.parquet(path))
        first = rows.filter(F.size("vec") > 0).select(F.size("vec")).first()
        if first is None:
            raise ValueError(f"{path} holds no vectors")
        return cut(sm.align_vectors(self.table("article_features"), rows, first[0])), first[0]


def build_features(spark: SparkSession, cfg: Config, folder: str) -> dict:
    """Article features from train clicks only, and profiles of each split's safe snapshot."""
    store = Store(spark, cfg, folder)
    feats = ft.article_features(store.table("articles"), store.split("train"), tuple(cfg.index_fields), cfg.language)
    write_table(feats, f"{folder}/article_features", "article_features")
    write_table(ft.user_profiles(store.history(), store.chosen()), f"{folder}/user_profiles", "user_profiles")
    feats, profiles = store.table("article_features"), store.table("user_profiles")
    stats = ft.feature_stats(feats).first().asDict() | {"top_share": ft.top_share(feats.select("article_id", "train_clicks", "popularity_rank")).first()[0]}
    out = {"articles": stats, "profiles": {r["split"]: r.asDict() for r in ft.profile_stats(profiles).collect()}}
    write_report(out, Path(folder) / "stats.json")
    return out


def recall(
    spark: SparkSession, cfg: Config, folder: str, method: str = "bm25", split_name: str = "test", last_n: int = 20, sample: int = 20_000,
    pools: tuple[str, ...] = POOLS, k1: float = lx.K1, b: float = lx.B, recency_weighted: bool = False, half_life: float = 5.0, ann: bool = False,
    vectors: str | None = None, out: str | None = None,
) -> dict:
    """recall@K of full-collection retrieval, per candidate pool."""
    store = Store(spark, cfg, folder, vectors)
    imps, feats = cut(sp.sample_n(store.split(split_name), sample)), store.table("article_features")
    clicks, profiles = cut(store.clicks(imps, last_n)), store.table("user_profiles")
    params = {"last_n": last_n, "sample": sample}
    if method == "bm25":
        queries, index = cut(lx.query_terms(clicks, feats)), cut(lx.postings(feats, k1, b))
        search = lambda ids: lx.retrieve(queries, index, ids, max(KS))
        params |= {"k1": k1, "b": b}
    elif method == "semantic":
        units, dim = store.vectors()
        users = cut(sm.user_vectors(clicks, units, dim, half_life if recency_weighted else None))
        search = lambda ids: sm.retrieve_vectors(users, units, ids, max(KS))
        params |= {"recency_weighted": recency_weighted, "half_life": half_life, "embedding_dim": dim}
    else:
        raise ValueError(f"unknown method {method!r}")
    report: dict = {"dataset": cfg.dataset, "split": split_name, "method": method, "params": params, "n_impressions_evaluated": imps.count(), "n_articles": feats.count(), "pools": {}}
    for kind in pools:
        ids, reason = ft.build_pool(feats, imps, kind, cfg.can("has_published_time"))
        if ids is None:
            report["pools"][kind] = {"available": False, "reason": reason}
            continue
        ids = cut(ids)
        size, began = ids.count(), time.perf_counter()
        found = cut(search(ids))
        entry = {"available": True, "pool_size": size, "search_ms": round(1000 * (time.perf_counter() - began), 1)}
        row = lx.recall_at(imps, found, profiles, KS).first()
        for k in KS:
            entry |= {f"recall@{k}": row[f"recall_{k}"], f"random@{k}": min(1.0, k / size) if size else None}
        if ann and method == "semantic":
            began = time.perf_counter()
            near = cut(sm.retrieve_approximate(users, units, ids, max(KS)))
            entry |= {"ann_search_ms": round(1000 * (time.perf_counter() - began), 1), "ann_recall_vs_exact": sm.agreement(found, near).first()["agreement"]}
        report["pools"][kind] = entry
    if out:
        write_report(report, out)
    return report


def _scored(store: Store, imps: DataFrame, last_n: int, pooling: str, topk: int, units: DataFrame, dim: int) -> DataFrame:
    feats = store.table("article_features")
    clicks = cut(store.clicks(imps, last_n))
    return cut(sc.score_candidates(
        sp.explode_candidates(imps, ("split",)), popularity=feats.select("article_id", "train_clicks"), clicks=clicks,
        queries=lx.query_terms(clicks, feats), index=lx.postings(feats), units=units, dim=dim, pooling=pooling, topk=topk))


def _fit(store: Store, last_n: int, pooling: str, topk: int, fit_sample: int, units: DataFrame, dim: int) -> tuple[dict[str, float], DataFrame]:
    val = cut(sp.sample_n(store.split("val"), fit_sample))
    scored = _scored(store, val, last_n, pooling, topk, units, dim)
    return hy.fit_hybrid(scored), scored


def evaluate(
    spark: SparkSession, cfg: Config, folder: str, split_name: str = "test", sample: int = 20_000, last_n: int = 20, pooling: str = "topk", topk: int = 5,
    fit_sample: int = 5_000, n_boot: int = 1000, vectors: str | None = None, out: str | None = None,
) -> dict:
    """All scorers on a split: metrics by slice with bootstrap intervals, and the leaky ablation.

    ``split_name="val"`` reports on the very sample that the combination was fitted on.
    """
    store = Store(spark, cfg, folder, vectors)
    units, dim = store.vectors()
    coefficients, fitted = _fit(store, last_n, pooling, topk, fit_sample, units, dim)
    on_fit = split_name == "val"
    imps = cut(sp.sample_n(store.split(split_name), fit_sample if on_fit else sample))
    wide = hy.apply_hybrid(fitted if on_fit else _scored(store, imps, last_n, pooling, topk, units, dim), coefficients)
    scorers = list(sc.SCORERS)
    counts = spark.read.parquet(cfg.raw["articles"]).select(F.col("article_id").cast("string").alias("article_id"), "total_pageviews") if cfg.serving_time_unavailable and "articles" in cfg.raw else None
    leaky = sc.score_leaky(wide, counts, "total_pageviews", bool(cfg.serving_time_unavailable))
    if leaky is not None:
        wide, scorers = leaky, [*scorers, "popularity_leaky"]
    feats = store.table("article_features")
    scores = cut(sc.long_scores(wide, tuple(scorers)))
    lists = cut(mt.list_metrics(scores, feats, feats.select("article_id", "train_clicks"), units, dim))
    slices = cut(ev.slice_flags(imps, store.table("user_profiles"), feats))
    found = ev.summaries(lists, slices).join(ev.intervals(lists, slices, n_boot=n_boot).drop("value", "n"), ["scorer", "slice", "metric"])
    report = ev.report(found, mt.coverage(mt.top_k(scores), feats), {
        "split": split_name, "sample": sample, "last_n": last_n, "pooling": pooling, "topk": topk, "n_boot": n_boot, "evaluated_on_fit_sample": on_fit,
        "hybrid": coefficients | {"fit_sample": fit_sample}})
    sizes = {r["slice"]: r["count"] for r in slices.groupBy("slice").count().collect()}
    for entry in report["scorers"].values():
        for name, part in entry["slices"].items():
            part["n_impressions"] = sizes.get(name, 0)
    ablation: dict = {"available": leaky is not None}
    if leaky is not None:
        honest, inflated = (report["scorers"][s]["slices"]["all"]["auc"]["value"] for s in ("popularity", "popularity_leaky"))
        ablation |= {"auc_honest": honest, "auc_leaky": inflated, "inflation": None if None in (honest, inflated) else inflated - honest}
    report["serving_time_ablation"] = ablation
    if out:
        write_report(report, out)
    return report


def _candidate_scores(store: Store, imps: DataFrame, method: str, last_n: int, pooling: str, topk: int, fit_sample: int) -> DataFrame:
    """Long candidates of ``imps`` with ``score``; no stage looks at labels of ``imps``."""
    sc.check_method(method)
    candidates, feats = sp.explode_candidates(imps, ("split",)), store.table("article_features")
    if method == "popularity":
        return sc.score_popularity(candidates, feats, "score")
    pairs = candidates.select("user_id", "split", "article_id").filter(F.col("user_id").isNotNull()).distinct()
    clicks = cut(store.clicks(imps, last_n))
    if method == "bm25":
        scored = lx.score_pairs(pairs, lx.query_terms(clicks, feats), lx.postings(feats), "score")
    else:
        units, dim = store.vectors()
        if method == "hybrid":
            coefficients, _ = _fit(store, last_n, pooling, topk, fit_sample, units, dim)
            wide = _scored(store, imps, last_n, pooling, topk, units, dim)
            return hy.apply_hybrid(wide, coefficients, out="score")
        if pooling == "mean":
            scored = sm.mean_pair_scores(pairs, sm.user_vectors(clicks, units, dim), units, "score")
        else:
            scored = sm.topk_pair_scores(pairs, clicks, units, topk, "score")
    return candidates.join(scored, ["user_id", "split", "article_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def submit(
    spark: SparkSession, cfg: Config, folder: str, out: str, split_name: str | None = None, method: str = "semantic", last_n: int = 20, pooling: str = "mean",
    topk: int = 5, fit_sample: int = 5_000, validate_only: bool = False, vectors: str | None = None, name: str = "prediction.txt", on_duplicate: str = "error",
) -> dict:
    """Ranks of a split's lists as a zipped text file, after validation."""
    store = Store(spark, cfg, folder, vectors)
    imps = cut(store.split(split_name or cfg.submission_split))
    ranks = cut(sub.ranks(_candidate_scores(store, imps, method, last_n, pooling, topk, fit_sample)))
    listed = imps.filter(F.size("inview_ids") > 0)
    problems = [f"{r['impression_id']}: {r['problem']}" for r in sub.submission_problems(ranks, listed, on_duplicate=on_duplicate).limit(6).collect()]
    report = {"rows": imps.count(), "problems": problems, "file": None}
    if problems:
        raise ValueError(f"invalid submission: {problems}")
    if not validate_only:
        order = imps.select("impression_id", "source_impression_id", F.col("impression_id").alias("row_no"))
        report["file"] = str(write_submission(sub.submission_lines(ranks, order), out, name))
    return report


def _infer(store: Store, imps: DataFrame, history: DataFrame, out: str, method: str, last_n: int, pooling: str, topk: int, coefficients: dict[str, float] | None, name: str, on_duplicate: str) -> dict:
    if on_duplicate == "error" and imps.groupBy("source_impression_id").count().filter("count > 1").limit(1).count():
        raise ValueError("impression ids occur more than once")
    sc.check_method(method)
    imps = cut(imps.withColumn("split", F.lit("new")))
    chosen = store.spark.createDataFrame([("new", "new")], "split string, snapshot string")
    clicks = cut(ft.recent_clicks(history.withColumn("snapshot", F.lit("new")), chosen, last_n, imps.select("user_id", "split")))
    candidates, feats = sp.explode_candidates(imps, ("split",)).drop("label"), store.table("article_features")
    pairs = candidates.select("user_id", "split", "article_id").distinct()
    if method == "popularity":
        scored = sc.score_popularity(pairs, feats, "score")
    elif method == "bm25":
        scored = lx.score_pairs(pairs, lx.query_terms(clicks, feats), lx.postings(feats), "score")
    else:
        units, dim = store.vectors()
        semantic = sm.mean_pair_scores(pairs, sm.user_vectors(clicks, units, dim), units, "score") if pooling == "mean" else sm.topk_pair_scores(pairs, clicks, units, topk, "score")
        scored = semantic
        if method == "hybrid":
            if not coefficients:
                raise ValueError("a hybrid needs fitted coefficients")
            both = lx.score_pairs(semantic.withColumnRenamed("score", "semantic"), lx.query_terms(clicks, feats), lx.postings(feats))
            wide = candidates.join(both, ["user_id", "split", "article_id"], "left").fillna(0.0, ["bm25", "semantic"])
            return _export(imps, sub.ranks(hy.apply_hybrid(wide, coefficients, out="score")), out, name)
    long = candidates.join(scored, ["user_id", "split", "article_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return _export(imps, sub.ranks(long), out, name)


def _export(imps: DataFrame, ranks: DataFrame, out: str, name: str) -> dict:
    order = imps.select("impression_id", "source_impression_id", F.col("impression_id").alias("row_no"))
    return {"rows": imps.count(), "file": str(write_submission(sub.submission_lines(ranks, order), out, name))}


def infer_tsv(
    spark: SparkSession, cfg: Config, folder: str, behaviors: str, out: str, method: str = "semantic", last_n: int = 50, pooling: str = "topk", topk: int = 5,
    fit_sample: int = 5_000, vectors: str | None = None, name: str = "prediction.txt",
) -> dict:
    """Rank unlabelled TSV impressions by each row's own history; repeated ids fail."""
    store = Store(spark, cfg, folder, vectors)
    log = raw.surrogate_ids(raw.scan_tsv(spark, behaviors, raw.BEHAVIOR_COLUMNS).withColumnRenamed("impression_id", "_source"), ["file_no", "row_no"])
    shown, clicked = raw.parse_candidates("impressions")
    # a row is its own user, as its history is its own
    imps = log.select("impression_id", F.col("_source").cast("bigint").alias("source_impression_id"), F.col("impression_id").cast("string").alias("user_id"),
                      raw.parse_time("time", strict=False).alias("timestamp"), shown.alias("inview_ids"), clicked.alias("clicked_ids"))
    ids = F.filter(F.split(F.trim("history"), r"\s+"), lambda x: x != "")
    history = raw.history_rows(log.select(F.col("impression_id").cast("string").alias("user_id"), ids.alias("ids")), "user_id", "ids", None, F.lit("new"))
    coefficients = None
    if method == "hybrid":
        units, dim = store.vectors()
        coefficients, _ = _fit(store, last_n, pooling, topk, fit_sample, units, dim)
    return _infer(store, imps, history, out, method, last_n, pooling, topk, coefficients, name, "error")


def infer_parquet(
    spark: SparkSession, cfg: Config, folder: str, behaviors: str, history: str, out: str, last_n: int = 20, vectors: str | None = None, name: str = "predictions.txt",
) -> dict:
    """Rank unlabelled nested Parquet impressions by mean-pooled vectors.

    Users without history keep the candidates' order; repeated ids are allowed.
    """
    store = Store(spark, cfg, folder, vectors)
    log = spark.read.parquet(behaviors).withColumn("file_no", F.lit(0)).withColumn("row_no", raw.row_place()).withColumnRenamed("impression_id", "_source")
    log = raw.surrogate_ids(log, ["file_no", "row_no"])
    imps = log.select("impression_id", F.col("_source").cast("bigint").alias("source_impression_id"), F.col("user_id").cast("string").alias("user_id"),
                      F.col("impression_time").cast("timestamp_ntz").alias("timestamp"), F.col("article_ids_inview").cast("array<string>").alias("inview_ids"),
                      F.array().cast("array<string>").alias("clicked_ids"))
    past = raw.history_rows(spark.read.parquet(history), "user_id", "article_id_fixed", "impression_time_fixed", F.lit("new"))
    return _infer(store, imps, past, out, "semantic", last_n, "mean", 5, None, name, "allow")


def score_externally(spark: SparkSession, truth: str, prediction: str, out: str | None = None) -> dict:
    """The four metrics of a prediction file against a truth file, lines paired by number."""
    read = lambda p: raw.surrogate_ids(spark.read.text(p).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_no")), ["_no"], "row_no").drop("_no")
    found = sub.score_summary(sub.external_scores(read(truth), read(prediction))).first().asDict()
    if out:
        Path(out).write_text("\n".join(f"{label}:{found[key]:.4f}" for label, key in (("AUC", "auc"), ("MRR", "mrr"), ("nDCG@5", "ndcg_5"), ("nDCG@10", "ndcg_10"))), encoding="utf-8")
    return found


def fetch(spark: SparkSession, sources: str, root: str, ids: str | None = None, group: str = "core", dataset: str | None = None, token_file: str | None = None, force: bool = False, status: bool = False) -> list[dict]:
    """Fetch the sources listed in a YAML file, or with ``status`` only say which are there."""
    import yaml

    from quillrank.sources import fetch as ft_

    listed = [ft_.Source(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for s in yaml.safe_load(Path(sources).read_text(encoding="utf-8"))]
    chosen = ft_.select_sources(listed, ids.split(",") if ids else None, group, dataset)
    if status:
        return [{"id": s.id, "dataset": s.dataset, "group": s.group, "status": "ready" if ft_.is_ready(Path(root) / s.dataset, s) else "absent"} for s in chosen]
    return ft_.fetch_sources(chosen, Path(root), ft_.find_token(Path(token_file) if token_file else None), force)
