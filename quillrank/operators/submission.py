"""Ranked-list exports, their validation and the external scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.metrics import accuracy


def ranks(scored: DataFrame, score: str = "score", group: str = "impression_id") -> DataFrame:
    """``(group, ranks)``: 1-based ranks in the candidates' order, ties to the earlier place."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "pos")
    placed = scored.select(group, "pos", F.row_number().over(w).alias("_rank"))
    packed = placed.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "_rank"))).alias("_x"))
    return packed.select(group, F.col("_x._rank").alias("ranks"))


def submission_problems(submission: DataFrame, expected: DataFrame, key: str = "impression_id", on_duplicate: str = "error") -> DataFrame:
    """``(impression_id, problem)`` for missing, unknown, duplicate and non-permutation rows."""
    n = submission.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    want = expected.select(key).distinct()
    found = [
        want.join(n, key, "left_anti").select(key, F.lit("missing").alias("problem")),
        n.join(want, key, "left_anti").select(key, F.lit("unknown").alias("problem")),
        submission.filter(~F.coalesce(F.array_sort("ranks") == F.sequence(F.lit(1), F.size("ranks")), F.lit(False)) & (F.size("ranks") > 0)).select(key, F.lit("no permutation").alias("problem")),
    ]
    if on_duplicate == "error":
        found.append(n.filter("_n > 1").select(key, F.lit("duplicate").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def submission_lines(submission: DataFrame, order: DataFrame, key: str = "impression_id") -> DataFrame:
    """``(row_no, line)`` with lines such as ``17 [2,1,3]``.

    ``order`` has ``key``, ``source_impression_id`` and ``row_no``; lists without
    candidates give ``[]``.
    """
    text = F.concat(F.col("source_impression_id").cast("string"), F.lit(" ["), F.coalesce(F.array_join("ranks", ","), F.lit("")), F.lit("]"))
    return order.join(submission, key, "left").select("row_no", text.alias("line"))


def parse_line(line: str = "line"):
    """Id and integer array columns of a line."""
    ident = F.regexp_extract(line, r"^\s*(\S+)\s", 1)
    body = F.regexp_extract(line, r"\[(.*)\]", 1)
    return ident, F.transform(F.filter(F.split(body, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def external_scores(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Metrics of ``(row_no, line)`` predictions against ``(row_no, line)`` labels.

    Lines meet by number. Empty label lists are skipped, a missing prediction ranks
    all candidates 1, another id fails the query. A rank scores ``1 / rank``; one row
    per list with the four metrics, and NULL AUC where labels are all equal.
    """
    tid, labels = parse_line()
    pid, places = parse_line()
    t = truth.select("row_no", tid.alias("_t"), labels.alias("_labels")).filter(F.size("_labels") > 0)
    p = prediction.select("row_no", pid.alias("_p"), places.alias("_ranks"))
    joined = t.join(p, "row_no", "left")
    same = F.col("_p").isNull() | (F.col("_p") == F.col("_t"))
    checked = joined.filter(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("ids differ in line "), F.col("row_no").cast("string"))).cast("boolean")))
    places_ = F.coalesce("_ranks", F.array_repeat(F.lit(1), F.size("_labels")))
    cells = checked.select("row_no", F.posexplode(F.arrays_zip(F.col("_labels").alias("l"), places_.alias("r"))).alias("pos", "x"))
    scores = cells.select(F.lit("external").alias("scorer"), F.col("row_no").alias("impression_id"), "pos", F.col("x.l").alias("label"), (1.0 / F.col("x.r")).alias("score"))
    # equal ranks: the external scorer reverses a rising order, so later places come first
    w = Window.partitionBy("scorer", "impression_id")
    placed = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("pos"))))
    ties = Window.partitionBy("scorer", "impression_id", "score")
    placed = placed.withColumn("up_rank", F.rank().over(w.orderBy("score")) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    return accuracy(placed).withColumnRenamed("impression_id", "row_no").drop("scorer")


def score_summary(per_list: DataFrame) -> DataFrame:
    return per_list.agg(F.avg("auc").alias("auc"), F.avg("mrr").alias("mrr"), F.avg("ndcg_5").alias("ndcg_5"), F.avg("ndcg_10").alias("ndcg_10"))
