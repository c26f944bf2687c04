"""How good a ranking is: nDCG, MRR, recall at k, paired bootstrap, location scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, mrr, recall) of run (qid, did, score) against judged (qid, did, rel).

    Gains are linear, discounts log2(rank + 1); ties in score go to the smaller did. Queries without a relevant document
    are left out; one without results scores 0.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    top = run.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    good = judged.where("rel > 0").groupBy("qid", "did").agg(F.max("rel").alias("rel"))
    ideal_order = Window.partitionBy("qid").orderBy(F.desc("rel"), "did")
    ideal = good.withColumn("r", F.row_number().over(ideal_order))
    wanted = ideal.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias("ideal"), F.count("*").alias("relevant"))
    hit = top.join(good, ["qid", "did"]).groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("gain"), F.min("rank").alias("first"), F.count("*").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(hit, "qid", "left").select("qid", zero(F.col("gain") / F.col("ideal")).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("found") / F.col("relevant")).alias("recall"))


def bootstrap(pairs: list[tuple[float, float]], draws: int = 4000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """Mean difference b - a of paired scores and its interval, by resampling queries with replacement."""
    d = np.array([b - a for a, b in pairs])
    if not len(d):
        return 0.0, 0.0, 0.0
    means = d[np.random.default_rng(seed).integers(0, len(d), (draws, len(d)))].mean(1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(d.mean()), float(low), float(high)


def located(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits (task, path, first, last) with `right`: the anchor, the first line, lies in a gold span (task, path, a, b) of
    the file, or the two overlap and the hit is at most three times as long and ten lines more."""
    both = hits.join(gold, ["task", "path"], "left")
    inside = F.col("first").between(F.col("a"), F.col("b"))
    near = (F.col("first") <= F.col("b")) & (F.col("last") >= F.col("a")) & (F.col("last") - F.col("first") + 1 <= 3 * (F.col("b") - F.col("a") + 1) + 10)
    return both.groupBy("task", "path", "first", "last").agg(F.max(F.coalesce(inside | near, F.lit(False))).alias("right"))


def reordered(run: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """(qid, did, fused): a ranking fused by rank with another one's order (qid, did, score)."""
    parts = None
    for r in (run, second):
        ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "did"))).select("qid", "did", (1.0 / (k + F.col("rank"))).alias("part"))
        parts = ranked if parts is None else parts.unionByName(ranked)
    return parts.groupBy("qid", "did").agg(F.sum("part").alias("fused"))


def summary(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
