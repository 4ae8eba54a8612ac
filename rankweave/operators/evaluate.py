"""Ranking quality against relevance judgments.

A run is `(mode, query_id, doc_id, score, rank)`; judgments are `(query_id, doc_id, relevance)`
with positive relevance only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from .topk import top_k

# Fixed value: the metrics reported by default.
METRICS = ("ndcg@10", "recall@100", "map", "mrr@10", "precision@10")

# Ranks per block when hits are counted along a ranking.
RANK_BLOCK = 65536


def build_run(ranking: DataFrame, mode: str, document: DataFrame | None = None,
              depth: int | None = None) -> DataFrame:
    """Mark a ranking with its mode and name documents by url.

    With `document` the id is replaced by the url; results without a url drop out and ranks close
    up. Without it the ids stay as they are.
    """
    run = ranking.select(F.lit(mode).alias("mode"), "query_id", "doc_id", "score", "rank")
    if document is not None:
        urls = document.filter(F.col("url").isNotNull()).select("doc_id", "url")
        run = (run.join(urls, "doc_id")
               .select("mode", "query_id", F.col("url").alias("doc_id"), "score",
                       F.col("rank").alias("_old")))
        run = top_k(run, ["mode", "query_id"], [F.col("_old")], depth).drop("_old")
    elif depth is not None:
        run = run.filter(F.col("rank") <= depth)
    return run


def _parse(metric: str) -> tuple[str, int | None]:
    match = re.fullmatch(r"(ndcg|recall|mrr|precision|map)(?:@([1-9]\d*))?", metric)
    if not match:
        raise ValueError(f"unknown metric {metric}")
    name, k = match.group(1), match.group(2)
    if name == "precision" and k is None:
        raise ValueError("precision needs a cutoff")
    return name, int(k) if k else None


def hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The relevant documents of a run with their rank, relevance and number among the hits.

    Only hits are kept, so the rest of a run is never sorted. The running number is counted in
    blocks of ranks: a query with very many hits is spread over its blocks.
    """
    found = (run.select("mode", "query_id", "doc_id", "rank")
             .join(qrels, ["query_id", "doc_id"])
             .withColumn("_block", F.floor((F.col("rank") - 1) / F.lit(RANK_BLOCK))))
    keys = ["mode", "query_id"]
    sizes = found.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("rank"))
    return (found.withColumn("_in", inside).join(offsets, [*keys, "_block"])
            .withColumn("hit", F.col("_in") + F.col("_before"))
            .drop("_in", "_before", "_block"))


def _discounted(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + F.lit(1))


def ideal_gain(qrels: DataFrame, k: int | None) -> DataFrame:
    """`(query_id, ideal)`: the discounted gain of the best possible ranking.

    With equal relevance the order does not matter, so each relevance level of a query adds a run
    of ranks. The judgments are counted per level first; a query with very many judgments is never
    sorted in one place.
    """
    levels = qrels.groupBy("query_id", "relevance").agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy("query_id").orderBy(F.col("relevance").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(higher), F.lit(0)) + F.lit(1)
    placed = levels.select("query_id", "relevance", start.alias("_from"), "n")
    end = F.col("_from") + F.col("n") - F.lit(1)
    if k is not None:
        placed = placed.filter(F.col("_from") <= k)
        end = F.least(end, F.lit(k))
    block = F.lit(RANK_BLOCK).cast("long")
    blocks = F.explode(F.sequence(F.col("_from"), F.col("_to"), block))
    ranks = F.explode(F.sequence(F.col("_start"),
                                 F.least(F.col("_start") + block - F.lit(1), F.col("_to"))))
    return (placed.select("query_id", "relevance", "_from", end.cast("long").alias("_to"))
            .select("query_id", "relevance", "_to", blocks.alias("_start"))
            .select("query_id", "relevance", ranks.alias("_rank"))
            .groupBy("query_id")
            .agg(F.sum(_discounted(F.col("relevance"), F.col("_rank"))).alias("ideal")))


def query_metrics(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = METRICS,
                  missing: str = "drop") -> DataFrame:
    """One row per mode and query with one column per metric.

    Queries without judgments are left out. Judged queries for which a mode found nothing are left
    out too (`missing="drop"`), or score 0 (`missing="zero"`).
    """
    if missing not in ("drop", "zero"):
        raise ValueError("missing must be 'drop' or 'zero'")
    parsed = [(metric, *_parse(metric)) for metric in metrics]
    keys = ["mode", "query_id"]
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("_relevant"))
    for k in {k for _, name, k in parsed if name == "ndcg"}:
        totals = totals.join(
            ideal_gain(qrels, k).withColumnRenamed("ideal", f"_ideal_{k}"), "query_id")

    rank = F.col("rank")
    aggregates = []
    for metric, name, k in parsed:
        within = rank <= k if k is not None else F.lit(True)
        if name in ("precision", "recall"):
            value = F.count_if(within).cast("double")
        elif name == "mrr":
            value = F.try_divide(F.lit(1.0), F.min(F.when(within, rank)).cast("double"))
        elif name == "map":
            value = F.sum(F.when(within, F.col("hit") / rank))
        else:
            value = F.sum(F.when(within, _discounted(F.col("relevance"), rank)))
        aggregates.append(F.coalesce(value, F.lit(0.0)).alias(metric))
    sums = hits(run, qrels).groupBy(*keys).agg(*aggregates)

    if missing == "drop":
        scored = run.select(*keys).distinct().join(totals, "query_id")
    else:
        # Modes are a handful of names; each judged query gets a row per mode.
        modes = run.agg(F.collect_set("mode").alias("modes")).select("modes").scalar()
        scored = totals.withColumn("mode", F.explode(modes))
    table = scored.join(sums, keys, "left")
    columns = []
    for metric, name, k in parsed:
        value = F.coalesce(F.col(f"`{metric}`"), F.lit(0.0))
        if name == "precision":
            value = value / F.lit(float(k))
        elif name in ("recall", "map"):
            value = value / F.col("_relevant")
        elif name == "ndcg":
            value = value / F.col(f"_ideal_{k}")
        columns.append(value.alias(metric))
    return table.select(*keys, *columns)


def evaluate_run(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = METRICS,
                 missing: str = "drop") -> DataFrame:
    """`(mode, metric, score, scored_queries)`: the mean of each metric per mode."""
    per_query = query_metrics(run, qrels, metrics, missing)
    means = per_query.groupBy("mode").agg(
        F.count(F.lit(1)).alias("scored_queries"),
        *[F.avg(F.col(f"`{m}`")).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"),
                               scoring.rounded(F.col(f"`{m}`"), scoring.METRIC_DIGITS)
                               .alias("score")) for m in metrics])
    return means.select("mode", "scored_queries", F.inline(pairs)).select(
        "mode", "metric", "score", "scored_queries")


def compare(evaluation: DataFrame, modes: list[str]) -> DataFrame:
    """Metrics down, modes across."""
    return evaluation.groupBy("metric").pivot("mode", modes).agg(F.first("score"))


def best_mode(evaluation: DataFrame, modes: list[str]) -> DataFrame:
    """The winner per metric; of equal modes the one listed first."""
    order = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode"))
    return (evaluation.filter(F.col("mode").isin(modes))
            .groupBy("metric")
            .agg(F.max_by("mode", F.struct("score", -order)).alias("best"),
                 F.max("score").alias("score")))


# Ranks of the approximate percentile are off by at most this share of the rows.
RANK_ERROR = 1e-4


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Mean and nearest-rank 95th percentile per mode, in milliseconds.

    The percentile is the smallest value with at least 95 % of the values at or below it. Two
    approximate percentiles close around it bound the value, however the values are spread; those
    below the band are only counted, and the band, under a thousandth of the rows, is ordered
    exactly. Equal values are counted before they are ordered.
    """
    ms = latencies.select("mode", (F.col("seconds") * F.lit(1000.0)).alias("ms")).filter(
        F.col("ms").isNotNull())
    margin = 2 * RANK_ERROR
    bounds = F.percentile_approx("ms", [0.95 - margin, 0.95 + margin], int(1 / RANK_ERROR))
    totals = ms.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"),
                                    bounds.alias("_bounds"))
    # One row per mode of an evaluation, a handful.
    marked = ms.join(F.broadcast(totals.select("mode", F.col("_bounds")[0].alias("_low"),
                                               F.col("_bounds")[1].alias("_high"))), "mode")
    below = marked.groupBy("mode").agg(F.count_if(F.col("ms") < F.col("_low")).alias("_below"))
    band = (marked.filter(F.col("ms").between(F.col("_low"), F.col("_high")))
            .groupBy("mode", "ms").agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy("mode").orderBy("ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (band.withColumn("_upto", F.sum("_n").over(upto)).join(below, "mode")
             .join(totals, "mode")
             .filter(F.col("_below") + F.col("_upto") >= F.ceil(F.lit(0.95) * F.col("n"))))
    return found.groupBy("mode").agg(
        F.first("n").alias("n"),
        scoring.rounded(F.first("mean_ms"), 6).alias("mean_ms"),
        scoring.rounded(F.min("ms"), 6).alias("p95_ms"))
