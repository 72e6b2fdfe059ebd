"""Retrieval metrics over frames of retrieved and relevant ids, boundary and citation measures, percentiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduped_ranks(retrieved: DataFrame, item: str = "item") -> DataFrame:
    """Each item of a query at its first rank, ranks without gaps again."""
    first = retrieved.groupBy("query_id", item).agg(F.min("rank").alias("_first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", item))).drop("_first")


def query_metrics(cases: DataFrame, retrieved: DataFrame, relevant: DataFrame, *, k: int = 10, item: str = "item") -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG of each query of ``cases``.

    ``retrieved`` has ``query_id, item, rank``; ``relevant`` has ``query_id,
    item``. Reciprocal rank looks at all retrieved items, the rest at the first
    ``k``. Without relevant items recall and NDCG are 1.
    """
    wanted = relevant.select("query_id", item).distinct()
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    hits = retrieved.join(wanted.withColumn("_hit", F.lit(1)), ["query_id", item])
    got = hits.groupBy("query_id").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("n_hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"))
    need = wanted.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.col("n_rel"))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = cases.select("query_id").distinct().join(got, "query_id", "left").join(need, "query_id", "left").na.fill(0, ["n_hits", "n_rel"])
    return rows.select(
        "query_id",
        (F.col("n_hits") / k).alias("precision_at_k"),
        F.when(F.col("n_rel") > 0, F.col("n_hits") / F.col("n_rel")).otherwise(1.0).alias("recall_at_k"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("n_rel") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(1.0).alias("ndcg_at_k"),
    )


def report(metrics: DataFrame) -> DataFrame:
    """Means over all queries, in one row."""
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count("*").alias("n_cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def source_diversity(retrieved: DataFrame, source: str = "source_id") -> DataFrame:
    """Share of different sources among a query's hits."""
    return retrieved.groupBy("query_id").agg((F.countDistinct(source) / F.count("*")).alias("source_diversity"))


def linear_percentile(col: str, percent: float) -> Column:
    """Percentile with linear interpolation."""
    return F.percentile(col, percent / 100)


def nearest_rank_percentile(col: str, share: float) -> Column:
    """The smallest value that at least this share of the values does not exceed."""
    return F.expr(f"percentile_disc({share}) within group (order by `{col}`)")


def citation_coverage(cited: Column, required: Column) -> Column:
    """Share of the required sources that are cited; 1 when none is required."""
    need = F.array_distinct(F.coalesce(required, F.array().cast("array<string>")))
    got = F.size(F.array_intersect(F.coalesce(cited, F.array().cast("array<string>")), need))
    return F.when(F.size(need) > 0, got / F.size(need)).otherwise(1.0)


def boundary_f1(boundaries: DataFrame, *, tolerance: int = 0, key: str = "doc_id") -> DataFrame:
    """Precision, recall and F1 of boundaries given as arrays ``predicted`` and ``gold``.

    Each predicted boundary, in order, takes the nearest gold one within the
    tolerance that is still free. At tolerance 0 this is the size of the
    intersection and stays in the JVM.
    """
    pred, gold = F.size("predicted"), F.size("gold")
    if tolerance == 0:
        hit = F.size(F.array_intersect(F.array_distinct("predicted"), F.array_distinct("gold")))
        rows = boundaries.select(key, hit.alias("tp"), pred.alias("p"), gold.alias("g"))
    else:
        @F.arrow_udf("int")
        def matched(a: pa.Array, b: pa.Array) -> pa.Array:
            out = []
            for p, g in zip(a.to_pylist(), b.to_pylist()):
                free, n = sorted(g), 0
                for x in p:
                    near = min(free, key=lambda y: (abs(x - y), g.index(y)), default=None)
                    if near is not None and abs(x - near) <= tolerance:
                        free.remove(near)
                        n += 1
                out.append(n)
            return pa.array(out, pa.int32())

        rows = boundaries.select(key, matched("predicted", "gold").alias("tp"), pred.alias("p"), gold.alias("g"))
    precision = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).when(F.col("g") > 0, 0.0).otherwise(1.0)
    recall = F.when(F.col("g") > 0, F.col("tp") / F.col("g")).otherwise(1.0)
    both = rows.select(key, precision.alias("precision"), recall.alias("recall"))
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def objective(recall: float, candidate_recall: float, ndcg: float, mrr: float) -> float:
    return 0.45 * recall + 0.25 * candidate_recall + 0.2 * ndcg + 0.1 * mrr


def optimize(grid: dict[str, Iterable], run: Callable[[dict], dict[str, float]]) -> pd.DataFrame:
    """Every setting of a grid run and measured, best objective first; each run is a Spark job of its own."""
    rows = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values))
        got = run(setting)
        rows.append({**setting, **got, "objective": objective(got["recall_at_k"], got.get("candidate_recall", got["recall_at_k"]), got["ndcg_at_k"], got["reciprocal_rank"])})
    return pd.DataFrame(rows).sort_values("objective", ascending=False, kind="stable").reset_index(drop=True)
