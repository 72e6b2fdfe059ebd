"""Fusion, scores, policy, diversity, learned rankers and calibration over ``(query_id, doc_id, ...)`` frames."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine
from corpusloom.session import checkpointed, read_text, write_text

VIEWS = ("raw_text", "summary", "keywords", "titles", "references")
VIEW_WEIGHTS = {"raw_text": 0.30, "summary": 0.25, "keywords": 0.15, "titles": 0.20, "references": 0.10}
#: How much each kind of evidence counts against a semantic match.
DAMPING = {"exact": 1.0, "sparse": 0.92, "lexical": 0.85, "visual": 0.85, "graph": 0.80}
FEATURES = ("semantic", "dense", "lexical", "sparse", "exact", "graph", "fusion")


def normal_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights summing to 1; negative or all-zero weights are an error."""
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must be positive in sum and none negative")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def reciprocal_rank_fusion(rankings: DataFrame, *, k: int = 60) -> DataFrame:
    """Fused scores ``(query_id, doc_id, fusion)`` of ranked lists ``(query_id, doc_id, rank, weight)``.

    Each list adds ``weight / (k + rank)``; scores are divided by the query's largest where that is positive.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    total = rankings.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("raw"))
    top = F.max("raw").over(Window.partitionBy("query_id"))
    return total.select("query_id", "doc_id", F.when(top > 0, F.col("raw") / top).otherwise(F.col("raw")).alias("fusion"))


def max_normalized(scores: DataFrame, by: list[str]) -> DataFrame:
    """``score`` divided by the largest of its group, 0 where that is not positive."""
    top = F.max("score").over(Window.partitionBy(*by))
    return scores.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)))


def view_score(a: Column, b: Column) -> Column:
    """Positive cosine of two views, 0 where one is missing."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def weighted_view_score(pairs: dict[str, tuple[Column, Column]], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the view scores over the views both sides have."""
    weights = normal_weights(weights or VIEW_WEIGHTS)
    there = {v: (F.size(a) > 0) & (F.size(b) > 0) for v, (a, b) in pairs.items()}
    top = sum((F.when(there[v], F.lit(weights[v]) * view_score(a, b)).otherwise(0.0) for v, (a, b) in pairs.items()), F.lit(0.0))
    low = sum((F.when(there[v], F.lit(weights[v])).otherwise(0.0) for v in pairs), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(F.lit(0.0))


def evidence_score(semantic: Column, fusion: Column, channels: dict[str, Column], blend: float = 0.65) -> Column:
    """The strongest evidence of all channels blended with the fused rank."""
    best = F.greatest(F.coalesce(semantic, F.lit(0.0)), *[F.lit(DAMPING[c]) * F.coalesce(v, F.lit(0.0)) for c, v in channels.items()])
    return F.lit(blend) * best + F.lit(1 - blend) * F.coalesce(fusion, F.lit(0.0))


def clipped(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def policy_score(score: Column, feedback: Column, trust: Column, feedback_weight: float = 0.05) -> Column:
    """Relevance moved by feedback and multiplied by the trust in the source, applied after every ranker."""
    adjusted = clipped(clipped(score) + F.lit(feedback_weight) * F.coalesce(feedback, F.lit(0.0)))
    return adjusted * clipped(F.coalesce(trust, F.lit(1.0)))


def source_capped(hits: DataFrame, per_source: int) -> DataFrame:
    """At most so many hits of one source a query, the best first, ties by id."""
    place = F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("_place", place).where(F.col("_place") <= per_source).drop("_place")


def diversified(hits: DataFrame, *, k: int, balance: float = 0.78, per_source: int | None = 4, pool: int = 120) -> DataFrame:
    """Maximal marginal relevance: greedy choice of ``k`` hits a query, with ``position``.

    A hit's worth is ``balance`` times its score less the rest times its
    largest cosine with one already chosen. Needs ``query_id, doc_id,
    source_id, score, vector``; only the best ``pool`` hits of a query compete,
    so a group fits in memory. Ties go to the higher score, then the lower id.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    few = hits.withColumn("_r", rank).where(F.col("_r") <= pool).drop("_r")
    balance = max(0.0, min(1.0, balance))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        score = group["score"].to_numpy(float)
        width = max((len(v) for v in group["vector"] if v is not None), default=0)
        x = np.zeros((len(group), width))
        for i, v in enumerate(group["vector"]):
            if v is not None and len(v) == width and width:
                n = np.linalg.norm(v)
                x[i] = np.asarray(v, float) / n if n else 0.0
        near, free = np.zeros(len(group)), np.ones(len(group), bool)
        chosen: list[int] = []
        used: dict = {}
        while free.any() and len(chosen) < k:
            worth = np.where(free, balance * score - (1 - balance) * near, -np.inf)
            i = int(worth.argmax())
            free[i] = False
            source = group.at[i, "source_id"]
            if per_source is not None and used.get(source, 0) >= per_source:
                continue
            used[source] = used.get(source, 0) + 1
            chosen.append(i)
            near = np.maximum(near, x @ x[i])
        out = group.loc[chosen].drop(columns="vector")
        out["position"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    fields = [f for f in few.schema.fields if f.name != "vector"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", position int"
    return few.groupBy("query_id").applyInPandas(choose, shape)


def reranked(hits: DataFrame, score: Column, *, blend: float | None = None, top: int = 30) -> DataFrame:
    """The best ``top`` hits of a query scored anew (blended with the old score, or replacing it), the tail as it was."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    new = score if blend is None else F.lit(1 - blend) * F.col("score") + F.lit(blend) * score
    return hits.withColumn("_r", rank).withColumn("score", F.when(F.col("_r") <= top, new).otherwise(F.col("score"))).drop("_r")


def callable_score(fn: Callable[[list[str], list[str]], list[float]], query: str, text: str) -> Column:
    """Scores of (query, text) pairs by an injected batch function, such as a cross encoder."""
    @F.arrow_udf("double")
    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([float(x) for x in fn(q.to_pylist(), t.to_pylist())], pa.float64())

    return run(query, text)


def term_max_sim(query: str, text: str, *, dimensions: int = 384, query_terms: int = 24, text_terms: int = 96) -> Column:
    """Late interaction over hash embeddings of single terms; 0 when a side has none."""
    from corpusloom.functions.vectors import hash_embed

    @F.arrow_udf("double")
    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        cache: dict[str, np.ndarray] = {}

        def rows(words: list[str]) -> np.ndarray:
            return np.array([cache.setdefault(w, hash_embed(w, dimensions)) for w in words])

        out = []
        for a, b in zip(q.to_pylist(), t.to_pylist()):
            x, y = (a or "").split()[:query_terms], (b or "").split()[:text_terms]
            out.append(float(np.maximum(rows(x) @ rows(y).T, 0).max(1).mean()) if x and y else 0.0)
        return pa.array(out, pa.float64())

    return run(query, text)


# ---- learned rankers: penalized logistic regression by Newton steps on sums over all rows, applied as expressions


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _local_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Callable:
    """Gradient, curvature and weight of the logistic loss of rows in memory, at given coefficients."""

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x, float(weight.sum())

    return sums


def _frame_sums(rows: DataFrame, x: list[Column], y: Column, weight: Column) -> Callable:
    """The same of the rows of a frame, by one aggregation a step."""
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    held = checkpointed(rows.select(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(x)], y.cast("double").alias("y"), weight.cast("double").alias("w")).where("y is not null and w is not null"))

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        raw = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        at = held.withColumn("p", 1 / (1 + F.exp(-raw)))
        gap, bend = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1 - F.col("p"))
        got = at.agg(F.sum("w"), *[F.sum(gap * F.col(f"x{i}")) for i in range(n)], *[F.sum(bend * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        total, rest = got[0] or 0.0, [v or 0.0 for v in got[1:]]
        curve = np.zeros((n, n))
        for (i, j), v in zip(pairs, rest[n:]):
            curve[i, j] = curve[j, i] = v
        return np.array(rest[:n]), curve, total

    return sums


def _newton(sums: Callable, start: np.ndarray, penalty: np.ndarray, steps: int) -> np.ndarray:
    """Coefficients of least mean loss with ``penalty`` on their squares."""
    beta = start
    for _ in range(steps):
        slope, curve, total = sums(beta)
        if not total:
            break
        slope, curve = slope / total + penalty * beta, curve / total + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        size = float(np.abs(step).max())
        beta = beta - step * min(1.0, 4.0 / size if size else 1.0)  # far from the solution a full step may overshoot
        if size < 1e-7:
            break
    return beta


class LinearRanker:
    """Logistic regression over the seven channel features."""

    def __init__(self, l2: float = 0.001, steps: int = 40) -> None:
        self.l2, self.steps = l2, steps
        self.bias, self.weights = 0.0, dict.fromkeys(FEATURES, 0.0)

    @staticmethod
    def label(value: float) -> float:
        """Feedback from -1 as a label from 0: a negative value is moved, others are clipped."""
        return (max(-1.0, value) + 1) / 2 if value < 0 else min(1.0, value)

    def fit(self, rows: DataFrame | list[tuple[dict[str, float], float]]) -> LinearRanker:
        """Fit on a frame with a column a feature (absent ones are 0) and ``value``, or on a list of features and value."""
        if isinstance(rows, DataFrame):
            value = F.col("value")
            y = F.when(value < 0, (F.greatest(F.lit(-1.0), value) + 1) / 2).otherwise(F.least(F.lit(1.0), value))
            sums = _frame_sums(rows, [F.lit(1.0), *(F.col(f) if f in rows.columns else F.lit(0.0) for f in FEATURES)], y, F.lit(1.0))
        else:
            x = np.array([[1.0, *(f.get(n, 0.0) for n in FEATURES)] for f, _ in rows]).reshape(-1, len(FEATURES) + 1)
            sums = _local_sums(x, np.array([self.label(v) for _, v in rows]), np.ones(len(rows)))
        beta = _newton(sums, np.array([self.bias, *self.weights.values()]), np.array([0.0, *[self.l2] * len(FEATURES)]), self.steps)
        self.bias, self.weights = float(beta[0]), dict(zip(FEATURES, map(float, beta[1:])))
        return self

    def score(self, features: dict[str, Column]) -> Column:
        raw = sum((F.lit(self.weights[f]) * F.coalesce(features[f], F.lit(0.0)) for f in FEATURES if f in features), F.lit(self.bias))
        return 1 / (1 + F.exp(-raw))

    def save(self, path: str | Path, spark: SparkSession | None = None) -> None:
        """Write the weights; with a session to any file system it knows."""
        text = json.dumps({"bias": self.bias, "weights": self.weights})
        if spark is None:
            Path(path).write_text(text)
        else:
            write_text(spark, str(path), text)

    @classmethod
    def load(cls, path: str | Path, spark: SparkSession | None = None) -> LinearRanker:
        data, out = json.loads(Path(path).read_text() if spark is None else read_text(spark, str(path))), cls()
        out.bias = data.get("bias", 0.0)
        out.weights = {f: data.get("weights", {}).get(f, 0.0) for f in FEATURES}
        return out


class PairwiseRanker(LinearRanker):
    """Weights that put the better of two feature sets first; no bias."""

    def fit_pairs(self, rows: DataFrame | list[tuple[dict[str, float], dict[str, float], float]]) -> PairwiseRanker:
        """Fit on a frame with columns ``good_`` and ``bad_`` of features and ``weight``, or on a list; negative weights count as none."""
        if isinstance(rows, DataFrame):
            own = lambda side, f: F.coalesce(F.col(f"{side}_{f}"), F.lit(0.0)) if f"{side}_{f}" in rows.columns else F.lit(0.0)
            sums = _frame_sums(rows, [own("good", f) - own("bad", f) for f in FEATURES], F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight")))
        else:
            x = np.array([[g.get(f, 0.0) - b.get(f, 0.0) for f in FEATURES] for g, b, _ in rows]).reshape(-1, len(FEATURES))
            sums = _local_sums(x, np.ones(len(rows)), np.array([max(0.0, w) for _, _, w in rows]))
        beta = _newton(sums, np.array(list(self.weights.values())), np.full(len(FEATURES), self.l2), self.steps)
        self.weights = dict(zip(FEATURES, map(float, beta)))
        return self


class PlattCalibrator:
    """Score to probability; never changes an order."""

    def __init__(self, l2: float = 0.001, steps: int = 40) -> None:
        self.l2, self.steps, self.a, self.b = l2, steps, 1.0, 0.0

    def fit(self, rows: DataFrame | list[tuple[float, float]]) -> PlattCalibrator:
        """Fit on a frame ``score, label`` or a list of both; labels are clipped to 0..1."""
        if isinstance(rows, DataFrame):
            sums = _frame_sums(rows, [F.col("score"), F.lit(1.0)], clipped(F.col("label").cast("double")), F.lit(1.0))
        else:
            x = np.array([[s, 1.0] for s, _ in rows]).reshape(-1, 2)
            sums = _local_sums(x, np.array([max(0.0, min(1.0, float(v))) for _, v in rows]), np.ones(len(rows)))
        self.a, self.b = map(float, _newton(sums, np.array([self.a, self.b]), np.array([self.l2, 0.0]), self.steps))
        return self

    def predict(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.a) * score + F.lit(self.b))))


# ---- feedback


def feedback_scores(feedback: DataFrame, *, query: str = "query_text", doc: str = "document_id", relevance: str = "relevance") -> DataFrame:
    """Mean relevance ``(query_norm, doc_id, feedback)`` of each folded query and document, each event clipped to -1..1."""
    from corpusloom.functions.text import folded

    rows = feedback.where(F.col(relevance).isNotNull() & F.col(query).isNotNull() & F.col(doc).isNotNull())
    return rows.groupBy(folded(query).alias("query_norm"), F.col(doc).alias("doc_id")).agg(F.avg(clipped(F.col(relevance), -1.0, 1.0)).alias("feedback"))
