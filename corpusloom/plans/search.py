"""Hybrid search of a batch of queries over embedded chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import folded
from corpusloom.functions.vectors import embedding, hash_embedding, top_k
from corpusloom.operators import lexical, ranking
from corpusloom.operators.enrich import query_views
from corpusloom.operators.graph import graph_search
from corpusloom.operators.routing import routed, sub_queries
from corpusloom.plans.trace import Trace
from corpusloom.session import checkpointed, small_side


@dataclass(frozen=True)
class SearchConfig:
    """How many candidates each channel offers, and how they are fused and scored."""

    multiplier: int = 10
    least_candidates: int = 50
    dense: int = 80
    lexical: int = 120
    sparse: int = 120
    exact: int = 50
    fused: int = 120
    graph: int = 50
    graph_mode: str = "drift"
    rrf_k: int = 60
    blend: float = 0.65
    balance: float = 0.78
    per_source: int | None = 4
    feedback_weight: float = 0.05
    hybrid: bool = True
    diversity: bool = True
    dimensions: int = 384
    weights: dict = field(default_factory=lambda: dict(ranking.VIEW_WEIGHTS))


def with_views(queries: DataFrame, cfg: SearchConfig, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Queries with a vector for each of their views that is not empty."""
    for name, view in query_views(F.col("query")).items():
        filled = F.when(F.length(F.trim(view)) > 0, view)
        queries = queries.withColumn(f"q_{name}", embedding(filled, embed) if embed else hash_embedding(filled, cfg.dimensions))
    return queries


Channel = Callable[[DataFrame, DataFrame], DataFrame]
Stage = Callable[[DataFrame], DataFrame]

#: Weights of the channels beside those a route sets, and of graph search by its mode.
EXTRA_WEIGHTS = {"visual": 0.8, "graph": 0.7}
#: Most rows of query parts that are sent to the executors; more stay a table.
PARTS = 20_000


def search(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    k: int = 10,
    least: float = 0.0,
    allowed: Column | None = None,
    feedback: DataFrame | None = None,
    graph: DataFrame | tuple[DataFrame, DataFrame] | None = None,
    extra: dict[str, DataFrame | Channel] | None = None,
    rerank: list[Stage] = (),
    calibrator: ranking.PlattCalibrator | None = None,
    trust: str | None = None,
    cfg: SearchConfig = SearchConfig(),
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    trace: Trace | None = None,
    fail_open: bool = True,
) -> DataFrame:
    """Best ``k`` chunks of each query with all their scores, ``position`` and ``reasons``.

    ``queries``: ``query_id, query``; ``chunks``: rows of the ingest plan.
    ``allowed`` is a predicate on chunks placed before every rank. ``graph`` is
    a pair of entity and edge tables, searched for the queries whose route asks
    for it, or found candidates; ``extra`` holds further channels by name (such
    as ``visual``), each a frame ``(query_id, doc_id, score, rank)`` or a
    function of queries and allowed chunks that gives one. ``rerank`` stages
    take the hits with ``query``, ``text`` and ``score`` and give them scored
    anew; policy, feedback and trust come after every stage. A calibrator adds
    ``probability`` and changes no order. With ``fail_open`` an extra channel or
    stage that fails is left out and named in the trace's notes.
    Counts and lengths of the lexical channel are those of all chunks. A query
    no channel finds anything for has no rows.
    """
    if k < 1 or not 0 <= least <= 1:
        raise ValueError("k must be positive and the least score between 0 and 1")
    spark, trace = queries.sparkSession, trace if trace is not None else Trace()

    def guarded(name: str, make: Callable[[], DataFrame], instead: DataFrame | None) -> DataFrame | None:
        """A stage run to its end, so that its failure shows here."""
        try:
            with trace.span(name):
                return checkpointed(make())
        except Exception as e:
            if not fail_open:
                raise
            trace.notes.setdefault("failed", {})[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return instead

    asked = routed(queries.where(F.length(F.trim("query")) > 0).select("query_id", F.trim("query").alias("query")))
    limit = max(k * cfg.multiplier, cfg.least_candidates)
    parts = asked.withColumn("part", F.explode(F.when(F.col("use_multi_query"), sub_queries(F.col("query"))).otherwise(F.array("query"))))
    parts = parts.withColumn("part_id", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.md5("part")))
    parts = parts.select("part_id", "query_id", "dense_weight", "lexical_weight", "sparse_weight", "exact_weight", F.col("part").alias("query"))
    with trace.span("queries"):
        parts = small_side(checkpointed(parts), PARTS)
        views = checkpointed(with_views(parts, cfg, embed))
    seen = chunks if allowed is None else chunks.where(allowed)
    ids = None if allowed is None else seen.select(F.col("id").alias("doc_id"))
    base = chunks.withColumnRenamed("id", "doc_id")

    channels = []

    def offer(name: str, found: DataFrame, weight: Column) -> None:
        channels.append(found.select(F.col("query_id").alias("part_id"), "doc_id", "score", "rank").join(parts, "part_id").select("query_id", "part_id", "doc_id", F.col("score").cast("double").alias("score"), "rank", F.lit(name).alias("channel"), weight.cast("double").alias("weight")))

    for view in ranking.VIEWS:
        q = views.where(F.col(f"q_{view}").isNotNull()).select(F.col("part_id").alias("query_id"), F.col(f"q_{view}").alias("vector"))
        d = seen.select(F.col("id").alias("doc_id"), F.col(f"v_{view}").alias("vector"))
        offer(f"dense:{view}", top_k(q, d, k=min(limit, cfg.dense)), F.col("dense_weight") * cfg.weights.get(view, 1.0))
    if cfg.hybrid:
        q = parts.select(F.col("part_id").alias("query_id"), "query")
        fields = {"body": "text", "summary": "summary", "keywords": F.concat_ws(", ", "keywords"), "titles": F.concat_ws(" | ", "titles"), "references": F.concat_ws(" | ", "references")}
        offer("bm25", lexical.bm25(q, base, fields=fields, k=min(limit, cfg.lexical), allowed=ids), F.col("lexical_weight"))
        index = lexical.exact_terms(seen.withColumnRenamed("id", "doc_id"), text="text", extra="references")
        offer("exact", lexical.exact_search(q, index, k=min(limit, cfg.exact)), F.col("exact_weight"))
        sparse_q = lexical.sparse_terms(q.withColumnRenamed("query_id", "doc_id"), text="query").withColumnRenamed("doc_id", "query_id")
        offer("sparse", lexical.sparse_search(sparse_q, lexical.sparse_terms(seen.withColumnRenamed("id", "doc_id")), k=min(limit, cfg.sparse)), F.col("sparse_weight"))
    found_by: dict[str, DataFrame | Channel] = dict(extra or {})
    if isinstance(graph, tuple):
        named, edges = graph
        wants = asked.where("use_graph").select("query_id", "query")
        found_by["graph"] = lambda _, docs: graph_search(wants, named, edges, k=min(limit, cfg.graph), mode=cfg.graph_mode, allowed=docs.select("doc_id"))
    elif graph is not None:
        found_by["graph"] = graph
    for name, channel in found_by.items():
        make = (lambda c=channel: c(asked.select("query_id", "query"), seen.withColumnRenamed("id", "doc_id"))) if callable(channel) else (lambda c=channel: c)
        found = guarded(f"channel:{name}", lambda make=make: make().select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "rank"), None)
        if found is None:
            continue
        found = found if ids is None else found.join(ids.distinct(), "doc_id", "left_semi")
        score = 1.0 / F.col("rank") if name == "graph" else F.col("score")
        channels.append(found.select("query_id", F.col("query_id").cast("string").alias("part_id"), "doc_id", score.alias("score"), "rank", F.lit(name).alias("channel"), F.lit(EXTRA_WEIGHTS.get(name, 1.0)).alias("weight")))

    rankings = channels[0]
    for c in channels[1:]:
        rankings = rankings.unionByName(c)
    with trace.span("candidates"):
        rankings = checkpointed(rankings)  # read by the fusion, the scores and the reasons
    fused = ranking.reciprocal_rank_fusion(rankings, k=cfg.rrf_k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion"), "doc_id"))
    fused = fused.withColumn("_p", place).where(F.col("_p") <= max(limit, cfg.fused)).drop("_p")
    kind = F.when(F.col("channel").startswith("dense"), "dense").when(F.col("channel") == "bm25", "lexical").otherwise(F.col("channel"))
    best = rankings.groupBy("query_id", "doc_id", kind.alias("kind")).agg(F.max("score").alias("score"))
    best = ranking.max_normalized(best, ["query_id", "kind"]).groupBy("query_id", "doc_id").pivot("kind", ["dense", "lexical", "sparse", "exact", "graph", "visual"]).agg(F.first("score"))
    why = rankings.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("channel")).alias("reasons"))

    whole = small_side(checkpointed(with_views(asked.select("query_id", "query"), cfg, embed)), PARTS)
    # the few candidates meet the chunks by id first, vectors last
    wanted = checkpointed(fused.join(best, ["query_id", "doc_id"]).join(why, ["query_id", "doc_id"]))
    own = base.join(small_side(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    columns = ["doc_id", "source_id", "text", *[f"v_{v}" for v in ranking.VIEWS], *([trust] if trust else [])]
    hits = wanted.join(own.select(*dict.fromkeys(columns)), "doc_id").join(whole, "query_id")
    pairs = {v: (F.col(f"q_{v}"), F.col(f"v_{v}")) for v in ranking.VIEWS}
    hits = hits.withColumn("semantic", ranking.weighted_view_score(pairs, cfg.weights))
    parts_of = {c: F.col(c) for c in ("exact", "sparse", "lexical", "graph", "visual")}
    relevance = ranking.evidence_score(F.col("semantic"), F.col("fusion"), parts_of, cfg.blend) if cfg.hybrid else F.col("semantic")
    hits = hits.withColumn("relevance", relevance)
    if rerank:
        hits = checkpointed(hits.withColumn("score", F.col("relevance")))
        for i, stage in enumerate(rerank):
            name = f"rerank:{getattr(stage, '__name__', i)}"
            hits = guarded(name, lambda stage=stage, hits=hits: stage(hits), hits)
        hits = hits.withColumn("relevance", F.col("score"))
    if feedback is not None:
        hits = hits.withColumn("query_norm", folded("query")).join(feedback, ["query_norm", "doc_id"], "left")
    else:
        hits = hits.withColumn("feedback", F.lit(0.0))
    hits = hits.withColumn("score", ranking.policy_score(F.col("relevance"), F.col("feedback"), F.col(trust) if trust else F.lit(1.0), cfg.feedback_weight)).where(F.col("score") >= least)
    rows = hits.select("query_id", "query", "doc_id", "source_id", "score", "relevance", "semantic", "fusion", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("dense", "lexical", "sparse", "exact", "graph", "visual")], "reasons", F.col("v_raw_text").alias("vector"))
    if calibrator is not None:
        rows = rows.withColumn("probability", calibrator.predict(F.col("score")))
    if cfg.diversity:
        return ranking.diversified(rows, k=k, balance=cfg.balance, per_source=cfg.per_source, pool=max(limit, cfg.fused))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.drop("vector").withColumn("position", position).where(F.col("position") <= k)
