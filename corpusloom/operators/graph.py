"""Entity graph: neighbours, communities and graph retrieval by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import folded
from corpusloom.operators.lexical import ranked
from corpusloom.session import checkpointed


def graph_tables(docs: DataFrame, *, id_col: str = "doc_id", entities: str = "entities", relations: str = "relations") -> tuple[DataFrame, DataFrame]:
    """``entity_docs(entity, doc_id)`` and ``edges(source, relation, target, doc_id)`` from arrays of names and triples."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.explode(entities).alias("e")).where("e is not null").select(F.lower("e").alias("entity"), "doc_id")
    triples = docs.select(F.col(id_col).alias("doc_id"), F.explode(relations).alias("r")).where(F.size("r") >= 3)
    edges = triples.select(F.lower(F.col("r")[0]).alias("source"), F.col("r")[1].alias("relation"), F.lower(F.col("r")[2]).alias("target"), "doc_id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("entity"), "doc_id")
    return named.unionByName(ends).distinct(), edges


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours ``(entity, neighbour)``; an edge to itself is none."""
    both = edges.select(F.col("source").alias("entity"), F.col("target").alias("neighbour")).unionByName(edges.select(F.col("target").alias("entity"), F.col("source").alias("neighbour")))
    return both.where("entity <> neighbour").distinct()


def communities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components ``(entity, community)``, each named by its first entity.

    Labels spread along edges and jump to their own label's label, so the
    number of rounds grows with the logarithm of a component's width; every
    round is checkpointed.
    """
    pairs = checkpointed(neighbours(edges))
    labels = checkpointed(entities.select("entity").unionByName(pairs.select("entity")).distinct().withColumn("community", F.col("entity")))
    while True:
        near = pairs.join(labels.withColumnRenamed("entity", "neighbour"), "neighbour").groupBy("entity").agg(F.min("community").alias("near"))
        spread = labels.join(near, "entity", "left").select("entity", "community", F.least("community", F.coalesce("near", "community")).alias("new"))
        jump = spread.join(labels.select(F.col("entity").alias("new"), F.col("community").alias("further")), "new", "left")
        after = checkpointed(jump.select("entity", F.least("new", F.coalesce("further", "new")).alias("new"), F.col("community").alias("old")))
        if not after.where("new <> old").limit(1).count():
            return after.select("entity", F.col("new").alias("community"))
        labels = after.select("entity", F.col("new").alias("community"))


def _substrings(queries: DataFrame, longest: int) -> DataFrame:
    """Substrings of the folded queries up to the longest entity: ``(q, part)``; an entity inside a query is one of them."""
    asked = queries.select(F.col("query_id").alias("q"), folded("query").alias("t")).where("t <> ''")
    at = asked.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("t"))))
    parts = at.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("t") - F.col("i") + 1))))
    return parts.select("q", F.expr("substring(t, i, n)").alias("part")).distinct()


def graph_search(queries: DataFrame, entity_docs: DataFrame, edges: DataFrame, *, k: int = 20, mode: str = "drift", allowed: DataFrame | None = None) -> DataFrame:
    """Documents near the entities a query names: ``(query_id, doc_id, score, rank)``.

    ``local``: 2 for a named entity's documents, 1 for its neighbours';
    ``drift`` adds 0.4 for every path of two steps; ``global`` scores the
    communities that share words with the query by their overlap and size.
    Rows of ``allowed`` (ids) are chosen before the rank.
    """
    docs = entity_docs if allowed is None else entity_docs.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    if mode == "global":
        groups = communities(entity_docs, edges)
        words = groups.withColumn("word", F.explode(F.array_distinct(F.split("entity", " "))))
        asked = queries.select(F.col("query_id").alias("q"), F.explode(F.array_distinct(F.split(folded("query"), " "))).alias("word"))
        overlap = words.join(asked, "word").select("q", "community", "entity").distinct().groupBy("q", "community").agg(F.count("*").alias("overlap"))
        weight = groups.join(entity_docs, "entity").groupBy("community").agg(F.count("*").alias("n"))
        scores = overlap.join(weight, "community").select("q", "community", (F.col("overlap") + 0.01 * F.col("n")).alias("w"))
        found = groups.join(scores, "community").join(docs, "entity").select("q", "doc_id", "w")
    else:
        longest = entity_docs.agg(F.max(F.length("entity"))).first()[0] or 0
        named = _substrings(queries, longest).join(entity_docs.select(F.col("entity").alias("part")).distinct(), "part").select("q", F.col("part").alias("entity"))
        pairs = neighbours(edges)
        one = named.join(pairs, "entity").select("q", F.col("neighbour").alias("entity"), F.col("entity").alias("start"))
        steps = named.select("q", "entity", F.lit(2.0).alias("w")).unionByName(one.select("q", "entity", F.lit(1.0).alias("w")))
        if mode == "drift":
            two = one.join(pairs, "entity").select("q", F.col("neighbour").alias("entity"), F.lit(0.4).alias("w"))
            steps = steps.unionByName(two)
        elif mode != "local":
            raise ValueError("mode must be local, drift or global")
        found = steps.groupBy("q", "entity").agg(F.sum("w").alias("w")).join(docs, "entity").select("q", "doc_id", "w")
    scored = found.groupBy("q", "doc_id").agg(F.sum("w").alias("score"))
    return ranked(scored, ["q"], k).select(F.col("q").alias("query_id"), "doc_id", "score", "rank")
