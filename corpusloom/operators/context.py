"""Token-budgeted context for the hits of each query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import IDENTIFIER
from corpusloom.operators.chunking import context_windows, size, truncate

LEAST = 32


def assemble(queries: DataFrame, hits: DataFrame, chunks: DataFrame, parent_texts: DataFrame, *, budget: int = 4000, neighbors: int = 1, pool: int = 50, max_sources: int | None = None) -> DataFrame:
    """Context documents ``(query_id, position, doc_id, role, text, tokens, truncated)`` within a budget.

    Hits come first in their order, each followed by its parent and its
    neighbours; hits are clipped to what is left, other context only if
    ``LEAST`` tokens are. Queries with an identifier get hits only.
    ``hits``: ``query_id, doc_id, rank``; ``chunks``: ``id, source_id,
    chunk_index, text, parent_id``; at most ``pool`` hits a query are used.
    """
    few = hits.where(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("hit_rank"))
    base = chunks.select(F.col("id").alias("doc_id"), "source_id", "text", "parent_id")
    own = few.join(base, "doc_id").select("query_id", "hit_rank", F.lit(0).alias("turn"), F.lit(0).alias("offset"), "doc_id", F.lit("hit").alias("role"), "text", "source_id")
    plain = few.join(queries.where(~F.col("query").rlike(IDENTIFIER)).select("query_id"), "query_id", "left_semi")
    above = plain.join(base.select("doc_id", "parent_id", "source_id"), "doc_id").join(parent_texts.select("parent_id", "text"), "parent_id")
    above = above.select("query_id", "hit_rank", F.lit(1).alias("turn"), F.lit(0).alias("offset"), F.col("parent_id").alias("doc_id"), F.lit("parent").alias("role"), "text", "source_id")
    near = context_windows(chunks, few.select(F.col("doc_id").alias("id")), neighbors=neighbors).where("offset <> 0")
    beside = plain.join(near.withColumnRenamed("asked_id", "doc_id"), "doc_id").drop("doc_id").join(base.withColumnRenamed("doc_id", "id"), "id")
    beside = beside.select("query_id", "hit_rank", F.lit(2).alias("turn"), "offset", F.col("id").alias("doc_id"), F.lit("neighbor").alias("role"), "text", "source_id")
    every = own.unionByName(above).unionByName(beside)
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("hit_rank", "turn", "offset"))
    every = every.withColumn("_n", first).where("_n = 1 or role = 'hit'").drop("_n")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        left, rows, seen, sources = budget, [], set(), set()
        barred = None
        for r in group.sort_values(["hit_rank", "turn", "offset", "doc_id"]).itertuples():
            if r.role == "hit":
                barred = r.hit_rank if max_sources is not None and r.source_id not in sources and len(sources) >= max_sources else None
            if left <= 0 or r.doc_id in seen or r.hit_rank == barred:
                continue
            n = size(r.text or "")
            text, cut = r.text, False
            if n > left:
                if r.role != "hit" and left < LEAST:
                    continue
                text, cut = truncate(r.text, left), True
                n = left
            if r.role == "hit":
                sources.add(r.source_id)
            if text:
                seen.add(r.doc_id)
                rows.append((r.query_id, len(rows) + 1, r.doc_id, r.role, text, size(text), cut))
                left -= n
        return pd.DataFrame(rows, columns=["query_id", "position", "doc_id", "role", "text", "tokens", "truncated"])

    q = hits.schema["query_id"].dataType.simpleString()
    return every.groupBy("query_id").applyInPandas(pack, f"query_id {q}, position int, doc_id string, role string, text string, tokens int, truncated boolean")
