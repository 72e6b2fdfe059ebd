"""Summary, keywords, titles, references, entities and context of chunks, and views of queries."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS, TERM, identifiers, sentence_parts


def summary(text: Column, parts: int = 2, longest: int = 700) -> Column:
    """The first sentence parts, cut at ``longest`` characters; the text's beginning if there is none."""
    own = F.substring(F.concat_ws(" ", F.slice(sentence_parts(text), 1, parts)), 1, longest)
    return F.when(F.length(own) > 0, own).otherwise(F.substring(text, 1, longest))


def words(text: Column) -> Column:
    """Lower-case words of more than two letters that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def keywords(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = 20) -> DataFrame:
    """The ``k`` most frequent words of each document, ties by first place: ``(id, keyword, n, rank)``."""
    placed = docs.select(F.col(id_col), F.posexplode(words(F.col(text))).alias("place", "keyword"))
    counted = placed.groupBy(id_col, "keyword").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "place"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select(id_col, "keyword", "n", "rank")


def keyword_list(col: Column | str, k: int = 20) -> Column:
    """The ``k`` most frequent words of a text as an array, ties by first place."""
    stop = frozenset(STOPWORDS)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            found = Counter(w for w in re.findall(r"[\w\-]+", (t or "").lower()) if len(w) > 2 and w not in stop)
            out.append([w for w, _ in sorted(found.items(), key=lambda x: -x[1])[:k]])
        return pa.array(out, pa.list_(pa.string()))

    return run(col)


def references(text: Column, k: int = 20) -> Column:
    return F.slice(F.array_distinct(identifiers(text)), 1, k)


def titles(title: Column, path: Column) -> Column:
    """Title and section names, each once, null and empty ones left out."""
    both = F.concat(F.array(title), F.coalesce(path, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda t: t.isNotNull() & (t != "")))


def entities(titles_: Column, references_: Column, k: int = 24) -> Column:
    return F.slice(F.array_distinct(F.concat(titles_, references_)), 1, k)


def context_text(text: Column, titles_: Column, parent: Column) -> Column:
    """The text led by lines for its titles and parent where there are any."""
    head = F.when(F.size(titles_) > 0, F.concat(F.lit("Title/section: "), F.concat_ws(" > ", titles_)))
    above = F.when(F.length(parent) > 0, F.concat(F.lit("Parent context: "), parent))
    return F.concat_ws("\n", head, above, text)


def enriched(chunks: DataFrame, *, text: str = "text", title: str | None = None, path: str = "section_path") -> DataFrame:
    """Chunks with ``summary, keywords, titles, references, entities, context_text``; given values of these stay."""
    have, t = set(chunks.columns), F.col(text)
    out = chunks
    new = {
        "summary": summary(t),
        "keywords": keyword_list(text),
        "titles": titles(F.col(title) if title else F.lit(None).cast("string"), F.col(path) if path in have else F.lit(None).cast("array<string>")),
        "references": references(t),
    }
    for name, value in new.items():
        out = out.withColumn(name, F.coalesce(F.when((F.size(name) if "array" in dict(chunks.dtypes)[name] else F.length(name)) > 0, F.col(name)), value) if name in have else value)
    out = out.withColumn("entities", entities(F.col("titles"), F.col("references")))
    return out.withColumn("context_text", context_text(t, F.col("titles"), F.concat_ws(" > ", path) if path in have else F.lit(None).cast("string")))


def query_views(query: Column) -> dict[str, Column]:
    """The five texts a query is embedded as."""
    unique = F.array_distinct(words(query))
    return {
        "raw_text": query,
        "summary": query,
        "keywords": F.concat_ws(", ", F.slice(unique, 1, 16)),
        "titles": F.concat_ws(" ", F.slice(unique, 1, 6)),
        "references": F.concat_ws(" | ", identifiers(query)),
    }


def document_views() -> dict[str, Column]:
    """The five texts an enriched chunk is embedded as."""
    return {
        "raw_text": F.col("context_text"),
        "summary": F.col("summary"),
        "keywords": F.concat_ws(", ", "keywords"),
        "titles": F.concat_ws(" | ", "titles"),
        "references": F.concat_ws(" | ", "references"),
    }
