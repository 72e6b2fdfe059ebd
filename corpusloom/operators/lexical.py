"""Term statistics, BM25 over one or several fields, sparse and exact-identifier search, for batches of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, identifiers, normal_form, terms
from corpusloom.session import checkpointed, rows_within, small_side

#: Most query terms sent to the executors as a set.
TERMS = 1_000_000

#: Weights of the fields of a chunk.
FIELD_WEIGHTS = {"body": 1.0, "summary": 1.15, "keywords": 1.35, "titles": 1.8, "references": 1.6}


def term_frequencies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, term, tf)`` of every search term."""
    return docs.select(F.col(id_col), F.explode(terms(folded(text))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def ranked(scored: DataFrame, by: list[str], k: int, id_col: str = "doc_id") -> DataFrame:
    """The best ``k`` rows of each group, ties (to nine digits, whatever the order of summing) by id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, *, fields: dict[str, Column | str], weights: dict[str, float] | None = None, k: int = 10, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None, query_id: str = "query_id", query: str = "query", id_col: str = "doc_id") -> DataFrame:
    """Best ``k`` documents of each query: ``(query_id, doc_id, score, rank)``.

    Each field is an index of its own; with several, a field offers its best
    ``3 k`` documents and scores are added by weight. Document counts, document
    frequencies and lengths are those of the whole corpus, whatever ``allowed``
    (a frame of ids) leaves; a query term given twice counts twice. Only terms
    of the queries leave the one scan of the documents.
    """
    weights = weights or FIELD_WEIGHTS
    asked = queries.select(F.col(query_id).alias("q"), F.explode(terms(folded(query))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    asked = small_side(asked)
    names = list(fields)
    text_of = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias(f"f{i}") for i, c in enumerate(fields.values())]
    # one pass over the documents keeps their lengths and the counts of wanted terms
    hits = checkpointed(_wanted_terms(docs.select(F.col(id_col).alias("d"), *text_of), asked.select("term").distinct(), len(names)))
    sizes = hits.agg(F.count("*").alias("n"), *[F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(len(names))]).first()
    n_docs = sizes["n"]
    every = hits.select("d", F.explode("hits").alias("h")).select("d", "h.*").withColumnRenamed("size", "dl")
    kept = every if allowed is None else every.join(allowed.select(F.col(id_col).alias("d")).distinct(), "d", "left_semi")
    df = small_side(every.groupBy("field", "term").agg(F.count("*").alias("df")))
    mean = F.element_at(F.array(*[F.lit(float(max((sizes[f"s{i}"] or 0) / max(n_docs, 1), 1e-9))) for i in range(len(names))]), F.col("field") + 1)
    idf = F.log(1.0 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / mean))
    out = kept.join(df, ["field", "term"]).join(asked, "term").groupBy("q", "field", "d").agg(F.sum(F.col("qtf") * idf * gain).alias("score"))
    if len(names) > 1:
        weight = F.element_at(F.array(*[F.lit(float(weights.get(n, 1.0))) for n in names]), F.col("field") + 1)
        out = ranked(out, ["q", "field"], 3 * k, "d").select("q", "d", (F.col("score") * weight).alias("score")).groupBy("q", "d").agg(F.sum("score").alias("score"))
    return ranked(out, ["q"], k, "d").select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score", "rank")


def _wanted_terms(docs: DataFrame, wanted: DataFrame, n_fields: int) -> DataFrame:
    """``(d, sizes, hits)``: lengths of the fields ``f0, f1, ...`` and the counts of wanted terms in them.

    The wanted terms, those of a batch of queries, go to the executors if there
    are at most ``TERMS``; beyond that all terms are kept and the others leave
    through a join.
    """
    spark = docs.sparkSession
    chosen = None
    if rows_within(wanted, TERMS):
        chosen = spark.sparkContext.broadcast(frozenset(wanted.toArrow().column("term").to_pylist()))
    item = pa.struct([("field", pa.int32()), ("term", pa.string()), ("tf", pa.int64()), ("size", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if chosen is None else chosen.value
        for batch in batches:
            sizes, hits = [], []
            for texts in zip(*(batch.column(1 + i).to_pylist() for i in range(n_fields))):
                lengths, found = [], []
                for i, t in enumerate(texts):
                    words = re.findall(r"[\w\-]+", normal_form(t).casefold()) if t else []
                    lengths.append(len(words))
                    n = Counter(words if keep is None else (w for w in words if w in keep))
                    found += [{"field": i, "term": w, "tf": c, "size": len(words)} for w, c in n.items()]
                sizes.append(lengths)
                hits.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.list_(pa.int64())), pa.array(hits, pa.list_(item))], names=["d", "sizes", "hits"])

    kind = docs.schema["d"].dataType.simpleString()
    got = docs.mapInArrow(count, f"d {kind}, sizes array<long>, hits array<struct<field:int,term:string,tf:long,size:long>>")
    if chosen is not None:
        return got
    some = got.select("d", F.explode("hits").alias("h")).join(wanted.withColumnRenamed("term", "w"), F.col("h.term") == F.col("w"), "left_semi").groupBy("d").agg(F.collect_list("h").alias("hits"))
    return got.select("d", "sizes").join(some, "d", "left").withColumn("hits", F.coalesce("hits", F.array().cast(some.schema["hits"].dataType)))


def sparse_search(queries: DataFrame, docs: DataFrame, *, k: int, allowed: DataFrame | None = None, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Dot products of sparse vectors given as ``(id, dim, weight)`` rows; the best ``k`` of each query."""
    kept = docs if allowed is None else docs.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    asked = small_side(queries.select(query_id, "dim", F.col("weight").alias("qw")))
    scored = kept.join(asked, "dim").groupBy(query_id, id_col).agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    return ranked(scored, [query_id], k, id_col).select(query_id, id_col, "score", "rank")


def sparse_terms(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", dims: int = 1_000_003) -> DataFrame:
    """A built-in sparse encoding: ``(id, dim, weight)`` with damped term counts in hashed dimensions."""
    tf = term_frequencies(docs, id_col=id_col, text=text)
    dim = F.pmod(F.conv(F.substring(F.md5("term"), 1, 12), 16, 10).cast("long"), F.lit(dims))
    return tf.groupBy(id_col, dim.alias("dim")).agg(F.sum(1.0 + F.log(F.col("tf").cast("double"))).alias("weight"))


def sparse_encoded(docs: DataFrame, encode: Callable[[list[str]], list[dict[int, float]]], *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Sparse vectors ``(id, dim, weight)`` by an injected batch function from texts to weights by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = encode(batch.column(1).to_pylist())
            who = [i for i, v in enumerate(got) for _ in v]
            flat = [x for v in got for x in v.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array([d for d, _ in flat], pa.int64()), pa.array([float(w) for _, w in flat], pa.float64())], names=["i", "dim", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    return rows.mapInArrow(run, f"i {kind}, dim long, weight double").withColumnRenamed("i", id_col)


def exact_terms(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", extra: str | None = None) -> DataFrame:
    """Distinct identifiers ``(id, term)`` of the documents, folded; ``extra`` names an array column of further terms."""
    found = identifiers(F.col(text))
    found = found if extra is None else F.concat(F.coalesce(found, F.array().cast("array<string>")), F.coalesce(F.col(extra), F.array().cast("array<string>")))
    return docs.select(id_col, F.explode(found).alias("raw")).select(id_col, folded("raw").alias("term")).where("term <> ''").distinct()


def exact_search(queries: DataFrame, index: DataFrame, *, k: int, query_id: str = "query_id", query: str = "query", id_col: str = "doc_id", codes_only: bool = True) -> DataFrame:
    """Documents with an indexed term inside the query: each adds 1 and its share of the query's length.

    A term inside the query is one of its substrings, so queries are spelt out
    into these and joined by equality instead of comparing every term with
    every query. With ``codes_only`` only substrings an identifier can be are
    spelt out: those with two digits, and links.
    """
    longest = index.agg(F.max(F.length("term"))).first()[0] or 0
    asked = queries.select(F.col(query_id).alias("q"), folded(query).alias("t")).where("t <> ''")
    starts = asked.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("t"))))
    ends = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("t") - F.col("i") + 1))))
    parts = ends.select("q", F.expr("substring(t, i, n)").alias("term"), F.length("t").alias("ql"))
    if codes_only:
        parts = parts.where(F.col("term").rlike(r"\d.*\d|^https?://"))
    hits = index.join(parts.distinct(), "term").groupBy("q", id_col).agg(F.sum(1.0 + F.least(F.lit(1.0), F.length("term") / F.col("ql"))).alias("score"))
    return ranked(hits, ["q"], k, id_col).select(F.col("q").alias(query_id), id_col, "score", "rank")
