"""Query routing and decomposition as expressions over a frame of queries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import IDENTIFIER

EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
# Word lists that choose a policy.
COMPARING = r"vs\.?|versus|compare|difference|تفاوت|مقایسه"
GLOBAL = r"across|overall|all reports|trend|summary of all|در همه|کل اسناد|روند"
CODE = r"def|class|function|method|stack trace|exception|api"
CALL = r"[A-Za-z_][A-Za-z0-9_]+\(\)"
RELATING = r"who|related|relationship|worked with|manager|owner|چه کسی|مرتبط|رابطه|مدیر"
JOINING = r"and|then|also|و|همچنین|سپس"
# Name, then weights of dense, lexical, sparse and exact search, several queries, graph.
POLICIES = (
    ("exact-heavy", 0.5, 1.5, 0.3, 2.0, False, False),
    ("code", 0.8, 1.4, 0.6, 1.7, False, False),
    ("comparative", 1.2, 0.8, 0.9, 1.5, True, False),
    ("global", 1.2, 0.5, 1.0, 1.5, True, True),
    ("entity-relational", 1.0, 0.8, 0.7, 1.5, True, True),
    ("short", 0.8, 1.2, 0.7, 1.5, False, False),
    ("balanced", 1.0, 1.0, 0.7, 1.5, False, False),
)


def whole(words: str) -> str:
    """Pattern of any of the words standing by itself, in any script, without case."""
    return f"(?i){EDGE}(?:{words}){END}"


def policy_name(query: Column) -> Column:
    """Policy of a query: the first that fits of identifier, code, comparison, overview, relation, short, balanced."""
    return (
        F.when(query.rlike(IDENTIFIER), "exact-heavy")
        .when(query.rlike(whole(CODE)) | query.rlike(CALL), "code")
        .when(query.rlike(whole(COMPARING)), "comparative")
        .when(query.rlike(whole(GLOBAL)), "global")
        .when(query.rlike(whole(RELATING)), "entity-relational")
        .when(F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")) <= 3, "short")
        .otherwise("balanced")
    )


def routed(queries: DataFrame, *, query: str = "query", classifier: Callable[[list[str]], list[tuple[str, float]]] | None = None, trust: float = 0.75) -> DataFrame:
    """Queries with their policy and its weights; a classifier's policy holds where its confidence reaches ``trust``."""
    name = policy_name(F.col(query))
    if classifier is not None:
        known = {p[0] for p in POLICIES}

        @F.arrow_udf("string")
        def classify(texts: pa.Array) -> pa.Array:
            try:
                got = classifier(texts.to_pylist())
            except Exception:  # an optional stage: the rules decide
                got = [("", 0.0)] * len(texts)
            return pa.array([n if n in known and c >= trust else None for n, c in got], pa.string())

        name = F.coalesce(classify(query), name)
    out = queries.withColumn("policy", name)
    for i, column in enumerate(("dense_weight", "lexical_weight", "sparse_weight", "exact_weight", "use_multi_query", "use_graph"), 1):
        value = F.lit(POLICIES[-1][i])
        for p in POLICIES[:-1]:
            value = F.when(F.col("policy") == p[0], F.lit(p[i])).otherwise(value)
        out = out.withColumn(column, value)
    return out


def sub_queries(query: Column) -> Column:
    """The query and its parts between connectives and semicolons, five at most, the query first."""
    marked = query
    for _ in range(2):  # neighbours share the sign between them
        marked = F.regexp_replace(marked, f"(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{JOINING})($|[^\\p{{L}}\\p{{N}}_])", "$1\x1f$2")
    parts = F.filter(F.transform(F.split(marked, "[\x1f;؛]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.when(F.size(parts) <= 1, F.array(query)).otherwise(F.slice(F.array_distinct(F.concat(F.array(query), parts)), 1, 5))


def decomposed(queries: DataFrame, *, query: str = "query", generate: Callable[[str], str] | None = None) -> DataFrame:
    """Queries with their parts as ``part_no, part``: by rule, or by an injected generator, one part a line.

    A generator that fails leaves the query whole.
    """
    if generate is None:
        parts = sub_queries(F.col(query))
    else:

        @F.arrow_udf("array<string>")
        def ask(texts: pa.Array) -> pa.Array:
            out = []
            for t in texts.to_pylist():
                try:
                    lines = [x.strip(" -\t") for x in generate(t).splitlines() if x.strip()]
                except Exception:  # an optional stage
                    lines = []
                out.append(list(dict.fromkeys([t, *lines]))[:5])
            return pa.array(out, pa.list_(pa.string()))

        parts = ask(query)
    return queries.select("*", F.posexplode(parts).alias("part_no", "part"))
