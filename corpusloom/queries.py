"""Core queries by name, each over its whole tables, with SQL that DuckDB can run beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vec
from corpusloom.operators import chunking, context, enrich, evaluation, graph, lexical, orphans, ranking, routing, security
from corpusloom.plans.ingest import ingest, ingest_pages
from corpusloom.plans.search import SearchConfig, search
from corpusloom.session import ship, table, written
from corpusloom.sources import files, store
from corpusloom.streaming.live import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "bm25_topk"

# The normal form of the characters found in the tables, for the SQL side.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "     　‑" + "".join(tx.LETTERS)
_PLAIN = ("".join(map(chr, range(0x21, 0x7F))) + " " * 6 + "‐" + "".join(tx.LETTERS.values())).replace("'", "''")


def _norm(x: str) -> str:
    return f"replace(replace(replace(translate({x}, '{_WIDE}', '{_PLAIN}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...')"


def _fold(x: str) -> str:
    return f"replace(lower({_norm(x)}), 'ß', 'ss')"


def _terms(x: str) -> str:
    return rf"regexp_extract_all({_fold(x)}, '[\p{{L}}\p{{N}}_\-]+')"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is any."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evaluation_cases").select(F.col("item_id").alias("query_id"), F.col("query_text").alias("query"))


# ---- references to records that do not exist


def _feedback_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(table(spark, folder, "feedback"), table(spark, folder, "documents"), ref_id="feedback_id", ref_key="document_id", ref_time="created_at", target_key="id", target_from="created_at", target_to="deleted_at")


_P3 = r"""
with f as (select distinct feedback_id, nullif(lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')), '') as k, created_at from feedback),
d as (select lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) as k, created_at as c, deleted_at as e from documents),
hit as (select f.feedback_id, f.created_at, count(d.k) as n, count(*) filter (where d.c <= f.created_at) as n_before,
  count(*) filter (where d.c <= f.created_at and (d.e is null or f.created_at < d.e)) as n_alive
  from f left join d on d.k = f.k where f.k is not null group by all),
o as (select feedback_id, case when n = 0 then 'missing' when n_before > 0 then 'deleted' else 'late' end as orphan_kind,
  strftime(created_at, '%Y-%m') as period from hit where n_alive = 0)
"""


@query(_P3 + "select * from o")
def p3_found(spark, folder):
    return _feedback_orphans(spark, folder)


@query(_P3 + "select 'feedback.document_id' as table_name, orphan_kind, period, count(*) as n_orphans from o group by all")
def p3_report(spark, folder):
    return orphans.orphan_report(_feedback_orphans(spark, folder), "feedback.document_id")


# ---- text scalars


@query(f"select doc_id, len(regexp_extract_all({_norm('text')}, '[\\p{{L}}\\p{{N}}_\\-]+|[^\\p{{L}}\\p{{N}}_\\s]')) as n_tokens from documents")
def tokens_count(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", tx.token_count(tx.normalized("text")).alias("n_tokens"))


@query(f"with t as (select doc_id, unnest({_terms('text')}) as term from documents) select doc_id, term, count(*) as tf from t group by all")
def term_freq(spark, folder):
    return lexical.term_frequencies(table(spark, folder, "documents", spread=True))


@query()
def normalized_text(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", tx.normalized("text", paragraphs=True).alias("text"))


@query()
def normalized_spans(spark, folder):
    rows = table(spark, folder, "search_documents").select("id", tx.normalized_spans("text").alias("n")).distinct()
    span = tx.original_span(F.col("n.offsets"), F.lit(0), F.size("n.offsets"))
    return rows.select("id", F.length("n.text").alias("n_chars"), span["start"].alias("start_char"), span["end"].alias("end_char"))


@query(r"""
with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(text), '([.!?؟])\s+', '\1' || chr(31), 'g'), '\n+(\S)', chr(31) || '\1', 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') as p from documents)
select doc_id, (i - 1)::int as part_no, p[i] as part from p, unnest(range(1, len(p) + 1)) as u(i)
""")
def sentence_parts(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", F.posexplode(tx.sentence_parts(F.col("text"))).alias("part_no", "part"))


@query()
def references_extract(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", F.posexplode(enrich.references(F.col("text"))).alias("place", "reference"))


# ---- retrieval


_BM25 = f"""
with t as (select doc_id, unnest({_terms('text')}) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all), dl as (select doc_id, count(*) as dl from t group by all),
st as (select count(*) as n, (select count(*) from t) / count(*)::double as mean from documents),
df as (select term, count(*) as df from tf group by all),
q as (select item_id as query_id, unnest({_terms('query_text')}) as term from evaluation_cases), qt as (select query_id, term, count(*) as qtf from q group by all),
s as (select query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) as score
  from qt join tf using (term) join df using (term) join dl using (doc_id), st group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s)
"""


@query(_BM25 + "select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 10")
def bm25_topk(spark, folder):
    found = lexical.bm25(_cases(spark, folder), table(spark, folder, "documents", spread=True), fields={"body": "text"}, k=10)
    return found.withColumn("score", F.round("score", 6))


def _bm25_field(name: str, column: str, weight: float) -> str:
    """The parts of one field: its best 30 documents of each query as ``r_name``."""
    return f"""
t_{name} as (select doc_id, unnest({_terms(f"coalesce({column}, '')")}) as term from documents),
tf_{name} as (select doc_id, term, count(*) as tf from t_{name} group by all), dl_{name} as (select doc_id, count(*) as dl from t_{name} group by all),
st_{name} as (select count(*) as n, (select count(*) from t_{name}) / count(*)::double as mean from documents), df_{name} as (select term, count(*) as df from tf_{name} group by all),
s_{name} as (select query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) as score
  from qt join tf_{name} using (term) join df_{name} using (term) join dl_{name} using (doc_id), st_{name} group by all),
r_{name} as (select query_id, doc_id, {weight} * score as score from s_{name} qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 30)"""


@query(f"""
with q as (select item_id as query_id, unnest({_terms('query_text')}) as term from evaluation_cases), qt as (select query_id, term, count(*) as qtf from q group by all),
{_bm25_field("body", "text", 1.0)}, {_bm25_field("titles", "source", 1.8)},
f as (select query_id, doc_id, sum(score) as score from (select * from r_body union all select * from r_titles) group by all)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from f qualify rank <= 10
""")
def bm25f_topk(spark, folder):
    found = lexical.bm25(_cases(spark, folder), table(spark, folder, "documents", spread=True), fields={"body": "text", "titles": "source"}, k=10)
    return found.withColumn("score", F.round("score", 6))


@query(f"""
with enc as (select 'd' as side, doc_id as id, unnest({_terms('text')}) as term from documents union all
  select 'q', item_id, unnest({_terms('query_text')}) from evaluation_cases),
tf as (select side, id, term, count(*) as tf from enc group by all),
w as (select side, id, ('0x' || substr(md5(term), 1, 12))::bigint % 1000003 as dim, sum(1 + ln(tf)) as weight from tf group by all),
s as (select q.id as query_id, d.id as doc_id, sum(q.weight * d.weight) as score from w q join w d on q.side = 'q' and d.side = 'd' and q.dim = d.dim group by all)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s qualify rank <= 10
""")
def sparse_dot(spark, folder):
    q = lexical.sparse_terms(_cases(spark, folder), id_col="query_id", text="query")
    d = lexical.sparse_terms(table(spark, folder, "documents", spread=True))
    return lexical.sparse_search(q, d, k=10).withColumn("score", F.round("score", 6))


@query()
def exact_search(spark, folder):
    asked = table(spark, folder, "feedback").select(F.col("query_text").alias("query")).where("query is not null").distinct().withColumn("query_id", F.md5("query"))
    index = lexical.exact_terms(table(spark, folder, "documents", spread=True))
    return lexical.exact_search(asked, index, k=10).withColumn("score", F.round("score", 6))


def _query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("""
with s as (select q.vec_id as query_id, d.vec_id as doc_id, list_cosine_similarity(q.embedding::double[], d.embedding::double[]) as score from embeddings q join embeddings d on q.vec_id % 20 = 0)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s where score > 0 qualify rank <= 10
""")
def dense_topk(spark, folder):
    docs = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vec.top_k(_query_vectors(spark, folder), docs, k=10).withColumn("score", F.round("score", 6))


@query("""
with s as (select q.vec_id as query_id, d.vec_id as doc_id, list_cosine_similarity(q.embedding[1:16]::double[], d.embedding[1:16]::double[]) as near, list_cosine_similarity(q.embedding::double[], d.embedding::double[]) as score from embeddings q join embeddings d on q.vec_id % 20 = 0),
c as (select * from s where near > 0 qualify row_number() over (partition by query_id order by round(near, 9) desc, doc_id) <= 100)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from c where score > 0 qualify rank <= 10
""")
def mrl_two_stage(spark, folder):
    docs = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vec.two_stage_top_k(_query_vectors(spark, folder), docs, k=10, coarse=16).withColumn("score", F.round("score", 6))


@query("""
with m as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings)
select vec_id, round(top / 127, 9) as scale, list_sum(list_transform(v, lambda x: greatest(-127, least(127, round_even(x / (top / 127), 0)))))::bigint as total,
  list_max(list_transform(v, lambda x: abs(round_even(x / (top / 127), 0))))::int as largest from m
""")
def quantize_int8(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", vec.int8_scale(F.col("embedding")).alias("s"), vec.int8_values(F.col("embedding")).alias("q"))
    return rows.select("vec_id", F.round("s", 9).alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(F.transform("q", lambda x: F.abs(x))).alias("largest"))


@query("""
with p as (select distinct mv_id, raw_text, summary from multi_vectors), v as (select mv_id, unnest([raw_text, summary]) as x from p),
n as (select mv_id, x::double[] as x from v where len(x) = 96 and list_bool_and(list_transform(x, lambda y: isfinite(y))) and list_sum(list_transform(x, lambda y: abs(y))) > 0),
q as (select mv_id as query_id, row_number() over () as i, x from n where mv_id % 20 = 0),
s as (select query_id, i, d.mv_id as page_id, max(greatest(0, list_cosine_similarity(q.x, d.x))) as best from q join n d on true group by all)
select query_id, page_id, round(sum(best) / count(*), 6) as score, row_number() over (partition by query_id order by round(sum(best) / count(*), 9) desc, page_id) as rank from s group by query_id, page_id qualify rank <= 10
""")
def maxsim(spark, folder):
    fine = lambda c: F.when((F.size(c) == 96) & F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.col(c))
    rows = table(spark, folder, "multi_vectors").select("mv_id", F.filter(F.array(fine("raw_text"), fine("summary")), lambda v: v.isNotNull()).alias("vectors")).dropDuplicates(["mv_id"]).where("size(vectors) > 0")
    asked = rows.where("mv_id % 20 = 0").withColumnRenamed("mv_id", "query_id")
    return vec.max_sim(asked, rows.withColumnRenamed("mv_id", "page_id"), k=10).withColumn("score", F.round("score", 6))


@query()
def hash_embeddings(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", vec.hash_embedding("text").alias("embedding"))


_RRF = _BM25 + """, b as (select query_id, doc_id, rank, 1.0 as weight from r where rank <= 50),
src as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9), doc_id) as rank, 0.5 as weight from r where rank <= 50),
u as (select query_id, doc_id, sum(weight / (60 + rank)) as raw from (select * from b union all select * from src) group by all)
select query_id, doc_id, round(raw / max(raw) over (partition by query_id), 6) as fusion from u"""


@query(_RRF)
def rrf_fusion(spark, folder):
    first = lexical.bm25(_cases(spark, folder), table(spark, folder, "documents", spread=True), fields={"body": "text"}, k=50)
    back = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), "doc_id")))
    lists = first.select("query_id", "doc_id", "rank", F.lit(1.0).alias("weight")).unionByName(back.select("query_id", "doc_id", "rank", F.lit(0.5).alias("weight")))
    return ranking.reciprocal_rank_fusion(lists).withColumn("fusion", F.round("fusion", 6))


# ---- predicates, routing, queries


def _acl_sql(inside: str) -> str:
    return f"select distinct id from search_documents where {inside} and coalesce(visibility, 'public') = 'public'"


@query("select 'isolated' as mode, id from (" + _acl_sql("(tenant_id is null or tenant_id = 'tenant-03')") + ") union all select 'shared_public', id from (" + _acl_sql("true") + ") union all select 'global', id from (" + _acl_sql("true") + ")")
def acl_filter(spark, folder):
    docs = table(spark, folder, "search_documents")
    out = None
    for mode, tenant in (("isolated", "tenant-03"), ("shared_public", None), ("global", "tenant-03")):
        seen = docs.where(security.acl_allows(tenant=F.col("tenant_id"), visibility=F.col("visibility"), tenant_id=tenant, mode=mode)).select(F.lit(mode).alias("mode"), "id").distinct()
        out = seen if out is None else out.unionByName(seen)
    return out


def _whole_sql(words: str) -> str:
    return "regexp_matches(query, '" + routing.whole(words).replace("'", "''") + "')"


@query(f"""
with q as (select distinct query_text as query from feedback where query_text is not null union select query_text from evaluation_cases)
select query, case when regexp_matches(query, '(?i)(?:https?://\\S+|\\b[A-Z]{{2,}}[\\-_]?\\d{{2,}}\\b|\\b[\\p{{L}}\\p{{N}}_]+[\\-_]\\d{{3,}}\\b)') then 'exact-heavy'
  when {_whole_sql(routing.CODE)} or regexp_matches(query, '{routing.CALL}') then 'code' when {_whole_sql(routing.COMPARING)} then 'comparative'
  when {_whole_sql(routing.GLOBAL)} then 'global' when {_whole_sql(routing.RELATING)} then 'entity-relational'
  when len(list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda w: w <> '')) <= 3 then 'short' else 'balanced' end as policy from q
""")
def route_policy(spark, folder):
    asked = table(spark, folder, "feedback").select(F.col("query_text").alias("query")).unionByName(_cases(spark, folder).select("query")).where("query is not null").distinct()
    return routing.routed(asked).select("query", "policy")


_SPLIT = "(?i)(^|[^\\p{L}\\p{N}_])(?:" + routing.JOINING + ")($|[^\\p{L}\\p{N}_])"


@query(f"""
with q as (select distinct query_text as query from feedback where query_text is not null),
p as (select query, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(query, '{_SPLIT}', '\\1' || chr(31) || '\\2', 'g'), '{_SPLIT}', '\\1' || chr(31) || '\\2', 'g'), '[' || chr(31) || ';؛]'), lambda x: trim(x)), lambda x: x <> '') as parts from q)
select query, i - 1 as place, parts2[i] as part from (select query, case when len(parts) <= 1 then [query] else list_slice(list_filter([query] || parts, lambda x, i: list_position([query] || parts, x) = i), 1, 5) end as parts2 from p), unnest(range(1, len(parts2) + 1)) as u(i)
""")
def decompose(spark, folder):
    asked = table(spark, folder, "feedback").select(F.col("query_text").alias("query")).where("query is not null").distinct()
    return asked.select("query", F.posexplode(routing.sub_queries(F.col("query"))).alias("place", "part")).withColumn("place", F.col("place").cast("long"))


@query(rf"""
with w as (select item_id, query_text as q, list_filter(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}_\-]+'), lambda x: length(x) > 2 and not list_contains([{", ".join(f"'{w}'" for w in tx.STOPWORDS)}], x)) as w from evaluation_cases),
u as (select *, list_filter(w, lambda x, i: list_position(w, x) = i) as u from w)
select item_id as query_id, q as raw_text, q as summary, array_to_string(u[1:16], ', ') as keywords, array_to_string(u[1:6], ' ') as titles,
  array_to_string(regexp_extract_all(q, '(?i)(?:https?://\S+|\b[A-Z]{{2,}}[\-_]?\d{{2,}}\b|\b[\p{{L}}\p{{N}}_]+[\-_]\d{{3,}}\b)'), ' | ') as references from u
""".replace("as references from", 'as "references" from'))
def query_views(spark, folder):
    asked = _cases(spark, folder)
    return asked.select("query_id", *[v.alias(n) for n, v in enrich.query_views(F.col("query")).items()])


@query("""
select doc_id, n from (select doc_id, len(list_filter([regexp_matches(text, '(?is)ignore\\s+(?:all|any|the)?\\s*(?:previous|prior)\\s+instructions'), regexp_matches(text, '(?is)system\\s+prompt'), regexp_matches(text, '(?is)developer\\s+message'), regexp_matches(text, '(?i)do\\s+not\\s+follow\\s+.*instructions'), regexp_matches(text, '(?is)jailbreak'), regexp_matches(text, '(?i)نادیده\\s+بگیر.*(?:دستور|راهنما)'), regexp_matches(text, '(?is)پرامپت\\s+سیستم')], lambda x: x)) as n from documents)
""")
def security_patterns(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", F.size(security.injection_patterns(F.col("text"))).cast("long").alias("n"))


@query()
def security_scan(spark, folder):
    found = table(spark, folder, "documents", spread=True).select("doc_id", security.scan("text").alias("f"))
    return found.select("doc_id", F.size("f").alias("n_findings"), F.concat_ws(",", F.transform("f", lambda x: x["kind"])).alias("kinds"))


# ---- chunks


@query("""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents),
c as (select doc_id, w, i from w, unnest(range(0, greatest(0, ceil((len(w) - 128) / 112.0)::int) + 1)) as u(i) where len(w) > 0)
select doc_id, i::int as chunk_index, array_to_string(list_slice(w, i * 112 + 1, i * 112 + 128), ' ') as chunk, len(list_slice(w, i * 112 + 1, i * 112 + 128))::int as n_words from c
""")
def sliding_chunks(spark, folder):
    return chunking.word_windows(table(spark, folder, "documents", spread=True), words=128, overlap=16)


@query(rf"""
with d as (select doc_id, text, len(regexp_extract_all({_norm('text')}, '[\p{{L}}\p{{N}}_\-]+|[^\p{{L}}\p{{N}}_\s]')) as n,
  regexp_matches(text, '(?m)^#{{1,6}}\s')::int + contains(text, '```')::int + regexp_matches(text, '(?m)^\s*\|.*\|\s*$')::int as kinds from documents)
select doc_id, case when kinds >= 2 then 'composite' when regexp_matches(text, '(?m)^#{{1,6}}\s+.+$') then 'hierarchical' when len(regexp_extract_all(text, '(?m)^[ \t]*\|.*\|[ \t]*$')) >= 2 then 'table'
  when regexp_matches(text, '(?s)```.*?```') or regexp_matches(text, '(?m)^\s*(?:def |class |async def |function |import |from |const |let |var |public |private |#include )') then 'code'
  when n > 5120 then 'sliding_window' when regexp_matches(text, '[.!?؟]\s+\S|\S\s*\n+\S') then 'semantic' else 'recursive' end as strategy from d
""")
def chunk_detect(spark, folder):
    docs = table(spark, folder, "documents", spread=True)
    return docs.select("doc_id", chunking.detected(F.col("text"), tx.token_count(tx.normalized("text"))).alias("strategy"))


def _chunker(name: str):
    def run(spark, folder):
        docs = table(spark, folder, "documents", spread=True).select(F.col("doc_id").cast("string").alias("source_id"), "text")
        return chunking.chunk_documents(docs, cfg=chunking.ChunkConfig(strategy=name, largest=128, smallest=20, overlap=16)).drop("parent_text")

    run.__name__ = f"chunks_{name}"
    return run


for _name in chunking.strategies():
    query()(_chunker(_name))


_CHUNKS = "c as (select distinct id, source_id, chunk_index from chunks)"


@query(f"with {_CHUNKS} select id, lag(id) over w as previous_id, lead(id) over w as next_id from c window w as (partition by source_id order by chunk_index, id)")
def prev_next_links(spark, folder):
    rows = table(spark, folder, "chunks").select("id", "source_id", "chunk_index").distinct()
    return chunking.linked(rows).select("id", "previous_id", "next_id")


@query(f"with {_CHUNKS}, p as (select *, row_number() over (partition by source_id order by chunk_index, id) as n from c) select a.id as asked_id, b.id, (b.n - a.n)::int as offset from p a join p b on a.source_id = b.source_id and abs(a.n - b.n) <= 1")
def context_window(spark, folder):
    rows = table(spark, folder, "chunks").select("id", "source_id", "chunk_index").distinct()
    return chunking.context_windows(rows, rows)


@query("""
with s as (select distinct id, source_id, chunk_index, text from search_documents)
select source_id as parent_id, string_agg(text, chr(10) || chr(10) order by chunk_index, text) as text, count(*) as n_children from s where source_id is not null group by source_id
""")
def parents_rollup(spark, folder):
    rows = table(spark, folder, "search_documents").select("id", "source_id", "chunk_index", "text").distinct()
    rows = rows.select(F.col("source_id").alias("parent_id"), "source_id", "chunk_index", "text", F.lit(None).cast("string").alias("parent_text"), F.lit(0).alias("token_count"))
    return chunking.parents(rows).select("parent_id", F.when(F.length("text") > 0, F.col("text")).alias("text"), "n_children")


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(rf"""
with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_\-]+'), lambda x: length(x) > 2 and not list_contains([{_STOP}], x)) as w from documents),
e as (select doc_id, w[i] as keyword, i from w, unnest(range(1, len(w) + 1)) as u(i)),
g as (select doc_id, keyword, count(*) as n, min(i) as i from e group by all)
select doc_id, keyword, n, row_number() over (partition by doc_id order by n desc, i) as rank from g qualify rank <= 20
""")
def keywords_top20(spark, folder):
    return enrich.keywords(table(spark, folder, "documents", spread=True))


@query()
def enriched_documents(spark, folder):
    docs = table(spark, folder, "documents", spread=True).select("doc_id", tx.normalized("text").alias("text"), F.col("source").alias("title"))
    return enrich.enriched(docs, title="title")


@query()
def html_text(spark, folder):
    pages = table(spark, folder, "documents", spread=True).select("doc_id", F.concat(F.lit("<html><head><style>p {}</style></head><body><h1>"), F.col("source"), F.lit("</h1><p>"), F.col("text"), F.lit("</p><div style='display:none'>hidden</div></body></html>")).alias("html"))
    return pages.select("doc_id", files.html_text("html").alias("text"))


# ---- feedback, policy, graph


@query(f"""
select {_fold("regexp_replace(trim(query_text), ' +', ' ', 'g')")} as query_norm, document_id as doc_id, round(avg(greatest(-1, least(1, relevance))), 9) as feedback from feedback
where relevance is not null and query_text is not null and document_id is not null group by all
""")
def feedback_avg(spark, folder):
    return ranking.feedback_scores(table(spark, folder, "feedback")).withColumn("feedback", F.round("feedback", 9))


@query("""
select id, round(greatest(0, least(1, greatest(0, least(1, chunk_index / 10.0)) + 0.05 * coalesce(source_trust, 0))) * greatest(0, least(1, coalesce(source_trust, 1))), 9) as score
from (select distinct id, chunk_index, source_trust from search_documents)
""")
def policy_score(spark, folder):
    rows = table(spark, folder, "search_documents").select("id", "chunk_index", "source_trust").distinct()
    return rows.select("id", F.round(ranking.policy_score(F.col("chunk_index") / 10.0, F.col("source_trust"), F.col("source_trust")), 9).alias("score"))


@query(_BM25 + """, h as (select query_id, doc_id, source, score from r join documents using (doc_id) where rank <= 50)
select query_id, doc_id, round(score, 6) as score from h qualify row_number() over (partition by query_id, source order by round(score, 9) desc, doc_id) <= 2""")
def source_cap(spark, folder):
    docs = table(spark, folder, "documents", spread=True)
    hits = lexical.bm25(_cases(spark, folder), docs, fields={"body": "text"}, k=50).join(docs.select("doc_id", F.col("source").alias("source_id")), "doc_id")
    kept = ranking.source_capped(hits.withColumn("raw", F.col("score")).withColumn("score", F.round("score", 9)), 2)
    return kept.select("query_id", "doc_id", F.round("raw", 6).alias("score"))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", spread=True).select("doc_id", F.array("source").alias("entities"), F.when(F.col("tenant_id").isNotNull(), F.array(F.array("source", F.lit("in"), "tenant_id"))).otherwise(F.array().cast("array<array<string>>")).alias("relations"))
    return graph.graph_tables(docs)


_GRAPH = """
with recursive e as (select distinct lower(source) as entity, doc_id from documents where source is not null union select lower(tenant_id), doc_id from documents where tenant_id is not null and source is not null),
n as (select distinct lower(source) as entity, lower(tenant_id) as neighbour from documents where tenant_id is not null and source is not null union select lower(tenant_id), lower(source) from documents where tenant_id is not null and source is not null),
q as (select item_id as query_id, array_to_string(relevant_source_ids, ' ') as query from evaluation_cases where len(relevant_source_ids) > 0),
m as (select query_id, entity from q join (select distinct entity from e) on contains(lower(query), entity)),
"""


def _graph_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evaluation_cases").where("size(relevant_source_ids) > 0").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "relevant_source_ids").alias("query"))


_SCORED = """s as (select query_id, doc_id, sum(w) as score from h join e using (entity) group by all)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s qualify rank <= 20"""


@query(_GRAPH + "h as (select query_id, entity, 2.0::double as w from m union all select query_id, neighbour, 1.0 from m join n using (entity)), " + _SCORED)
def graph_local(spark, folder):
    return graph.graph_search(_graph_queries(spark, folder), *_graph(spark, folder), mode="local").withColumn("score", F.round("score", 6))


@query(_GRAPH + "o as (select query_id, neighbour as entity from m join n using (entity)), h as (select query_id, entity, 2.0::double as w from m union all select query_id, entity, 1.0 from o union all select query_id, neighbour, 0.4::double from o join n using (entity)), " + _SCORED)
def graph_drift(spark, folder):
    return graph.graph_search(_graph_queries(spark, folder), *_graph(spark, folder), mode="drift").withColumn("score", F.round("score", 6))


@query()
def graph_global(spark, folder):
    return graph.graph_search(_graph_queries(spark, folder), *_graph(spark, folder), mode="global").withColumn("score", F.round("score", 6))


@query("""
with recursive n as (select distinct lower(source) as a, lower(tenant_id) as b from documents where tenant_id is not null and source is not null union select lower(tenant_id), lower(source) from documents where tenant_id is not null and source is not null),
e as (select distinct lower(source) as entity from documents where source is not null union select a from n),
walk(entity, reached) as (select entity, entity from e union select w.entity, n.b from walk w join n on w.reached = n.a)
select entity, min(reached) as community from walk group by entity
""")
def graph_components(spark, folder):
    entity_docs, edges = _graph(spark, folder)
    return graph.communities(entity_docs, edges)


# ---- evaluation


_METRICS = _BM25 + """, got as (select query_id, source as item, min(rank) as f from r join documents using (doc_id) where rank <= 50 and source is not null group by all),
gr as (select query_id, item, row_number() over (partition by query_id order by f, item) as rank from got),
rel as (select distinct item_id as query_id, unnest(relevant_source_ids) as item from evaluation_cases),
hit as (select query_id, rank from gr join rel using (query_id, item)),
a as (select query_id, count(*) filter (where rank <= 10) as h, min(rank) as f, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as dcg from hit group by all),
nr as (select query_id, count(*) as n from rel group by all),
m as (select item_id as query_id, coalesce(h, 0) / 10.0 as precision_at_k, case when n > 0 then coalesce(h, 0) / n::double else 1 end as recall_at_k, coalesce(1.0 / f, 0) as reciprocal_rank,
  case when n > 0 then coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))) else 1 end as ndcg_at_k
  from (select distinct item_id from evaluation_cases) left join a on item_id = a.query_id left join nr on item_id = nr.query_id)
"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    docs, cases = table(spark, folder, "documents", spread=True), table(spark, folder, "evaluation_cases")
    found = lexical.bm25(_cases(spark, folder), docs, fields={"body": "text"}, k=50).join(docs.select("doc_id", F.col("source").alias("item")), "doc_id").where("item is not null")
    relevant = cases.select(F.col("item_id").alias("query_id"), F.explode("relevant_source_ids").alias("item"))
    return evaluation.query_metrics(_cases(spark, folder), evaluation.deduped_ranks(found), relevant)


@query(_METRICS + "select query_id, round(precision_at_k, 9) as precision_at_k, round(recall_at_k, 9) as recall_at_k, round(reciprocal_rank, 9) as reciprocal_rank, round(ndcg_at_k, 9) as ndcg_at_k from m")
def retrieval_metrics(spark, folder):
    m = _metrics(spark, folder)
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query(_METRICS + "select count(*) as n_cases, round(avg(precision_at_k), 6) as precision_at_k, round(avg(recall_at_k), 6) as recall_at_k, round(avg(reciprocal_rank), 6) as reciprocal_rank, round(avg(ndcg_at_k), 6) as ndcg_at_k from m")
def evaluation_report(spark, folder):
    r = evaluation.report(_metrics(spark, folder))
    return r.select("n_cases", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


@query("""
with c as (select source_id, list(distinct start_char) as p, list(distinct end_char) as g from chunks where source_id is not null group by all),
h as (select source_id, len(list_intersect(p, g)) as tp, len(p) as p, len(g) as g from (select source_id, list_filter(p, lambda x: x is not null) as p, list_filter(g, lambda x: x is not null) as g from c)),
f as (select source_id, case when p > 0 then tp / p::double when g > 0 then 0 else 1 end as precision, case when g > 0 then tp / g::double else 1 end as recall from h)
select source_id, round(precision, 9) as precision, round(recall, 9) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1 from f
""")
def boundary_f1_tol0(spark, folder):
    rows = table(spark, folder, "chunks").where("source_id is not null").groupBy("source_id").agg(F.collect_set("start_char").alias("predicted"), F.collect_set("end_char").alias("gold"))
    out = evaluation.boundary_f1(rows, key="source_id")
    return out.select("source_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""
select event_type, round(quantile_cont(value, 0.2), 9) as p20, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by all
""")
def latency_percentiles(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(evaluation.linear_percentile("value", 20), 9).alias("p20"), evaluation.nearest_rank_percentile("value", 0.95).alias("p95"), evaluation.nearest_rank_percentile("value", 0.99).alias("p99"))


@query("""
with k as (select item_id, list_distinct(relevant_source_ids) as need, list_distinct(list_filter(string_split(query_text, ' '), lambda x: x <> '')) as words from evaluation_cases)
select item_id, case when len(need) > 0 then round(len(list_intersect(['kb-harbor', 'wiki-orchard', 'policy-meadow'], need)) / len(need)::double, 9) else 1 end as coverage from k
""")
def citation_coverage(spark, folder):
    cited = F.array(*map(F.lit, ("kb-harbor", "wiki-orchard", "policy-meadow")))
    return table(spark, folder, "evaluation_cases").select("item_id", F.round(evaluation.citation_coverage(cited, F.col("relevant_source_ids")), 9).alias("coverage"))


@query("""
with c as (select channel, max(score) over (partition by id, channel) as top, id, score from (select doc_id as id, source as channel, n_chars::double as score from documents where n_chars is not null and source is not null))
select id, channel, round(case when top > 0 then score / top else 0 end, 9) as score from c
""")
def max_normalize(spark, folder):
    rows = table(spark, folder, "documents", spread=True).where("n_chars is not null and source is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("channel"), F.col("n_chars").cast("double").alias("score"))
    return ranking.max_normalized(rows, ["id", "channel"]).select("id", "channel", F.round("score", 9).alias("score"))


# ---- store


@query("""
with old as (select distinct id, source_id, chunk_index from chunks), fresh as (select id, 'file-00-000033' as source_id, chunk_index + 1000 as chunk_index from old where source_id = 'file-00-000019')
select * from old where source_id is null or source_id <> 'file-00-000033' union all select * from fresh
""")
def source_replace(spark, folder):
    old = table(spark, folder, "chunks").select("id", "source_id", "chunk_index").distinct()
    new = old.where("source_id = 'file-00-000019'").select("id", F.lit("file-00-000033").alias("source_id"), (F.col("chunk_index") + 1000).alias("chunk_index"))
    return store.replaced(old, new, "file-00-000033")


@query("""
with old as (select distinct id, source_id, chunk_index from chunks), fresh as (select id, source_id, -chunk_index as chunk_index from old where chunk_index = 0 union all select id || ':new', source_id, 7 from old where chunk_index = 1)
select * from old where id not in (select id from fresh) union all select * from fresh
""")
def upsert_chunks(spark, folder):
    old = table(spark, folder, "chunks").select("id", "source_id", "chunk_index").distinct()
    new = old.where("chunk_index = 0").select("id", "source_id", (-F.col("chunk_index")).alias("chunk_index")).unionByName(old.where("chunk_index = 1").select(F.concat("id", F.lit(":new")).alias("id"), "source_id", F.lit(7).alias("chunk_index")))
    return store.upserted(old, new, "id")


@query("""
select strategy, (select count(*) from documents where regexp_matches(text, '\\S')) as n_docs, 0 as n_gaps, 0 as n_blank
from unnest(['recursive', 'semantic', 'sliding_window', 'token_based', 'markdown', 'hierarchical', 'code', 'composite']) as u(strategy)
""")
def chunk_coverage(spark, folder):
    """Every chunker leaves no document out, numbers its chunks without gaps and makes no blank ones."""
    docs = table(spark, folder, "documents", spread=True).select(F.col("doc_id").cast("string").alias("source_id"), "text")
    out = None
    for name in ("recursive", "semantic", "sliding_window", "token_based", "markdown", "hierarchical", "code", "composite"):
        chunks = chunking.chunk_documents(docs, cfg=chunking.ChunkConfig(strategy=name, largest=128, smallest=20, overlap=16))
        each = chunks.groupBy("source_id").agg((F.max("chunk_index") + 1 - F.count("*")).alias("gaps"), F.count(F.when(F.length(F.trim("text")) == 0, 1)).alias("blank"))
        row = each.agg(F.count("*").alias("n_docs"), F.sum("gaps").alias("n_gaps"), F.sum("blank").alias("n_blank")).select(F.lit(name).alias("strategy"), "n_docs", "n_gaps", "n_blank")
        out = row if out is None else out.unionByName(row)
    return out


# ---- whole pipelines


def _search_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", spread=True).select("source", F.col("doc_id").cast("string").alias("source_id"), "text", "tenant_id")
    return written(ingest(docs, cfg=chunking.ChunkConfig(strategy="recursive", largest=256, smallest=40, overlap=0, dimensions=96), keep=["tenant_id"]).drop("parent_text"), "chunks")


@query()
def ingest_documents(spark, folder):
    docs = table(spark, folder, "documents", spread=True).select(F.col("doc_id").cast("string").alias("source_id"), "text")
    return ingest(docs, cfg=chunking.ChunkConfig(largest=256, smallest=40, overlap=16, dimensions=96)).select("id", "source_id", "chunk_index", "chunk_type", "previous_id", "next_id", "summary", "retrieval_signature", "v_raw_text")


@query()
def ingest_loaded_pages(spark, folder):
    loaded = table(spark, folder, "loaded_documents").dropDuplicates(["loaded_id"])
    return ingest_pages(loaded, cfg=chunking.ChunkConfig(strategy="recursive", largest=256, smallest=40, overlap=16)).select("id", "source_id", "page", "chunk_index", "token_count", "previous_id", "next_id")


@query("""
with p as (select distinct source_id, n, pages[n] as t from loaded_documents, unnest(range(1, len(pages) + 1)) as u(n))
select source_id, count(distinct n) as n_pages, min(n) as first_page, max(n) as last_page, 0 as first_index from p where regexp_matches(t, '\\S') group by all
""")
def ingest_pages_coverage(spark, folder):
    """Every page that is not blank is ingested, and every source numbered from 0."""
    loaded = table(spark, folder, "loaded_documents").dropDuplicates(["loaded_id"])
    chunks = ingest_pages(loaded, cfg=chunking.ChunkConfig(strategy="recursive", largest=256, smallest=40, overlap=16))
    return chunks.groupBy("source_id").agg(F.countDistinct("page").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("chunk_index").alias("first_index"))


@query()
def hybrid_search(spark, folder):
    chunks = _search_chunks(spark, folder)
    found = search(_cases(spark, folder), chunks, k=10, allowed=security.acl_allows(tenant=F.col("tenant_id"), visibility=F.lit("public"), mode="global"), cfg=SearchConfig(dimensions=96))
    return found.select("query_id", "doc_id", "source_id", "position", F.round("score", 6).alias("score"), "reasons")


@query()
def search_context(spark, folder):
    chunks = _search_chunks(spark, folder)
    cases = _cases(spark, folder)
    hits = lexical.bm25(cases, chunks.withColumnRenamed("id", "doc_id"), fields={"body": "text"}, k=5)
    return context.assemble(cases, hits, chunks, chunking.parents(chunks.withColumn("parent_id", F.coalesce("parent_id", "source_id")).withColumn("parent_text", F.lit(None).cast("string"))), budget=1200)


@query("""
select date_trunc('day', ts) as window_start, event_type, count(*) as n_events, round(avg(value), 6) as mean_value from events group by all
""")
def events_windowed(spark, folder):
    rows = windowed(table(spark, folder, "events"), time="ts", by=["event_type"], value="value")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("mean_value", F.round("mean_value", 6))
