"""Queries of the training-data operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import canonical, leakage, neighbors, packing, scans, sentences, splitting
from corpusloom.session import ship, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return scans.scanned_noise(table(spark, folder, "document_blocks", spread=True))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as repaired paragraphs in reading order."""
    ship(spark)
    return scans.repaired_paragraphs(table(spark, folder, "document_blocks", spread=True))


def p2_units(spark: SparkSession, folder: str) -> DataFrame:
    """All sentence units with their text."""
    ship(spark)
    return sentences.sentence_units(table(spark, folder, "search_documents", spread=True), key="id", text="text").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    units = sentences.sentence_units(table(spark, folder, "search_documents", spread=True), key="id", text="text")
    return units.select("id", "start_char", "end_char").distinct()


def p4_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every usable vector of both fields."""
    ship(spark)
    near = neighbors.nearest_vectors(table(spark, folder, "multi_vectors", spread=True), id_col="mv_id", fields=["raw_text", "summary"], dimension=96)
    return near.withColumnsRenamed({"id": "mv_id", "neighbor": "neighbor_id"})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    near = neighbors.nearest_vectors(table(spark, folder, "multi_vectors", spread=True), id_col="mv_id", fields=["raw_text", "summary"], dimension=96, least=0.85)
    return neighbors.mutual_pairs(near, 0.85).withColumnsRenamed({"id_a": "mv_id_a", "id_b": "mv_id_b"})


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and chunks as items, each once."""
    pages = table(spark, folder, "loaded_documents", spread=True).select(F.lit("page").alias("item_kind"), F.col("loaded_id").alias("item_id"), F.posexplode("pages").alias("n", "text"))
    pages = pages.select("item_kind", "item_id", (F.col("n") + 1).alias("page_no"), "text")
    chunks = table(spark, folder, "chunks", spread=True).select(F.lit("chunk").alias("item_kind"), F.col("chunk_no").alias("item_id"), F.lit(0).alias("page_no"), F.col("raw_text").alias("text"))
    return pages.unionByName(chunks)


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized pages and chunks."""
    ship(spark)
    return splitting.split_items(_items(spark, folder), keys=["item_kind", "item_id", "page_no"], text="text").dropDuplicates(["item_kind", "item_id", "page_no", "piece_no"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    pieces = splitting.split_items(_items(spark, folder), keys=["item_kind", "item_id", "page_no"], text="text")
    return pieces.where("piece_no = 0").select("item_kind", "item_id", "page_no", "cut_at").distinct()


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return packing.pack_texts(table(spark, folder, "documents", spread=True), key="doc_id", text="text")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with windows like those of test items, exact or nearly so."""
    ship(spark)
    return leakage.leaked_passages(table(spark, folder, "documents", spread=True), table(spark, folder, "evaluation_cases"), doc_id="doc_id", text="text", item_id="item_id", passage="passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where("n_exact > 0").select("doc_id", "item_id").distinct()


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of every document's text."""
    ship(spark)
    return table(spark, folder, "documents", spread=True).select("doc_id", canonical.canonical_text("text").alias("text"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look like one stored otherwise, by form and spelling."""
    ship(spark)
    return canonical.look_alike_classes(table(spark, folder, "documents", spread=True), key="doc_id", text="text").withColumnsRenamed({"key": "doc_id"})


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return canonical.look_alike_pairs(table(spark, folder, "documents", spread=True), key="doc_id", text="text").withColumnsRenamed({"key_a": "doc_id_a", "key_b": "doc_id_b"})


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_paragraphs, p2_found, p2_units, p4_found, p4_neighbors, p5_found, p5_pieces, p6_containers, p7_found, p7_leaks, p8_found, p8_classes, p8_canonical)
}

_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_INLINE = _SPACE.replace(r"\s", r"\t\f ", 1)
_FINAL, _CLOSE = ".!?…؟۔।॥。！？", r"\"'’”»)\]}」』）】〕］》".replace("'", "''")


def _longest(text: str) -> str:
    """Longest part of a text cut at the sign chr(31), white space at its ends left out."""
    return f"list_max(list_transform(string_split({text}, chr(31)), lambda x: length(regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))))"


_P5 = rf"""
with i as (select distinct item_kind, item_id, page_no::int as page_no, t from (
  select 'page' as item_kind, loaded_id as item_id, n as page_no, pages[n] as t from loaded_documents, unnest(range(1, len(pages) + 1)) as u(n)
  union all select 'chunk', chunk_no, 0, raw_text from chunks) where length(t) > 2000),
p as (select *, regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[\n\r][{_INLINE}]*[\n\r][{_SPACE}]*', chr(31), 'g') as para from i),
s as (select *, regexp_replace(para, '([{_FINAL}][{_FINAL}{_CLOSE}]*)[{_SPACE}]+|([。！？][{_FINAL}{_CLOSE}]*)', '\1\2' || chr(31), 'g') as sent from p)
select item_kind, item_id, page_no, case when {_longest("para")} <= 2000 then 'paragraph' when {_longest("sent")} <= 2000 then 'sentence'
  when {_longest(f"regexp_replace(t, '[{_SPACE}]+', chr(31), 'g')")} <= 2000 then 'word' else 'none' end as cut_at from s
"""

SQL: dict[str, str] = {"p5_found": _P5}
