"""Ingestion: texts, pages or files to normalized, scanned, chunked, linked, enriched and embedded rows, in one job for any number of sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normal_form_spans, normalized
from corpusloom.functions.vectors import embedding, hash_embedding
from corpusloom.operators import enrich
from corpusloom.operators.chunking import ChunkConfig, chunk_documents, linked
from corpusloom.operators.security import quarantined, scan
from corpusloom.sources.files import Loader, read_documents

Embed = Callable[[list[str]], list[list[float]]]


def prepared(docs: DataFrame, *, text: str = "text", paragraphs: bool = True, quarantine: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Normalized and scanned documents: those let in, and those held back with their findings."""
    rows = docs.withColumn("source_content_hash", F.sha2(F.col(text), 256)).withColumn(text, normalized(text, paragraphs=paragraphs)).withColumn("findings", scan(text))
    held = quarantined(F.col("findings"), list(quarantine))
    return rows.where(~held), rows.where(held)


def budgeted(cfg: ChunkConfig, max_input_tokens: int | None) -> ChunkConfig:
    """Chunk sizes held to what a model reads at once."""
    if max_input_tokens is None or cfg.largest <= max_input_tokens:
        return cfg
    if max_input_tokens < 1:
        raise ValueError("a model must read one token at least")
    return replace(cfg, largest=max_input_tokens, smallest=min(cfg.smallest, max_input_tokens), overlap=min(cfg.overlap, max_input_tokens // 4))


def signature(cfg: ChunkConfig, model: str) -> str:
    """What vectors depend on beside their text: the model, its dimension and how texts are cut."""
    return "|".join([model, *(f"{k}={v}" for k, v in sorted(asdict(cfg).items()))])


def original_places(text: Column, start: Column, end: Column) -> Column:
    """``struct<start, end>``: where ``[start, end)`` of the normal form lies in the text as it came."""

    @F.arrow_udf("struct<start:int,end:int>")
    def places(texts, starts, ends):
        import pyarrow as pa

        out, last, at = [], None, []
        for t, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if t is None or a is None or b is None:
                out.append(None)
                continue
            if t is not last:
                last, at = t, normal_form_spans(t)[1]
            out.append({"start": at[a], "end": at[min(b, len(at)) - 1] + 1} if a < len(at) and b > a else None)
        return pa.array(out, pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    return places(text, start, end)


def ingest(docs: DataFrame, *, source: str = "source_id", text: str = "text", cfg: ChunkConfig = ChunkConfig(), keep: list[str] = (), embed: Embed | None = None, model: str = "hash", known: DataFrame | None = None, quarantine: list[str] = (), max_input_tokens: int | None = None, originals: bool = False) -> DataFrame:
    """Chunks with links, enrichment, hashes and five vectors.

    Vectors of ``known`` chunks with the same id and signature are taken over;
    only new contents are embedded. The signature holds the text of all views,
    the name of the ``model`` (give one with ``embed``) and the settings, so
    another model or other sizes never reuse a vector. ``originals`` adds where
    a chunk lies in the text as it came; blank lines are then not kept, as
    positions are those of the plain normal form.
    """
    cfg = budgeted(cfg, max_input_tokens)
    rows = docs.select(source, text, *keep)
    if originals:
        rows = rows.withColumn("original_text", F.col(text))
    allowed, _ = prepared(rows, text=text, quarantine=quarantine, paragraphs=not originals)
    kept = [*keep, "source_content_hash", *(["original_text"] if originals else [])]
    chunks = linked(chunk_documents(allowed, source=source, text=text, cfg=cfg, keep=kept), source=source)
    if originals:
        place = original_places(F.col("original_text"), F.col("start_char"), F.col("end_char"))
        chunks = chunks.withColumn("_at", place).withColumn("original_start", F.col("_at.start")).withColumn("original_end", F.col("_at.end")).drop("_at", "original_text")
    return finished(chunks, cfg=cfg, embed=embed, model=model, known=known)


def finished(chunks: DataFrame, *, cfg: ChunkConfig, embed: Embed | None = None, model: str = "hash", known: DataFrame | None = None) -> DataFrame:
    """Chunks enriched, signed and embedded; vectors of known chunks of the same signature are kept."""
    if embed is not None and model == "hash":
        model = f"{getattr(embed, '__module__', '')}.{getattr(embed, '__qualname__', type(embed).__qualname__)}"
    rows = enrich.enriched(chunks)
    rows = rows.withColumn("retrieval_signature", F.sha2(F.concat_ws("\x1f", F.lit(signature(cfg, model)), "text", "context_text", F.concat_ws("\x1e", "keywords"), F.concat_ws("\x1e", "titles")), 256))
    if known is None:
        return embedded(rows, cfg, embed)
    old = known.select("id", "retrieval_signature", *[f"v_{v}" for v in enrich.document_views()]).dropDuplicates(["id", "retrieval_signature"])
    same = rows.join(old, ["id", "retrieval_signature"])
    return same.unionByName(embedded(rows.join(old, ["id", "retrieval_signature"], "left_anti"), cfg, embed))


def embedded(rows: DataFrame, cfg: ChunkConfig, embed: Embed | None = None) -> DataFrame:
    for name, view in enrich.document_views().items():
        filled = F.when(F.length(F.trim(view)) > 0, view)
        rows = rows.withColumn(f"v_{name}", embedding(filled, embed) if embed else hash_embedding(filled, cfg.dimensions))
    return rows


def pages_as_sources(loaded: DataFrame, *, pages: str = "pages", source: str = "source_id", keep: list[str] = ()) -> DataFrame:
    """Loaded documents as one row a page that is not blank: ``(source_id, page, text)`` and the columns kept."""
    return loaded.select(source, *keep, F.posexplode(pages).alias("page", "text")).where("length(trim(text)) > 0").withColumn("page", F.col("page") + 1)


def ingest_pages(loaded: DataFrame, *, cfg: ChunkConfig = ChunkConfig(), pages: str = "pages", source: str = "source_id", blocks: str | None = None, embed: Embed | None = None, model: str = "hash", known: DataFrame | None = None, quarantine: list[str] = (), max_input_tokens: int | None = None) -> DataFrame:
    """Chunks of every page like those of :func:`ingest`, ids marked ``:p3``, numbered through their source in page order.

    A source with a finding of a kind to ``quarantine`` on any of its pages is
    held back whole. ``blocks`` names a column of layout blocks; each chunk gets
    those of its page as ``page_blocks``.
    """
    cfg = budgeted(cfg, max_input_tokens)
    rows = pages_as_sources(loaded, pages=pages, source=source, keep=[blocks] if blocks else [])
    if blocks:
        rows = rows.withColumn("page_blocks", F.filter(blocks, lambda b: b["page"] == F.col("page"))).drop(blocks)
    allowed, held = prepared(rows, quarantine=quarantine)
    if quarantine:
        allowed = allowed.join(held.select(source).distinct(), source, "left_anti")
    chunks = chunk_documents(allowed, source=source, cfg=cfg, keep=["page", "source_content_hash", *(["page_blocks"] if blocks else [])])
    # places of pages first, from counts alone, so a large source is numbered page by page
    counts = chunks.groupBy(source, "page").agg(F.max("chunk_index").alias("_last"))
    before = F.coalesce(F.sum(F.col("_last") + 1).over(Window.partitionBy(source).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = chunks.join(counts.select(source, "page", before.alias("_before")), [source, "page"])
    numbered = numbered.withColumn("id", F.concat("id", F.lit(":p"), F.col("page").cast("string"))).withColumn("chunk_index", (F.col("_before") + F.col("chunk_index")).cast("int")).drop("_before")
    return finished(linked(numbered, source=source), cfg=cfg, embed=embed, model=model, known=known)


def ingest_files(spark: SparkSession, path: str, *, ocr: Callable[[bytes, int], str] | None = None, loaders: dict[str, Loader] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Files under a path read and ingested page by page, their layout blocks kept; beside them the files not read, with their errors."""
    files = read_documents(spark, path, ocr=ocr, loaders=loaders)
    good = files.where("error is null").withColumnRenamed("path", "source_id")
    return ingest_pages(good, blocks="blocks", **options), files.where("error is not null").select("path", "error")
