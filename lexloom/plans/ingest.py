"""Ingestion as one DAG over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.operators import chunking as C
from lexloom.operators import hierarchy as H
from lexloom.operators import structure as L
from lexloom.operators.retrieval import embed
from lexloom.session import checkpointed
from lexloom.sources.contexts import ContextStore
from lexloom.sources.store import pending_docs, unique_ids, upsert


def empty_cache(spark) -> DataFrame:
    return spark.createDataFrame([], "key string, context string")


_SETTINGS = {"chunk_size": K.CHUNK_SIZE, "chunk_overlap": K.CHUNK_OVERLAP, "enable_contextual": True}


def _with_settings(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Title, collection and the document's own chunking settings (defaults where the manifest has none)."""
    own = [F.col(c) if c in manifest.columns else F.lit(v).alias(c) for c, v in _SETTINGS.items()]
    fields = F.struct(*C.document_fields(manifest)).alias("manifest_row")
    d = docs.join(manifest.select("source_id", F.col("title").alias("doc_title"), "collection_name", *own, fields), "source_id", "left")
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in _SETTINGS.items()})


def _situated(splits: DataFrame, cache: DataFrame | ContextStore | None, generator, contextual: bool) -> DataFrame:
    on = F.col("enable_contextual") & F.lit(contextual)
    away = ["parent_context", "fallback_context", *_SETTINGS]
    if not contextual or (cache is None and generator is None):
        # Nothing to look up or to generate: the structural sentence of each chunk.
        d = splits.withColumn("generated_context", F.when(on, F.col("fallback_context")).otherwise(""))
        return C.contextualise(d.drop(*away))
    cache = cache if cache is not None else empty_cache(splits.sparkSession)
    # The look-up reads its input for the keys and for the chunks; split once.
    splits = checkpointed(splits)
    if isinstance(cache, ContextStore):
        situated = cache.lookup(splits.where(on), generator)
    else:
        situated, _ = C.context_lookup(splits.where(on), cache, generator)
    plain = splits.where(~on).withColumn("generated_context", F.lit(""))
    return C.contextualise(situated.unionByName(plain, allowMissingColumns=True).drop(*away))


def build_tree(docs: DataFrame, offsets: DataFrame | None = None, toc: DataFrame | None = None) -> DataFrame:
    """Documents → validated nodes with parents, pages, paths and ancestors: narrow rows, without texts."""
    cands = L.accepted(L.validate(L.detect_candidates(docs, toc), docs))
    nodes = H.build_hierarchy(cands)
    if offsets is not None:
        nodes = L.page_range(nodes, offsets)
        if toc is not None:
            nodes = H.toc_titles(nodes, toc)
    else:
        nodes = nodes.withColumns({"start_page": F.lit(1), "end_page": F.lit(1)})
    return C.mark_parents(H.ancestors(nodes))


def build_nodes(docs: DataFrame, offsets: DataFrame | None = None, toc: DataFrame | None = None) -> DataFrame:
    """Documents → validated nodes with parents, pages, texts, paths and ancestors."""
    return H.slice_text(build_tree(docs, offsets, toc), docs)


def _of_manifest(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    return _with_settings(nodes.withColumn("source_id", F.col("doc_id").cast("string")), manifest)


def chunk_nodes(
    nodes: DataFrame, manifest: DataFrame, cache: DataFrame | ContextStore | None = None, generator: Callable | None = None,
    size: int | None = None, overlap: int | None = None, contextual: bool = True,
) -> DataFrame:
    """Nodes → enriched chunks (doc_id is the source id).

    Sizes are those of the document in the manifest unless ``size`` or ``overlap`` is given. Nodes that met the
    manifest before they got their texts stay where they are.
    """
    n = nodes if "manifest_row" in nodes.columns else _of_manifest(nodes, manifest)
    size = F.col("chunk_size") if size is None else size
    overlap = F.col("chunk_overlap") if overlap is None else overlap
    n = C.hierarchy_columns(C.breadcrumb(C.chunkable_index(C.select_chunkable(n, size))))
    parent = F.concat("breadcrumb", F.lit("\n\nFull Provision Content:\n"), "text")
    label = F.coalesce(F.nullif("number", F.lit("")), F.col("chunkable_ix").cast("string"))
    fallback = C.structural_context(
        F.coalesce("doc_title", F.lit("Legal Document")), F.col("chapter"), label, F.coalesce("title", F.lit(""))
    )
    n = n.withColumns({"parent_context": parent, "fallback_context": fallback})
    splits = C.number_chunks(C.split_nodes(n, "text", size, overlap))
    splits = splits.withColumnRenamed("title", "node_title").withColumn("node_number", F.coalesce("number", F.lit("")))
    drop = ["text", "original_text", "path", "ancestors", "rank", "parent_ix", "parent_hint", "detection_method", "doc_title"]
    chunks = _situated(splits.drop(*drop), cache, generator, contextual)
    chunks = chunks.withColumn("structure_confidence", F.col("confidence"))
    chunks = chunks.withColumn("position", F.shiftleft(F.col("node_ix").cast("long"), 32) + F.col("chunk_index"))
    return C.enrich(chunks, manifest)


def ingest_pages(
    pages: DataFrame, manifest: DataFrame, toc: DataFrame | None = None, existing: DataFrame | None = None,
    cache: DataFrame | ContextStore | None = None, generator: Callable | None = None, encoder: Callable | None = None,
    dim: int = 256, force: bool = False, contextual: bool = True,
) -> DataFrame:
    """Page texts of pending documents → embedded chunks, merged with the store."""
    if existing is not None:
        todo = pending_docs(manifest, existing, dim, force).select(F.col("source_id").alias("doc_id"))
        pages = pages.join(todo, "doc_id", "left_semi")
    docs, offsets = L.concat_pages(pages)
    # Everything that joins is done on narrow rows; texts come last and are not exchanged after that.
    nodes = H.slice_text(_of_manifest(build_tree(docs, offsets, toc), manifest), docs)
    chunks = chunk_nodes(nodes, manifest, cache, generator, contextual=contextual)
    # Ids are made unique on the stored chunk table, and vectors are computed last:
    # neither splitting nor encoding runs twice.
    return upsert(embed(unique_ids(checkpointed(chunks)), "page_content", encoder, dim), existing)


def ingest_texts(
    docs: DataFrame, manifest: DataFrame, cache: DataFrame | ContextStore | None = None, generator: Callable | None = None,
    encoder: Callable | None = None, dim: int = 256, contextual: bool = True,
) -> DataFrame:
    """Plain texts bypass the structure steps: windows of the whole text as one section."""
    d = _with_settings(docs.withColumn("source_id", F.col("doc_id").cast("string")), manifest)
    title = F.coalesce("doc_title", F.lit("Legal Document"))
    parent = F.concat(
        F.lit("Document: "), title, F.lit("\nChapter: N/A\nSection: sec_0 ()\n\nFull Section Text:\n"), "text"
    )
    d = d.withColumns(
        {
            "section_number": F.lit("sec_0"), "parent_context": parent,
            "fallback_context": C.structural_context(title, F.lit("N/A"), F.lit("sec_0"), F.lit("")),
        }
    )
    splits = C.number_section_chunks(C.split_recursive(d, "text", F.col("chunk_size"), F.col("chunk_overlap")))
    splits = splits.withColumnsRenamed({"piece": "split_text", "piece_no": "chunk_index", "piece_total": "total_chunks_in_section"})
    chunks = _situated(splits.drop("doc_title"), cache, generator, contextual)
    chunks = C.enrich(chunks.withColumn("position", F.col("chunk_index").cast("long")), manifest)
    return embed(chunks, "page_content", encoder, dim)


def ingest_legacy(pages: DataFrame, manifest: DataFrame, toc: DataFrame | None = None,
                  cache: DataFrame | ContextStore | None = None, generator: Callable | None = None, contextual: bool = True) -> DataFrame:
    """The section-only flow."""
    docs, offsets = L.concat_pages(pages)
    sections = L.validate_legacy(L.detect_sections_legacy(docs, toc), docs)
    s = _with_settings(H.section_docs(sections, offsets, toc).withColumn("source_id", F.col("doc_id").cast("string")), manifest)
    title = F.coalesce("doc_title", F.lit("Legal Document"))
    parent = F.concat(
        F.lit("Document: "), title, F.lit("\nChapter: "), "chapter", F.lit("\nSection: "), "section_number",
        F.lit(" ("), "section_title", F.lit(")\n\nFull Section Text:\n"), "text",
    )
    fallback = C.structural_context(title, F.col("chapter"), F.col("section_number"), F.col("section_title"))
    s = s.withColumns({"parent_context": parent, "fallback_context": fallback})
    splits = C.number_section_chunks(C.split_recursive(s, "text", F.col("chunk_size"), F.col("chunk_overlap")))
    splits = splits.withColumnsRenamed({"piece": "split_text", "piece_no": "chunk_index", "piece_total": "total_chunks_in_section"})
    return C.enrich(_situated(splits.drop("doc_title"), cache, generator, contextual), manifest)
