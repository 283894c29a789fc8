"""Chunks from nodes and sections: selection, splitting, context, enrichment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.blocked import dense_index
from lexloom.functions.text import filled, first_cap, strip


def _col(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def mark_parents(nodes: DataFrame) -> DataFrame:
    """Add ``has_kids``. A join, so better on nodes that have no texts yet."""
    parents = nodes.where("parent_ix is not null").select("doc_id", F.col("parent_ix").alias("node_ix")).distinct()
    out = nodes.join(parents.withColumn("__kids", F.lit(True)), ["doc_id", "node_ix"], "left")
    return out.withColumn("has_kids", F.coalesce("__kids", F.lit(False))).drop("__kids")


def select_chunkable(nodes: DataFrame, size: int | Column = K.CHUNK_SIZE) -> DataFrame:
    """Drop containers with children, long nodes with children, and blank nodes."""
    out = nodes if "has_kids" in nodes.columns else mark_parents(nodes)
    kids = F.col("has_kids")
    container = kids & F.lower("node_type").isin("document", "part", "chapter")
    long_parent = kids & (F.length("text") > size)
    return out.where(~container & ~long_parent & (strip(F.col("text")) != "")).drop("has_kids")


def pack_paragraphs(text: Column, size: int | Column = K.CHUNK_SIZE) -> Column:
    """Greedy packing of blank-line paragraphs, as array<struct<text, oversize>>.

    A paragraph longer than ``size`` stands alone and is flagged: it is split
    further by :func:`split_recursive`.
    """
    paras = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")
    item = "struct<text:string,oversize:boolean>"
    start = F.struct(
        F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n")
    )

    def piece(t, over):
        return F.struct(t.alias("text"), F.lit(over).alias("oversize"))

    def flushed(acc):
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(piece(acc["open"], False)))
        )

    def state(done, open_, n):
        return F.struct(done.alias("done"), open_.alias("open"), n.alias("n"))

    none = F.lit(None).cast("string")

    def step(acc, p):
        return (
            F.when(
                F.length(p) > size,
                state(F.concat(flushed(acc), F.array(piece(p, True))), none, F.lit(0)),
            )
            .when(
                acc["open"].isNotNull() & (acc["n"] + F.length(p) + 2 > size),
                state(flushed(acc), p, F.length(p)),
            )
            .otherwise(
                state(acc["done"], F.concat_ws("\n\n", acc["open"], p), acc["n"] + F.length(p) + 2)
            )
        )

    packed = F.aggregate(paras, start, step, flushed)
    whole = F.array(piece(text, False))
    return F.when((F.length(text) <= size) | (F.size(packed) == 0), whole).otherwise(packed)


def _pieces(text: str, pattern: str) -> list[str]:
    """Cut before every match; the match stays with what follows it."""
    cuts = [0]
    for m in re.finditer(pattern, text):
        if m.end() > m.start():
            cuts.append(m.start())
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def _windows(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join consecutive parts up to ``size``, keeping up to ``overlap`` characters of the last window."""
    first, total = 0, 0
    for i, part in enumerate(parts):
        if total + len(part) > size and i > first:
            yield "".join(parts[first:i])
            while first < i and (total > overlap or (total + len(part) > size and total > 0)):
                total -= len(parts[first])
                first += 1
        total += len(part)
    if first < len(parts):
        yield "".join(parts[first:])


def _char_windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """What :func:`_windows` makes of single characters, without listing them."""
    first = 0
    while first + size < len(text):
        yield text[first : first + size]
        first += size - overlap
    yield text[first:]


def _split(text: str, size: int, overlap: int, seps: list[str]) -> Iterator[str]:
    at = next((i for i, s in enumerate(seps) if re.search(s, text)), len(seps) - 1)
    if seps[at] == "." and 0 <= overlap < size and size > 1 and text and "\n" not in text[1:]:
        yield from _char_windows(text, size, overlap)
        return
    finer = seps[at + 1:] if re.search(seps[at], text) else []
    small: list[str] = []
    for part in _pieces(text, seps[at]):
        if len(part) < size:
            small.append(part)
            continue
        yield from _windows(small, size, overlap)
        small = []
        if finer:
            yield from _split(part, size, overlap, finer)
        else:
            yield part
    yield from _windows(small, size, overlap)


def splitter(size: int | Column, overlap: int | Column, separators: list[str], literal_dot: bool) -> Callable:
    """Column array of texts → array of window arrays, by a pandas UDF; null texts stay null."""
    seps = [r"\." if (s == "." and literal_dot) else s for s in separators]

    def windows(text, width, kept):
        return None if text is None else [w.strip() for w in _split(text, width, kept, seps) if w.strip()]

    @F.pandas_udf("array<array<string>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes, overlaps in batches:
            rows = zip(texts, sizes, overlaps, strict=True)
            yield pd.Series([None if ts is None else [windows(t, int(n), int(o)) for t in ts] for ts, n, o in rows], dtype=object)

    return lambda texts: cut(texts, _col(size), _col(overlap))


def split_recursive(
    df: DataFrame,
    col: str,
    size: int | Column = K.CHUNK_SIZE,
    overlap: int | Column = K.CHUNK_OVERLAP,
    separators: list[str] | None = None,
    literal_dot: bool = False,
    out: str = "piece",
) -> DataFrame:
    """One row per window of ``col``: ordered separators, greedy windows with overlap.

    Separators are regular expressions, so the default "." matches any
    character; ``literal_dot`` makes it a full stop.
    """
    cut = splitter(size, overlap, separators or K.SEPARATORS, literal_dot)
    cols = [c for c in df.columns if c != col]
    rows = df.withColumn("__w", F.get(cut(F.array(col)), F.lit(0)))
    rows = rows.select(*cols, F.size("__w").alias(f"{out}_total"), F.posexplode_outer("__w").alias(f"{out}_no", out))
    return rows.where(F.col(out).isNotNull())


def split_nodes(nodes: DataFrame, col: str = "text", size: int | Column = K.CHUNK_SIZE, overlap: int | Column = K.CHUNK_OVERLAP,
                literal_dot: bool = False) -> DataFrame:
    """Paragraph packing, then recursive splitting of the oversize paragraphs only.

    Adds chunk_index, total_chunks_in_section and split_text. All pieces of a
    node stay in its row until the final explode: no shuffle, no window.
    """
    cut = splitter(size, overlap, K.SEPARATORS, literal_dot)
    packed = nodes.withColumn("__p", pack_paragraphs(F.col(col), size))
    over = F.transform("__p", lambda p: F.when(p["oversize"], p["text"]))
    some = F.exists("__p", lambda p: p["oversize"])
    packed = packed.withColumn("__c", cut(F.when(some, over)))
    aligned = F.coalesce("__c", F.transform("__p", lambda p: F.lit(None).cast("array<string>")))
    windows = F.flatten(F.zip_with("__p", aligned, lambda p, c: F.coalesce(c, F.array(p["text"]))))
    packed = packed.withColumn("__w", windows)
    return packed.select(
        *nodes.columns, F.size("__w").alias("total_chunks_in_section"),
        F.posexplode_outer("__w").alias("chunk_index", "split_text"),
    )


def number_chunks(splits: DataFrame, source: str = "source_id") -> DataFrame:
    """Add chunk_id ``{source}_{type}_{number or index}_c{i}``."""
    label = filled(F.col("number"), F.col("chunkable_ix").cast("string"))
    head = F.concat_ws("_", F.col(source).cast("string"), "node_type", label)
    return splits.withColumn("chunk_id", F.concat(head, F.lit("_c"), F.col("chunk_index").cast("string")))


def number_section_chunks(splits: DataFrame, source: str = "source_id") -> DataFrame:
    """Legacy ids ``{source}_Sec{n}_c{i}`` for the rows of :func:`split_recursive`."""
    cid = F.concat(
        F.col(source).cast("string"), F.lit("_Sec"), "section_number", F.lit("_c"), F.col("piece_no").cast("string")
    )
    return splits.withColumn("chunk_id", cid)


def chunkable_index(nodes: DataFrame) -> DataFrame:
    """Position among the chunkable nodes of a document (used when a node has no number)."""
    return dense_index(nodes, ["doc_id"], "node_ix", "chunkable_ix")


def breadcrumb(nodes: DataFrame, title: str = "doc_title") -> DataFrame:
    """Add the lineage text, from the ancestors map."""
    parts = [F.concat(F.lit("Document: "), F.coalesce(title, F.lit("Legal Document")))]
    for level in ("part", "chapter", "section", "rule", "article"):
        value = F.nullif(F.try_element_at("ancestors", F.lit(level)), F.lit(""))
        parts.append(F.concat(F.lit(f"{level.capitalize()}: "), value))
    own = F.concat(
        first_cap(F.col("node_type")), F.lit(": "), F.coalesce("number", F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("title"), F.lit("")), F.lit(")")), F.lit("")),
    )
    parts.append(F.when(~F.col("node_type").isin("part", "chapter", "document"), own))
    return nodes.withColumn("breadcrumb", F.concat_ws(" | ", *parts))


def hierarchy_columns(nodes: DataFrame) -> DataFrame:
    """Add the twelve level columns from the node itself or its ancestors."""

    def anc(level: str, default: str = "") -> Column:
        return F.coalesce(F.try_element_at("ancestors", F.lit(level)), F.lit(default))

    kind = F.col("node_type")
    numbered = kind.isin("section", "article", "rule")
    up = F.coalesce(*[F.try_element_at("ancestors", F.lit(x)) for x in ("section", "rule", "article")], F.lit(""))
    cols = {
        "section_number": F.when(numbered, F.col("number")).otherwise(up),
        "section_title": F.when(numbered, F.col("title")).otherwise(F.lit("")),
        "chapter": anc("chapter", "N/A"),
        "part": anc("part"),
    }
    for level in K.LEVEL_COLUMNS:
        cols[level] = F.when(kind == level, F.col("number")).otherwise(anc(level))
    return nodes.withColumns(cols)


ENRICHED = [
    "source_id", "title", "document_type", "jurisdiction", "legal_area", "authority_level", "publication_date",
    "effective_from", "status", "source_url", "is_amendment", "parent_document", "applicable_product",
]


def document_fields(manifest: DataFrame) -> list[Column]:
    """The manifest's fields that every chunk of a document gets."""
    return [F.coalesce(c, F.lit("")).alias(c) if c == "parent_document" else F.col(c) for c in ENRICHED]


def enrich(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Overwrite the document fields from the manifest; default absent hierarchy fields.

    One manifest row per source keeps the join from multiplying chunks. Spark
    broadcasts the manifest when its measured size allows, and joins by hash
    otherwise. Chunks whose rows met the manifest before they got their texts bring the
    fields in a struct ``manifest_row``: they are not joined again.
    """
    keep = [c for c in chunks.columns if c not in ENRICHED and c != "manifest_row"]
    if "manifest_row" in chunks.columns:
        out = chunks.select("source_id", *keep, *[F.col(f"manifest_row.{c}") for c in ENRICHED if c != "source_id"])
    else:
        out = chunks.select("source_id", *keep).join(manifest.select(*document_fields(manifest)), "source_id", "left")
    have = set(out.columns)

    def col_or(name: str, default: Column) -> Column:
        return F.col(name) if name in have else default

    blank, number = F.lit(""), col_or("section_number", F.lit(""))
    kind = col_or("node_type", F.lit("section"))
    defaults = {
        "node_type": kind,
        "node_number": col_or("node_number", number),
        "node_title": col_or("node_title", col_or("section_title", blank)),
        "part": blank,
        "chapter": F.lit("N/A"),
        "section": F.when(kind == "section", number).otherwise(""),
        **{level: blank for level in K.LEVEL_COLUMNS[1:]},
        "start_page": col_or("page", F.lit(1)),
        "end_page": col_or("start_page", col_or("page", F.lit(1))),
        "original_text": col_or("original_content", col_or("page_content", blank)),
        "contextual_text": col_or("generated_context", blank),
        "parent_id": blank,
        "structure_confidence": F.lit(1.0),
    }
    return out.withColumns({k: v for k, v in defaults.items() if k not in have})


# --- situating context -------------------------------------------------------------------
def context_key(parent: Column, chunk: Column) -> Column:
    return F.sha2(F.concat(strip(parent), F.lit("|||"), strip(chunk)), 256)


def structural_context(doc_title: Column, chapter: Column, number: Column, title: Column) -> Column:
    return F.format_string(K.STRUCTURAL_CONTEXT, doc_title, chapter, number, title)


def context_prompt(chunks: DataFrame, parent: str = "parent_context", chunk: str = "split_text") -> DataFrame:
    """Add the request text for a generator; the parent is cut at the model's limit."""
    return chunks.withColumn(
        "prompt",
        F.concat(
            F.lit("<document>\n"), F.substring(F.col(parent), 1, K.CONTEXT_LIMIT), F.lit("\n</document>\n<chunk>\n"),
            F.col(chunk),
            F.lit("\n</chunk>\nSituate the chunk within the document in 50-100 tokens, for better search. "
                  "Reply with that context only."),
        ),
    )


def context_lookup(
    chunks: DataFrame,
    cache: DataFrame,
    generator: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chunks with generated_context, new cache rows).

    ``chunks`` needs parent_context, split_text and fallback_context. Each
    distinct missing key is generated once. ``generator`` maps (key, prompt) rows
    to (key, context) rows, for example with ``mapInPandas``; without it, or where
    it gives nothing, the structural sentence is used.
    """
    keyed = chunks.withColumn("key", context_key(F.col("parent_context"), F.col("split_text")))
    known = cache.select("key", F.col("context").alias("cached"))
    wanted = context_prompt(keyed).groupBy("key").agg(
        F.min("prompt").alias("prompt"), F.min("fallback_context").alias("fallback_context")
    )
    missing = wanted.join(known, "key", "left_anti")
    if generator is None:
        fresh = missing.select("key", F.col("fallback_context").alias("context"))
    else:
        made = generator(missing.select("key", "prompt")).select("key", F.col("context").alias("made"))
        fresh = missing.join(made, "key", "left").select(
            "key", filled(strip(F.col("made")), F.col("fallback_context")).alias("context")
        )
    every = known.select("key", F.col("cached").alias("generated_context")).unionByName(
        fresh.select("key", F.col("context").alias("generated_context"))
    )
    return keyed.join(every, "key", "left").drop("key"), fresh


def contextualise(chunks: DataFrame) -> DataFrame:
    """page_content = context, blank line, original; the original stays verbatim."""
    has = F.coalesce(F.col("generated_context"), F.lit("")) != ""
    content = F.when(has, F.concat("generated_context", F.lit("\n\n"), "split_text")).otherwise(F.col("split_text"))
    return chunks.withColumns({"page_content": content, "original_text": F.col("split_text"),
                               "original_content": F.col("split_text")})


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Documents and chunks per outcome (successful, skipped, failed)."""
    return outcomes.groupBy("outcome").agg(
        F.count("*").alias("n_documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks")
    )
