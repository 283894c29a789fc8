"""From word boxes and page texts to validated structural candidates.

Positions are character offsets (code points) into a document's text. All text
matching is done by the JVM regex engine over the whole text of a document;
only offsets and short strings leave that projection, so the order-dependent
steps that follow never shuffle texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import constants as K
from lexloom.functions.blocked import asof_join, carry, running_sum
from lexloom.functions.text import filled, let, strip

PAGE_BLOCK = 4096  # pages per block of one document
PIECE = 1 << 16  # characters per text piece when spans are cut out of texts

# Unicode non-characters: they cannot occur in interchanged text.
_M = ["\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"]


# --- pages and lines ---------------------------------------------------------------------
def modal_font_size(words: DataFrame) -> DataFrame:
    """Most common rounded font size per page; first seen wins a tie; 12 without sizes."""
    size = F.when(F.col("size") != 0, F.bround("size", 0).cast("int"))
    counts = words.groupBy("doc_id", "page", size.alias("sz")).agg(
        F.count("*").alias("n"), F.min("word_ix").alias("first_ix")
    )
    rank = F.when(F.col("sz").isNotNull(), F.struct("n", -F.col("first_ix")))
    return counts.groupBy("doc_id", "page").agg(
        F.coalesce(F.max_by("sz", rank), F.lit(12)).alias("modal_size")
    )


_RUN_KEYS = ("doc_id", "page", "y", "sz", "bold")


def _separator(texts: pa.Array) -> str:
    """A character that no text of the batch holds; a blank if possible."""
    return next(c for c in map(chr, (32, *range(1, 0xD800))) if not pc.any(pc.match_substring(texts, c)).as_py())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive words of one line, size and weight as one row, their texts joined by ``sep``.

    ``word_ix`` lists the numbers of the words that have a text, null if these are ``first_ix``, ``first_ix`` + 1, ….
    """
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for key in _RUN_KEYS:
            here, before = b.column(key).slice(1), b.column(key).slice(0, n - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        edges = np.append(starts, n)
        ix, text = b.column("word_ix"), b.column("text")
        there = text.is_valid().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.append(0, np.cumsum(there))[edges], pa.int32())
        said = text.drop_null()
        sep = _separator(said)
        next_one = pc.fill_null(pc.equal(ix.slice(1), pc.add(ix.slice(0, n - 1), pa.scalar(1, ix.type))), False)
        odd = ~there | ix.is_null().to_numpy(zero_copy_only=False)
        odd[1:] |= ~(next_one.to_numpy(zero_copy_only=False) | new[1:])
        plain = ~np.logical_or.reduceat(odd, starts)
        first = pa.table({"r": np.cumsum(new), "i": ix}).group_by("r").aggregate([("i", "min")]).sort_by("r")["i_min"].combine_chunks()
        listed = pa.ListArray.from_arrays(offsets, ix.filter(text.is_valid()))
        yield pa.RecordBatch.from_arrays(
            [*[b.column(key).take(pa.array(starts)) for key in _RUN_KEYS], pa.array(np.diff(edges)), first,
             pc.if_else(pa.array(plain), pa.scalar(None, listed.type), listed),
             pc.binary_join(pa.ListArray.from_arrays(offsets, said), sep), pa.array([sep] * len(starts), pa.string())],
            names=[*_RUN_KEYS, "n", "first_ix", "word_ix", "line", "sep"],
        )


def _lines(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per visual line with its words joined, its largest size and ``sizes`` (sz, n, first_ix).

    Words are packed into runs where they lie, so that an exchange, by ``by``, moves a row per line and not one per
    word, and no words are sorted or held before it. Words in any order give the same lines, in more runs.
    """
    w = words.where("doc_id IS NOT NULL AND page IS NOT NULL").select(
        "doc_id", "page", F.bround("top", 0).cast("int").alias("y"),
        F.when(F.col("size") != 0, F.bround("size", 0).cast("int")).alias("sz"),
        F.lower(F.coalesce("fontname", F.lit(""))).contains("bold").alias("bold"), "word_ix", "text",
    )
    ix = w.schema["word_ix"].dataType
    shape = T.StructType([
        *[T.StructField(k, w.schema[k].dataType) for k in _RUN_KEYS], T.StructField("n", T.LongType()), T.StructField("first_ix", ix),
        T.StructField("word_ix", T.ArrayType(ix)), T.StructField("line", T.StringType()), T.StructField("sep", T.StringType()),
    ])
    run = F.struct("sz", "n", "first_ix", "word_ix", "line", "sep")
    lines = w.mapInArrow(_runs, shape).repartition(*by).groupBy("doc_id", "page", "y").agg(
        F.collect_list(run).alias("runs"), F.max(F.coalesce("sz", F.lit(0))).alias("max_size"), F.bool_or("bold").alias("bold")
    )

    def spoken(r):
        texts = F.split(r["line"], F.concat(F.lit("\\Q"), r["sep"], F.lit("\\E")), -1)
        numbers = F.coalesce(r["word_ix"], F.sequence(r["first_ix"], (r["first_ix"] + r["n"] - 1).cast(ix)))
        return F.zip_with(numbers, F.when(F.size(numbers) > 0, texts).otherwise(F.array().cast("array<string>")), lambda i, t: F.struct(i.alias("i"), t.alias("t")))

    only = F.get("runs", F.lit(0))
    merged = F.array_join(F.transform(F.array_sort(F.flatten(F.transform("runs", spoken))), lambda x: x["t"]), " ")
    line = F.when((F.size("runs") == 1) & only["word_ix"].isNull(), F.replace(only["line"], only["sep"], F.lit(" "))).otherwise(merged)
    sizes = F.transform("runs", lambda r: F.struct(r["sz"].alias("sz"), r["n"].alias("n"), r["first_ix"].alias("first_ix")))
    return lines.select("doc_id", "page", "y", line.alias("line"), "max_size", "bold", sizes.alias("sizes"))


def _modal(sizes: Column) -> Column:
    """Modal size of (sz, n, first_ix) entries, as :func:`modal_font_size` defines it; equal sizes follow each other after the sort."""
    start = "named_struct('sz', int(null), 'n', 0L, 'first_ix', {0}, 'best', {1})"
    rank = "struct<n:bigint,first:bigint,sz:int>"
    none = F.expr(start.format("bigint(null)", f"cast(null as {rank})"))

    def best(acc):
        own = F.struct(acc["n"].alias("n"), (-acc["first_ix"]).alias("first"), acc["sz"].alias("sz"))
        return F.array_max(F.array(acc["best"], F.when(acc["sz"].isNotNull(), own)))

    def step(acc, x):
        same, first = acc["sz"] == x["sz"], x["first_ix"].cast("long")
        more = F.struct(acc["sz"].alias("sz"), (acc["n"] + x["n"]).alias("n"), F.least(acc["first_ix"], first).alias("first_ix"), acc["best"].alias("best"))
        other = F.struct(x["sz"].alias("sz"), x["n"].alias("n"), first.alias("first_ix"), best(acc).alias("best"))
        return F.when(same, more).otherwise(other)

    known = F.array_sort(F.filter(sizes, lambda x: x["sz"].isNotNull()))
    return F.coalesce(F.aggregate(known, none, step, best)["sz"], F.lit(12))


def text_lines(words: DataFrame, modal: DataFrame) -> DataFrame:
    """One row per visual line, with the heading decision."""
    return _lines(words, ["doc_id", "page"]).join(modal, ["doc_id", "page"]).select(
        "doc_id", "page", "y", "line", "modal_size",
        ((F.col("max_size") > F.col("modal_size")) | F.col("bold")).alias("is_heading"),
    )


def assemble_lines(words: DataFrame, modal: DataFrame | None = None) -> DataFrame:
    """Page texts with marked headings; pages without words do not appear.

    Words are read once and exchanged once, by document: its lines, pages, sizes and number of pages all follow there.
    """
    line = F.struct("y", "line", "max_size", "bold")
    pages = _lines(words, ["doc_id"]).groupBy("doc_id", "page").agg(
        F.collect_list(line).alias("lines"), F.flatten(F.collect_list("sizes")).alias("sizes")
    )
    total = F.max("page").over(Window.partitionBy("doc_id"))
    pages = pages.withColumns({"lines": F.array_sort("lines"), "total_pages": total})
    if modal is None:
        pages = pages.withColumn("modal_size", _modal(F.col("sizes")))
    else:
        pages = pages.join(modal, ["doc_id", "page"])

    def part(x):
        mark = F.concat(F.lit("\n" + K.HEADING_START), x["line"], F.lit(K.HEADING_END))
        return F.when((x["max_size"] > F.col("modal_size")) | x["bold"], mark).otherwise(x["line"])

    text = F.array_join(F.transform("lines", part), "\n")
    return pages.select("doc_id", "page", text.alias("text"), "modal_size", "total_pages")


def page_offsets(pages: DataFrame) -> DataFrame:
    """Start and end offset of each page in the joined text (end counts the joint)."""
    p = pages.select("doc_id", "page", (F.length("text") + 1).cast("long").alias("size"))
    p = running_sum(p, ["doc_id"], "page", F.col("size"), "start", block=PAGE_BLOCK)
    return p.select("doc_id", "page", "start", (F.col("start") + F.col("size")).alias("end"))


def concat_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, page offsets). A document's text is one value, hence one row."""
    docs = pages.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n"
        ).alias("text")
    )
    return docs, page_offsets(pages)


def page_range(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add start_page and end_page; the later page wins a shared boundary; else 1."""
    ev = offsets.select("doc_id", F.col("start").alias("__s"), F.col("page").alias("__page"), F.col("end").alias("__end"))
    for probe, out in (("start_char", "start_page"), ("end_char", "end_page")):
        spans = asof_join(spans, ev, ["doc_id"], probe, "__s", ["__page", "__end"])
        inside = F.col(probe) <= F.col("__end")
        spans = spans.withColumn(out, F.coalesce(F.when(inside, F.col("__page")), F.lit(1))).drop("__page", "__end")
    return spans


def split_lines(docs: DataFrame) -> DataFrame:
    """Line table with character offsets."""
    lines = docs.where("text is not null").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "text")
    )
    size = F.length("text").cast("long")
    lines = running_sum(lines, ["doc_id"], "line_no", size + 1, "start_char")
    has = F.col("text").contains(K.HEADING_START)
    return lines.select(
        "doc_id", "line_no", "text", "start_char", (F.col("start_char") + size).alias("end_char"),
        has.alias("is_heading"),
    )


# --- table of contents -------------------------------------------------------------------
def toc_index(toc: DataFrame) -> DataFrame:
    """Chapter entries of the embedded contents table, in page order."""
    title = strip(F.col("title"))
    keep = (F.col("level") == 1) | title.rlike(r"(?i)^chapter\s+[IVXLCDM\d]+")
    return toc.where(keep).select("doc_id", "page", "entry_ix", F.upper(title).alias("label"))


def body_start(toc: DataFrame) -> DataFrame:
    return toc_index(toc).groupBy("doc_id").agg(F.min("page").alias("body_page"))


def chapter_for_page(probes: DataFrame, toc: DataFrame, page: str = "page", block: int | None = None) -> DataFrame:
    """Add the chapter label in force on a page. ``block`` spreads documents with very many probes."""
    ev = toc_index(toc).select("doc_id", F.col("page").alias("__p"), "entry_ix", F.col("label").alias("chapter"))
    return asof_join(probes, ev, ["doc_id"], page, "__p", ["chapter"], event_tie="entry_ix", block=block)


def entry_for_page(probes: DataFrame, toc: DataFrame, page: str = "page", block: int | None = None) -> DataFrame:
    """Add the contents entry (any level) in force on a page."""
    ev = toc.select(
        "doc_id", F.col("page").alias("entry_page"), "entry_ix",
        F.col("level").alias("entry_level"), strip(F.col("title")).alias("entry_title"),
    )
    return asof_join(
        probes, ev, ["doc_id"], page, "entry_page", ["entry_level", "entry_title", "entry_page"],
        event_tie="entry_ix", block=block,
    )


# --- pattern spans -----------------------------------------------------------------------
def _marked_up(label: str, pattern: str, groups: int) -> Column:
    refs = "".join(f"${i}{_M[2]}" for i in range(1, groups + 1))
    return F.struct(
        F.lit(label).alias("label"),
        F.split(F.regexp_replace("text", pattern, f"{_M[0]}{refs}$0{_M[3]}"), _M[0], -1).alias("segs"),
    )


def find_spans(docs: DataFrame, patterns, groups: int = 2, marked: Column | None = None) -> DataFrame:
    """All matches of (label, pattern) pairs, with offsets, in one projection.

    The regex engine marks every match in place; splitting at the marks gives the
    matches and the lengths in between, and a running sum of these lengths gives
    the offsets. Texts are read once per pattern and never leave the row (the outer explode keeps
    the optimizer from adding a non-empty filter that would run them twice). With
    ``marked``, documents where it holds get the heading-block pattern instead.
    """
    cuts = F.array(*[_marked_up(label, p, groups) for label, p in patterns])
    if marked is not None:
        block = f"(?s){K.HEADING_START}(.*?)(){K.HEADING_END}"
        cuts = F.when(marked, F.array(_marked_up("heading", block, groups))).otherwise(cuts)
    segs = docs.select("doc_id", F.length("text").cast("long").alias("doc_size"), F.explode_outer(cuts).alias("m"))
    segs = segs.where(F.size("m.segs") > 1).select(
        "doc_id", "doc_size", F.col("m.label").alias("label"), F.posexplode_outer("m.segs").alias("seg_no", "seg")
    )
    parts = F.split("seg", _M[2], -1)
    body = F.when(F.col("seg_no") == 0, F.col("seg")).otherwise(F.element_at(parts, -1))
    hit = F.substring_index(body, _M[3], 1)
    size = F.length(body) - F.when(F.col("seg_no") == 0, 0).otherwise(1)
    out = segs.select(
        "doc_id", "doc_size", "label", "seg_no", size.cast("long").alias("seg_size"),
        F.when(F.col("seg_no") > 0, F.length(hit)).cast("long").alias("hit_size"),
        *[F.when(F.col("seg_no") > 0, F.get(parts, F.lit(i - 1))).alias(f"g{i}") for i in range(1, groups + 1)],
    )
    out = running_sum(out, ["doc_id", "label"], "seg_no", F.col("seg_size"), "start_char")
    return out.where("seg_no > 0").select(
        "doc_id", "doc_size", "label", "start_char", (F.col("start_char") + F.col("hit_size")).alias("end_char"),
        *[f"g{i}" for i in range(1, groups + 1)],
    )


def is_marked(text: Column) -> Column:
    return text.contains(K.HEADING_START)


def _plain_patterns() -> list[tuple[str, str]]:
    return [(t, ("(?mdU)" if t == "section" else "(?imdU)") + p) for t, p in K.PLAIN_PATTERNS]


def _typed_heading(h: Column) -> Column:
    """struct(node_type, number, title) of a heading text; the first matching pattern decides."""
    hit = None
    for t, p in K.HEADING_PATTERNS:
        pattern = ("(?dU)" if t == "section" else "(?idU)") + p
        value = F.struct(
            F.lit(t).alias("node_type"), F.regexp_extract(h, pattern, 1).alias("number"),
            F.regexp_extract(h, pattern, 2).alias("title"),
        )
        hit = F.when(h.rlike(pattern), value) if hit is None else hit.when(h.rlike(pattern), value)
    return hit


def _candidates(spans: DataFrame) -> DataFrame:
    spans = spans.withColumn("__h", strip(F.col("g1")))
    plain = F.struct(F.col("label").alias("node_type"), F.col("g1").alias("number"), F.col("g2").alias("title"))
    hit = F.when(F.col("label") == "heading", _typed_heading(F.col("__h"))).otherwise(plain)
    return spans.withColumn("__hit", hit).where("__hit is not null").select(
        "doc_id", "__hit.node_type", strip(F.col("__hit.number")).alias("number"),
        F.nullif(strip(F.col("__hit.title")), F.lit("")).alias("title"), "start_char", "end_char",
        F.when(F.col("label") == "heading", "heading_sentinel").otherwise("regex").alias("detection_method"), "doc_size",
    )


def detect_headings(docs: DataFrame) -> DataFrame:
    """Candidates inside marked headings; the first matching pattern decides the type."""
    return _candidates(find_spans(docs.where(is_marked(F.col("text"))), _plain_patterns(), marked=F.lit(True)))


def detect_plain(docs: DataFrame) -> DataFrame:
    """Line-anchored patterns for texts without marked headings.

    A heading number may be followed by a line break: the next line then is the
    title, because the separator class of the patterns crosses line ends.
    """
    return _candidates(find_spans(docs.where(~is_marked(F.col("text"))), _plain_patterns()))


def detect_any(docs: DataFrame) -> DataFrame:
    """Marked headings where a document has them, else plain patterns: one pass over the texts."""
    return _candidates(find_spans(docs, _plain_patterns(), marked=is_marked(F.col("text"))))


def dedup_last(cands: DataFrame) -> DataFrame:
    """Per (document, type, number) keep the last occurrence: the body beats the contents page."""
    rest = [c for c in cands.columns if c not in ("doc_id", "node_type", "number")]
    best = cands.groupBy("doc_id", "node_type", "number").agg(
        F.max_by(F.struct(*rest), F.col("start_char")).alias("r")
    )
    return best.select("doc_id", "node_type", "number", "r.*").select(*cands.columns)


def bound_spans(cands: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """End of a candidate = start of the next one, else the end of the document.

    Detected candidates carry the document's length; for others it is read from ``docs``.
    """
    cols = cands.columns
    if "doc_size" not in cols:
        sizes = docs.select("doc_id", F.length("text").cast("long").alias("doc_size"))
        cands = cands.join(sizes, "doc_id", "left")
    out = carry(cands, ["doc_id"], "start_char", {"__next": F.col("start_char")}, after=True, ties=["node_type"])
    return out.withColumn("end_char", F.coalesce("__next", "doc_size")).select(*cols)


def leading_int(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d+)", 1).try_cast("long")


def sequential_flag(cands: DataFrame) -> DataFrame:
    """True when the leading integer repeats or follows that of the previous same-type candidate."""
    prev = carry(cands, ["doc_id", "node_type"], "start_char", {"__prev": F.coalesce("number", F.lit(""))})
    step = leading_int(F.col("number")) - leading_int(F.col("__prev"))
    return prev.withColumn("is_sequential", F.coalesce(step.isin(0, 1), F.lit(False))).drop("__prev")


def score_candidate(cands: DataFrame, has_toc: Column | bool = False) -> DataFrame:
    """Confidence from heading style, numbering, contents table and title length."""
    toc = has_toc if isinstance(has_toc, Column) else F.lit(bool(has_toc))
    marked = F.col("detection_method") == "heading_sentinel"
    size = F.length(F.coalesce("title", F.lit("")))
    score = (
        F.lit(0.5)
        + F.when(marked, 0.30).otherwise(0.0)
        + F.when(F.col("is_sequential"), 0.20).otherwise(0.0)
        + F.when(marked & toc & F.col("node_type").isin("chapter", "part"), 0.20).otherwise(0.0)
        - F.when(size > 120, 0.10).otherwise(0.0)
        - F.when(size > 200, 0.20).otherwise(0.0)
    )
    return cands.withColumn("confidence", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def detect_candidates(docs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Detection as a whole: headings or plain patterns, last wins, bounds, flags, scores."""
    found = dedup_last(detect_any(docs))
    found = sequential_flag(bound_spans(found))
    if toc is None:
        return score_candidate(found)
    listed = toc_index(toc).select("doc_id").distinct().withColumn("__toc", F.lit(True))
    found = found.join(listed, "doc_id", "left")
    return score_candidate(found, F.coalesce("__toc", F.lit(False))).drop("__toc")


def number_gaps(cands: DataFrame, min_gap: int = 2, expand: bool = True) -> DataFrame:
    """Numbers missing between consecutive distinct numbers of one type."""
    n = leading_int(F.col("number"))
    nums = cands.select("doc_id", "node_type", n.alias("n")).where("n is not null").distinct()
    nums = carry(nums, ["doc_id", "node_type"], "n", {"next_n": F.col("n")}, after=True)
    gaps = nums.where(F.col("next_n") - F.col("n") > min_gap)
    if not expand:
        return gaps.select("doc_id", "node_type", F.col("n").alias("after_number"), F.col("next_n").alias("before_number"))
    return gaps.select(
        "doc_id", "node_type", F.explode(F.sequence(F.col("n") + 1, F.col("next_n") - 1)).alias("missing")
    )


def missing_chapters(sections: DataFrame) -> DataFrame:
    """Sections that got no chapter."""
    return sections.where(F.col("chapter_ref").isNull()).select("doc_id", "section_number")


def detect_sections_legacy(docs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Section-only detection; the chapter is the nearest chapter heading before."""
    sec = find_spans(docs, [("section", "(?mdU)" + K.LEGACY_SECTION)])
    sec = sec.select(
        "doc_id", F.lit("section").alias("node_type"), strip(F.col("g1")).alias("number"),
        strip(F.col("g2")).alias("title"), "start_char", "end_char", "doc_size",
    )
    sec = bound_spans(dedup_last(sec))
    chap = find_spans(docs, [("chapter", "(?mdU)" + K.LEGACY_CHAPTER)])
    chap = chap.groupBy("doc_id", strip(F.col("g1")).alias("k")).agg(
        F.max_by("g2", "start_char").alias("g2"), F.max("start_char").alias("__at")
    )
    chap = chap.select("doc_id", "__at", F.concat("k", F.lit(": "), strip(F.col("g2"))).alias("chapter_ref"))
    if toc is not None:
        listed = toc_index(toc).select("doc_id").distinct()
        chap = chap.join(listed, "doc_id", "left_anti")
    sec = asof_join(sec, chap, ["doc_id"], "start_char", "__at", ["chapter_ref"])
    return sec.select(
        "doc_id", F.col("number").alias("section_number"), F.col("title").alias("section_title"),
        "start_char", "end_char", "chapter_ref",
    )


def from_legacy(sections: DataFrame) -> DataFrame:
    return sections.select(
        "doc_id", F.lit("section").alias("node_type"), F.col("section_number").alias("number"),
        F.col("section_title").alias("title"), "start_char", "end_char",
        F.lit(0.85).alias("confidence"), F.lit("legacy").alias("detection_method"),
        F.col("chapter_ref").alias("parent_hint"),
    )


# --- cutting texts -----------------------------------------------------------------------
def text_pieces(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """Documents cut into fixed-size pieces (doc_id, piece_no, piece)."""
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int")
    nos = F.explode_outer(F.sequence(F.lit(0), last)).alias("piece_no")
    cut = docs.select("doc_id", "text", nos)
    return cut.select("doc_id", "piece_no", F.substring(F.col("text"), F.col("piece_no") * size + 1, F.lit(size)).alias("piece"))


def slice_spans(spans: DataFrame, docs: DataFrame, out: str = "original_text", size: int = PIECE) -> DataFrame:
    """Add the text of [start_char, end_char) to each span.

    Spans meet only the pieces they overlap, so neither a long document nor one
    with very many spans lands in a single task.
    """
    cols = spans.columns
    start, stop = F.col("start_char"), F.greatest("end_char", "start_char")
    first = F.floor(start / size).cast("int")
    last = F.floor((F.greatest(stop, start + 1) - 1) / size).cast("int")
    parts = spans.withColumn("piece_no", F.explode_outer(F.sequence(first, last)))
    begin = F.greatest(start - F.col("piece_no") * size, F.lit(0))
    end = F.least(stop - F.col("piece_no") * size, F.lit(size))
    part = F.substring(F.col("piece"), (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    parts = parts.join(text_pieces(docs, size), ["doc_id", "piece_no"], "left").select(*cols, "piece_no", part.alias("part"))
    nested = {f.name for f in spans.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    texts = parts.groupBy(*[c for c in cols if c not in nested]).agg(
        F.collect_set(F.struct("piece_no", "part")).alias("ps"), F.count("*").alias("__n"),
        *[F.first(c).alias(c) for c in cols if c in nested],
    )
    joined = F.array_join(F.transform(F.array_sort("ps"), lambda x: x["part"]), "")
    # Equal spans meet in one group: each piece is then there once per span.
    times = (F.col("__n") / F.size("ps")).cast("int")
    found = texts.select(*cols, joined.alias(out), times.alias("__times"))
    return found.select(*cols, out, F.explode_outer(F.sequence(F.lit(1), "__times")).alias("__i")).drop("__i")


def cut_spans(spans: DataFrame, docs: DataFrame, out: str = "original_text", size: int = 4096) -> DataFrame:
    """As :func:`slice_spans`, for spans that stem from their document's text, which bounds their number.

    Spans travel to their document as one list, so texts are not exchanged; a span is cut out of the pieces it
    overlaps, not from the start of the text. The result stays partitioned by doc_id.
    """
    rest = [c for c in spans.columns if c != "doc_id"]
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("__cs"))
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))
    met = per_doc.join(docs.select("doc_id", pieces.alias("__ps")), "doc_id", "left")
    each = met.select("doc_id", "__ps", F.explode_outer("__cs").alias("__c"))
    start = F.when(F.col("__c.start_char") < 0, F.lit(0)).otherwise(F.col("__c.start_char")).cast("long")
    stop = F.greatest(F.col("__c.end_char"), start)
    first, last = F.floor(start / size), F.floor((F.greatest(stop, start + 1) - 1) / size)
    some = F.array_join(F.slice("__ps", (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    text = F.substring(some, (start - first * size + 1).cast("int"), (stop - start).cast("int"))
    cut = each.select("doc_id", *[F.col(f"__c.{c}").alias(c) for c in rest], F.coalesce(text, F.lit("")).alias(out))
    return cut.select(*spans.columns, out)


# --- validation --------------------------------------------------------------------------
def integrity_form(text: str) -> str:
    """Compatibility-normalised text with single blanks."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


def heads_found(heads: list[str], source: str, near: int = 4096) -> list[bool]:
    """Which heads occur in the source, in time linear in both.

    Heads in the order of the text are expected just behind their predecessor; all that are not there are
    looked up together by one automaton in one scan of the source.
    """
    import ahocorasick

    found, at, rest = [False] * len(heads), 0, {}
    for i, head in enumerate(heads):
        hit = source.find(head, at, at + near + len(head))
        if hit < 0:
            rest.setdefault(head, []).append(i)
        else:
            found[i], at = True, hit
    if rest:
        automaton = ahocorasick.Automaton()
        for head in rest:
            automaton.add_word(head, head)
        automaton.make_automaton()
        for _, head in automaton.iter(source):
            for i in rest.pop(head, ()):
                found[i] = True
            if not rest:
                break
    return found


_REPEALED = re.compile(K.REPEALED_PATTERN.replace("(?iU)", "(?i)"))  # Python's classes are Unicode by themselves


def may_be_repealed(text: str) -> bool:
    """False only where the pattern cannot match: plain look-ups in place of a scan (the dotless and the dotted i fold to i)."""
    low = text.lower()
    return "repeal" in low or "omit" in low or "deleted" in low or "\u0130" in text or "\u0131" in text


def _outcomes(text: str | None, cands: list[dict], source: str | None) -> list[str]:
    """The outcome of each candidate of one document."""
    out, heads = ["not_in_source"] * len(cands), {}
    maybe = text is not None and may_be_repealed(text)
    for i, c in enumerate(cands):
        if text is None or c["start_char"] is None or c["end_char"] is None:
            continue
        cut = text[c["start_char"] : max(c["end_char"], c["start_char"])].strip()
        gone = maybe and _REPEALED.search(cut) is not None
        if c["confidence"] is not None and c["confidence"] < K.REVIEW_THRESHOLD and not (gone or c["named"]):
            out[i] = "low_confidence"
        elif len(cut) < 10 and not gone:
            out[i] = "too_short"
        else:
            heads[i] = integrity_form(cut[:500])
    if heads and source is not None:
        order = sorted(heads, key=lambda i: cands[i]["start_char"])
        for i, found in zip(order, heads_found([heads[i] for i in order], integrity_form(source))):
            if found:
                out[i] = "accepted"
    return out


def validate(cands: DataFrame, docs: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """All candidates with an ``outcome``: accepted, low_confidence, too_short or not_in_source.

    ``source`` (doc_id, text) is the text to be held against, where it is not that of ``docs``; a document that
    it lacks has nothing in the source. Candidates travel to their document as short records (they are headings
    of that same text value, which bounds their number); its text is cut, normalised and scanned once.
    """
    named = F.coalesce(F.col("title").rlike(K.REPEALED_PATTERN), F.lit(False))
    brief = F.struct("start_char", "end_char", "confidence", named.alias("named"))
    per_doc = cands.groupBy("doc_id").agg(F.collect_list(F.struct(F.struct(*cands.columns).alias("c"), brief.alias("b"))).alias("cs"))
    d = docs.select("doc_id", "text").join(per_doc, "doc_id")
    if source is not None:
        d = d.join(source.select("doc_id", F.col("text").alias("__src")), "doc_id", "left")

    own = source is None

    @F.arrow_udf("array<string>")
    def judged(text: pa.Array, briefs: pa.Array, other: pa.Array) -> pa.Array:
        rows = ((t.as_py(), b.as_py(), o) for t, b, o in zip(text, briefs, other))
        return pa.array([_outcomes(t, b, t if own else o.as_py()) for t, b, o in rows], pa.list_(pa.string()))

    other = F.col("cs.b.named") if own else F.col("__src")  # the text itself is sent once
    told = d.select("cs", judged(F.col("text"), F.col("cs.b"), other).alias("os"))
    each = told.select(F.explode_outer(F.arrays_zip(F.col("cs.c").alias("c"), F.col("os").alias("o"))).alias("x"))
    return each.select(*[F.col(f"x.c.{n}").alias(n) for n in cands.columns], F.col("x.o").alias("outcome"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("outcome = 'accepted'").drop("outcome")


def validate_legacy(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Cleaned section texts; short repealed ones become stubs, other short ones go."""
    cut = slice_spans(sections, docs, "__cut").withColumn("__cut", strip(F.col("__cut")))
    short = F.length("__cut") < 20
    gone = F.col("__cut").rlike(K.REPEALED_PATTERN) | F.col("section_title").rlike(K.REPEALED_PATTERN)
    stub = F.concat(F.lit("[STATUS: REPEALED/OMITTED] "), filled(F.col("__cut"), F.col("section_title")))
    clean = F.regexp_replace(F.regexp_replace("__cut", r"\n{3,}", "\n\n"), r"(?U)\[\d+\]", "")
    text = F.when(short & gone, stub).when(~short, clean)
    return cut.select(*sections.columns, text.alias("text")).where("text is not null")


def validation_summary(validated: DataFrame) -> DataFrame:
    """Counts per document: candidates, accepted, reviewed, rejected."""
    conf = F.col("confidence")
    reviewed = (conf >= K.REVIEW_THRESHOLD) & (conf < K.ACCEPT_THRESHOLD)
    return validated.groupBy("doc_id").agg(
        F.count("*").alias("n_candidates"),
        F.count_if(F.col("outcome") == "accepted").alias("n_accepted"),
        F.count_if(reviewed).alias("n_reviewed"),
        F.count_if(F.col("outcome") != "accepted").alias("n_rejected"),
    )
