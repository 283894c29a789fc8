"""Trees over structural candidates, as tables.

Spark has no recursive types: a node carries ``parent_ix`` and, on request, the
path of its ancestors. The open ancestors of a node are the last node of each
rank that no later node of the same or a higher rank has closed, so nine
carried values per row replace a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.blocked import carry, dense_index
from lexloom.functions.text import filled, lookup, present, strip, tokens
from lexloom.operators.structure import chapter_for_page, cut_spans, page_range
from lexloom.session import checkpointed

RANKS = range(9)


def rank_of(node_type: Column) -> Column:
    return lookup(F.lower(node_type), K.NODE_RANK, K.DEFAULT_RANK)


def numbering_prefix(number: Column) -> Column:
    """``3(a)`` → 3, ``14.1`` → 14, else null."""
    m1 = F.regexp_extract(number, r"^(\d+[A-Z]?)\(", 1)
    m2 = F.regexp_extract(number, r"^(\d+)\.\d", 1)
    return F.coalesce(F.nullif(m1, F.lit("")), F.nullif(m2, F.lit("")))


def node_id(cands: DataFrame, source: str = "doc_id") -> DataFrame:
    """Add ``node_id``: source, type and number (or the per-type index), sanitised."""
    out = dense_index(cands, ["doc_id", "node_type"], "start_char", "__type_ix")
    label = filled(F.col("number"), F.col("__type_ix").cast("string"))
    raw = F.concat_ws("_", F.col(source).cast("string"), "node_type", label)
    return out.withColumn("node_id", F.regexp_replace(raw, r"(?U)[^\w\-]", "_")).drop("__type_ix")


def _parent(rank: Column, prefix: Column, hint: Column, open_nodes: Column) -> Column:
    by_prefix = F.filter(open_nodes, lambda a: a["number"] == prefix)
    by_rank = F.filter(open_nodes, lambda a: a["rank"] < rank)
    by_hint = F.filter(
        open_nodes,
        lambda a: F.coalesce(F.contains(F.upper(a["title"]), F.upper(hint)), F.lit(False))
        | F.coalesce(F.contains(F.upper(a["number"]), F.upper(hint)), F.lit(False)),
    )
    return F.coalesce(
        F.when(prefix.isNotNull(), F.array_max(by_prefix)),
        F.array_max(by_rank),
        F.when(F.nullif(hint, F.lit("")).isNotNull(), F.array_max(by_hint)),
    )


def build_hierarchy(cands: DataFrame) -> DataFrame:
    """Add node_ix (document order), rank, parent_ix and parent_id.

    A parent is the nearest open node whose number is the node's numbering
    prefix, else the nearest open node of a lower rank, else the nearest open
    node named by ``parent_hint``.
    """
    if "parent_hint" not in cands.columns:
        cands = cands.withColumn("parent_hint", F.lit(None).cast("string"))
    nodes = dense_index(node_id(cands), ["doc_id"], "start_char", "node_ix", ties=["node_type"])
    nodes = nodes.withColumn("node_ix", F.col("node_ix").cast("int")).withColumn("rank", rank_of(F.col("node_type")))
    entry = F.struct(
        F.col("node_ix").alias("ix"), F.col("rank").alias("rank"),
        F.col("number").alias("number"), F.col("title").alias("title"), F.col("node_id").alias("node_id"),
    )
    last = {f"__r{r}": F.when(F.col("rank") == r, entry) for r in RANKS}
    nodes = carry(nodes, ["doc_id"], "node_ix", last)
    still_open = []
    for r in RANKS:
        later = [F.col(f"__r{q}.ix") for q in range(r)]
        closed = F.coalesce(F.greatest(F.lit(-1), *later) > F.col(f"__r{r}.ix"), F.lit(False)) if later else F.lit(False)
        still_open.append(F.when(~closed, F.col(f"__r{r}")))
    nodes = nodes.withColumn("__open", present(F.array(*still_open)))
    nodes = nodes.withColumn(
        "__p", _parent(F.col("rank"), numbering_prefix(F.col("number")), F.col("parent_hint"), F.col("__open"))
    )
    nodes = nodes.withColumns({"parent_ix": F.col("__p.ix"), "parent_id": F.col("__p.node_id")})
    return nodes.drop("__open", "__p", *last)


def toc_titles(nodes: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapter-or-higher nodes take the contents label of their start page."""
    cols = nodes.columns
    out = chapter_for_page(nodes, toc, page="start_page")
    high = rank_of(F.col("node_type")) <= K.NODE_RANK["chapter"]
    return out.withColumn("title", F.when(high, F.coalesce("chapter", "title")).otherwise(F.col("title"))).select(*cols)


def tree_paths(nodes: DataFrame, levels: int = 16) -> DataFrame:
    """Add ``path``: the nodes from the root down to the node itself.

    Pointer doubling: each round joins a path to the path of its topmost node,
    so 16 levels take four equi-joins over narrow rows. The rounds reuse one
    table, which is checkpointed so that they never repeat what led to it. Ranks
    bound the depth below 11; chains of parent hints can be deeper, so rounds go
    on, each checkpointed, until no path has a node above it. ``levels`` is how
    deep paths may be before that is looked at.
    """
    nodes = checkpointed(nodes)
    label = filled(F.col("number"), F.coalesce("title", F.lit("")))
    step = F.struct(F.col("node_ix").alias("ix"), F.col("node_type").alias("node_type"), label.alias("label"))
    paths = nodes.select("doc_id", "node_ix", F.array(step).alias("path"), F.col("parent_ix").alias("up"))
    reach = 1
    while True:
        if reach >= levels:
            paths = checkpointed(paths)
            if paths.where("up IS NOT NULL").isEmpty():
                break
        above = paths.select(
            "doc_id", F.col("node_ix").alias("up"), F.col("path").alias("__above"), F.col("up").alias("__up")
        )
        paths = paths.join(above, ["doc_id", "up"], "left").select(
            "doc_id", "node_ix", F.concat(F.coalesce("__above", F.expr("slice(path, 1, 0)")), "path").alias("path"),
            F.col("__up").alias("up"),
        )
        reach *= 2
    return nodes.join(paths.select("doc_id", "node_ix", "path"), ["doc_id", "node_ix"])


def preorder(nodes: DataFrame, levels: int = 16) -> DataFrame:
    """Depth-first order key: the array of node_ix from the root down, plus the depth."""
    out = nodes if "path" in nodes.columns else tree_paths(nodes, levels)
    key = F.transform("path", lambda s: s["ix"])
    return out.withColumn("order_key", key).withColumn("depth", F.size("path") - 1)


def ancestors(nodes: DataFrame, levels: int = 16) -> DataFrame:
    """Add a map node type → number or title; the farthest ancestor of a type wins."""
    out = nodes if "path" in nodes.columns else tree_paths(nodes, levels)
    ups = F.filter(F.slice("path", 1, F.size("path") - 1), lambda s: s["label"] != "")
    kinds = F.transform(ups, lambda s: s["node_type"])
    firsts = F.filter(ups, lambda s, i: F.array_position(kinds, s["node_type"]) == i + 1)
    return out.withColumn(
        "ancestors", F.map_from_entries(F.transform(firsts, lambda s: F.struct(s["node_type"], s["label"])))
    )


def strip_marks(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{K.HEADING_END}|{K.HEADING_START}", ""))


def slice_text(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the verbatim slice and a copy without heading marks."""
    cols = nodes.columns
    n = nodes.withColumn("__end", F.col("end_char"))
    if "doc_size" in cols:
        end = F.when(F.col("end_char") > F.col("start_char"), F.least("end_char", "doc_size")).otherwise(F.col("doc_size"))
        n = n.withColumn("end_char", end)
    out = cut_spans(n, docs, "original_text").withColumn("end_char", F.col("__end"))
    return out.select(*cols, "original_text", strip_marks(F.col("original_text")).alias("text"))


def section_docs(sections: DataFrame, offsets: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Legacy section records with provision, chapter, pages and token estimate."""
    out = page_range(sections, offsets)
    if toc is not None:
        out = chapter_for_page(out, toc, page="start_page").withColumn("__toc", F.col("chapter"))
    else:
        out = out.withColumn("__toc", F.lit(None).cast("string"))
    return out.select(
        "doc_id", "section_number", "section_title",
        F.concat(F.lit("Section "), "section_number").alias("provision_ref"),
        F.coalesce("__toc", F.nullif(F.col("chapter_ref"), F.lit("")), F.lit("N/A")).alias("chapter"),
        "start_page", "end_page", F.size(tokens(F.col("text"))).alias("token_estimate"), "text",
    )


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("parent_ix").isNull()).alias("n_roots"),
        F.max("rank").alias("deepest_rank"),
    )
