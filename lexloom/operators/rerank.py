"""Reranking: all signals in one projection, one window per (query, area)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions import signals as S
from lexloom.functions.text import lookup, strip
from lexloom.operators.containment import greedy_by_containment

PACK = ["query_id", "area_ix"]


def question_values(df: DataFrame) -> DataFrame:
    """Add what the rules read from ``effective_query``: once per question where a plan adds it before its candidates are joined."""
    low = F.lower("effective_query")
    return df.withColumns(
        {"__loc": S.extract_citations(F.col("effective_query")), "__ins": S.named_instruments(low), "__kw": S.keyword_areas(low)}
    )


def score(df: DataFrame, preset: str = "backend", as_of: Column | None = None, **override: float) -> DataFrame:
    """Add the signals, ``composite`` and ``explanation``.

    Reads effective_query, raw_score, section, source_title, document_id,
    jurisdiction, authority, document_type, legal_area, status; optionally
    effective_from, applicable_product; context: ctx_jurisdiction, ctx_areas,
    ctx_category. Values of ``question_values`` are read where they are there.
    """
    have = set(df.columns)

    def opt(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    # Question-side values first, so the per-candidate rules reuse them.
    d = df if {"__loc", "__ins", "__kw"} <= have else question_values(df)
    d = d.withColumn("__q", F.lower("effective_query"))
    given = F.coalesce(F.size(opt("ctx_areas", "array<string>")), F.lit(0)) > 0
    areas = F.when(given, opt("ctx_areas", "array<string>")).otherwise(
        F.when(F.coalesce(opt("ctx_category"), F.lit("")) != "", S.infer_areas(opt("ctx_category")))
    )
    d = d.withColumns({"__areas": areas, "__given": given})
    d = d.withColumns(
        {
            "s_relevance": S.s_relevance(F.col("raw_score"), preset),
            "s_freshness": S.s_freshness(
                F.col("status"), F.col("effective_from") if "effective_from" in have else None, as_of
            ),
            "s_authority": S.s_authority(F.col("authority"), F.col("document_type")),
            "s_jurisdiction": S.s_jurisdiction(F.col("__q"), F.col("jurisdiction"), opt("ctx_jurisdiction"), preset),
            "s_applicability": S.s_applicability(
                F.col("__kw"), F.col("legal_area"), F.col("__areas"),
                *( (opt("ctx_category"), opt("applicable_product")) if preset == "backend" else () ),
            ),
            "s_citation": S.s_citation(F.col("__loc"), F.col("section")),
            "s_instrument": S.s_instrument(F.col("__ins"), F.col("source_title"), opt("document_id")),
        }
    )
    w = S.weights(preset, **override)
    d = d.withColumn("composite", S.composite(w, F.col("s_relevance"), F.col("__given"), preset))
    return d.withColumn("explanation", S.explanation()).drop("__q", "__loc", "__ins", "__kw", "__areas", "__given")


def ranked(df: DataFrame, keys: list[str] = PACK, by: str = "composite", tie: str = "input_pos") -> DataFrame:
    """Add ``position``: score descending, input position on ties (a stable sort)."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie))
    return df.withColumn("position", F.row_number().over(w))


def dedup_near(scored: DataFrame, preset: str = "backend", keys: list[str] = PACK, small: bool = False) -> DataFrame:
    """Drop near-duplicates in rank order within a pack.

    backend: repeated chunk, blank text, equal text, or (beyond 80 characters)
    a text containing or contained in one kept before. Packs of any size find
    containing texts by shared grams (``containment``). ``small`` says that packs
    are top-k results: each is folded in order as one array, comparing all its
    texts. ingestion: first per (document, section).
    """
    if preset == "ingestion":
        d = scored.withColumn("__sec", F.coalesce("section", F.lit("")))
        group = [*keys, "document_id", "__sec"]
        first = d.groupBy(*group).agg(F.min("position").alias("__first"))
        out = d.join(first, group, "left")
        return out.where(F.col("document_id").isNull() | (F.col("position") == F.col("__first"))).drop("__first", "__sec")
    if not small:
        kept = greedy_by_containment(scored, keys, F.col("text"), F.col("chunk_id"))
        return kept.select(*keys, "position", *[c for c in scored.columns if c not in (*keys, "position")])
    rest = [c for c in scored.columns if c not in (*keys, "position")]
    low = scored.select(
        *keys, F.struct("position", strip(F.lower(F.coalesce("text", F.lit("")))).alias("low"),
                        F.struct(*rest).alias("row")).alias("c")
    )
    packs = low.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    empty = F.filter("cs", lambda c: F.lit(False))

    def known(kept, c):
        return F.exists(
            kept,
            lambda k: (k["low"] == c["low"])
            | ((F.coalesce(c["row"]["chunk_id"], F.lit("")) != "") & (k["row"]["chunk_id"] == c["row"]["chunk_id"]))
            | ((F.length(c["low"]) > 80) & (F.contains(k["low"], c["low"]) | F.contains(c["low"], k["low"]))),
        )

    kept = F.aggregate(
        "cs", empty,
        lambda acc, c: F.when((c["low"] == "") | F.coalesce(known(acc, c), F.lit(False)), acc).otherwise(
            F.concat(acc, F.array(c))
        ),
    )
    # Outer: an inferred non-empty filter would fold every pack twice.
    return packs.select(*keys, F.explode_outer(kept).alias("c")).where("c is not null").select(*keys, "c.position", "c.row.*")


def pack_inputs(packs: DataFrame, sub_queries: DataFrame, ctx: DataFrame | None = None,
                normalise_areas: bool = False) -> DataFrame:
    """Candidates joined with their sub-query, as the reranker sees them.

    ``packs``: query_id, area_ix, chunk fields and vector_score, plus rank as
    input position. ``sub_queries``: query_id, area_ix, legal_area, query_text,
    query, jurisdiction, product_category. A score of 0 or none counts as 0.5.
    The chunk's own area decides, the sub-query's only when it has none.
    """
    sq = sub_queries.select(
        "query_id", "area_ix", F.col("legal_area").alias("sub_area"), F.col("query_text").alias("sub_text"),
        "query", F.col("jurisdiction").alias("ctx_jurisdiction"), F.col("product_category").alias("ctx_category"),
    )
    has_text = F.coalesce("sub_text", F.lit("")) != ""
    asked = F.when(has_text, F.concat("query", F.lit(" - "), "sub_text")).otherwise(F.col("query"))
    d = packs.drop("effective_query").join(question_values(sq.withColumn("effective_query", asked)), PACK)
    if ctx is not None:
        d = d.drop("ctx_jurisdiction", "ctx_category").join(ctx, "query_id", "left")
    area = F.coalesce(F.nullif("legal_area", F.lit("")), "sub_area")
    if normalise_areas:
        area = lookup(area, K.AREA_ALIGNMENT, area)
    return d.withColumns(
        {
            "raw_score": F.coalesce(F.nullif("vector_score", F.lit(0.0)), F.lit(0.5)),
            "section": F.col("provision"),
            "source_title": F.col("title"),
            "document_id": F.col("title"),
            "authority": F.coalesce(F.col("authority_level").cast("string"), F.col("source_authority")),
            "legal_area": area,
            "status": F.lit("active"),
            "ctx_areas": F.array("sub_area"),
            "input_pos": F.col("rank"),
        }
    )


_DONE = ["relevance_score", "authority_score", "jurisdiction_score", "freshness_score", "applicability_score"]


def _evidence(d: DataFrame) -> DataFrame:
    names = {f"{s}_score": F.bround(f"s_{s}", 4) for s in
             ("relevance", "authority", "jurisdiction", "freshness", "applicability")}
    return d.withColumns(names).withColumn("final_score", F.col("composite"))


def rerank(packs: DataFrame, sub_queries: DataFrame, ctx: DataFrame | None = None, as_of: Column | None = None,
           normalise_areas: bool = False, dedup: bool = True, small: bool = False) -> DataFrame:
    """Ranked evidence of every pack; ``small``: packs are top-k results (``dedup_near``)."""
    d = score(pack_inputs(packs, sub_queries, ctx, normalise_areas), "backend", as_of)
    d = ranked(d)
    if dedup:
        d = dedup_near(d, small=small)
    return _evidence(d)


def rerank_pack(query: str, chunks: DataFrame, area: str | None = None, jurisdiction: str | None = None) -> DataFrame:
    """One question over a set of candidates; the given area is stamped on all of them."""
    d = chunks.withColumns(
        {
            "query_id": F.lit(0), "area_ix": F.lit(0), "effective_query": F.lit(query),
            "raw_score": F.coalesce(F.nullif("vector_score", F.lit(0.0)), F.lit(0.5)),
            "section": F.col("provision"), "source_title": F.col("title"), "document_id": F.col("title"),
            "authority": F.coalesce(F.col("authority_level").cast("string"), F.col("source_authority"), F.lit("Act")),
            "legal_area": F.lit(area or "").cast("string"), "status": F.lit("active"),
            "ctx_areas": F.array(F.lit(area)) if area else F.lit(None).cast("array<string>"),
            "ctx_jurisdiction": F.lit(jurisdiction).cast("string"),
        }
    )
    if "input_pos" not in d.columns:
        d = d.withColumn("input_pos", F.col("rank") if "rank" in d.columns else F.col("chunk_id"))
    return _evidence(ranked(score(d, "backend")))


def neural_blend(
    scored: DataFrame,
    scorer: Callable[[Column, Column], Column] | None = None,
    top: int = K.NEURAL_TOP,
    preset: str = "backend",
) -> DataFrame:
    """Blend a pair model into the best ``top`` candidates of each pack and rank again.

    ``scorer`` is a pandas UDF (question, text) → logit; without it a ``logit``
    column is used. Only the pruned candidates reach the scorer.
    """
    head = scored.where(F.col("position") <= top)
    tail = scored.where(F.col("position") > top)
    if scorer is not None:
        head = head.withColumn("logit", scorer(F.col("effective_query"), F.col("text")))
    neural = 1.0 / (1.0 + F.exp(-F.col("logit").cast("double")))
    head = head.withColumn("neural_score", F.bround(neural, 4))
    blended = K.NEURAL_SHARE * neural + (1 - K.NEURAL_SHARE) * F.bround("s_relevance", 4)
    head = head.withColumn("__b", blended).withColumn("s_authority", F.bround("s_authority", 4))
    given = F.coalesce(F.size("ctx_areas"), F.lit(0)) > 0
    head = head.withColumn("composite", S.composite(S.weights(preset), F.col("__b"), given, preset))
    head = head.withColumn("s_relevance", F.bround("__b", 4)).drop("__b")
    head = head.withColumn("explanation", S.explanation())
    every = head.unionByName(tail, allowMissingColumns=True)
    again = ranked(every.withColumn("input_pos", F.col("position")).drop("position"))
    return dedup_near(again)
