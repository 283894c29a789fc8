"""Formulation audits: sub-queries, context, verdict parsing, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.text import filled, strip


def audit_category(classification: Column) -> Column:
    low = F.lower(classification)
    return (
        F.when(low.contains("classical") | low.contains("asu"), "classical")
        .when(low.contains("ayurveda aahar") | low.contains("food"), "ayurveda-aahar")
        .otherwise("proprietary")
    )


def audit_queries(requests: DataFrame) -> DataFrame:
    """Three sub-queries per request (query_id, abstract, classification, synergy, ingredients_text)."""
    ing, syn = F.coalesce("ingredients_text", F.lit("")), F.coalesce("synergy", F.lit(""))

    def sub(area: str, text: Column) -> Column:
        return F.struct(F.lit(area).alias("legal_area"), text.alias("query_text"))

    subs = F.array(
        sub("patent", F.concat(F.lit(K.AUDIT_PATENT), F.substring("abstract", 1, 150))),
        sub("abs", F.concat(F.lit(K.AUDIT_ABS), ing)),
        sub("drug_regulation", F.concat(F.lit(K.AUDIT_REGULATION), "classification")),
    )
    d = requests.withColumn("query", F.concat_ws(" ", "abstract", ing, syn))
    d = d.withColumn("rerank_category", audit_category(F.col("classification")))
    # Retrieval itself is not limited to a category; only the reranker knows it.
    return d.select("*", F.posexplode_outer(subs).alias("area_ix", "s")).select(
        *d.columns, "area_ix", "s.legal_area", "s.query_text",
        F.lit("india").alias("jurisdiction"), F.lit(None).cast("string").alias("product_category"),
    )


def audit_context(ranked: DataFrame, cap: int = 6, preview: int = 400) -> DataFrame:
    """Context text and sources: first appearance of each chunk in pack order, at most ``cap``."""
    rest = ["provision", "title", "text", "chapter", "pages"]
    first = ranked.groupBy("query_id", "chunk_id").agg(
        F.min_by(F.struct(*rest), F.struct("area_ix", "position")).alias("r"),
        F.min(F.struct("area_ix", "position")).alias("at"),
    )
    w = Window.partitionBy("query_id").orderBy("at")
    top = first.withColumn("no", F.row_number().over(w)).where(F.col("no") <= cap)
    text = F.col("r.text")
    short = F.concat(F.substring(text, 1, preview), F.when(F.length(text) > preview, "...").otherwise(""))
    block = F.concat(F.lit("["), "r.provision", F.lit(" - "), "r.title", F.lit("]\n"), short)
    src = F.struct(
        "no", F.col("chunk_id").alias("id"), F.col("r.provision").alias("provision"), F.col("r.title").alias("title"),
        F.col("r.chapter").alias("chapter"), F.col("r.pages").alias("pages"), block.alias("block"),
    )
    d = top.groupBy("query_id").agg(F.array_sort(F.collect_list(src)).alias("s"))
    return d.select(
        "query_id", F.array_join(F.transform("s", lambda x: x["block"]), "\n\n---\n\n").alias("context"),
        F.transform("s", lambda x: x["id"]).alias("source_ids"),
    )


FIELDS = ["verdict", "tkdl_band", "s3e_band", "nba_band", "analysis"]


def parse_verdict(raw: Column) -> Column:
    """struct(verdict, bands, analysis) from a model reply; a floor when it has no usable JSON."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    typed = F.try_variant_get(parsed, "$", "map<string,variant>")
    usable = F.coalesce(F.map_contains_key(typed, "verdict"), F.lit(False))

    def field(name: str, default: Column) -> Column:
        value = F.try_variant_get(parsed, f"$.{name}", "string")
        return F.when(usable, F.when(F.map_contains_key(typed, name), F.coalesce(value, F.lit("None"))).otherwise(default))

    band, floor = F.lit(K.BAND_DEFAULT), F.lit(K.BAND_FLOOR)
    return F.struct(
        F.coalesce(field("verdict", F.lit(K.VERDICT_DEFAULT)), F.lit(K.VERDICT_FLOOR)).alias("verdict"),
        *[F.coalesce(field(b, band), floor).alias(b) for b in ("tkdl_band", "s3e_band", "nba_band")],
        F.coalesce(field("analysis", raw), filled(raw, K.ANALYSIS_FLOOR)).alias("analysis"),
    )


def audit_report(df: DataFrame) -> DataFrame:
    """Add ``report``: verdict, three bands and the analysis as one text."""
    return df.withColumn(
        "report",
        F.concat(
            F.lit("**Formulation Audit — "), "verdict", F.lit("** 🇮🇳 India Domestic Analysis\n\n"),
            F.lit("**Section 3(p) / TKDL Bar:** "), "tkdl_band", F.lit("\n\n**Section 3(e) / Synergy:** "), "s3e_band",
            F.lit("\n\n**NBA Form III / Section 6:** "), "nba_band", F.lit("\n\n"), "analysis",
        ),
    )
