"""Ranking signals as native column expressions.

``q_low`` is the lower-cased effective question; context columns may be null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.text import any_of, contains_any, lookup, present, round4, strip


def weights(preset: str = "backend", **override: float) -> dict[str, float]:
    """Six weights; scaled to one when their sum is off by more than 0.01."""
    w = {**K.WEIGHTS[preset], **override}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if abs(total - 1.0) > 0.01 else w


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def s_relevance(score: Column, preset: str = "backend") -> Column:
    """Raw similarity, stretched by a sigmoid (backend) or clipped (ingestion)."""
    if preset == "ingestion":
        return clip01(score.cast("double"))
    return round4(clip01(1.0 / (1.0 + F.exp(-K.SIGMOID_STEEPNESS * (score.cast("double") - K.SIGMOID_CENTER)))))


def s_freshness(status: Column, effective_from: Column | None = None, as_of: Column | None = None) -> Column:
    base = lookup(F.lower(strip(F.coalesce(status, F.lit("")))), K.STATUS_SCORE, K.STATUS_DEFAULT)
    if effective_from is None:
        return round4(base)
    as_of = as_of if as_of is not None else F.current_timestamp()
    raw = effective_from.cast("string")
    begun = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(raw))
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(begun)
    years = F.floor(seconds / 86400) / 365.25
    nudge = F.greatest(F.lit(0.0), 1.0 - F.least(years, F.lit(30.0)) / 60)
    lifted = F.least(F.lit(1.0), base * 0.85 + nudge * 0.15)
    return round4(F.when((base >= 0.9) & begun.isNotNull(), lifted).otherwise(base))


def s_authority(level: Column, document_type: Column) -> Column:
    digits = F.regexp_replace(level.cast("string"), "[^0-9]", "")
    number = F.nullif(digits, F.lit("")).try_cast("double")
    by_type = lookup(F.lower(strip(F.coalesce(document_type, F.lit("")))), K.DOCTYPE_SCORE, K.DOCTYPE_DEFAULT)
    # least and greatest skip nulls, so a missing level is decided before clipping
    return F.when(number.isNotNull(), clip01(1.0 - number / K.AUTHORITY_MAX)).otherwise(by_type)


def s_jurisdiction(q_low: Column, doc: Column, target: Column, preset: str = "backend") -> Column:
    doc = F.lower(F.coalesce(doc, F.lit("")))
    target = F.lower(F.nullif(target, F.lit("")))
    central = doc.isin(*K.CENTRAL_JURISDICTIONS)
    base = F.when((doc == "") | central, 0.8).otherwise(0.3)
    with_target = (
        F.when(doc == target, 1.0)
        .when((target == "india") & central, 1.0)
        .when((target == "international") & ~central, 1.0)
        .when(~central, 0.15)
        .otherwise(base)
    )
    words = {**K.JURISDICTION_KEYWORDS, **(K.STATE_KEYWORDS if preset == "ingestion" else {})}
    named = F.lit(False)
    for name, keys in words.items():
        named = named | ((doc == name) & contains_any(q_low, keys))
    named = named | (~doc.isin(*words) & F.contains(q_low, doc))
    return F.when(target.isNotNull(), with_target).otherwise(F.when(named, 1.0).otherwise(base))


def keyword_areas(q_low: Column) -> Column:
    """Areas whose keywords occur in the question."""
    return present(F.array(*[F.when(contains_any(q_low, words), F.lit(a)) for a, words in K.AREA_KEYWORDS.items()]))


def infer_areas(category: Column) -> Column:
    """Areas implied by a product category; null when none."""
    norm = F.regexp_replace(F.lower(category), "[- ]", "_")
    return lookup(norm, K.CATEGORY_INFERRED_AREAS, F.lit(None).cast("array<string>"))


def s_applicability(
    q_areas: Column, doc_area: Column, ctx_areas: Column, category: Column | None = None, product: Column | None = None
) -> Column:
    """``q_areas``: :func:`keyword_areas` of the question, used without context areas."""
    area = F.lower(F.coalesce(doc_area, F.lit("")))

    def match(areas: Column, empty: float) -> Column:
        return (
            F.when(F.size(areas) == 0, empty)
            .when(F.array_contains(areas, area), 1.0)
            .when(F.exists(areas, lambda a: F.contains(area, a) | F.contains(a, area)), 0.8)
            .otherwise(0.2)
        )

    given = F.coalesce(F.size(ctx_areas), F.lit(0)) > 0
    base = F.when(given, match(F.transform(ctx_areas, F.lower), 0.2)).otherwise(match(q_areas, 0.5))
    if category is not None and product is not None:
        tokens = F.transform(
            F.split(F.regexp_replace(F.lower(strip(F.coalesce(product, F.lit("all")))), ";", ","), ","),
            lambda t: F.replace(strip(t), F.lit("-"), F.lit("_")),
        )
        norm = F.regexp_replace(F.lower(category), "[- ]", "_")
        neutral = F.coalesce(category, F.lit("")) == ""
        base = (
            F.when(neutral | F.array_contains(tokens, "all"), base)
            .when(F.array_contains(tokens, norm), F.least(F.lit(1.0), base + 0.10))
            .otherwise(F.greatest(F.lit(0.0), base - 0.10))
        )
    return round4(base)


def extract_citations(query: Column) -> Column:
    """Locators such as 3(p) that the question names."""
    return F.regexp_extract_all(query, F.lit(K.LOCATOR_PATTERN), F.lit(1))


def locator_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[^\w()]", "")


def s_citation(locators: Column, section: Column) -> Column:
    own = locator_form(F.coalesce(section.cast("string"), F.lit("")))
    norms = F.filter(F.transform(locators, locator_form), lambda x: x != "")
    hit = F.exists(norms, lambda n: F.contains(own, n) | F.contains(n, own))
    return F.when((own != "") & hit, 1.0).otherwise(0.0)


def named_instruments(q_low: Column) -> Column:
    return present(F.array(*[F.when(F.contains(q_low, F.lit(n)), F.lit(n)) for n in K.INSTRUMENTS]))


def s_instrument(named: Column, title: Column, document: Column) -> Column:
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(document, F.lit(""))))
    hit = any_of(
        [F.array_contains(named, name) & contains_any(low, aliases) for name, aliases in K.INSTRUMENTS.items()]
    )
    return F.when(hit, 1.0).otherwise(0.0)


def composite(w: dict[str, float], relevance: Column, has_ctx_area: Column, preset: str = "backend") -> Column:
    """Weighted sum with hard boosts and, in the backend preset, the area penalty."""
    base = (
        w["relevance"] * relevance + w["freshness"] * F.col("s_freshness") + w["authority"] * F.col("s_authority")
        + w["jurisdiction"] * F.col("s_jurisdiction") + w["applicability"] * F.col("s_applicability")
        + w["citation"] * F.col("s_citation")
    )
    lifted = (
        F.when(F.col("s_citation") >= 0.99, F.least(F.lit(1.0), base + K.CITATION_BOOST))
        .when(F.col("s_instrument") >= 0.99, F.least(F.lit(1.0), base + K.INSTRUMENT_BOOST))
        .otherwise(base)
    )
    if preset != "backend":
        return lifted
    return F.when((F.col("s_applicability") <= 0.2) & has_ctx_area, lifted * K.MISMATCH_FACTOR).otherwise(lifted)


def explanation() -> Column:
    """Reasons of a rank, joined by "; "."""
    r = K.REASONS
    text = F.concat_ws(
        "; ",
        F.when(F.col("s_citation") >= 0.99, r["citation"]),
        F.when(F.col("s_instrument") >= 0.99, r["instrument"]),
        F.when(round4(F.col("s_authority")) >= 0.9, r["authority_high"]).when(
            round4(F.col("s_authority")) <= 0.3, r["authority_low"]
        ),
        F.when(F.col("s_freshness") <= 0.2, r["freshness"]),
        F.when(F.col("s_jurisdiction") <= 0.2, r["jurisdiction"]),
        F.when(F.col("s_applicability") <= 0.3, r["applicability"]),
    )
    return F.when(text == "", r["default"]).otherwise(text)
