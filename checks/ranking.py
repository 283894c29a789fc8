"""Signals, reranking, evidence and guardrails."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import any_of, case_map, duck, duck_strip, fx
from lexloom.functions import constants as K
from lexloom.functions import signals as S
from lexloom.functions.rules import admission_check
from lexloom.operators import evidence as E
from lexloom.operators import rerank as R
from lexloom.operators.retrieval import context_blocks

Q: dict = {}
AS_OF = "2025-01-01"
SUB_AREA = "CASE (query_id + area_ix) % 6 WHEN 0 THEN 'patent' WHEN 1 THEN 'abs' WHEN 2 THEN 'tk_prior_art' WHEN 3 THEN 'drug_regulation' WHEN 4 THEN 'trademark' ELSE 'gi' END"


def pairs(s, d):
    """Candidate, chunk and question in one row; one row per pair."""
    p = fx(s, d, "fx_pairs").drop("doc_id")
    q = fx(s, d, "fx_queries").selectExpr("query_id", "query", "jurisdiction AS ctx_jurisdiction", "category AS ctx_category")
    p = p.join(q, "query_id").join(fx(s, d, "fx_chunks"), "chunk_id")
    return p.selectExpr(
        "*", f"{SUB_AREA} AS sub_area", "query AS effective_query", "vector_score AS raw_score",
        "CAST(authority_level AS STRING) AS authority", "source_title AS document_id", "doc_id AS input_pos",
        f"CASE WHEN query_id % 5 = 4 THEN NULL ELSE array({SUB_AREA}) END AS ctx_areas",
    )


def scored(s, d, preset="backend"):
    return R.score(pairs(s, d), preset, F.lit(AS_OF).cast("timestamp"))


# --- the same in SQL ---------------------------------------------------------------------
_AREAS = "[" + ", ".join(f"CASE WHEN {any_of('q', w)} THEN '{a}' END" for a, w in K.AREA_KEYWORDS.items()) + "]"
_INFER = "CASE replace(lower(ctx_category), '-', '_') " + " ".join(f"WHEN '{c}' THEN {a!r}" for c, a in K.CATEGORY_INFERRED_AREAS.items()) + " END"
_INS = "(" + " OR ".join(f"(contains(q, '{n}') AND {any_of('low_title', al)})" for n, al in K.INSTRUMENTS.items()) + ")"
_JUR = " ".join(f"WHEN jurisdiction = '{j}' AND {any_of('q', w)} THEN 1.0::DOUBLE" for j, w in K.JURISDICTION_KEYWORDS.items())


def _signals(preset: str) -> str:
    ing = preset == "ingestion"
    w = K.WEIGHTS[preset]
    relevance = "least(greatest(vector_score, 0), 1)" if ing else "round(1 / (1 + exp(-16 * (vector_score - 0.55))), 4)"
    product = "base" if ing else (
        "CASE WHEN list_contains(toks, 'all') THEN base WHEN list_contains(toks, replace(ctx_category, '-', '_')) THEN least(1.0, base + 0.1::DOUBLE) ELSE greatest(0.0, base - 0.1::DOUBLE) END"
    )
    penalty = "lifted" if ing else "CASE WHEN s_applicability <= 0.2 AND given THEN lifted * 0.35::DOUBLE ELSE lifted END"
    return f"""
, base0 AS (SELECT p.query_id, p.area_ix, p.vector_score, q.query, lower(q.query) AS q, q.jurisdiction AS ctx_j, q.category AS ctx_category, c.*,
   {SUB_AREA.replace('query_id', 'p.query_id')} AS sub_area FROM fx_pairs p JOIN fx_queries q USING (query_id) JOIN fx_chunks c ON c.chunk_id = p.chunk_id),
base1 AS (SELECT *, query_id % 5 <> 4 AS given, CASE WHEN query_id % 5 = 4 THEN {_INFER} ELSE [sub_area] END AS areas,
   list_filter({_AREAS}, lambda x: x IS NOT NULL) AS kw, lower(concat(source_title, ' ', source_title)) AS low_title,
   list_transform(string_split(replace(applicable_product, ';', ','), ','), lambda t: replace(trim(t), '-', '_')) AS toks,
   list_transform(regexp_extract_all(query, '(?i)\\b(?:section|sec\\.?|s\\.|rule|article|art\\.?)\\s*(\\d+[a-zA-Z]?(?:\\([\\w]+\\))*)', 1), lambda x: regexp_replace(lower(x), '[^\\w()]', '', 'g')) AS locs,
   {case_map('status', K.STATUS_SCORE, '0.5')}::DOUBLE AS st, date_diff('day', effective_from, DATE '{AS_OF}') / 365.25::DOUBLE AS years FROM base0),
base2 AS (SELECT *, coalesce(areas, kw) AS used,
   CASE WHEN coalesce(len(areas), 0) = 0 AND len(kw) = 0 THEN 0.5::DOUBLE WHEN list_contains(coalesce(areas, kw), legal_area) THEN 1.0::DOUBLE
     WHEN len(list_filter(coalesce(areas, kw), lambda a: contains(legal_area, a) OR contains(a, legal_area))) > 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS base FROM base1),
sig AS (SELECT *, {relevance} AS s_relevance,
   round(CASE WHEN st >= 0.9 THEN least(1.0::DOUBLE, st * 0.85::DOUBLE + greatest(0.0::DOUBLE, 1.0 - least(years, 30.0::DOUBLE) / 60) * 0.15::DOUBLE) ELSE st END, 4) AS s_freshness,
   coalesce(CASE WHEN authority_level IS NOT NULL THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - authority_level / 7) END, {case_map('document_type', K.DOCTYPE_SCORE, '0.1')}::DOUBLE) AS s_authority,
   CASE WHEN ctx_j IS NULL THEN CASE {_JUR} WHEN jurisdiction = 'india' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END
     WHEN ctx_j = jurisdiction THEN 1.0::DOUBLE WHEN jurisdiction <> 'india' THEN 0.15::DOUBLE ELSE 0.8::DOUBLE END AS s_jurisdiction,
   round({product}, 4) AS s_applicability,
   CASE WHEN len(list_filter(locs, lambda n: contains(section, n) OR contains(n, section))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_citation,
   CASE WHEN {_INS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_instrument FROM base2),
mix AS (SELECT *, {w['relevance']}::DOUBLE * s_relevance + {w['freshness']}::DOUBLE * s_freshness + {w['authority']}::DOUBLE * s_authority
   + {w['jurisdiction']}::DOUBLE * s_jurisdiction + {w['applicability']}::DOUBLE * s_applicability + {w['citation']}::DOUBLE * s_citation AS b FROM sig),
lift AS (SELECT *, CASE WHEN s_citation >= 0.99 THEN least(1.0, b + 0.25::DOUBLE) WHEN s_instrument >= 0.99 THEN least(1.0, b + 0.1::DOUBLE) ELSE b END AS lifted FROM mix),
scored AS (SELECT *, {penalty} AS composite FROM lift)"""


FX = ("fx_pairs", "fx_queries", "fx_chunks")
SIGS = ["s_relevance", "s_freshness", "s_authority", "s_jurisdiction", "s_applicability", "s_citation", "s_instrument"]


def _show(df):
    return df.select("query_id", "area_ix", "chunk_id", *[F.round(c, 4).alias(c) for c in [*SIGS, "composite"]])


_SHOW = " SELECT query_id, area_ix, chunk_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in [*SIGS, "composite"]) + " FROM scored"
Q["signals"] = (lambda s, d: _show(scored(s, d)), duck(*FX) + _signals("backend") + _SHOW)
# six digits: this preset's weights give exact ties in the fifth
Q["signals_ingestion_preset"] = (
    lambda s, d: scored(s, d, "ingestion").select("query_id", "area_ix", "chunk_id", F.round("composite", 6).alias("composite")),
    duck(*FX) + _signals("ingestion") + " SELECT query_id, area_ix, chunk_id, round(composite, 6) AS composite FROM scored",
)
Q["explain"] = (
    lambda s, d: scored(s, d).groupBy("explanation").agg(F.count("*").alias("n")),
    duck(*FX) + _signals("backend") + """, ex AS (SELECT concat_ws('; ', CASE WHEN s_citation >= 0.99 THEN 'exact section/rule citation match' END,
  CASE WHEN s_instrument >= 0.99 THEN 'named instrument match' END,
  CASE WHEN round(s_authority, 4) >= 0.9 THEN 'primary legislation/treaty authority' WHEN round(s_authority, 4) <= 0.3 THEN 'low source authority' END,
  CASE WHEN s_freshness <= 0.2 THEN 'superseded/repealed — historical context only' END, CASE WHEN s_jurisdiction <= 0.2 THEN 'jurisdiction mismatch' END,
  CASE WHEN s_applicability <= 0.3 THEN 'legal area likely mismatched' END) AS e FROM scored)
SELECT CASE WHEN e = '' THEN 'moderate relevance across all signals' ELSE e END AS explanation, count(*) AS n FROM ex GROUP BY 1""",
)
Q["extract_citations"] = (
    lambda s, d: fx(s, d, "fx_queries").select("query_id", F.array_join(S.extract_citations(F.col("query")), "|").alias("locators")),
    duck("fx_queries") + " SELECT query_id, array_to_string(regexp_extract_all(query, '(?i)\\b(?:section|sec\\.?|s\\.|rule|article|art\\.?)\\s*(\\d+[a-zA-Z]?(?:\\([\\w]+\\))*)', 1), '|') AS locators FROM fx_queries",
)
Q["infer_areas"] = (
    lambda s, d: fx(s, d, "fx_queries").select("query_id", F.array_join(S.infer_areas(F.col("category")), "|").alias("areas")),
    duck("fx_queries") + f" SELECT query_id, array_to_string({_INFER.replace('ctx_category', 'category')}, '|') AS areas FROM fx_queries",
)

# --- reranked packs ----------------------------------------------------------------------


def subs(s, d):
    q = fx(s, d, "fx_queries")
    both = q.withColumn("area_ix", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.selectExpr(
        "query_id", "area_ix", f"{SUB_AREA} AS legal_area", f"concat(query, ' about ', {SUB_AREA}) AS query_text", "query",
        "coalesce(jurisdiction, 'india') AS jurisdiction", "category AS product_category",
    )


def packs(s, d):
    """All candidates of every sub-query, by score."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "area_ix").orderBy(F.col("vector_score").desc(), F.col("doc_id"))
    p = fx(s, d, "fx_pairs").withColumn("rank", F.row_number().over(w)).drop("doc_id")
    return p.join(fx(s, d, "fx_chunks"), "chunk_id").selectExpr(
        "query_id", "area_ix", "rank", "chunk_id", "vector_score", "section AS provision", "source_title AS title", "'N/A' AS chapter",
        "concat(doc_id % 9, ' to ', doc_id % 9 + 1) AS pages", "source_title AS source_authority", "authority_level", "document_type",
        "jurisdiction", "CASE WHEN doc_id % 8 = 0 THEN '' ELSE legal_area END AS legal_area", "text",
    )


def reranked(s, d, dedup=True):
    return R.rerank(packs(s, d), subs(s, d), dedup=dedup)


_RANKED_SQL = duck(*FX) + f"""
, top AS (SELECT *, row_number() OVER (PARTITION BY query_id, area_ix ORDER BY vector_score DESC, doc_id) AS rank FROM fx_pairs),
r0 AS (SELECT t.query_id, t.area_ix, t.rank, t.vector_score, c.chunk_id, c.section, c.source_title AS title, c.authority_level, c.document_type, c.jurisdiction, c.doc_id, c.text,
  coalesce(nullif(CASE WHEN c.doc_id % 8 = 0 THEN '' ELSE c.legal_area END, ''), {SUB_AREA.replace('query_id', 't.query_id')}) AS area,
  CASE WHEN c.doc_id % 8 = 0 THEN '' ELSE c.legal_area END AS own_area,
  {SUB_AREA.replace('query_id', 't.query_id')} AS sub_area, q.category, coalesce(q.jurisdiction, 'india') AS ctx_j,
  lower(concat(q.query, ' - ', q.query, ' about ', {SUB_AREA.replace('query_id', 't.query_id')})) AS q FROM top t JOIN fx_chunks c ON c.chunk_id = t.chunk_id JOIN fx_queries q ON q.query_id = t.query_id),
r1 AS (SELECT *, round(1 / (1 + exp(-16 * (coalesce(nullif(vector_score, 0), 0.5) - 0.55))), 4) AS s_relevance, 1.0::DOUBLE AS s_freshness,
  coalesce(CASE WHEN authority_level IS NOT NULL THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - authority_level / 7) END, CASE WHEN contains(title, '19') THEN 0.0::DOUBLE ELSE {case_map('document_type', K.DOCTYPE_SCORE, '0.1')}::DOUBLE END) AS s_authority,
  CASE WHEN ctx_j = jurisdiction THEN 1.0::DOUBLE WHEN jurisdiction <> 'india' THEN 0.15::DOUBLE ELSE 0.8::DOUBLE END AS s_jurisdiction,
  CASE WHEN area = sub_area THEN 1.0::DOUBLE WHEN contains(area, sub_area) OR contains(sub_area, area) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS s_applicability,
  list_transform(regexp_extract_all(q, '(?i)\\b(?:section|sec\\.?|s\\.|rule|article|art\\.?)\\s*(\\d+[a-zA-Z]?(?:\\([\\w]+\\))*)', 1), lambda x: regexp_replace(x, '[^\\w()]', '', 'g')) AS locs,
  lower(concat(title, ' ', title)) AS low_title FROM r0),
r2 AS (SELECT *, CASE WHEN len(list_filter(locs, lambda n: contains(section, n) OR contains(n, section))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_citation,
  CASE WHEN {_INS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_instrument FROM r1),
r3 AS (SELECT *, 0.6::DOUBLE * s_relevance + 0.05::DOUBLE * s_freshness + 0.15::DOUBLE * s_authority + 0.05::DOUBLE * s_jurisdiction + 0.1::DOUBLE * s_applicability + 0.05::DOUBLE * s_citation AS b FROM r2),
r4 AS (SELECT *, CASE WHEN s_citation >= 0.99 THEN least(1.0, b + 0.25::DOUBLE) WHEN s_instrument >= 0.99 THEN least(1.0, b + 0.1::DOUBLE) ELSE b END AS l FROM r3),
ranked AS (SELECT *, CASE WHEN s_applicability <= 0.2 THEN l * 0.35::DOUBLE ELSE l END AS final_score FROM r4),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, area_ix ORDER BY final_score DESC, rank) AS INT) AS position, {duck_strip('lower(text)')} AS low FROM ranked)"""

# greedy, order-dependent: one recursion step per rank position of a pack
_DEDUP_SQL = _RANKED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, keys AS (SELECT DISTINCT query_id, area_ix FROM placed),
fold AS (SELECT query_id, area_ix, 0 AS step, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS texts FROM keys
  UNION ALL SELECT f.query_id, f.area_ix, f.step + 1,
    CASE WHEN p.low = '' OR list_contains(f.ids, p.chunk_id) OR len(list_filter(f.texts, lambda t: t = p.low OR (length(p.low) > 80 AND (contains(t, p.low) OR contains(p.low, t))))) > 0 THEN f.ids ELSE list_append(f.ids, p.chunk_id) END,
    CASE WHEN p.low = '' OR list_contains(f.ids, p.chunk_id) OR len(list_filter(f.texts, lambda t: t = p.low OR (length(p.low) > 80 AND (contains(t, p.low) OR contains(p.low, t))))) > 0 THEN f.texts ELSE list_append(f.texts, p.low) END
  FROM fold f JOIN placed p ON p.query_id = f.query_id AND p.area_ix = f.area_ix AND p.position = f.step + 1),
done AS (SELECT query_id, area_ix, ids FROM fold QUALIFY row_number() OVER (PARTITION BY query_id, area_ix ORDER BY step DESC) = 1),
kept AS (SELECT p.* FROM placed p JOIN done d ON d.query_id = p.query_id AND d.area_ix = p.area_ix AND list_contains(d.ids, p.chunk_id))"""


def _r(df):
    return df.select("query_id", "area_ix", "position", "chunk_id", F.round("final_score", 4).alias("final_score"),
                     F.round("relevance_score", 4).alias("relevance_score"), F.round("authority_score", 4).alias("authority_score"),
                     F.round("applicability_score", 4).alias("applicability_score"))


_R = " SELECT query_id, area_ix, position, chunk_id, round(final_score, 4) AS final_score, round(s_relevance, 4) AS relevance_score, round(s_authority, 4) AS authority_score, round(s_applicability, 4) AS applicability_score FROM "
Q["rerank"] = (lambda s, d: _r(reranked(s, d)), _DEDUP_SQL + _R + "kept")
Q["rerank_without_dedup"] = (lambda s, d: _r(reranked(s, d, False)), _RANKED_SQL + _R + "placed")


def dups(s, d):
    """Packs with copies, contained lines, lower-case copies and blanks."""
    p = packs(s, d).select("query_id", "area_ix", "rank", "chunk_id", "text")
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.lower("text").alias("t")),
        F.struct(F.lit(2).alias("k"), F.element_at(F.split("text", "\n"), -1).alias("t")), F.struct(F.lit(3).alias("k"), F.lit(" ").alias("t")),
    )
    p = p.withColumn("x", F.explode(kinds))
    return p.select(
        "query_id", "area_ix", (F.col("rank") * 4 + F.col("x.k")).alias("position"),
        F.concat("chunk_id", F.lit("-"), F.col("x.k").cast("string")).alias("chunk_id"), F.col("x.t").alias("text"),
    )


_DUPS_SQL = duck(*FX).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, top AS (SELECT p.*, c.text, row_number() OVER (PARTITION BY query_id, area_ix ORDER BY vector_score DESC, p.doc_id) AS rank FROM fx_pairs p JOIN fx_chunks c ON c.chunk_id = p.chunk_id),
dd AS (SELECT query_id, area_ix, concat(chunk_id, '-', k) AS chunk_id, CAST(rank * 4 + k AS INT) AS pos,
  CASE k WHEN 0 THEN text WHEN 1 THEN lower(text) WHEN 2 THEN string_split(text, chr(10))[-1] ELSE ' ' END AS t FROM top, range(0, 4) AS r(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, area_ix ORDER BY pos) AS position, {duck_strip('lower(t)')} AS low FROM dd)
, keys AS""" + _DEDUP_SQL.split("\n, keys AS", 1)[1]
Q["dedup_near"] = (
    lambda s, d: R.dedup_near(dups(s, d)).select("query_id", "area_ix", "position", "chunk_id"),
    _DUPS_SQL + " SELECT query_id, area_ix, pos AS position, chunk_id FROM kept",
)


def dedup_by_provision(s, d):
    p = packs(s, d).selectExpr("query_id", "area_ix", "rank AS position", "chunk_id", "title AS document_id", "CASE WHEN rank % 4 = 0 THEN NULL ELSE substr(provision, 1, 1) END AS section", "text")
    return R.dedup_near(p, "ingestion").select("query_id", "area_ix", "position", "chunk_id")


Q["dedup_by_provision"] = (
    dedup_by_provision,
    duck(*FX) + """, top AS (SELECT p.query_id, p.area_ix, p.chunk_id, source_title, section, row_number() OVER (PARTITION BY query_id, area_ix ORDER BY vector_score DESC, p.doc_id) AS position
  FROM fx_pairs p JOIN fx_chunks c ON c.chunk_id = p.chunk_id)
SELECT query_id, area_ix, position, chunk_id FROM top QUALIFY row_number() OVER (PARTITION BY query_id, area_ix, source_title, CASE WHEN position % 4 = 0 THEN '' ELSE section[1] END ORDER BY position) = 1""",
)


def neural(s, d):
    r = reranked(s, d, dedup=False).withColumn(
        "logit", ((F.substring("chunk_id", 2, 9).cast("long") * 13 + F.col("query_id") * 7) % 200 - 100) / 25.0
    )
    out = R.neural_blend(r, top=5)
    return out.select("query_id", "area_ix", "position", "chunk_id", F.round("composite", 4).alias("composite"), F.round("neural_score", 4).alias("neural_score"))


def _neural_sql() -> str:
    sql = _DEDUP_SQL
    blend = """
, n0 AS (SELECT *, 1 / (1 + exp(-((doc_id * 13 + query_id * 7) % 200 - 100) / 25.0::DOUBLE)) AS ns FROM placed0),
n1 AS (SELECT *, CASE WHEN position0 <= 5 THEN 0.6::DOUBLE * (0.6::DOUBLE * ns + 0.4::DOUBLE * s_relevance) + 0.05::DOUBLE * s_freshness + 0.15::DOUBLE * round(s_authority, 4) + 0.05::DOUBLE * s_jurisdiction + 0.1::DOUBLE * s_applicability + 0.05::DOUBLE * s_citation END AS b2 FROM n0),
n2 AS (SELECT *, CASE WHEN s_citation >= 0.99 THEN least(1.0, b2 + 0.25::DOUBLE) WHEN s_instrument >= 0.99 THEN least(1.0, b2 + 0.1::DOUBLE) ELSE b2 END AS l2 FROM n1),
n3 AS (SELECT *, CASE WHEN position0 > 5 THEN final_score WHEN s_applicability <= 0.2 THEN l2 * 0.35::DOUBLE ELSE l2 END AS composite, CASE WHEN position0 <= 5 THEN round(ns, 4) END AS neural_score FROM n2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, area_ix ORDER BY composite DESC, position0) AS INT) AS position FROM n3)
"""
    head, tail = sql.split("\n, keys AS", 1)
    head = head.replace("placed AS (", "placed0 AS (").replace(" AS INT) AS position", " AS INT) AS position0")
    return head + blend + ", keys AS" + tail + " SELECT query_id, area_ix, position, chunk_id, round(composite, 4) AS composite, neural_score FROM kept"


Q["neural_blend"] = (neural, _neural_sql())


# --- evidence ----------------------------------------------------------------------------


def evidence(s, d):
    return E.merge_evidence(reranked(s, d))


_MERGE_SQL = _DEDUP_SQL + """
, best AS (SELECT *, first_value(area_ix) OVER w AS a0, first_value(position) OVER w AS p0 FROM kept
  WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY area_ix, position)
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY final_score DESC, area_ix, position) = 1),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 4) DESC, round(s_relevance, 4) DESC, round(vector_score, 4) DESC, a0, p0) AS INT) AS evidence_rank FROM best QUALIFY evidence_rank <= 8)"""
Q["merge_evidence"] = (
    lambda s, d: evidence(s, d).select("query_id", "evidence_rank", "chunk_id", "area_ix", F.round("final_score", 4).alias("final_score")),
    _MERGE_SQL + " SELECT query_id, evidence_rank, chunk_id, area_ix, round(final_score, 4) AS final_score FROM merged",
)
_LOW = "lower(concat_ws(' ', section, title, title, chunk_id))"
_W = [any_of("lowtext", r[0]) for r in K.CANONICAL_RULES]


def _canon(i: int, fallback: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN '{r[i]}'" for w, r in zip(_W, K.CANONICAL_RULES)) + f" ELSE {fallback} END"


_CANON_SQL = f""", canon AS (SELECT *, {_canon(1, 'title')} AS doc_title, {_canon(2, 'title')} AS doc_authority,
  coalesce(nullif(own_area, ''), {_canon(3, "'Indian Regulatory Framework'")}) AS doc_area, {_canon(4, "''")} AS doc_url FROM (SELECT *, {_LOW} AS lowtext,
  concat(doc_id % 9, ' to ', doc_id % 9 + 1) AS pages FROM merged))"""
# reranked evidence carries the area it was scored with
_CANON_SQL = _CANON_SQL.replace("nullif(own_area, '')", "nullif(area, '')")
Q["canonical_doc"] = (
    lambda s, d: E.canonical_doc(evidence(s, d)).select("query_id", "chunk_id", "doc_title", "doc_authority", "doc_area", "doc_url", "doc_key"),
    _MERGE_SQL + _CANON_SQL + " SELECT query_id, chunk_id, doc_title, doc_authority, doc_area, doc_url, lower(doc_title) AS doc_key FROM canon",
)
Q["context_string"] = (
    lambda s, d: E.context_string(evidence(s, d)),
    _MERGE_SQL + _CANON_SQL + f""", blocks AS (SELECT query_id, doc_title, min(evidence_rank) AS r, concat('### [DOCUMENT: ', doc_title, ' | Authority: ', arg_min(doc_authority, evidence_rank), ' | Legal Framework: ', arg_min(doc_area, evidence_rank), ']', chr(10),
  string_agg(concat('• [Provision: ', section, ' | Ref: ', chunk_id, ', Pages: ', pages, ']', chr(10), {duck_strip('text')}), chr(10) || chr(10) ORDER BY evidence_rank)) AS b FROM canon GROUP BY query_id, doc_title)
SELECT query_id, string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context FROM blocks GROUP BY query_id""",
)
Q["format_sources"] = (
    lambda s, d: E.format_sources(evidence(s, d)).select(
        "query_id", "source_no", "id", "doc_id", "provision", "source_url", "document_type", "legal_area", "chunk_count",
        F.array_join("chunk_ids", "|").alias("chunk_ids"), F.size("sections").alias("n_sections"), F.size("excerpts").alias("n_excerpts"),
        F.sha2("text", 256).alias("text_hash"),
    ),
    _MERGE_SQL + _CANON_SQL + f""", g AS (SELECT query_id, lower(doc_title) AS doc_id, min(evidence_rank) AS r, arg_min(chunk_id, evidence_rank) AS id, arg_min(doc_url, evidence_rank) AS source_url,
  arg_min(document_type, evidence_rank) AS document_type, arg_min(doc_area, evidence_rank) AS legal_area, count(DISTINCT chunk_id) AS chunk_count,
  string_agg(chunk_id, '|' ORDER BY evidence_rank) AS chunk_ids, count(*) AS n_sections, count(DISTINCT substring({duck_strip('text')}, 1, 600)) AS n_excerpts,
  sha256(arg_min(substring({duck_strip('text')}, 1, 1200), evidence_rank)) AS text_hash FROM canon GROUP BY query_id, lower(doc_title)),
pv AS (SELECT query_id, doc_id, string_agg(section, ', ' ORDER BY f) AS provision FROM (SELECT query_id, lower(doc_title) AS doc_id, section, min(evidence_rank) AS f FROM canon GROUP BY ALL) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS source_no, id, doc_id, provision, source_url, document_type, legal_area, chunk_count, chunk_ids, n_sections, n_excerpts, text_hash FROM g JOIN pv USING (query_id, doc_id)""",
)


def answers(s, d):
    return fx(s, d, "fx_answers").selectExpr("concat(conv_id, '-', turn) AS answer_id", "conv_id AS query_id", "turn", "answer")


def guarded(s, d):
    a = answers(s, d)
    return E.gate_answers(E.guardrail(a, evidence(s, d)).withColumn("intent", F.when(F.col("turn") % 4 == 3, "other").otherwise("compliance")))


Q["guardrail"] = (
    lambda s, d: guarded(s, d).select("answer_id", "passed", "reason", "status", F.sha2("final_answer", 256).alias("final_hash")),
    _MERGE_SQL + f""", ag AS (SELECT query_id, avg(final_score) AS sc, avg(s_applicability) AS ap FROM merged GROUP BY query_id),
{duck('fx_answers').removeprefix('WITH ')},
gr AS (SELECT concat(conv_id, '-', turn) AS answer_id, answer, turn, CASE WHEN ag.query_id IS NULL THEN 'No relevant legal provisions retrieved.'
  WHEN sc < 0.25 THEN concat('Retrieved evidence quality too low (avg score: ', printf('%.2f', sc), '). Likely area mismatch — will retry.')
  WHEN ap < 0.3 THEN concat('Retrieved evidence applicability too low (avg: ', printf('%.2f', ap), '). Wrong legal area retrieved — will retry.')
  WHEN (contains(lower(answer), 'insufficient') AND contains(lower(answer), 'material')) OR contains(lower(answer), 'cannot answer') THEN 'LLM determined that the retrieved context was insufficient.' END AS reason
  FROM fx_answers fa LEFT JOIN ag ON ag.query_id = fa.conv_id)
SELECT answer_id, reason IS NULL AS passed, reason, CASE WHEN reason IS NOT NULL AND turn % 4 <> 3 THEN 'abstained' ELSE 'answered' END AS status,
  sha256(CASE WHEN reason IS NOT NULL AND turn % 4 <> 3 THEN concat('I don''t have sufficient grounded evidence to answer confidently. ', reason) ELSE answer END) AS final_hash FROM gr""",
)
Q["verify_citations"] = (
    lambda s, d: E.verify_citations(answers(s, d), evidence(s, d)).select(
        "answer_id", "passed", "reason", F.array_join("verified", "|").alias("verified"), F.array_join("unverified", "|").alias("unverified")
    ),
    _MERGE_SQL + f""", {duck('fx_answers').removeprefix('WITH ')},
va AS (SELECT concat(conv_id, '-', turn) AS answer_id, conv_id, contains(lower(answer), 'excerpt does not contain') AS admits, regexp_extract_all(answer, '(?i)\\b(?:Section|Sec\\.|Rule|Article)\\s*\\d+[A-Za-z]?(?:\\s*\\([a-z0-9A-Z]+\\))*', 0) AS cs FROM fx_answers),
vc AS (SELECT answer_id, conv_id, i, cs[i] AS cite, regexp_replace(lower(cs[i]), '[^\\w()]', '', 'g') AS norm FROM va, range(1, len(cs) + 1) AS r(i) WHERE NOT admits),
vd AS (SELECT *, regexp_extract(norm, '(\\d+[a-z]?(?:\\([a-z0-9]+\\))*)', 1) AS t, regexp_extract(norm, '(\\d+)', 1) AS parent FROM vc QUALIFY row_number() OVER (PARTITION BY answer_id, norm ORDER BY i) = 1),
ve AS (SELECT query_id, section AS loc, lower(concat_ws(' ', section, title, text)) AS low FROM merged),
vo AS (SELECT d.answer_id, d.i, d.cite, coalesce(bool_or(contains(loc, t) OR contains(t, loc) OR contains(low, t) OR contains(low, 'section ' || parent)), false) AS ok FROM vd d LEFT JOIN ve e ON e.query_id = d.conv_id GROUP BY ALL),
vs AS (SELECT answer_id, string_agg(cite, '|' ORDER BY i) FILTER (ok) AS v, string_agg(cite, '|' ORDER BY i) FILTER (NOT ok) AS u FROM vo GROUP BY answer_id)
SELECT a.answer_id, NOT admits AND u IS NULL AS passed, CASE WHEN admits THEN 'Model admitted evidence was missing from retrieved context (''excerpt does not contain'').'
  WHEN u IS NOT NULL THEN concat('Statutory citations not backed by retrieved evidence text: ', replace(u, '|', ', '), '. Answer relied on background model knowledge rather than retrieved statutory chunks.') END AS reason,
  coalesce(v, '') AS verified, coalesce(u, '') AS unverified FROM va a LEFT JOIN vs USING (answer_id)""",
)
Q["admissions"] = (
    lambda s, d: answers(s, d).select("answer_id", admission_check(F.lower("answer")).alias("reason")),
    duck("fx_answers") + " SELECT concat(conv_id, '-', turn) AS answer_id, CASE WHEN contains(lower(answer), 'excerpt does not contain') THEN 'Model admitted evidence was missing from retrieved context (''excerpt does not contain'').' END AS reason FROM fx_answers",
)


def caveats(s, d):
    a = answers(s, d).withColumn("assumptions", F.when(F.col("turn") % 2 == 1, F.array(F.lit(K.INDIA_ASSUMPTION))).otherwise(F.array().cast("array<string>")))
    return E.assumption_caveat(a).select("answer_id", F.sha2("answer", 256).alias("answer_hash"))


Q["assumption_caveat"] = (
    caveats,
    duck("fx_answers") + " SELECT concat(conv_id, '-', turn) AS answer_id, sha256(CASE WHEN turn % 2 = 1 THEN concat(answer, chr(10), chr(10), '> **Regulatory Assumptions Applied (Max Clarification Reached):**', chr(10), '> - Assumed Indian jurisdiction') ELSE answer END) AS answer_hash FROM fx_answers",
)


def blocks(s, d):
    r = reranked(s, d).withColumn("query_id", F.concat_ws("-", "query_id", "area_ix")).withColumn("effective_from", F.lit("1970-01-01"))
    return context_blocks(r, 4).select("query_id", F.sha2("context", 256).alias("context_hash"))


Q["context_blocks"] = (
    blocks,
    _DEDUP_SQL + """ SELECT concat(query_id, '-', area_ix) AS query_id, sha256(string_agg(concat('[', section, ' - ', title, '] (Chapter: N/A, Pages: ', doc_id % 9, ' to ', doc_id % 9 + 1, ', Type: ', document_type, ', Effective: 1970-01-01, Re-rank score: ',
  printf('%.4f', final_score), ')', chr(10), text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position)) AS context_hash FROM kept WHERE position <= 4 GROUP BY kept.query_id, area_ix""",
)
