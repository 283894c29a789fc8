"""Question understanding, classification, decomposition, clarification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import any_of, case_map, duck, duck_strip, first_of, fx
from lexloom.functions import constants as K
from lexloom.functions import rules as R
from lexloom.operators import questions as P

Q: dict = {}

# Texts to understand: all questions and all turns.
ASKED = """
, asked AS (SELECT query_id, 0 AS turn, query FROM fx_queries UNION ALL SELECT conv_id, 1 + turn, text FROM fx_turns)"""


def asked(s, d):
    q = fx(s, d, "fx_queries").selectExpr("query_id", "0L AS turn", "query")
    return q.unionAll(fx(s, d, "fx_turns").selectExpr("conv_id", "1 + turn", "text"))


_HERBS = "[" + ", ".join(f"CASE WHEN contains(low, '{m}') THEN '{m.capitalize()}' END" for m in K.ENTITY_MARKERS) + "]"
UND_SQL = duck("fx_queries", "fx_turns") + ASKED + f"""
, low AS (SELECT *, lower(query) AS low FROM asked),
it AS (SELECT *, {first_of('low', K.INTENT_RULES, "'other'")} AS intent FROM low),
und AS (SELECT *, CASE WHEN {any_of('low', K.FORMULATION_MARKERS)} AND intent <> 'general_info' THEN query END AS description,
  list_filter({_HERBS}, lambda x: x IS NOT NULL) AS entities, {first_of('low', K.MENTION_RULES)} AS mentions_jurisdiction FROM it)"""


def und(s, d):
    return P.understand(asked(s, d))


Q["understand"] = (
    lambda s, d: und(s, d).select(
        "query_id", "turn", "intent", F.sha2("raw_product_description", 256).alias("description_hash"),
        F.array_join("entities", "|").alias("entities"), "mentions_jurisdiction",
    ),
    UND_SQL + " SELECT query_id, turn, intent, sha256(description) AS description_hash, array_to_string(entities, '|') AS entities, mentions_jurisdiction FROM und",
)
_CAT = "CASE " + " ".join(f"WHEN {any_of('dl', w)} THEN '{c}' " for c, _, _, w in K.CATEGORY_RULES) + "ELSE 'unclassified' END"
_CONF = "CASE " + " ".join(f"WHEN {any_of('dl', w)} THEN {f}::DOUBLE " for _, f, _, w in K.CATEGORY_RULES) + "ELSE 0.5::DOUBLE END"
_REASON = "CASE " + " ".join(f"WHEN {any_of('dl', w)} THEN '{r}' " for _, _, r, w in K.CATEGORY_RULES) + "ELSE 'Initial classification.' END"
_BOT = "[" + ", ".join(f"CASE WHEN contains(mixtext, '{k}') THEN '{v}' END" for k, v in K.BOTANICALS.items()) + "]"
CLS_SQL = UND_SQL + f"""
, dl AS (SELECT *, lower(coalesce(description, '')) AS dl, lower(concat(coalesce(description, ''), ' ', array_to_string(entities, ' '))) AS mixtext FROM und),
c0 AS (SELECT *, {_CAT} AS category, {_CONF} AS confidence, {_REASON} AS reasoning, {first_of('dl', K.ROUTE_RULES, "'unknown'")} AS route_of_administration,
  {first_of('dl', K.USE_RULES, "'unknown'")} AS intended_use, list_sort(list_distinct(list_filter({_BOT}, lambda x: x IS NOT NULL))) AS ingredients FROM dl),
cls AS (SELECT *, concat_ws('|', CASE WHEN category = 'unclassified' AND coalesce(description, '') <> '' THEN 'category' END,
  CASE WHEN category = 'proprietary' AND intent = 'compliance' AND route_of_administration = 'unknown' AND coalesce(description, '') <> '' THEN 'route_of_administration' END) AS missing FROM c0)"""


def cls(s, d):
    return P.classify(und(s, d))


CC = ["query_id", "turn", "category", "confidence", "reasoning", "route_of_administration", "intended_use"]
Q["classify"] = (
    lambda s, d: cls(s, d).select(*CC, F.array_join("ingredients", "|").alias("ingredients"), F.array_join("missing_facts", "|").alias("missing")),
    CLS_SQL + f" SELECT {', '.join(CC)}, array_to_string(ingredients, '|') AS ingredients, missing FROM cls",
)
_FACTS = "map_filter(map('category', CASE query_id % 4 WHEN 0 THEN 'Ayurveda_Aahar' WHEN 1 THEN 'bogus' END, 'route_of_administration', CASE query_id % 3 WHEN 0 THEN ' Oral' WHEN 1 THEN 'nasal' END, 'jurisdiction', CASE query_id % 5 WHEN 0 THEN 'national' WHEN 1 THEN 'US market' END), (k, v) -> v IS NOT NULL)"


def known(s, d):
    return P.classify(und(s, d).withColumn("facts", F.expr(_FACTS)), "facts")


Q["apply_known_facts"] = (
    lambda s, d: P.route_jurisdiction(known(s, d)).select("query_id", "turn", "category", "route_of_administration", F.array_join("missing_facts", "|").alias("missing"), "jurisdiction"),
    CLS_SQL + f""", k AS (SELECT *, CASE query_id % 4 WHEN 0 THEN 'ayurveda-aahar' WHEN 1 THEN 'unclassified' ELSE category END AS cat2,
  CASE query_id % 3 WHEN 0 THEN 'oral' ELSE route_of_administration END AS route2 FROM c0)
SELECT query_id, turn, cat2 AS category, route2 AS route_of_administration,
  concat_ws('|', CASE WHEN cat2 = 'unclassified' AND query_id % 4 > 1 AND coalesce(description, '') <> '' THEN 'category' END,
   CASE WHEN cat2 = 'proprietary' AND intent = 'compliance' AND route2 = 'unknown' AND query_id % 3 = 2 AND coalesce(description, '') <> '' THEN 'route_of_administration' END) AS missing,
  CASE query_id % 5 WHEN 0 THEN 'india' WHEN 1 THEN 'international' ELSE CASE WHEN {any_of('low', K.INTERNATIONAL_KEYWORDS)} THEN 'international' ELSE 'india' END END AS jurisdiction FROM k""",
)


def extracted(s, d):
    c = cls(s, d).withColumn("query_id", F.concat_ws("-", "query_id", "turn"))
    x = asked(s, d).selectExpr("concat_ws('-', query_id, turn) AS query_id", "CASE query_id % 3 WHEN 0 THEN 'classical' WHEN 1 THEN 'proprietary' ELSE 'unclassified' END AS category", "0.7D AS confidence", "'oral' AS route_of_administration", "array('Extra') AS ingredients", "'from model' AS reasoning")
    return P.merge_extracted(c, x).select("query_id", "category", "confidence", "route_of_administration", "reasoning", F.array_join("ingredients", "|").alias("ingredients"))


Q["merge_extracted"] = (
    extracted,
    CLS_SQL + """, m AS (SELECT c.* REPLACE (concat(c.query_id, '-', c.turn) AS query_id), CASE c.query_id % 3 WHEN 0 THEN 'classical' WHEN 1 THEN 'proprietary' ELSE 'unclassified' END AS x, coalesce(c.description, '') <> '' AND (c.category = 'unclassified' OR len(ingredients) = 0) AS ask FROM cls c)
SELECT query_id, CASE WHEN ask AND category = 'unclassified' AND x <> 'unclassified' THEN x ELSE category END AS category,
  CASE WHEN ask AND category = 'unclassified' AND x <> 'unclassified' THEN 0.7::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN ask AND route_of_administration = 'unknown' THEN 'oral' ELSE route_of_administration END AS route_of_administration,
  CASE WHEN ask AND reasoning = 'Initial classification.' THEN 'from model' ELSE reasoning END AS reasoning,
  array_to_string(CASE WHEN ask THEN list_sort(list_append(ingredients, 'Extra')) ELSE ingredients END, '|') AS ingredients FROM m""",
)


def hyde(s, d):
    every = cls(s, d).withColumn("query_id", F.concat_ws("-", "query_id", "turn"))
    g = asked(s, d).selectExpr("concat_ws('-', query_id, turn) AS query_id").selectExpr("query_id", "concat(' generated ', query_id) AS generated")
    return P.hyde_gate(every, g).select("query_id", "hyde_eligible", "hyde_context")


Q["hyde_gate"] = (
    hyde,
    CLS_SQL + f", h AS (SELECT concat(query_id, '-', turn) AS query_id, length({duck_strip('coalesce(description, chr(32))')}) > 20 AND category <> 'unclassified' AND confidence >= 0.65 AS ok FROM cls) "
    "SELECT query_id, ok AS hyde_eligible, CASE WHEN ok THEN concat('generated ', query_id) END AS hyde_context FROM h",
)
_SLOTS = {s: first_of("low", r) for s, r in K.SLOT_RULES.items()}
Q["slot_answers"] = (
    lambda s, d: asked(s, d).withColumn("low", F.lower("query")).withColumn("m", R.slot_answers(F.col("low"))).select(
        "query_id", "turn", *[F.try_element_at("m", F.lit(k)).alias(k) for k in K.SLOT_RULES]
    ),
    UND_SQL + " SELECT query_id, turn, " + ", ".join(f"{v} AS {k}" for k, v in _SLOTS.items()) + " FROM low",
)
Q["clarify_gate"] = (
    lambda s, d: cls(s, d).select(
        "query_id", "turn", R.clarify_gate(F.col("intent"), F.col("missing_facts"), (F.col("query_id") % 4).cast("int")).alias("clarify"),
        R.bypass_gate(F.col("intent")).alias("bypass"),
    ),
    CLS_SQL + " SELECT query_id, turn, intent NOT IN ('general_info', 'other') AND missing <> '' AND query_id % 4 < 2 AS clarify, intent = 'general_info' AS bypass FROM cls",
)
_MISSING = "CASE query_id % 4 WHEN 0 THEN {a}'category', 'route_of_administration', 'jurisdiction', 'intended_use'{z} WHEN 1 THEN {a}'dosage_form', 'shelf_life', 'colour'{z} WHEN 2 THEN {a}'x', 'intended_use'{z} ELSE {e} END"


def missing(s, d):
    return asked(s, d).select(F.concat_ws("-", "query_id", "turn").alias("query_id"), F.expr(_MISSING.format(a="array(", z=")", e="cast(array() as array<string>)")).alias("missing_facts"))


_QSQL = UND_SQL + f""", m AS (SELECT concat(query_id, '-', turn) AS query_id, {_MISSING.format(a='[', z=']', e='[]')} AS f FROM low),
v AS (SELECT query_id, f, list_filter(f, lambda x: list_contains(['category', 'jurisdiction', 'route_of_administration', 'intended_use'], x)) AS ok FROM m),
a AS (SELECT query_id, CASE WHEN len(ok) > 0 THEN ok[1:3] ELSE f[1:2] END AS l FROM v),
qs AS (SELECT query_id, CAST(i AS INT) AS question_no, l[i] AS field FROM a, range(1, len(l) + 1) AS r(i)),
qq AS (SELECT *, coalesce({case_map('field', {f: q for f, q, _ in K.QUESTION_CATALOG})}, concat('Could you please specify details regarding the ', replace(field, '_', ' '), '?')) AS question,
  {case_map('field', {f: '|'.join(o) for f, _, o in K.QUESTION_CATALOG})} AS options FROM qs)"""
Q["clarification_questions"] = (
    lambda s, d: P.clarification_questions(missing(s, d)).withColumn("options", F.array_join("options", "|")),
    _QSQL + " SELECT query_id, question_no, field, question, options FROM qq",
)
Q["clarification_message"] = (
    lambda s, d: P.clarification_message(P.clarification_questions(missing(s, d))),
    _QSQL + f""" SELECT query_id, concat('{K.CLARIFY_INTRO}', chr(10), string_agg(concat(question_no, '. ', question, coalesce(' (Options: ' || replace(options, '|', ', ') || ')', '')), chr(10) ORDER BY question_no), chr(10), '{K.CLARIFY_OUTRO.replace(chr(10), "' || chr(10) || '")}') AS final_answer FROM qq GROUP BY query_id""",
)


def options(s, d):
    cat = P.question_catalog(s).select("field", F.posexplode("options").alias("no", "option"))
    t = fx(s, d, "fx_turns").selectExpr("conv_id", "turn", "element_at(array('category', 'jurisdiction', 'route_of_administration', 'intended_use'), CAST(turn % 4 AS INT) + 1) AS field")
    return t.join(cat, "field").select("conv_id", "turn", "field", "no", R.option_to_fact(F.col("field"), F.col("option")).alias("fact"))


_OPT_FACTS = {
    "category": ["classical", "proprietary", "phytopharmaceutical", "ayurveda_aahar", "cosmetic"],
    "jurisdiction": ["india", "international"], "route_of_administration": ["oral", "external"],
    "intended_use": ["medicine", "food", "cosmetic"],
}
Q["option_to_fact"] = (
    options,
    "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{v}')" for k, vs in _OPT_FACTS.items() for i, v in enumerate(vs))
    + ") AS x(field, no, fact)), t AS (SELECT conv_id, turn, ['category', 'jurisdiction', 'route_of_administration', 'intended_use'][turn % 4 + 1] AS field FROM conversations) "
    "SELECT conv_id, turn, field, CAST(no AS INT) AS no, fact FROM t JOIN f USING (field)",
)


def refinements(s, d):
    t = fx(s, d, "fx_turns").selectExpr("conv_id AS session_id", "turn AS turn_index", "role", "CASE WHEN turn % 4 = 2 THEN concat('Refinement: ', text) ELSE text END AS text")
    return P.refinement_query(t).select("session_id", F.sha2("query", 256).alias("query_hash"))


Q["refinement_query"] = (
    refinements,
    duck("fx_turns") + """, r AS (SELECT conv_id AS session_id, arg_max(text, turn) FILTER (turn % 4 = 2) AS ref, arg_max(text, turn) FILTER (turn % 4 <> 2) AS orig FROM fx_turns WHERE role = 'user' GROUP BY conv_id)
SELECT session_id, sha256(CASE WHEN coalesce(orig, '') <> '' THEN concat(orig, ' (Refinement: ', ref, ')') ELSE ref END) AS query_hash FROM r WHERE ref IS NOT NULL""",
)


def inherited(s, d):
    t = fx(s, d, "fx_turns").selectExpr("conv_id AS session_id", "turn AS turn_index", "role", "text")
    return P.inherit_context(t, 4).select("session_id", "turn_index", "intent", F.array_join("entities", "|").alias("entities"), F.sha2("raw_product_description", 256).alias("description_hash"))


Q["inherit_context"] = (
    inherited,
    duck("fx_turns") + f""", low AS (SELECT *, lower(text) AS low FROM fx_turns),
it AS (SELECT *, {first_of('low', K.INTENT_RULES, "'other'")} AS intent, list_filter({_HERBS}, lambda x: x IS NOT NULL) AS ents, {any_of('low', K.FORMULATION_MARKERS)} AS marked,
  {any_of('low', K.PRONOUN_MARKERS)} AND role = 'user' AS refers FROM low),
p AS (SELECT *, last_value(CASE WHEN role = 'user' AND marked THEN text END IGNORE NULLS) OVER w AS pd, last_value(CASE WHEN role = 'user' AND len(ents) > 0 THEN ents END IGNORE NULLS) OVER w AS pe FROM it
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT conv_id AS session_id, turn AS turn_index, intent, array_to_string(CASE WHEN refers AND len(ents) = 0 THEN coalesce(pe, ents) ELSE ents END, '|') AS entities,
  sha256(coalesce(CASE WHEN marked AND intent <> 'general_info' THEN text END, CASE WHEN refers THEN pd END)) AS description_hash FROM p""",
)


def history(s, d):
    t = fx(s, d, "fx_turns").selectExpr("conv_id AS session_id", "turn AS turn_index", "role", "text")
    return P.history_text(t, 3, 300).select("session_id", F.sha2("history", 256).alias("history_hash"))


Q["history_text"] = (
    history,
    duck("fx_turns") + f""", r AS (SELECT conv_id, turn, role, {duck_strip('text')} AS c FROM fx_turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id AS session_id, sha256(string_agg(concat(upper(role[1]), role[2:], ': ', CASE WHEN role IN ('user', 'assistant') AND length(c) > 300 THEN concat(substring(c, 1, 300), '...') ELSE c END), chr(10) ORDER BY turn)) AS history_hash
FROM r WHERE c <> '' GROUP BY conv_id""",
)
_ADD = "[" + ", ".join(
    f"CASE WHEN {c} THEN '{a}' END" for a, c in {
        "patent": f"{any_of('low', ['patent', 'invent'])} OR {any_of('low', K.SECTION3_KEYWORDS)}",
        "abs": any_of("low", K.AREA_QUERY_RULES["abs"]),
        "tk_prior_art": f"{any_of('low', K.AREA_QUERY_RULES['tk_prior_art'])} OR {any_of('mix', K.HERB_KEYWORDS)} OR {any_of('low', K.SECTION3_KEYWORDS)}",
        "trademark": any_of("low", K.AREA_QUERY_RULES["trademark"]), "gi": any_of("mix", K.HERB_KEYWORDS),
    }.items()
) + "]"
_BASE = "CASE category " + " ".join(f"WHEN '{c}' THEN {a!r}" for c, a in K.CATEGORY_AREAS.items()) + " END"
AREAS_SQL = CLS_SQL + f"""
, mixd AS (SELECT *, concat(low, ' ', lower(array_to_string(ingredients, ' '))) AS mix FROM cls),
ar AS (SELECT *, {_BASE} AS base, list_filter({_ADD}, lambda x: x IS NOT NULL) AS added FROM mixd),
ab AS (SELECT *, list_concat(base, list_filter(added, lambda x: NOT list_contains(base, x))) AS l1 FROM ar),
areas AS (SELECT *, CASE WHEN NOT list_contains(l1, 'drug_regulation') AND {any_of('low', K.LEGAL_WORDS)} THEN list_append(l1, 'drug_regulation') ELSE l1 END AS l FROM ab)"""
_SUFFIX = case_map("legal_area", K.AREA_SUFFIX)
Q["decompose"] = (
    lambda s, d: P.decompose(cls(s, d)).select("query_id", "turn", "area_ix", "legal_area", "product_category", F.sha2("query_text", 256).alias("text_hash")),
    AREAS_SQL + f" SELECT query_id, turn, area_ix, legal_area, product_category, sha256(concat(query, {_SUFFIX})) AS text_hash FROM (SELECT query_id, turn, query, category AS product_category, CAST(i - 1 AS INT) AS area_ix, l[i] AS legal_area FROM areas, range(1, len(l) + 1) AS r(i))",
)


def retry(s, d):
    q = fx(s, d, "fx_queries").withColumn("unverified", F.expr("CASE WHEN query_id % 2 = 0 THEN array('Section 9', 'Rule 2') ELSE cast(array() as array<string>) END"))
    return P.retry_decompose(q).select("query_id", "area_ix", "legal_area", F.sha2("query_text", 256).alias("text_hash"))


Q["retry_decompose"] = (
    retry,
    duck("fx_queries") + f", a AS (SELECT {K.AREAS!r} AS l) SELECT query_id, CAST(i - 1 AS INT) AS area_ix, legal_area, sha256(concat(query, CASE WHEN query_id % 2 = 0 THEN ' Section 9, Rule 2' ELSE '' END, {_SUFFIX})) AS text_hash "
    "FROM (SELECT query_id, query, i, l[i] AS legal_area FROM fx_queries, a, range(1, 7) AS r(i))",
)


def prompts(s, d):
    q = cls(s, d).withColumn("query_id", F.concat_ws("-", "query_id", "turn")).withColumn("abstract", F.col("query")).withColumn("classification", F.col("category"))
    out = None
    for kind in ("understand", "classify", "hyde", "answer", "audit"):
        p = P.build_prompts(q, kind).select("query_id", F.lit(kind).alias("kind"), F.contains("prompt", "query").alias("has_query"))
        out = p if out is None else out.unionAll(p)
    return out


Q["build_prompts"] = (
    prompts,
    CLS_SQL + " SELECT concat(query_id, '-', turn) AS query_id, kind, kind IN ('understand', 'answer', 'audit') OR coalesce(description, '') <> '' AS has_query FROM cls, (VALUES ('understand'), ('classify'), ('hyde'), ('answer'), ('audit')) AS k(kind)",
)
Q["strip_thinking"] = (
    lambda s, d: fx(s, d, "fx_turns").select(
        "conv_id", "turn", F.sha2(R.strip_thinking(F.concat(F.lit("<think>a\nb</think> "), "text", F.lit(" <|thinking|>x<|/thinking|>\n"))), 256).alias("text_hash")
    ),
    duck("fx_turns") + f" SELECT conv_id, turn, sha256({duck_strip('text')}) AS text_hash FROM fx_turns",
)
