"""Citations, audits, sessions and the flows as a whole."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks.adapters import any_of, duck, duck_strip, first_of, fx, table
from checks.retrieval import AREA_OK, VEC_SQL
from lexloom.functions import constants as K
from lexloom.functions import signals as S
from lexloom.operators import audit as A
from lexloom.operators import citations as C
from lexloom.operators import retrieval as V
from lexloom.operators.evidence import guardrail
from lexloom.plans.answer import answer, chat_result
from lexloom.session import shared_folder
from lexloom.plans.audit import audit
from lexloom.streaming.sessions import session_machine, session_machine_batch
from lexloom.streaming.turn_log import turn_log

Q: dict = {}


def answers(s, d):
    return fx(s, d, "fx_answers").selectExpr("concat(conv_id, '-', turn) AS answer_id", "conv_id", "answer")


def sources(s, d):
    """Three sources per answer: a chunk id, a document with listed chunks, an unrelated one."""
    a = fx(s, d, "fx_answers").selectExpr("concat(conv_id, '-', turn) AS answer_id", "conv_id")
    rows = a.selectExpr(
        "answer_id",
        "explode(array(named_struct('source_no', 1, 'id', concat('X', conv_id), 'doc_id', 'doc one', 'chunk_ids', array(concat('D', (conv_id + 1) % 50))),"
        " named_struct('source_no', 2, 'id', concat('D', conv_id % 50), 'doc_id', 'doc two', 'chunk_ids', array('Q1')),"
        " named_struct('source_no', 3, 'id', 'ZZZ', 'doc_id', 'doc three', 'chunk_ids', array('Q2')))) AS s",
    )
    return rows.select("answer_id", "s.*")


_REWRITE = "regexp_replace(regexp_replace(answer, '\\(Ref: (D\\d+)\\)', ' [^1](#citation:\\1) ', 'g'), '\\(Excerpt 1, Ref: (D\\d+)\\)', ' [^2](#citation:\\1) ', 'g')"
Q["index_citations"] = (
    lambda s, d: C.index_citations(answers(s, d), sources(s, d)).select(
        "answer_id", F.sha2("processed_text", 256).alias("text_hash"), F.array_join("cited_chunks", "|").alias("cited"),
        F.array_join(F.transform("ref_numbers", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("numbers"),
    ),
    duck("fx_answers") + f" SELECT concat(conv_id, '-', turn) AS answer_id, sha256({_REWRITE}) AS text_hash, concat('D', conv_id % 50, '|X', conv_id) AS cited, '1,2,1,-' AS numbers FROM fx_answers",
)
_EXC = "CASE doc_id % 4 WHEN 0 THEN concat(' ', {last}, ' ') WHEN 1 THEN lower({last}) WHEN 2 THEN concat({first}, '  \n ', {last}) ELSE 'zz qq vv' END"


def spans(s, d):
    docs = table(s, d, "documents").withColumn("exc", F.expr(_EXC.format(last="element_at(split(text, '\\n'), -1)", first="element_at(split(text, '\\n'), 1)")))
    return docs.select("doc_id", C.highlight_span(F.col("text"), F.col("exc")).alias("h")).select("doc_id", F.col("h.start").alias("start"), F.col("h.end").alias("stop"))


_SQL_EXC = _EXC.format(last="l[-1]", first="l[1]")
Q["highlight_span"] = (
    spans,
    f"""WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT *, {duck_strip('(' + _SQL_EXC + ')')} AS e FROM a),
c AS (SELECT *, strpos(text, e) - 1 AS x, strpos(lower(text), lower(e)) - 1 AS y, list_filter(regexp_split_to_array(e, '\\s+'), lambda w: length(w) > 2) AS w FROM b),
f AS (SELECT *, lower(array_to_string(w[1:3], ' ')) AS hd, lower(array_to_string(w[greatest(len(w) - 2, 1):], ' ')) AS tl FROM c),
g AS (SELECT *, strpos(lower(text), hd) - 1 AS p FROM f),
h AS (SELECT *, CASE WHEN p >= 0 THEN strpos(substring(lower(text), p + 1), tl) - 1 END AS q FROM g)
SELECT doc_id, CAST(CASE WHEN e = '' THEN NULL WHEN x >= 0 THEN x WHEN y >= 0 THEN y WHEN len(w) >= 3 AND p >= 0 THEN p END AS INT) AS start,
 CAST(CASE WHEN e = '' THEN NULL WHEN x >= 0 THEN x + length(e) WHEN y >= 0 THEN y + length(e) WHEN len(w) >= 3 AND p >= 0 THEN CASE WHEN q >= 0 THEN p + q + length(tl) ELSE least(length(text), p + length(e)) END END AS INT) AS stop FROM h""",
)
_PROV = "CASE doc_id % 6 WHEN 0 THEN 's.3(p)' WHEN 1 THEN 'Sec. 6' WHEN 2 THEN 'Form III' WHEN 3 THEN 'Section 3(e)' WHEN 4 THEN 'efficacy clause' ELSE section END"
_CID = "CASE doc_id % 5 WHEN 0 THEN concat('L0-IN-PAT-3P-', doc_id) WHEN 1 THEN concat('ABS-001-', doc_id) WHEN 2 THEN concat('TKDL-', doc_id) ELSE chunk_id END"
Q["statute_id"] = (
    lambda s, d: fx(s, d, "fx_chunks").selectExpr("doc_id", f"{_PROV} AS prov", f"{_CID} AS cid", "CASE WHEN doc_id % 9 = 0 THEN 'bda-6' WHEN doc_id % 9 = 1 THEN 'other' END AS given").select(
        "doc_id", C.statute_id(F.col("prov"), F.col("cid"), F.col("given")).alias("statute")
    ),
    duck("fx_chunks") + f""", t AS (SELECT doc_id, lower(concat({_PROV}, ' ', {_CID})) AS low FROM fx_chunks)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'bda-6' ELSE {first_of('low', K.STATUTE_RULES, "'unmapped'")} END AS statute FROM t""",
)
_TITLE = "CASE doc_id % 4 WHEN 0 THEN source_title WHEN 1 THEN 'The claims of it' WHEN 2 THEN ' Document 7' ELSE '' END"
Q["source_label"] = (
    lambda s, d: C.source_label(fx(s, d, "fx_chunks").selectExpr("doc_id", f"{_PROV} AS provision", f"{_TITLE} AS title", "CASE WHEN doc_id % 10 = 0 THEN 'crumb' ELSE '' END AS breadcrumb")).select("doc_id", "label"),
    duck("fx_chunks") + f""", t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'crumb' ELSE '' END AS b,
  trim(regexp_replace(regexp_replace({_PROV}, '(?i)^s\\.(\\d+)', 'Section \\1'), '(?i)^sec\\.?\\s*(\\d+)', 'Section \\1')) AS p, CASE doc_id % 4 WHEN 0 THEN source_title ELSE '' END AS t FROM fx_chunks)
SELECT doc_id, CASE WHEN b <> '' THEN b WHEN t <> '' AND p <> '' AND t <> p THEN concat(t, ' — ', p) WHEN t <> '' THEN t WHEN p <> '' THEN p ELSE 'Statutory Provision' END AS label FROM t""",
)
_CIT = [
    "doc_id AS n", f"{_CID} AS id", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source_title END AS title", "section AS provision",
    "CASE doc_id % 4 WHEN 0 THEN 'p. ? to ?' WHEN 1 THEN ' 12 ' WHEN 2 THEN 'N/A' END AS page_number", "'3 to 4' AS pages",
    "CASE doc_id % 7 WHEN 0 THEN 'patents-3d' WHEN 1 THEN 'unmapped' END AS statute", "'II' AS chapter", "text",
]
NCOLS = ["n_id", "n_chunk_id", "n_doc_id", "n_title", "n_section", "n_page", "n_authority", "n_area", "n_breadcrumb", "n_document_type", "n_status"]


def normalised(s, d):
    return C.normalise_citation(fx(s, d, "fx_chunks").selectExpr(*_CIT))


_BY_AUTH = "CASE WHEN contains(u, 'ABS') OR contains(u, 'BDA') THEN 'National Biodiversity Authority (NBA) · MoEFCC' WHEN contains(u, 'PAT') THEN 'Office of the Controller General of Patents, Designs & Trade Marks (CGPDTM)' WHEN contains(u, 'TKDL') THEN 'CSIR · Traditional Knowledge Digital Library' WHEN statute IS NOT NULL THEN 'Government of India · Ministry of Law & Justice' END"
_BY_AREA = "CASE WHEN contains(u, 'ABS') OR contains(u, 'BDA') THEN 'Access & Benefit Sharing (Biological Diversity Act, 2002)' WHEN contains(u, 'PAT') THEN 'Patentability Exclusions & Traditional Knowledge (Patents Act, 1970)' WHEN statute = 'patents-3d' THEN 'Phytopharmaceuticals · Isolated fractions · Novel extracts and nano-forms' ELSE 'Indian Intellectual Property & Statutory Grounding' END"
Q["normalise_citation"] = (
    lambda s, d: normalised(s, d).select("n", *NCOLS),
    duck("fx_chunks") + ", t AS (SELECT " + ", ".join(_CIT) + f""" FROM fx_chunks), t2 AS (SELECT *, upper(id) AS u FROM t)
SELECT n, id AS n_id, id AS n_chunk_id, id AS n_doc_id, coalesce(nullif(title, ''), 'Official Legal Record') AS n_title, provision AS n_section,
  CASE n % 4 WHEN 1 THEN '12' WHEN 3 THEN '3 to 4' END AS n_page, {_BY_AUTH} AS n_authority, {_BY_AREA} AS n_area,
  CASE WHEN statute = 'patents-3d' THEN 'Chapter II, Section 3(d) with Explanation' ELSE 'Chapter II' END AS n_breadcrumb,
  CASE WHEN statute IS NOT NULL THEN 'Principal Statutory Enactment (Bare Act)' ELSE 'Official Statutory Record / Regulatory Guideline' END AS n_document_type,
  CASE WHEN statute = 'patents-3d' THEN 'In force' ELSE 'In Force' END AS n_status FROM t2""",
)


def full_texts(s, d):
    bodies = {i: f"body of {i}" for i in K.STATUTE_IDS}
    return C.full_text(normalised(s, d), C.statute_catalog(s, bodies)).select("n", "full_text")


Q["full_text"] = (
    full_texts,
    duck("fx_chunks") + f", t AS (SELECT doc_id AS n, upper({_CID}) AS u, CASE doc_id % 7 WHEN 0 THEN 'patents-3d' END AS st FROM fx_chunks) "
    "SELECT n, concat('body of ', coalesce(st, CASE WHEN contains(u, 'PAT-3P') THEN 'patents-3p' WHEN contains(u, 'ABS-001') THEN 'bda-6' END)) AS full_text FROM t "
    "WHERE coalesce(st, CASE WHEN contains(u, 'PAT-3P') THEN 'patents-3p' WHEN contains(u, 'ABS-001') THEN 'bda-6' END) IS NOT NULL "
    "UNION ALL SELECT n, NULL FROM t WHERE coalesce(st, CASE WHEN contains(u, 'PAT-3P') THEN 'patents-3p' WHEN contains(u, 'ABS-001') THEN 'bda-6' END) IS NULL",
)


def conversations(s, d):
    m = fx(s, d, "fx_turns").selectExpr("conv_id", "turn", "role", "text", "conv_id * 7 % 101 AS updated")
    return C.conversation_index(m)


_TAG = first_of("lower(f)", K.TAG_RULES, f"'{K.TAG_DEFAULT}'")
Q["conversation_index"] = (
    conversations,
    duck("fx_turns") + f""", c AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS f, any_value(conv_id * 7 % 101) AS updated, count(*) AS n_messages FROM fx_turns GROUP BY conv_id),
t AS (SELECT conv_id, regexp_replace({duck_strip('f')}, '\\s+', ' ', 'g') AS x, f, updated, n_messages FROM c WHERE f IS NOT NULL)
SELECT conv_id, CASE WHEN length(x) > 42 THEN concat(substring(x, 1, 42), '…') ELSE x END AS title, {_TAG} AS tag, updated, n_messages FROM t ORDER BY updated DESC, conv_id DESC LIMIT 40""",
)

# --- audits ------------------------------------------------------------------------------
_REQ = ["doc_id AS query_id", "text AS abstract", "CASE doc_id % 3 WHEN 0 THEN 'Classical ASU' WHEN 1 THEN 'health food' ELSE 'novel' END AS classification",
        "CASE WHEN doc_id % 2 = 0 THEN 'synergy shown' END AS synergy", "concat('neem, ', source) AS ingredients_text"]


def requests(s, d):
    return table(s, d, "documents").selectExpr(*_REQ)


Q["audit_queries"] = (
    lambda s, d: A.audit_queries(requests(s, d)).select("query_id", "area_ix", "legal_area", F.sha2("query_text", 256).alias("text_hash"), F.sha2("query", 256).alias("query_hash"), "rerank_category"),
    "WITH r AS (SELECT " + ", ".join(_REQ) + f""" FROM documents)
SELECT query_id, CAST(a AS INT) AS area_ix, ['patent', 'abs', 'drug_regulation'][a + 1] AS legal_area,
  sha256(CASE a WHEN 0 THEN concat('{K.AUDIT_PATENT}', substring(abstract, 1, 150)) WHEN 1 THEN concat('{K.AUDIT_ABS}', ingredients_text) ELSE concat('{K.AUDIT_REGULATION}', classification) END) AS text_hash,
  sha256(concat_ws(' ', abstract, ingredients_text, coalesce(synergy, ''))) AS query_hash,
  CASE query_id % 3 WHEN 0 THEN 'classical' WHEN 1 THEN 'ayurveda-aahar' ELSE 'proprietary' END AS rerank_category FROM r, range(0, 3) AS x(a)""",
)


def audit_context(s, d):
    from checks.ranking import reranked

    return A.audit_context(reranked(s, d)).select("query_id", F.sha2("context", 256).alias("context_hash"), F.array_join("source_ids", "|").alias("source_ids"))


def _audit_context_sql():
    from checks.ranking import _DEDUP_SQL

    return _DEDUP_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY area_ix, position) AS k FROM kept),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY area_ix, position) AS no FROM f WHERE k = 1)
SELECT query_id, sha256(string_agg(concat('[', section, ' - ', title, ']', chr(10), substring(text, 1, 400), CASE WHEN length(text) > 400 THEN '...' ELSE '' END), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY no)) AS context_hash,
  string_agg(chunk_id, '|' ORDER BY no) AS source_ids FROM u WHERE no <= 6 GROUP BY query_id"""


Q["audit_context"] = (audit_context, _audit_context_sql())
_REPLY = (
    "CASE doc_id % 5 WHEN 0 THEN 'no json here' WHEN 1 THEN concat('Sure: {{\"verdict\": \"Likely Blocked\", \"tkdl_band\": \"Clear — x\", \"analysis\": \"', source, '\"}} done') "
    "WHEN 2 THEN '{{\"verdict\": 3, \"s3e_band\": null}}' WHEN 3 THEN '{{\"tkdl_band\": \"x\"}}' ELSE '{{broken' END"
).replace("{{", "{").replace("}}", "}")
VCOLS = ["verdict", "tkdl_band", "s3e_band", "nba_band", "analysis"]


def verdicts(s, d):
    r = table(s, d, "documents").select("doc_id", F.expr(_REPLY).alias("reply"))
    return A.audit_report(r.select("doc_id", A.parse_verdict(F.col("reply")).alias("v")).select("doc_id", "v.*"))


_NA, _FL = "Assessment unavailable — see analysis below", "Assessment unavailable — see raw analysis below"
Q["parse_verdict"] = (
    lambda s, d: verdicts(s, d).select("doc_id", *VCOLS),
    f"""WITH r AS (SELECT doc_id, source, {_REPLY} AS reply FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'Likely Blocked' WHEN 2 THEN '3' ELSE 'Assessment Unavailable' END AS verdict,
  CASE doc_id % 5 WHEN 1 THEN 'Clear — x' WHEN 2 THEN '{_NA}' ELSE '{_FL}' END AS tkdl_band,
  CASE doc_id % 5 WHEN 1 THEN '{_NA}' WHEN 2 THEN 'None' ELSE '{_FL}' END AS s3e_band,
  CASE doc_id % 5 WHEN 1 THEN '{_NA}' WHEN 2 THEN '{_NA}' ELSE '{_FL}' END AS nba_band,
  CASE doc_id % 5 WHEN 1 THEN source ELSE reply END AS analysis FROM r""",
)
Q["audit_report"] = (
    lambda s, d: verdicts(s, d).select("doc_id", F.sha2("report", 256).alias("report_hash")),
    "WITH v AS (" + Q["parse_verdict"][1] + """) SELECT doc_id, sha256(concat('**Formulation Audit — ', verdict, '** 🇮🇳 India Domestic Analysis', chr(10), chr(10),
  '**Section 3(p) / TKDL Bar:** ', tkdl_band, chr(10), chr(10), '**Section 3(e) / Synergy:** ', s3e_band, chr(10), chr(10), '**NBA Form III / Section 6:** ', nba_band, chr(10), chr(10), analysis)) AS report_hash FROM v""",
)

# --- sessions ----------------------------------------------------------------------------


def session_turns(s, d):
    return fx(s, d, "fx_session_events").select("session_id", "turn_index", "text")


SESSION = ["session_id", "turn_index", "status", "clarification_round", "awaiting", "category", "route_of_administration"]
#: What the rules give for the five remarks of the adapter: intent, description, mention, then slots (route, category, jurisdiction, use), then rules (category, route).
_REMARKS = """(VALUES
  ('it is an oral capsule', 'other', true, NULL, 'oral', NULL, NULL, NULL, 'unclassified', 'oral'),
  ('a proprietary neem cream', 'other', true, NULL, 'external', 'proprietary', NULL, NULL, 'proprietary', 'external'),
  ('for india, therapeutic', 'other', false, 'Europe', NULL, NULL, 'india', 'medicine', NULL, NULL),
  ('can i patent my herbal mixture', 'patentability', true, NULL, NULL, NULL, NULL, NULL, 'unclassified', 'unknown'),
  ('unrelated remark', 'other', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
) AS x(text, t_intent, t_desc, t_mention, s_route, s_cat, s_jur, s_use, t_cat, t_route)"""
_SESSION_SQL = f"""
, turns AS (SELECT e.session_id, e.turn_index, row_number() OVER (PARTITION BY e.session_id ORDER BY e.turn_index) AS no, x.* FROM fx_session_events e JOIN {_REMARKS} ON x.text = e.text),
steps AS (
  SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(0 AS BIGINT) AS turn_index, CAST(0 AS BIGINT) AS no, 'x' AS status, 0 AS clarification_round, false AS awaiting, '' AS pending,
    'other' AS intent, false AS has_desc, CAST(NULL AS VARCHAR) AS r_cat, CAST(NULL AS VARCHAR) AS r_route, 'unclassified' AS category, 'unknown' AS route,
    CAST(NULL AS VARCHAR) AS f_cat, CAST(NULL AS VARCHAR) AS f_route, CAST(NULL AS VARCHAR) AS f_jur, CAST(NULL AS VARCHAR) AS f_use, false AS f_desc
  FROM (SELECT DISTINCT session_id FROM turns)
  UNION ALL
  SELECT session_id, turn_index, no, CASE WHEN ask THEN 'needs_clarification' ELSE 'answered' END, clarification_round, ask, CASE WHEN ask THEN concat_ws('|', CASE WHEN need_cat THEN 'category' END, CASE WHEN need_route THEN 'route_of_administration' END) ELSE '' END,
    intent, has_desc, r_cat, r_route, category, route, f_cat, f_route, f_jur, f_use, f_desc
  FROM (SELECT *, (need_cat OR need_route) AND intent NOT IN ('other', 'general_info') AND clarification_round < 2 AS ask FROM (
    SELECT *, category = 'unclassified' AND f_cat IS NULL AND has_desc AS need_cat, category = 'proprietary' AND intent = 'compliance' AND route = 'unknown' AND f_route IS NULL AND has_desc AS need_route FROM (
      SELECT * REPLACE (coalesce(f_cat, CASE WHEN has_desc AND r_cat <> 'unclassified' THEN r_cat END, category) AS category, coalesce(f_route, CASE WHEN has_desc AND r_route <> 'unknown' THEN r_route END, route) AS route) FROM (
        SELECT s.session_id, t.turn_index, t.no, s.clarification_round + CAST(s.awaiting AS INT) AS clarification_round, CASE WHEN s.awaiting THEN s.intent ELSE t.t_intent END AS intent,
          CASE WHEN s.awaiting THEN s.has_desc ELSE s.f_desc OR t.t_desc END AS has_desc, CASE WHEN NOT s.awaiting AND t.t_desc THEN t.t_cat ELSE s.r_cat END AS r_cat, CASE WHEN NOT s.awaiting AND t.t_desc THEN t.t_route ELSE s.r_route END AS r_route,
          s.category, s.route, CASE WHEN s.awaiting THEN coalesce(t.s_cat, s.f_cat) ELSE s.f_cat END AS f_cat, CASE WHEN s.awaiting THEN coalesce(t.s_route, s.f_route) ELSE s.f_route END AS f_route,
          CASE WHEN s.awaiting THEN coalesce(t.s_jur, s.f_jur) ELSE coalesce(s.f_jur, t.t_mention) END AS f_jur, CASE WHEN s.awaiting THEN coalesce(t.s_use, s.f_use) ELSE s.f_use END AS f_use, s.f_desc OR (NOT s.awaiting AND t.t_desc) AS f_desc
        FROM steps s JOIN turns t ON CAST(t.session_id AS VARCHAR) = s.session_id AND t.no = s.no + 1))))
)
SELECT session_id, turn_index, status, clarification_round, awaiting, category, route AS route_of_administration, pending, coalesce(f_cat, '') AS f_category, coalesce(f_route, '') AS f_route, coalesce(f_jur, '') AS f_jurisdiction, coalesce(f_use, '') AS f_use FROM steps WHERE no > 0"""


def session_rows(out):
    fact = lambda k, n: F.coalesce(F.try_element_at("known_facts", F.lit(k)), F.lit("")).alias(n)
    facts = [fact("category", "f_category"), fact("route_of_administration", "f_route"), fact("jurisdiction", "f_jurisdiction"), fact("intended_use", "f_use")]
    return out.select(*SESSION, F.array_join("pending", "|").alias("pending"), *facts)


Q["session_batch"] = (lambda s, d: session_rows(session_machine_batch(session_turns(s, d))), duck("fx_session_events").replace("WITH ", "WITH RECURSIVE ", 1) + _SESSION_SQL)


def _stream(s, d, name):
    """The adapter as a stream over a copy of the table's schema and folder."""
    path = f"{d}/events.parquet"
    raw = s.readStream.schema(s.read.parquet(path).schema).parquet(os.path.dirname(path) + "/[e]vents.parquet")
    return raw.selectExpr(
        "user_id AS session_id", "event_id AS turn_index", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'click' THEN 'it is an oral capsule' WHEN 'view' THEN 'a proprietary neem cream' WHEN 'purchase' THEN 'for india, therapeutic' "
        "WHEN 'signup' THEN 'can i patent my herbal mixture' ELSE 'unrelated remark' END AS text",
    )


def _run(s, df, mode="append"):
    """Run a stream over all available input into parquet and read it back."""
    out = f"{shared_folder(s)}/lexloom-stream-{os.urandom(6).hex()}"
    before = s.conf.get("spark.sql.shuffle.partitions")
    if s.sparkContext.master.startswith("local"):  # one state store per core is enough on one machine
        s.conf.set("spark.sql.shuffle.partitions", str(s.sparkContext.defaultParallelism))
    try:
        q = (
            df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", out + "/_state")
            .option("path", out + "/rows").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        s.conf.set("spark.sql.shuffle.partitions", before)
    return s.read.schema(df.schema).parquet(out + "/rows")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_stream(s, d):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return session_rows(_run(s, session_machine(_stream(s, d, "events").select("session_id", "turn_index", "text"))))


Q["session_stream"] = (session_stream, Q["session_batch"][1])
Q["turn_log"] = (
    lambda s, d: _run(s, turn_log(_stream(s, d, "events"))).select("session_id", "turn_index", "text"),
    duck("fx_session_events") + " SELECT session_id, turn_index, text FROM fx_session_events",
)

# --- flows -------------------------------------------------------------------------------


def flagship(s, d):
    """Every vector as a question: filtered exact top-k, signals, best evidence, guardrail."""
    v = fx(s, d, "fx_vec_chunks")
    q = v.selectExpr(
        "vec_id AS query_id", "0 AS area_ix", "CASE legal_area WHEN 'biodiversity' THEN 'abs' WHEN 'regulation' THEN 'drug_regulation' ELSE legal_area END AS legal_area",
        "CASE vec_id % 3 WHEN 0 THEN 'classical' WHEN 1 THEN 'proprietary' ELSE 'unclassified' END AS product_category", "embedding",
    )
    hits = V.filtered_topk(V.route(q), v.withColumnRenamed("vec_id", "chunk_id"), 5)
    hits = hits.join(q.select("query_id", "legal_area"), "query_id").join(v.selectExpr("vec_id AS chunk_id", "legal_area AS chunk_area"), "chunk_id")
    score = F.bround(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), 4)
    ev = hits.select(
        "query_id", "chunk_id", S.s_relevance(score).alias("relevance"),
        S.s_applicability(F.array().cast("array<string>"), F.col("chunk_area"), F.array("legal_area")).alias("applicability_score"),
    )
    ev = ev.withColumn("final_score", 0.9 * F.col("relevance") + 0.1 * F.col("applicability_score"))
    out = guardrail(q.select("query_id", F.lit("grounded").alias("answer")), ev)
    agg = ev.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("final_score"), 4).alias("best"))
    return out.join(agg, "query_id").select("query_id", "n", "best", "passed")


Q["flagship"] = (
    flagship,
    duck("fx_vec_chunks") + VEC_SQL + f"""
, pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.legal_area AS qa, c.legal_area AS ca, round(list_inner_product(q.v, c.v), 9) AS s FROM v q JOIN v c ON {AREA_OK}),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 5),
ar AS (SELECT *, CASE qa WHEN 'biodiversity' THEN 'abs' WHEN 'regulation' THEN 'drug_regulation' ELSE qa END AS a FROM top),
ev AS (SELECT query_id, round(1 / (1 + exp(-16 * (round(least(greatest(s, 0), 1), 4) - 0.55))), 4) AS rel, CASE WHEN ca = a THEN 1.0::DOUBLE WHEN contains(ca, a) OR contains(a, ca) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS ap FROM ar)
SELECT query_id, count(*) AS n, round(max(0.9::DOUBLE * rel + 0.1::DOUBLE * ap), 4) AS best, avg(0.9::DOUBLE * rel + 0.1::DOUBLE * ap) >= 0.25 AND avg(ap) >= 0.3 AS passed FROM ev GROUP BY query_id""",
)


def corpus(s, d):
    c = fx(s, d, "fx_chunks").selectExpr(
        "chunk_id", "CASE WHEN legal_area = 'biodiversity' THEN 'abs' ELSE 'legal_acts_patent' END AS collection_name", "legal_area", "applicable_product",
        "jurisdiction", "authority_level", "document_type", "section", "source_title", "text",
    )
    return V.embed(c, "text", dim=128)


def answered(s, d):
    q = fx(s, d, "fx_queries").select("query_id", "query")
    out = chat_result(answer(q, corpus(s, d), dim=128, verify=True))
    hashes = [F.sha2(c, 256).alias(f"{c}_hash") for c in ("answer", "sources", "questions")]
    return out.select("query_id", "status", *hashes)


def audited(s, d):
    return audit(requests(s, d), corpus(s, d), dim=128).select("query_id", "verdict", F.size("source_ids").alias("n_sources"), F.length("context").alias("context_length"))


Q["answer_questions"] = (answered, None)
Q["audit_requests"] = (audited, None)
