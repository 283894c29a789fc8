"""Pages, lines, headings, validation and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import duck, duck_strip, fx, table
from lexloom.functions import constants as K
from lexloom.operators import hierarchy as H
from lexloom.operators import structure as L

Q: dict = {}


def words(spark, sf):
    return fx(spark, sf, "fx_words")


MODAL_SQL = """
, counts AS (SELECT doc_id, page, CAST(round(size) AS INT) AS sz, count(*) AS n, min(word_ix) AS f FROM fx_words WHERE size <> 0 GROUP BY ALL),
modal AS (SELECT doc_id, page, sz AS modal_size FROM counts QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, f) = 1)"""

Q["modal_font_size"] = (
    lambda s, d: L.modal_font_size(words(s, d)),
    duck("fx_words") + MODAL_SQL + " SELECT doc_id, page, modal_size FROM modal",
)

Q["assemble_lines"] = (
    lambda s, d: L.assemble_lines(words(s, d)),
    duck("fx_words") + MODAL_SQL + """
, lines AS (SELECT doc_id, page, CAST(round(top) AS INT) AS y, string_agg(text, ' ' ORDER BY word_ix) AS line,
    max(CAST(round(size) AS INT)) AS sz, bool_or(contains(lower(fontname), 'bold')) AS bold FROM fx_words GROUP BY ALL),
parts AS (SELECT l.*, modal_size, CASE WHEN sz > modal_size OR bold
    THEN concat(chr(10), '<<<HEADING>>>', line, '<<<END_HEADING>>>') ELSE line END AS part FROM lines l JOIN modal USING (doc_id, page))
SELECT doc_id, page, string_agg(part, chr(10) ORDER BY y) AS text, any_value(modal_size) AS modal_size,
    (SELECT max(w.page) FROM fx_words w WHERE w.doc_id = parts.doc_id) AS total_pages FROM parts GROUP BY doc_id, page""",
)

OFFSETS_SQL = """
, offsets AS (SELECT doc_id, page, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS "end" FROM fx_pages)"""

Q["page_offsets"] = (
    lambda s, d: L.page_offsets(fx(s, d, "fx_pages")),
    duck("fx_pages") + OFFSETS_SQL + ' SELECT doc_id, page, start, "end" FROM offsets',
)
Q["concat_pages"] = (
    lambda s, d: L.concat_pages(fx(s, d, "fx_pages"))[0],
    "SELECT doc_id, text FROM documents",
)

LINES_SQL = """
, spans AS (SELECT doc_id, line_no, line AS text, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM fx_lines)"""

Q["split_lines"] = (
    lambda s, d: L.split_lines(table(s, d, "documents")).drop("is_heading"),
    duck("fx_lines") + LINES_SQL
    + " SELECT doc_id, line_no, text, start_char, start_char + length(text) AS end_char FROM spans",
)


def page_range(s, d):
    lines = L.split_lines(table(s, d, "documents")).select("doc_id", "line_no", "start_char", "end_char")
    return L.page_range(lines, L.page_offsets(fx(s, d, "fx_pages")))


Q["page_range"] = (
    page_range,
    duck("fx_lines", "fx_pages") + LINES_SQL + OFFSETS_SQL + """
, s2 AS (SELECT doc_id, line_no, start_char, start_char + length(text) AS end_char FROM spans)
SELECT doc_id, line_no, start_char, end_char,
  coalesce((SELECT max(page) FROM offsets o WHERE o.doc_id = s2.doc_id AND s2.start_char BETWEEN o.start AND o."end"), 1) AS start_page,
  coalesce((SELECT max(page) FROM offsets o WHERE o.doc_id = s2.doc_id AND s2.end_char BETWEEN o.start AND o."end"), 1) AS end_page FROM s2""",
)

TOC = (
    "SELECT doc_id, page AS entry_ix, 1 + page % 2 AS level, "
    "CASE page % 3 WHEN 1 THEN concat(' Chapter ', CAST(page AS STRING), ' of it') WHEN 2 THEN 'Notes' ELSE 'topic' END AS title, page FROM {p}"
)


def toc(s, d):
    return s.sql(TOC, p=fx(s, d, "fx_pages"))


def chapter_asof(s, d):
    probes = fx(s, d, "fx_pages").select("doc_id", "page")
    t = toc(s, d)
    return L.entry_for_page(L.chapter_for_page(probes, t), t)


Q["chapter_asof"] = (
    chapter_asof,
    duck("fx_pages") + ", toc AS (" + TOC.replace("{p}", "fx_pages") + """),
ix AS (SELECT doc_id, page, upper(trim(title)) AS chapter FROM toc WHERE level = 1 OR regexp_matches(trim(title), '(?i)^chapter\\s+[IVXLCDM0-9]+'))
SELECT p.doc_id, p.page, i.chapter, t.level AS entry_level, trim(t.title) AS entry_title, t.page AS entry_page
FROM fx_pages p ASOF LEFT JOIN ix i ON p.doc_id = i.doc_id AND p.page >= i.page ASOF LEFT JOIN toc t ON p.doc_id = t.doc_id AND p.page >= t.page""",
)
Q["toc_body_start"] = (
    lambda s, d: L.body_start(toc(s, d)),
    duck("fx_pages") + ", toc AS (" + TOC.replace("{p}", "fx_pages")
    + ") SELECT doc_id, min(page) AS body_page FROM toc WHERE level = 1 OR regexp_matches(trim(title), '(?i)^chapter\\s+[IVXLCDM0-9]+') GROUP BY doc_id",
)

# --- detection ---------------------------------------------------------------------------
CAND = ["doc_id", "node_type", "number", "title", "start_char", "end_char", "is_sequential", "confidence"]


def _re2(t: str, p: str) -> str:
    flag = "" if t == "section" else "(?i)"
    return (flag + p).replace("[^<<<]", "[^<]").replace("'", "''")


def _match(col: str, patterns, field: int) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({col}, '{_re2(t, p)}') THEN " + (f"'{t}'" if field == 0 else f"regexp_extract({col}, '{_re2(t, p)}', {field})")
        for t, p in patterns
    )
    return f"CASE {whens} END"


def _candidates_sql(source: str, marked: bool) -> str:
    line = "regexp_extract(line, '<<<HEADING>>>(.*)<<<END_HEADING>>>', 1)" if marked else "line"
    pats = K.HEADING_PATTERNS if marked else K.PLAIN_PATTERNS
    h = duck_strip(line) if marked else line
    bonus = "0.30::DOUBLE" if marked else "0::DOUBLE"
    return f"""
, dl AS (SELECT doc_id, i, l[i] AS line, length(text) AS size FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {source}), range(1, len(l) + 1) AS r(i)),
dp AS (SELECT *, {h} AS h, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM dl),
dm AS (SELECT *, {_match('h', pats, 0)} AS node_type, {_match('h', pats, 1)} AS number, nullif({duck_strip(_match('h', pats, 2))}, '') AS title FROM dp),
dk AS (SELECT doc_id, node_type, number, title, start_char, size FROM dm WHERE node_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, node_type, number ORDER BY start_char DESC) = 1),
db AS (SELECT *, coalesce(lead(start_char) OVER (PARTITION BY doc_id ORDER BY start_char), size) AS end_char,
  coalesce(TRY_CAST(regexp_extract(number, '^(\\d+)', 1) AS BIGINT) - TRY_CAST(regexp_extract(lag(number) OVER (PARTITION BY doc_id, node_type ORDER BY start_char), '^(\\d+)', 1) AS BIGINT) IN (0, 1), false) AS is_sequential FROM dk),
cands AS (SELECT *, least(greatest(0.5::DOUBLE + {bonus} + CASE WHEN is_sequential THEN 0.2::DOUBLE ELSE 0::DOUBLE END + 0::DOUBLE
  - CASE WHEN length(coalesce(title, '')) > 120 THEN 0.1::DOUBLE ELSE 0::DOUBLE END - CASE WHEN length(coalesce(title, '')) > 200 THEN 0.2::DOUBLE ELSE 0::DOUBLE END, 0), 1) AS confidence FROM db)"""


Q["candidates_marked"] = (
    lambda s, d: L.detect_candidates(fx(s, d, "fx_marked")).select(*CAND),
    duck("fx_marked") + _candidates_sql("fx_marked", True) + f" SELECT {', '.join(CAND)} FROM cands",
)
Q["candidates_plain"] = (
    lambda s, d: L.detect_candidates(fx(s, d, "fx_plain")).select(*CAND),
    duck("fx_plain") + _candidates_sql("fx_plain", False) + f" SELECT {', '.join(CAND)} FROM cands",
)


def cands_with_toc(s, d):
    docs = fx(s, d, "fx_marked")
    return L.detect_candidates(docs, toc(s, d)).groupBy("node_type").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total")
    )


Q["candidates_toc_confirmed"] = (
    cands_with_toc,
    duck("fx_marked", "fx_pages") + _candidates_sql("fx_marked", True) + ", toc AS (" + TOC.replace("{p}", "fx_pages") + """),
has AS (SELECT DISTINCT doc_id FROM toc WHERE level = 1 OR regexp_matches(trim(title), '(?i)^chapter\\s+[IVXLCDM0-9]+'))
SELECT node_type, count(*) AS n, round(sum(CASE WHEN node_type = 'chapter' AND doc_id IN (SELECT doc_id FROM has)
  THEN least(1.0::DOUBLE, confidence + 0.2::DOUBLE) ELSE confidence END), 4) AS total FROM cands GROUP BY node_type""",
)
Q["number_gaps"] = (
    lambda s, d: L.number_gaps(L.detect_candidates(fx(s, d, "fx_plain")), 2),
    duck("fx_plain") + _candidates_sql("fx_plain", False) + """
, nums AS (SELECT DISTINCT doc_id, node_type, TRY_CAST(regexp_extract(number, '^(\\d+)', 1) AS BIGINT) AS n FROM cands),
nx AS (SELECT *, lead(n) OVER (PARTITION BY doc_id, node_type ORDER BY n) AS nn FROM nums WHERE n IS NOT NULL)
SELECT doc_id, node_type, CAST(g AS BIGINT) AS missing FROM nx, range(n + 1, nn) AS r(g) WHERE nn - n > 2""",
)


def validated(s, d):
    docs = fx(s, d, "fx_plain")
    return L.validate(L.detect_candidates(docs), docs)


_REPEALED = "(?i)\\b(omit|omitted|repeal|repealed|deleted)\\b"
VALID_SQL = f"""
, cut AS (SELECT c.*, {duck_strip('substring(d.text, c.start_char + 1, c.end_char - c.start_char)')} AS chunk FROM cands c JOIN fx_plain d USING (doc_id)),
valid AS (SELECT *, CASE WHEN confidence < 0.7 AND NOT (regexp_matches(chunk, '{_REPEALED}') OR coalesce(regexp_matches(title, '{_REPEALED}'), false)) THEN 'low_confidence'
  WHEN length(chunk) < 10 AND NOT regexp_matches(chunk, '{_REPEALED}') THEN 'too_short' ELSE 'accepted' END AS outcome FROM cut)"""

Q["validate_candidates"] = (
    lambda s, d: validated(s, d).select("doc_id", "node_type", "number", "start_char", "outcome"),
    duck("fx_plain") + _candidates_sql("fx_plain", False) + VALID_SQL + " SELECT doc_id, node_type, number, start_char, outcome FROM valid",
)
def half_source(s, d):
    """Candidates held against the first half of their text only."""
    docs = fx(s, d, "fx_plain")
    half = docs.select("doc_id", F.expr("substring(text, 1, CAST(floor(length(text) / 2) AS INT))").alias("text"))
    return L.validate(L.detect_candidates(docs), docs, half)


def _single(col: str) -> str:
    return f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"


Q["validate_other_source"] = (
    lambda s, d: half_source(s, d).select("doc_id", "node_type", "number", "start_char", "outcome"),
    duck("fx_plain") + _candidates_sql("fx_plain", False) + VALID_SQL + f"""
, src AS (SELECT doc_id, {_single("substring(text, 1, CAST(floor(length(text) / 2) AS INT))")} AS src FROM fx_plain)
SELECT doc_id, node_type, number, start_char, CASE WHEN outcome = 'accepted' AND NOT contains(src, {_single("substring(chunk, 1, 500)")})
  THEN 'not_in_source' ELSE outcome END AS outcome FROM valid JOIN src USING (doc_id)""",
)
Q["validation_summary"] = (
    lambda s, d: L.validation_summary(validated(s, d)),
    duck("fx_plain") + _candidates_sql("fx_plain", False) + VALID_SQL + """
SELECT doc_id, count(*) AS n_candidates, count(*) FILTER (outcome = 'accepted') AS n_accepted,
  count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS n_reviewed, count(*) FILTER (outcome <> 'accepted') AS n_rejected FROM valid GROUP BY doc_id""",
)


def slices(s, d):
    docs = fx(s, d, "fx_marked")
    return H.slice_text(L.detect_candidates(docs), docs).select("doc_id", "node_type", "number", "original_text", "text")


Q["slice_text"] = (
    slices,
    duck("fx_marked") + _candidates_sql("fx_marked", True) + f"""
, cut AS (SELECT c.*, substring(d.text, c.start_char + 1, c.end_char - c.start_char) AS original_text FROM cands c JOIN fx_marked d USING (doc_id))
SELECT doc_id, node_type, number, original_text, {duck_strip("replace(replace(original_text, '<<<END_HEADING>>>', ''), '<<<HEADING>>>', '')")} AS text FROM cut""",
)


LEGACY_LINE = r"^(\d{1,3}[A-Z]{0,2})\.\s+([A-Za-z].{3,200}?)[.—–:-]\s*$"


def legacy(s, d):
    docs = fx(s, d, "fx_plain")
    return L.detect_sections_legacy(docs)


LEGACY_SQL = f"""
, ll AS (SELECT doc_id, i, l[i] AS line, len(l) AS n, length(text) AS size FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM fx_plain), range(1, len(l) + 1) AS r(i)),
lp AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) - 1 AS start_char FROM ll),
lm AS (SELECT *, regexp_extract(line, '{LEGACY_LINE}', 1) AS section_number, {duck_strip(f"regexp_extract(line, '{LEGACY_LINE}', 2)")} AS section_title FROM lp
  WHERE i > 1 AND i < n AND regexp_matches(line, '{LEGACY_LINE}')),
lk AS (SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY doc_id, section_number ORDER BY start_char DESC) = 1),
legacy AS (SELECT doc_id, section_number, section_title, start_char, coalesce(lead(start_char) OVER (PARTITION BY doc_id ORDER BY start_char), size) AS end_char FROM lk)"""
LCOLS = ["doc_id", "section_number", "section_title", "start_char", "end_char"]
# The adapter numbers chapters in digits, which the legacy chapter pattern does not take.
Q["sections_legacy"] = (
    lambda s, d: legacy(s, d).select(*LCOLS), duck("fx_plain") + LEGACY_SQL + f" SELECT {', '.join(LCOLS)} FROM legacy",
)
Q["missing_chapters"] = (
    lambda s, d: L.missing_chapters(legacy(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_missing")),
    duck("fx_plain") + LEGACY_SQL + " SELECT doc_id, count(*) AS n_missing FROM legacy GROUP BY doc_id",
)
Q["validate_legacy"] = (
    lambda s, d: L.validate_legacy(legacy(s, d), fx(s, d, "fx_plain")).select("doc_id", "section_number", "section_title", "text"),
    duck("fx_plain") + LEGACY_SQL + f"""
, cut AS (SELECT l.*, {duck_strip('substring(d.text, l.start_char + 1, l.end_char - l.start_char)')} AS c FROM legacy l JOIN fx_plain d USING (doc_id)),
ok AS (SELECT *, regexp_matches(c, '{_REPEALED}') OR regexp_matches(section_title, '{_REPEALED}') AS gone FROM cut)
SELECT doc_id, section_number, section_title, CASE WHEN length(c) < 20 THEN concat('[STATUS: REPEALED/OMITTED] ', coalesce(nullif(c, ''), section_title))
  ELSE regexp_replace(regexp_replace(c, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\[\\d+\\]', '', 'g') END AS text FROM ok WHERE length(c) >= 20 OR gone""",
)


def section_docs(s, d):
    docs = fx(s, d, "fx_plain")
    return H.section_docs(L.validate_legacy(legacy(s, d), docs), L.page_offsets(fx(s, d, "fx_pages")), toc(s, d)).drop("text")


Q["section_docs"] = (
    section_docs,
    "WITH " + Q["validate_legacy"][1].removeprefix("WITH ").rsplit("SELECT doc_id, section_number", 1)[0].rstrip() + """,
vt AS (SELECT doc_id, section_number, section_title, start_char, end_char, CASE WHEN length(c) < 20 THEN concat('[STATUS: REPEALED/OMITTED] ', coalesce(nullif(c, ''), section_title)) ELSE regexp_replace(c, '\\[\\d+\\]', '', 'g') END AS text FROM ok WHERE length(c) >= 20 OR gone),
""" + duck("fx_pages").removeprefix("WITH ") + OFFSETS_SQL + ", toc AS (" + TOC.replace("{p}", "fx_pages") + """),
ix AS (SELECT doc_id, page, upper(trim(title)) AS chapter FROM toc WHERE level = 1 OR regexp_matches(trim(title), '(?i)^chapter\\s+[IVXLCDM0-9]+')),
pg AS (SELECT *, coalesce((SELECT max(page) FROM offsets o WHERE o.doc_id = vt.doc_id AND vt.start_char BETWEEN o.start AND o."end"), 1) AS start_page,
  coalesce((SELECT max(page) FROM offsets o WHERE o.doc_id = vt.doc_id AND vt.end_char BETWEEN o.start AND o."end"), 1) AS end_page FROM vt)
SELECT p.doc_id, section_number, section_title, concat('Section ', section_number) AS provision_ref, coalesce(i.chapter, 'N/A') AS chapter, start_page, end_page,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS INT) AS token_estimate FROM pg p ASOF LEFT JOIN ix i ON p.doc_id = i.doc_id AND p.start_page >= i.page""",
)
Q["from_legacy"] = (
    lambda s, d: L.from_legacy(legacy(s, d)).select("doc_id", "node_type", "number", "confidence", "detection_method", "parent_hint"),
    duck("fx_plain") + LEGACY_SQL + " SELECT doc_id, 'section' AS node_type, section_number AS number, 0.85::DOUBLE AS confidence, 'legacy' AS detection_method, CAST(NULL AS VARCHAR) AS parent_hint FROM legacy",
)

# --- trees -------------------------------------------------------------------------------
RANK = "CASE node_type WHEN 'document' THEN 0 WHEN 'part' THEN 1 WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'subsection' THEN 4 WHEN 'clause' THEN 5 WHEN 'subclause' THEN 6 WHEN 'paragraph' THEN 7 ELSE 8 END"
NODES_SQL = f"""
, nd AS (SELECT *, start_char AS node_ix, {RANK} AS rank, nullif(regexp_extract(number, '^(\\d+[A-Z]?)\\(', 1), '') AS prefix,
  regexp_replace(concat(doc_id, '_', node_type, '_', coalesce(nullif(number, ''), CAST(row_number() OVER (PARTITION BY doc_id, node_type ORDER BY start_char) - 1 AS VARCHAR))), '[^\\w\\-]', '_', 'g') AS node_id FROM fx_nodes),
shut AS (SELECT a.doc_id, a.node_ix, min(b.node_ix) AS closed_at FROM nd a LEFT JOIN nd b ON a.doc_id = b.doc_id AND b.node_ix > a.node_ix AND b.rank <= a.rank GROUP BY ALL),
open_nodes AS (SELECT nd.*, closed_at FROM nd JOIN shut USING (doc_id, node_ix)),
p1 AS (SELECT n.doc_id, n.node_ix, max(a.node_ix) AS up FROM nd n JOIN open_nodes a ON a.doc_id = n.doc_id AND a.node_ix < n.node_ix AND a.number = n.prefix AND (a.closed_at IS NULL OR a.closed_at >= n.node_ix) GROUP BY ALL),
p2 AS (SELECT n.doc_id, n.node_ix, max(a.node_ix) AS up FROM nd n JOIN nd a ON a.doc_id = n.doc_id AND a.node_ix < n.node_ix AND a.rank < n.rank GROUP BY ALL),
tree AS (SELECT nd.*, coalesce(p1.up, p2.up) AS parent_ix FROM nd LEFT JOIN p1 USING (doc_id, node_ix) LEFT JOIN p2 USING (doc_id, node_ix))"""
WALK_SQL = """
, walk AS (SELECT doc_id, node_ix, [node_ix] AS path, [struct_pack(t := node_type, l := coalesce(nullif(number, ''), title, ''))] AS steps FROM tree WHERE parent_ix IS NULL
  UNION ALL SELECT t.doc_id, t.node_ix, list_append(w.path, t.node_ix), list_append(w.steps, struct_pack(t := t.node_type, l := coalesce(nullif(t.number, ''), t.title, '')))
  FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.parent_ix = w.node_ix)"""


def nodes(s, d):
    return H.build_hierarchy(fx(s, d, "fx_nodes"))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


Q["hierarchy_parents"] = (
    lambda s, d: nodes(s, d).select("doc_id", "node_ix", "node_id", "rank", "parent_ix", "parent_id"),
    duck("fx_nodes") + NODES_SQL + """
SELECT t.doc_id, t.node_ix, t.node_id, t.rank, t.parent_ix, p.node_id AS parent_id FROM tree t LEFT JOIN nd p ON p.doc_id = t.doc_id AND p.node_ix = t.parent_ix""",
)
Q["tree_stats"] = (
    lambda s, d: H.tree_stats(nodes(s, d)),
    duck("fx_nodes") + NODES_SQL
    + " SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (parent_ix IS NULL) AS n_roots, max(rank) AS deepest_rank FROM tree GROUP BY doc_id",
)
Q["preorder"] = (
    lambda s, d: H.preorder(nodes(s, d)).select(
        "doc_id", "node_ix", F.array_join(F.transform("order_key", lambda x: x.cast("string")), "/").alias("order_key"), "depth"
    ),
    recursive(duck("fx_nodes") + NODES_SQL + WALK_SQL)
    + " SELECT doc_id, node_ix, array_to_string(path, '/') AS order_key, CAST(len(path) - 1 AS INT) AS depth FROM walk",
)
LEVELS = ["document", "part", "chapter", "section", "subsection", "clause", "subclause", "paragraph"]
Q["ancestors"] = (
    lambda s, d: H.ancestors(nodes(s, d)).select(
        "doc_id", "node_ix", *[F.try_element_at("ancestors", F.lit(t)).alias(f"in_{t}") for t in LEVELS]
    ),
    recursive(duck("fx_nodes") + NODES_SQL + WALK_SQL)
    + " SELECT doc_id, node_ix, " + ", ".join(
        f"list_filter(steps[1:len(steps)-1], lambda x: x.t = '{t}' AND x.l <> '')[1].l AS in_{t}" for t in LEVELS
    ) + " FROM walk",
)


def titled(s, d):
    n = nodes(s, d).withColumn("start_page", (F.floor(F.col("start_char") / 5) + 1).cast("int"))
    return H.toc_titles(n, toc(s, d)).select("doc_id", "node_ix", "title")


Q["toc_titles"] = (
    titled,
    duck("fx_nodes", "fx_pages") + NODES_SQL + ", toc AS (" + TOC.replace("{p}", "fx_pages") + """),
ix AS (SELECT doc_id, page, upper(trim(title)) AS chapter FROM toc WHERE level = 1 OR regexp_matches(trim(title), '(?i)^chapter\\s+[IVXLCDM0-9]+')),
np AS (SELECT doc_id, node_ix, title, rank, CAST(floor(start_char / 5) AS INT) + 1 AS page FROM nd)
SELECT n.doc_id, n.node_ix, CASE WHEN n.rank <= 2 THEN coalesce(i.chapter, n.title) ELSE n.title END AS title
FROM np n ASOF LEFT JOIN ix i ON n.doc_id = i.doc_id AND n.page >= i.page""",
)
