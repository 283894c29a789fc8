"""Engine inputs derived from the driver tables, as SQL both engines run.

``{name}`` marks a driver table. All adapters read whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.readers import read_table

TABLES = ("documents", "labels", "benchmark", "embeddings", "conversations", "events", "pages")

SHARED = {
    # one chunk per document, with metadata
    "fx_chunks": """
SELECT doc_id, concat('D', CAST(doc_id AS STRING)) AS chunk_id,
  CASE doc_id % 6 WHEN 0 THEN 'patent' WHEN 1 THEN 'biodiversity' WHEN 2 THEN 'tk_prior_art'
    WHEN 3 THEN 'regulation' WHEN 4 THEN 'trademark' ELSE 'gi' END AS legal_area,
  CASE WHEN lang = 'en' THEN 'india' ELSE 'international' END AS jurisdiction,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(substring(source, 4) AS INT) % 8 END AS authority_level,
  CASE doc_id % 5 WHEN 0 THEN 'act' WHEN 1 THEN 'rule' WHEN 2 THEN 'policy' WHEN 3 THEN 'plan' ELSE 'memo' END AS document_type,
  CASE doc_id % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'amended' WHEN 2 THEN 'superseded' WHEN 3 THEN 'repealed'
    WHEN 4 THEN 'not_yet_effective' WHEN 5 THEN 'in_force' ELSE 'draft' END AS status,
  CAST(DATE '1970-01-01' + CAST((doc_id * 17) % 18000 AS INT) AS DATE) AS effective_from,
  concat(CAST(1 + doc_id % 160 AS STRING), CASE WHEN doc_id % 7 = 0 THEN '(p)' ELSE '' END) AS section,
  CASE doc_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'classical' WHEN 2 THEN 'proprietary' ELSE 'classical;proprietary' END AS applicable_product,
  CASE doc_id % 4 WHEN 0 THEN 'The Patents Act' WHEN 1 THEN 'The Biological Diversity Act'
    WHEN 2 THEN 'Drugs and Cosmetics Rules' ELSE 'Office Manual' END AS source_title,
  text
FROM {documents}""",
    "fx_queries": """
SELECT item_id AS query_id,
  concat(CASE item_id % 6 WHEN 0 THEN 'can i patent this formulation under section '
    WHEN 1 THEN 'compliance license for a tablet, rule ' WHEN 2 THEN 'biodiversity approval under article '
    WHEN 3 THEN 'classical ashwagandha taila and section ' WHEN 4 THEN 'hello, what about section '
    ELSE 'patents act scope of sec. ' END,
    CAST(1 + item_id % 160 AS STRING), CASE WHEN item_id % 7 = 0 THEN '(p) ' ELSE ' ' END, text) AS query,
  CASE item_id % 3 WHEN 0 THEN 'india' WHEN 1 THEN 'international' ELSE NULL END AS jurisdiction,
  CASE item_id % 7 WHEN 0 THEN 'classical' WHEN 1 THEN 'proprietary' WHEN 2 THEN 'phytopharmaceutical'
    WHEN 3 THEN 'ayurveda-aahar' WHEN 4 THEN 'cosmetic' WHEN 5 THEN 'non-classical' ELSE 'unclassified' END AS category
FROM {benchmark}""",
    # every document is a candidate of two sub-queries: linear in the documents
    "fx_pairs": """
SELECT q.item_id AS query_id, 0 AS area_ix, d.doc_id, concat('D', CAST(d.doc_id AS STRING)) AS chunk_id,
  CAST((d.doc_id * 31 + q.item_id * 17) % 1000 AS DOUBLE) / 1000 AS vector_score
FROM {documents} d JOIN {benchmark} q ON q.item_id = (d.doc_id * 7) % (SELECT count(*) FROM {benchmark})
UNION ALL
SELECT q.item_id AS query_id, 1 AS area_ix, d.doc_id, concat('D', CAST(d.doc_id AS STRING)) AS chunk_id,
  CAST((d.doc_id * 37 + q.item_id * 13) % 1000 AS DOUBLE) / 1000 AS vector_score
FROM {documents} d JOIN {benchmark} q ON q.item_id = (d.doc_id * 7 + CASE WHEN d.doc_id % 3 = 0 THEN 0 ELSE 5 END) % (SELECT count(*) FROM {benchmark})""",
    "fx_turns": """
SELECT conv_id, turn, role, concat(CASE (conv_id + turn) % 5 WHEN 0 THEN 'my herbal ashwagandha tablet. '
  WHEN 1 THEN 'can i export this? ' WHEN 2 THEN 'it is an oral capsule in india. '
  WHEN 3 THEN 'a proprietary neem cream. ' ELSE '' END, text) AS text FROM {conversations}""",
    "fx_answers": """
SELECT conv_id, turn, concat('Under Section ', CAST(1 + conv_id % 160 AS STRING), ' (Ref: D', CAST(conv_id % 50 AS STRING),
  ') and Rule ', CAST(1 + turn AS STRING), ' (Excerpt 1, Ref: D', CAST((conv_id + 1) % 50 AS STRING), ') see (Ref: D',
  CAST(conv_id % 50 AS STRING), '), (Ref: NONE-1). ',
  CASE WHEN conv_id % 9 = 0 THEN 'The material is insufficient. ' WHEN conv_id % 9 = 1 THEN 'The excerpt does not contain it. ' ELSE '' END,
  text) AS answer
FROM {conversations} WHERE role = 'assistant'""",
    "fx_vec_chunks": """
SELECT vec_id, embedding, CASE label % 6 WHEN 0 THEN 'patent' WHEN 1 THEN 'biodiversity' WHEN 2 THEN 'tk_prior_art'
  WHEN 3 THEN 'regulation' WHEN 4 THEN 'trademark' ELSE 'gi' END AS legal_area,
  CASE vec_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'classical' WHEN 2 THEN 'proprietary' ELSE 'classical;proprietary' END AS applicable_product
FROM {embeddings}""",
    "fx_session_events": """
SELECT user_id AS session_id, event_id AS turn_index, ts, CASE event_type WHEN 'click' THEN 'it is an oral capsule'
  WHEN 'view' THEN 'a proprietary neem cream' WHEN 'purchase' THEN 'for india, therapeutic'
  WHEN 'signup' THEN 'can i patent my herbal mixture' ELSE 'unrelated remark' END AS text FROM {events}""",
    # one manifest row per document, all cells as text, as a CSV gives them
    "fx_manifest_raw": """
SELECT concat('S-', CAST(doc_id AS STRING)) AS source_id_external, concat('  Title of ', source, ' ') AS title,
  CASE doc_id % 3 WHEN 0 THEN 'act' WHEN 1 THEN ' rule ' ELSE '' END AS document_type,
  CASE WHEN lang = 'en' THEN 'india' ELSE 'international' END AS jurisdiction,
  CASE doc_id % 4 WHEN 0 THEN '2' WHEN 1 THEN ' 3' WHEN 2 THEN 'x1' ELSE NULL END AS authority_level,
  CASE doc_id % 5 WHEN 0 THEN '500' WHEN 1 THEN '-5' ELSE '' END AS chunk_size,
  CASE doc_id % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN 'N' WHEN 3 THEN 'maybe' WHEN 4 THEN '' WHEN 5 THEN '1' ELSE NULL END AS is_ingested,
  CASE doc_id % 7 WHEN 0 THEN 'f' WHEN 1 THEN 'no' WHEN 2 THEN 'perhaps' ELSE NULL END AS enable_contextual_retrieval,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'classical' ELSE NULL END AS applicable_product,
  CASE doc_id % 2 WHEN 0 THEN 'proprietary' ELSE NULL END AS applicable_products,
  CASE doc_id % 2 WHEN 0 THEN 'abs' ELSE '' END AS collection_name,
  concat('/pdfs/', CAST(doc_id AS STRING), '.pdf') AS pdf_path
FROM {documents}""",
}

# engine-specific spellings of the same table: (Spark, DuckDB)
SPLIT = {
    "fx_lines": (
        "SELECT doc_id, pos AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n', -1)) AS pos, line",
        "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l "
        "FROM {documents}), range(1, len(l) + 1) AS r(i)",
    ),
    "fx_words": (
        "SELECT doc_id, pos AS word_ix, w AS text, CAST(floor(pos / 120) AS INT) + 1 AS page, "
        "CAST(floor((pos % 120) / 12) AS DOUBLE) * 12.5 + 0.2 AS top, "
        "CASE WHEN floor(pos / 12) % 7 = 0 THEN 14.2D ELSE 10.1D END AS size, "
        "CASE WHEN floor(pos / 12) % 11 = 3 THEN 'Serif-Bold' ELSE 'Serif' END AS fontname "
        "FROM {documents} LATERAL VIEW posexplode(split(text, ' ', -1)) AS pos, w",
        "SELECT doc_id, CAST(i - 1 AS INT) AS word_ix, l[i] AS text, CAST(floor((i-1) / 120) AS INT) + 1 AS page, "
        "CAST(floor(((i-1) % 120) / 12) AS DOUBLE) * 12.5 + 0.2 AS top, "
        "CASE WHEN floor((i-1) / 12) % 7 = 0 THEN 14.2::DOUBLE ELSE 10.1::DOUBLE END AS size, "
        "CASE WHEN floor((i-1) / 12) % 11 = 3 THEN 'Serif-Bold' ELSE 'Serif' END AS fontname "
        "FROM (SELECT doc_id, string_split(text, ' ') AS l FROM {documents}), range(1, len(l) + 1) AS r(i)",
    ),
    # pages of five lines; joined with line breaks they give the text again
    "fx_pages": (
        "SELECT doc_id, p + 1 AS page, array_join(slice(l, 5 * p + 1, 5), '\\n') AS text FROM "
        "(SELECT doc_id, split(text, '\\n', -1) AS l FROM {documents}) "
        "LATERAL VIEW explode(sequence(0, CAST(floor((size(l) - 1) / 5) AS INT))) AS p",
        "SELECT doc_id, CAST(p + 1 AS INT) AS page, array_to_string(l[5 * p + 1 : 5 * p + 5], chr(10)) AS text FROM "
        "(SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}), range(0, CAST(floor((len(l) - 1) / 5) AS BIGINT) + 1) AS r(p)",
    ),
}
_HEAD = (
    "CASE WHEN length({l}) <= 5 THEN {l} WHEN {i} % 9 = 0 THEN concat({a}, 'CHAPTER ', CAST(1 + CAST(floor({i} / 9) AS INT) AS STRING), "
    "' x', substring({l}, 1, 40), {z}, {n}, {l}) WHEN {i} % 9 IN (3, 6) THEN concat({a}, CAST(1 + CAST(floor({i} / 3) AS INT) AS STRING), "
    "'. Title ', substring({l}, 1, 30), '.', {z}, {n}, {l}) WHEN {i} % 9 = 4 THEN concat({a}, 'Rule ', CAST(1 + {i} % 20 AS STRING), "
    "'. y', substring({l}, 1, 30), {z}, {n}, {l}) ELSE {l} END"
)


def _documents_with_headings(marked: bool) -> tuple[str, str]:
    a, z = ("'<<<HEADING>>>'", "'<<<END_HEADING>>>'") if marked else ("''", "''")
    spark = _HEAD.format(l="l", i="i", a=a, z=z, n="'\\n'")
    duck = _HEAD.format(l="l", i="(i - 1)", a=a, z=z, n="chr(10)")
    return (
        f"SELECT doc_id, array_join(transform(split(text, '\\n', -1), (l, i) -> {spark}), '\\n') AS text FROM {{documents}}",
        f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {duck}), chr(10)) AS text FROM {{documents}}",
    )


# whole documents with heading lines put before some of their lines
SPLIT["fx_marked"] = _documents_with_headings(True)
SPLIT["fx_plain"] = _documents_with_headings(False)

# nodes of all ranks; numbers, some with a numbering prefix
_NODES = (
    "SELECT doc_id, line_no AS start_char, line_no + 1 AS end_char, line AS text, "
    "CASE (doc_id * 7 + line_no * 5) % 9 WHEN 0 THEN 'document' WHEN 1 THEN 'part' WHEN 2 THEN 'chapter' WHEN 3 THEN 'section' "
    "WHEN 4 THEN 'subsection' WHEN 5 THEN 'clause' WHEN 6 THEN 'subclause' WHEN 7 THEN 'paragraph' ELSE 'subparagraph' END AS node_type, "
    "CASE line_no % 4 WHEN 0 THEN CAST(line_no % 7 AS STRING) WHEN 1 THEN concat(CAST(line_no % 7 AS STRING), '(a)') "
    "WHEN 2 THEN NULL ELSE CAST(line_no AS STRING) END AS number, "
    "CASE WHEN line_no % 4 = 2 THEN concat('T', CAST(line_no AS STRING)) END AS title FROM "
)
SPLIT["fx_nodes"] = tuple(_NODES + f"({s}) x" for s in SPLIT["fx_lines"])


TEXT_TABLES = ("documents",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread=name in TEXT_TABLES)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Adapter as a DataFrame."""
    text = SHARED[name] if name in SHARED else SPLIT[name][0]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(*names: str) -> str:
    """Adapters as common table expressions for DuckDB."""
    parts = []
    for name in names:
        text = SHARED[name] if name in SHARED else SPLIT[name][1]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts)


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def first_of(col: str, rules, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {any_of(col, words)} THEN '{label}'" for label, words in rules)
    return f"CASE {whens} ELSE {default} END"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


# PostgreSQL-like trim of white space in DuckDB
def duck_strip(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"
