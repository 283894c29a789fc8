"""Manifest, store, memory and chunk queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.adapters import duck, duck_strip, fx, table
from checks.structure import NODES_SQL, WALK_SQL, nodes, recursive
from lexloom.operators import chunking as C
from lexloom.operators import hierarchy as H
from lexloom.operators.retrieval import embed
from lexloom.plans.ingest import ingest_pages, ingest_texts
from lexloom.sources import manifest as M
from lexloom.session import shared_folder
from lexloom.sources import memory, store
from lexloom.sources.contexts import ContextStore
from lexloom.streaming.ingest_stream import Ingestion

Q: dict = {}

# --- manifest ----------------------------------------------------------------------------


def manifest(s, d):
    return M.typed_manifest(fx(s, d, "fx_manifest_raw"))


def _bool(col: str, default: str) -> str:
    v = f"lower(trim(coalesce({col}, '')))"
    return (
        f"CASE WHEN {v} IN ('true','1','yes','y','t') THEN true WHEN {v} IN ('false','0','no','n','f','') THEN false ELSE {default} END"
    )


def _int(col: str, default: int) -> str:
    v = f"trim(coalesce({col}, ''))"
    return f"CASE WHEN regexp_full_match({v}, '[0-9]+') THEN coalesce(TRY_CAST({v} AS INT), {default}) ELSE {default} END"


MANIFEST_SQL = duck("fx_manifest_raw") + f"""
, manifest AS (SELECT trim(source_id_external) AS source_id, trim(title) AS title, trim(document_type) AS document_type, trim(jurisdiction) AS jurisdiction,
  coalesce(nullif(trim(collection_name), ''), 'legal_acts') AS collection_name,
  coalesce(nullif(trim(coalesce(applicable_product, '')), ''), nullif(trim(coalesce(applicable_products, '')), ''), 'all') AS applicable_product,
  {_int('authority_level', 0)} AS authority_level, {_int('chunk_size', 1000)} AS chunk_size,
  {_bool('is_ingested', 'false')} AS is_ingested, {_bool('enable_contextual_retrieval', 'true')} AS enable_contextual,
  regexp_replace(trim(pdf_path), '^[/\\\\]+', '') AS path FROM fx_manifest_raw)"""
MCOLS = ["source_id", "title", "document_type", "jurisdiction", "collection_name", "applicable_product", "authority_level",
         "chunk_size", "is_ingested", "enable_contextual", "path"]
Q["manifest_coerce"] = (
    lambda s, d: manifest(s, d).select(*MCOLS), MANIFEST_SQL + f" SELECT {', '.join(MCOLS)} FROM manifest",
)
Q["format_router"] = (
    lambda s, d: M.format_router(
        table(s, d, "documents").selectExpr("doc_id", "concat('a/', source, CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' ELSE '' END) AS path")
    ),
    "SELECT doc_id, concat('a/', source, CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' ELSE '' END) AS path, "
    "CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' ELSE 'rejected' END AS format FROM documents",
)
Q["embedding_dims"] = (
    lambda s, d: table(s, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 'Gemini' ELSE 'huggingface' END AS p",
        "CASE doc_id % 5 WHEN 0 THEN 'BAAI/bge-m3' WHEN 1 THEN 'BAAI/bge-base-en' WHEN 2 THEN 'BAAI/bge-large-en' ELSE 'mini' END AS m")
    .select("doc_id", M.embedding_dims(F.col("p"), F.col("m")).alias("dim")),
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 3072 ELSE CASE doc_id % 5 WHEN 0 THEN 1024 WHEN 1 THEN 768 WHEN 2 THEN 1024 ELSE 384 END END AS dim FROM documents",
)
_FILE = (
    "CASE doc_id % 6 WHEN 0 THEN concat('pdfs/', doc_id, '.pdf') WHEN 1 THEN concat('data/pdfs/', doc_id, '.pdf') "
    "WHEN 2 THEN concat('data/pdfs/The  Act ', doc_id, '.PDF') WHEN 3 THEN concat('data/abs/S-', doc_id, '.pdf') "
    "WHEN 4 THEN concat('pdfs/b', doc_id, '.pdf') ELSE concat('elsewhere/', doc_id, '.pdf') END"
)
_PATH = (
    "CASE doc_id % 6 WHEN 2 THEN concat('pdfs/the act ', doc_id, '.pdf') WHEN 4 THEN concat('pdfs/a', doc_id, ', b', doc_id, '.pdf') "
    "ELSE concat('pdfs/', doc_id, '.pdf') END"
)


def resolve(s, d):
    docs = table(s, d, "documents")
    m = docs.selectExpr("concat('S-', doc_id) AS source_id", f"{_PATH} AS path")
    return M.resolve_paths(m, docs.selectExpr(f"{_FILE} AS file"))


Q["resolve_paths"] = (
    resolve,
    f"SELECT concat('S-', doc_id) AS source_id, {_PATH} AS path, CASE WHEN doc_id % 6 = 5 THEN {_PATH} ELSE {_FILE} END AS resolved_path, "
    "doc_id % 6 <> 5 AS resolved FROM documents",
)


def ingested(s, d):
    """Store rows: labelled documents with a vector, in the collection of their manifest row."""
    lab = table(s, d, "labels").join(table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    ids = lab.select(F.concat(F.lit("S-"), F.col("doc_id").cast("string")).alias("source_id"), "embedding", "quality")
    return ids.join(manifest(s, d).select("source_id", "collection_name"), "source_id")


STORE_SQL = MANIFEST_SQL + """
, store AS (SELECT m.source_id, m.collection_name, e.embedding FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id
  JOIN manifest m ON m.source_id = concat('S-', l.doc_id))"""
Q["pending_docs"] = (
    lambda s, d: store.pending_docs(manifest(s, d), ingested(s, d), 64).select("source_id", "collection_name"),
    STORE_SQL + " SELECT source_id, collection_name FROM manifest m WHERE NOT is_ingested AND NOT EXISTS "
    "(SELECT 1 FROM store s WHERE s.source_id = m.source_id AND s.collection_name = m.collection_name)",
)
Q["check_dimension"] = (
    lambda s, d: store.check_dimension(ingested(s, d), 64),
    STORE_SQL + " SELECT collection_name, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(*) AS n_points, "
    "CASE WHEN min(len(embedding)) = 64 AND max(len(embedding)) = 64 THEN 'keep' ELSE 'recreate' END AS action FROM store GROUP BY collection_name",
)


def marked(s, d):
    done = table(s, d, "labels").where("quality = 1").select(F.concat(F.lit("S-"), F.col("doc_id").cast("string")).alias("source_id"))
    return M.mark_ingested(manifest(s, d).select("source_id", "title", "is_ingested"), done)


Q["mark_ingested"] = (
    marked,
    MANIFEST_SQL + " SELECT source_id, title, is_ingested OR source_id IN (SELECT concat('S-', doc_id) FROM labels WHERE quality = 1) AS is_ingested FROM manifest",
)


def summary(s, d):
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    o = docs.join(lab, "doc_id", "left").selectExpr(
        "CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'successful' ELSE 'failed' END AS outcome",
        "CASE WHEN quality = 1 THEN size(split(text, '\\n', -1)) ELSE 0 END AS n_chunks",
    )
    return C.ingest_summary(o)


Q["ingest_summary"] = (
    summary,
    "SELECT CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'successful' ELSE 'failed' END AS outcome, count(*) AS n_documents, "
    "CAST(sum(CASE WHEN quality = 1 THEN len(string_split(text, chr(10))) ELSE 0 END) AS BIGINT) AS n_chunks FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)

# --- store ids ---------------------------------------------------------------------------
_UUID = """concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substring('89ab', CAST(('0x' || h[17]) AS INT) % 4 + 1, 1) || h[18:20], h[21:32])"""
Q["point_uuid"] = (
    lambda s, d: store.unique_ids(
        table(s, d, "documents").selectExpr("doc_id AS position", "concat(source, '_', CAST(n_chars % 50 AS STRING)) AS chunk_id")
    ),
    f"""WITH c AS (SELECT doc_id AS position, concat(source, '_', CAST(n_chars % 50 AS VARCHAR)) AS cid FROM documents),
n AS (SELECT position, CASE WHEN position > min(position) OVER (PARTITION BY cid) THEN concat(cid, '_dup', position) ELSE cid END AS chunk_id FROM c),
hx AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM n)
SELECT position, chunk_id, {_UUID} AS point_id FROM hx""",
)


def upsert(s, d):
    docs = table(s, d, "documents").selectExpr("doc_id AS position", "concat('D', doc_id) AS chunk_id", "n_chars")
    lab = table(s, d, "labels").select("doc_id")
    old = store.unique_ids(docs)
    new = docs.join(lab, F.col("position") == F.col("doc_id"), "left_semi").withColumn("n_chars", -F.col("n_chars"))
    return store.write_chunks(new, old).select("chunk_id", "n_chars")


Q["upsert_chunks"] = (
    upsert,
    "SELECT concat('D', doc_id) AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -n_chars ELSE n_chars END AS n_chars FROM documents",
)



def store_batches(s, d):
    """Three ingests of the documents, compaction between them, and a batch whose index never came."""
    docs = table(s, d, "documents").selectExpr("doc_id", "concat('D', doc_id) AS point_id", "source AS source_id", "lang AS collection_name", "n_chars AS v")
    found = store.ChunkStore(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    found.append(docs.where("doc_id % 2 = 0"), 0)
    found.append(docs.where("doc_id % 3 = 0").withColumn("v", -F.col("v")), 1)
    found.compact()
    found.append(docs.where("doc_id % 5 = 0").withColumn("v", 2 * F.col("v")), 2)
    docs.withColumn("v", F.lit(0)).write.parquet(f"{found.path}/rows/{store.BATCH}=6")
    return found.read().select("point_id", "source_id", "v")


Q["store_batches"] = (
    store_batches,
    "SELECT concat('D', doc_id) AS point_id, source AS source_id, CASE WHEN doc_id % 5 = 0 THEN 2 * n_chars WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS v "
    "FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0",
)


def ingest_batches(s, d):
    """Two runs of the stream over a growing folder, the second one repeated after the fact; known sources that come again are skipped."""
    at = f"{shared_folder(s)}/ingest-{uuid.uuid4().hex}"
    docs = table(s, d, "documents").selectExpr("concat('S-', doc_id) AS doc_id", "text", "doc_id AS modified")
    schema = docs.schema
    load = Ingestion(s, manifest(s, d).withColumn("chunk_size", F.lit(1_000_000)), f"{at}/store")

    def run():
        stream = s.readStream.schema(schema).parquet(f"{at}/in")
        stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()

    docs.where("modified % 3 <> 0").write.mode("append").parquet(f"{at}/in")
    run()
    more = docs.where("modified % 3 = 0 OR modified % 7 = 0").withColumn("text", F.concat(F.lit("again "), F.coalesce("text", F.lit(""))))
    more.write.mode("append").parquet(f"{at}/in")
    run()
    load(more, 1)
    out = load.chunks().groupBy("source_id").agg(F.max(store.BATCH).alias("b"), F.count("*").alias("n"))
    return out.select("source_id", F.expr("CAST(b DIV 2 AS BIGINT)").alias("batch"), "n")


Q["ingest_batches"] = (
    ingest_batches,
    "SELECT concat('S-', doc_id) AS source_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch, 1 AS n FROM documents "
    "WHERE doc_id % 3 = 0 OR trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''",
)

# --- memory ------------------------------------------------------------------------------


def turns(s, d):
    return fx(s, d, "fx_turns").selectExpr("conv_id AS session_id", "turn AS turn_index", "role", "text")


def appended(s, d):
    t = turns(s, d)
    new = t.selectExpr("session_id", "turn_index * 1000 AS ts", "text")
    return memory.append_turn(t, new).select("session_id", "ts", "turn_index")


Q["append_turn"] = (
    appended,
    "SELECT conv_id AS session_id, turn * 1000 AS ts, CAST(count(*) OVER (PARTITION BY conv_id) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn_index FROM conversations",
)
Q["clear_session"] = (
    lambda s, d: memory.clear_session(turns(s, d), table(s, d, "labels").where("toxic = 1").selectExpr("doc_id AS session_id")).select("session_id", "turn_index"),
    "SELECT conv_id AS session_id, turn AS turn_index FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
Q["get_history"] = (
    lambda s, d: memory.get_history(turns(s, d), table(s, d, "labels").selectExpr("doc_id AS session_id")).select("session_id", "turn_index", "role"),
    "SELECT conv_id AS session_id, turn AS turn_index, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)",
)
Q["history_window"] = (
    lambda s, d: memory.history_window(turns(s, d), 4).select("session_id", "turn_index"),
    "SELECT conv_id AS session_id, turn AS turn_index FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
)
_FACTS = "map(role, CAST(length(text) AS STRING), 'last', role)"


def facts(s, d):
    f = fx(s, d, "fx_turns").selectExpr("conv_id AS session_id", f"{_FACTS} AS facts", "turn AS seq")
    old, new = f.where("seq < 3"), f.where("seq >= 3")
    out = memory.save_facts(old, new)
    return out.select("session_id", *[F.try_element_at("facts", F.lit(k)).alias(f"f_{k}") for k in ("user", "assistant", "system", "last")])


def latest_facts(s, d):
    f = fx(s, d, "fx_turns").selectExpr("conv_id AS session_id", f"{_FACTS} AS facts", "turn AS seq")
    return memory.get_facts(f).select("session_id", F.try_element_at("facts", F.lit("last")).alias("f_last"))


Q["facts_merge"] = (
    facts,
    duck("fx_turns") + " SELECT conv_id AS session_id, " + ", ".join(
        f"CAST(arg_max(length(text), turn) FILTER (role = '{r}') AS VARCHAR) AS f_{r}" for r in ("user", "assistant", "system")
    ) + ", arg_max(role, turn) AS f_last FROM fx_turns GROUP BY conv_id",
)
Q["facts_latest"] = (
    latest_facts, "SELECT conv_id AS session_id, arg_max(role, turn) AS f_last FROM conversations GROUP BY conv_id",
)

# --- chunks ------------------------------------------------------------------------------


def chunk_base(s, d):
    n = H.ancestors(nodes(s, d))
    return n.withColumn("doc_title", F.concat(F.lit("Act "), F.col("doc_id").cast("string")))


KIDS_SQL = ", kids AS (SELECT DISTINCT doc_id, parent_ix AS node_ix, true AS has_kids FROM tree WHERE parent_ix IS NOT NULL)"
CHUNKABLE_SQL = KIDS_SQL + f""", chunkable AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id ORDER BY node_ix) - 1 AS chunkable_ix FROM tree t LEFT JOIN kids USING (doc_id, node_ix)
  WHERE NOT (coalesce(has_kids, false) AND node_type IN ('document', 'part', 'chapter')) AND NOT (coalesce(has_kids, false) AND length(text) > 200) AND {duck_strip('text')} <> '')"""
Q["select_chunkable"] = (
    lambda s, d: C.chunkable_index(C.select_chunkable(nodes(s, d), 200)).select("doc_id", "node_ix", F.col("chunkable_ix").cast("long").alias("chunkable_ix")),
    duck("fx_nodes") + NODES_SQL + CHUNKABLE_SQL + " SELECT doc_id, node_ix, chunkable_ix FROM chunkable",
)
_ANC = "list_filter(steps[1:len(steps)-1], lambda x: x.t = '{t}' AND x.l <> '')[1].l"


def _crumb() -> str:
    ups = "".join(f", ' | {t.capitalize()}: ' || nullif({_ANC.format(t=t)}, '')" for t in ("part", "chapter", "section", "rule", "article"))
    own = (
        "CASE WHEN node_type NOT IN ('part', 'chapter', 'document') THEN ' | ' || upper(node_type[1]) || node_type[2:] || ': ' || coalesce(number, '') "
        "|| coalesce(' (' || nullif(title, '') || ')', '') END"
    )
    return f"concat('Document: Act ', doc_id{ups}, {own})"


Q["breadcrumbs"] = (
    lambda s, d: C.breadcrumb(chunk_base(s, d)).select("doc_id", "node_ix", "breadcrumb"),
    recursive(duck("fx_nodes") + NODES_SQL + WALK_SQL) + f" SELECT doc_id, node_ix, {_crumb()} AS breadcrumb FROM walk JOIN tree USING (doc_id, node_ix)",
)
LEVELS = ["section", "subsection", "clause", "subclause"]
Q["hierarchy_columns"] = (
    lambda s, d: C.hierarchy_columns(chunk_base(s, d)).select(
        "doc_id", "node_ix", "section_number", "section_title", "chapter", "part", *LEVELS
    ),
    recursive(duck("fx_nodes") + NODES_SQL + WALK_SQL) + f""" SELECT doc_id, node_ix,
  CASE WHEN node_type = 'section' THEN number ELSE coalesce({_ANC.format(t='section')}, '') END AS section_number,
  CASE WHEN node_type = 'section' THEN title ELSE '' END AS section_title,
  coalesce({_ANC.format(t='chapter')}, 'N/A') AS chapter, coalesce({_ANC.format(t='part')}, '') AS part, """
    + ", ".join(f"CASE WHEN node_type = '{t}' THEN number ELSE coalesce({_ANC.format(t=t)}, '') END AS {t}" for t in LEVELS)
    + " FROM walk JOIN tree USING (doc_id, node_ix)",
)


def enriched(s, d):
    chunks = table(s, d, "documents").selectExpr("concat('S-', doc_id) AS source_id", "concat('D', doc_id) AS chunk_id", "text AS page_content")
    cols = ["chunk_id", "source_id", "title", "document_type", "jurisdiction", "authority_level", "applicable_product", "node_type", "chapter",
            "section", "original_text", "structure_confidence"]
    return C.enrich(chunks, manifest(s, d)).select(*cols)


Q["enrich"] = (
    enriched,
    MANIFEST_SQL + " SELECT concat('D', d.doc_id) AS chunk_id, m.source_id, m.title, m.document_type, m.jurisdiction, m.authority_level, m.applicable_product, "
    "'section' AS node_type, 'N/A' AS chapter, '' AS section, d.text AS original_text, 1.0::DOUBLE AS structure_confidence FROM documents d JOIN manifest m ON m.source_id = concat('S-', d.doc_id)",
)


def context_input(s, d):
    """All documents as chunks, and contexts that are known for the labelled ones."""
    docs = table(s, d, "documents")
    chunks = docs.select(
        "doc_id", F.concat(F.lit(" parent "), "source").alias("parent_context"), F.col("text").alias("split_text"),
        C.structural_context(F.col("source"), F.lit("N/A"), F.col("doc_id").cast("string"), F.col("lang")).alias("fallback_context"),
    )
    keyed = docs.select(
        "doc_id", C.context_key(F.concat(F.lit("parent "), "source"), F.col("text")).alias("key"), F.concat(F.lit("cached "), "source").alias("context")
    )
    cache = keyed.join(table(s, d, "labels").select("doc_id"), "doc_id").select("key", "context").distinct()
    return chunks, cache


def situated(found):
    return C.contextualise(found).select("doc_id", "generated_context", F.sha2("page_content", 256).alias("content_hash"))


def context(s, d):
    found, _ = C.context_lookup(*context_input(s, d))
    return situated(found)


def context_store(s, d):
    """The same through a store that is looked up twice; the second run may not ask for anything."""
    chunks, cache = context_input(s, d)
    kept = ContextStore(s, f"{shared_folder(s)}/contexts-{uuid.uuid4().hex}")
    kept.add(cache)
    kept.fill(chunks)

    def nothing(prompts):
        raise AssertionError("a stored context was asked for again")

    return situated(kept.lookup(chunks, nothing))


Q["context_cache"] = (
    context,
    f"""WITH c AS (SELECT doc_id, text, source, lang, sha256(concat({duck_strip("concat(' parent ', source)")}, '|||', {duck_strip('text')})) AS key FROM documents),
known AS (SELECT DISTINCT key, concat('cached ', source) AS context FROM c WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT key, min(concat('This chunk is part of ', source, ', Chapter N/A, Section ', doc_id, ': ''', lang, '''.')) AS context FROM c WHERE key NOT IN (SELECT key FROM known) GROUP BY key),
j AS (SELECT doc_id, text, context AS generated_context FROM c JOIN (SELECT * FROM known UNION ALL SELECT * FROM fresh) USING (key))
SELECT doc_id, generated_context, sha256(concat(generated_context, chr(10), chr(10), text)) AS content_hash FROM j""",
)
Q["context_store"] = (context_store, Q["context_cache"][1])
Q["context_prompt"] = (
    lambda s, d: C.context_prompt(
        table(s, d, "documents").select("doc_id", F.col("text").alias("parent_context"), F.col("source").alias("split_text"))
    ).select("doc_id", F.sha2("prompt", 256).alias("prompt_hash")),
    """SELECT doc_id, sha256('<document>' || chr(10) || substring(text, 1, 3500) || chr(10) || '</document>' || chr(10) || '<chunk>' || chr(10) || source
  || chr(10) || '</chunk>' || chr(10)
  || 'Situate the chunk within the document in 50-100 tokens, for better search. Reply with that context only.') AS prompt_hash FROM documents""",
)


def packed(s, d):
    para = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    docs = table(s, d, "documents").select("doc_id", para.alias("text"))
    return docs.select("doc_id", F.posexplode(C.pack_paragraphs(F.col("text"), 400)).alias("piece_no", "p")).select(
        "doc_id", "piece_no", "p.text", "p.oversize"
    )


Q["pack_paragraphs"] = (
    packed,
    # one recursion step per paragraph of a document
    f"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
p AS (SELECT doc_id, t, [y FOR y IN [{duck_strip("x")} FOR x IN string_split(t, chr(10) || chr(10))] IF y <> ''] AS ps FROM d),
fold AS (
  SELECT doc_id, t, ps, 0 AS i, CAST([] AS STRUCT(txt VARCHAR, oversize BOOLEAN)[]) AS done, CAST(NULL AS VARCHAR) AS o, 0::BIGINT AS n FROM p
  UNION ALL
  SELECT doc_id, t, ps, i + 1,
    CASE WHEN length(ps[i + 1]) > 400
      THEN list_concat(CASE WHEN o IS NULL THEN done ELSE list_append(done, {{'txt': o, 'oversize': false}}) END, [{{'txt': ps[i + 1], 'oversize': true}}])
      WHEN o IS NOT NULL AND n + length(ps[i + 1]) + 2 > 400 THEN list_append(done, {{'txt': o, 'oversize': false}})
      ELSE done END,
    CASE WHEN length(ps[i + 1]) > 400 THEN NULL WHEN o IS NOT NULL AND n + length(ps[i + 1]) + 2 > 400 THEN ps[i + 1]
      ELSE concat_ws(chr(10) || chr(10), o, ps[i + 1]) END,
    CASE WHEN length(ps[i + 1]) > 400 THEN 0 WHEN o IS NOT NULL AND n + length(ps[i + 1]) + 2 > 400 THEN length(ps[i + 1])
      ELSE n + length(ps[i + 1]) + 2 END
  FROM fold WHERE i < len(ps)),
ended AS (SELECT doc_id, t, CASE WHEN o IS NULL THEN done ELSE list_append(done, {{'txt': o, 'oversize': false}}) END AS done FROM fold WHERE i = len(ps)),
whole AS (SELECT doc_id, CASE WHEN length(t) <= 400 OR len(done) = 0 THEN [{{'txt': t, 'oversize': false}}] ELSE done END AS done FROM ended)
SELECT doc_id, CAST(generate_subscripts(done, 1) - 1 AS INT) AS piece_no, unnest(done).txt AS text, unnest(done).oversize AS oversize FROM whole""",
)
Q["split_recursive"] = (
    lambda s, d: C.split_recursive(table(s, d, "documents").select("doc_id", "text"), "text"), None,
)


def numbered(s, d):
    para = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    n = table(s, d, "documents").select(
        "doc_id", para.alias("text"), F.lit(0).alias("node_ix"), F.lit("section").alias("node_type"),
        F.col("doc_id").cast("string").alias("number"), F.lit(0).alias("chunkable_ix"), F.col("source").alias("source_id"),
    )
    return C.number_chunks(C.split_nodes(n)).select("doc_id", "chunk_id", "chunk_index", "total_chunks_in_section", "split_text")


Q["chunk_nodes"] = (numbered, None)
Q["embed_hashed"] = (
    lambda s, d: embed(table(s, d, "documents").select("doc_id", "text"), "text", dim=64).select(
        "doc_id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"),
    ),
    f"SELECT doc_id, 64 AS dim, CASE WHEN {duck_strip('text')} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM documents",
)


def ingest(s, d):
    """Documents with heading lines → store rows, the flow as a whole."""
    docs = fx(s, d, "fx_marked").select("doc_id", F.lit(1).alias("page"), "text")
    m = manifest(s, d).withColumn("source_id", F.regexp_replace("source_id", "^S-", ""))
    return ingest_pages(docs, m, dim=64).select(
        "chunk_id", "point_id", "source_id", "node_type", "section", "chapter", "breadcrumb", "chunk_index",
        F.size("embedding").alias("dim"), "page_content",
    )


def ingest_text(s, d):
    m = manifest(s, d).withColumn("source_id", F.regexp_replace("source_id", "^S-", ""))
    return ingest_texts(table(s, d, "documents").select("doc_id", "text"), m, dim=64).select(
        "chunk_id", "source_id", "chunk_index", "total_chunks_in_section", "page_content"
    )


Q["ingest_documents"] = (ingest, None)
Q["ingest_texts"] = (ingest_text, None)
