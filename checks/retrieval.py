"""Filters, similarity and lexical search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import duck, fx, table
from lexloom.functions import constants as K
from lexloom.operators import retrieval as R

Q: dict = {}

DOT = "list_inner_product(q.v, c.v)"
VEC_SQL = """
, v AS (SELECT vec_id, legal_area, applicable_product, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM fx_vec_chunks)"""


def vectors(s, d):
    return fx(s, d, "fx_vec_chunks")


def knn(s, d, blocked=None, k=5):
    v = vectors(s, d)
    hits = R.cosine_topk(
        v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), k,
        not_self=True, blocked=blocked, block_rows=128 if blocked else R.BLOCK_ROWS,
    )
    return hits.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def _knn_sql(k: int, on: str = "true", self_: str = "q.vec_id <> c.vec_id") -> str:
    return f"""
, pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({DOT}, 9) AS s FROM v q JOIN v c ON {self_} AND {on}),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INT) AS rank FROM pairs QUALIFY rank <= {k})"""


Q["cosine_topk"] = (
    lambda s, d: knn(s, d),
    duck("fx_vec_chunks") + VEC_SQL + _knn_sql(5) + " SELECT query_id, chunk_id, round(s, 4) AS score, rank FROM top",
)
Q["cosine_topk_blocked"] = (
    lambda s, d: knn(s, d, blocked=True),
    duck("fx_vec_chunks") + VEC_SQL + _knn_sql(5) + " SELECT query_id, chunk_id, round(s, 4) AS score, rank FROM top",
)


def overfetch(s, d):
    v = vectors(s, d)
    hits = R.overfetch(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), 4, 3, not_self=True)
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 4).alias("worst"))


Q["overfetch"] = (
    overfetch,
    duck("fx_vec_chunks") + VEC_SQL + _knn_sql(12) + " SELECT query_id, count(*) AS n, round(min(s), 4) AS worst FROM top GROUP BY query_id",
)


def subqueries(s, d):
    """Every vector as a sub-query of the area and category of its own row."""
    return vectors(s, d).selectExpr(
        "vec_id AS query_id", "0 AS area_ix",
        "CASE legal_area WHEN 'biodiversity' THEN 'abs' WHEN 'regulation' THEN 'drug_regulation' ELSE legal_area END AS legal_area",
        "CASE vec_id % 3 WHEN 0 THEN 'classical' WHEN 1 THEN 'proprietary' ELSE 'unclassified' END AS product_category", "embedding",
    )


def filtered(s, d):
    routed = R.route(subqueries(s, d))
    chunks = vectors(s, d).withColumnRenamed("vec_id", "chunk_id")
    hits = R.filtered_topk(routed, chunks, 5)
    return hits.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


AREA_OK = """(CASE q.legal_area WHEN 'patent' THEN c.legal_area IN ('patent') WHEN 'biodiversity' THEN c.legal_area IN ('biodiversity')
  WHEN 'tk_prior_art' THEN c.legal_area IN ('patent', 'tk_prior_art') WHEN 'regulation' THEN c.legal_area IN ('regulation')
  WHEN 'trademark' THEN c.legal_area IN ('trademark') ELSE c.legal_area IN ('gi', 'patent') END)
 AND (q.vec_id % 3 = 2 OR c.applicable_product = 'all' OR c.applicable_product = CASE q.vec_id % 3 WHEN 0 THEN 'classical' ELSE 'proprietary' END)"""
Q["filtered_topk"] = (
    filtered,
    duck("fx_vec_chunks") + VEC_SQL + _knn_sql(5, AREA_OK, "true") + " SELECT query_id, chunk_id, round(s, 4) AS score, rank FROM top",
)
Q["legal_area_filter"] = (
    lambda s, d: fx(s, d, "fx_chunks").select(
        "doc_id", *[R.legal_area_filter(F.array(F.lit(a)), F.col("legal_area")).alias(f"in_{a}") for a in ("abs", "patent", "gi", "regulation")],
        R.legal_area_filter(F.array().cast("array<string>"), F.col("legal_area")).alias("no_filter"),
    ),
    duck("fx_chunks") + " SELECT doc_id, legal_area IN ('abs', 'biodiversity') AS in_abs, legal_area IN ('patent', 'patents') AS in_patent, "
    "legal_area = 'gi' AS in_gi, legal_area = 'regulation' AS in_regulation, true AS no_filter FROM fx_chunks",
)
Q["product_filter"] = (
    lambda s, d: fx(s, d, "fx_chunks").select(
        "doc_id", *[R.product_filter(F.lit(c), F.col("applicable_product")).alias(n) for n, c in
                    (("classical", "Classical"), ("proprietary", "proprietary"), ("unclassified", "unclassified"))],
    ),
    duck("fx_chunks") + " SELECT doc_id, applicable_product IN ('all', 'classical') AS classical, applicable_product IN ('all', 'proprietary') AS proprietary, true AS unclassified FROM fx_chunks",
)
Q["store_filter_fallback"] = (
    lambda s, d: fx(s, d, "fx_chunks").drop("applicable_product").where(
        R.store_filter(fx(s, d, "fx_chunks").drop("applicable_product"), F.array(F.lit("gi")), F.lit("classical"))
    ).select("doc_id"),
    duck("fx_chunks") + " SELECT doc_id FROM fx_chunks WHERE legal_area = 'gi'",
)
Q["route_subqueries"] = (
    lambda s, d: R.route(fx(s, d, "fx_chunks").select("doc_id", "legal_area")).select(
        "doc_id", "legal_area", "collection", F.array_join("filter_areas", "|").alias("filter_areas"), "top_k"
    ),
    duck("fx_chunks") + """ SELECT doc_id, legal_area, 'legal_acts_patent' AS collection, CASE legal_area WHEN 'patent' THEN 'patent' WHEN 'tk_prior_art' THEN 'patent|tk_prior_art'
  WHEN 'trademark' THEN 'trademark' WHEN 'gi' THEN 'gi|patent' ELSE 'regulation' END AS filter_areas, 5 AS top_k FROM fx_chunks""",
)


def packs(s, d):
    p = fx(s, d, "fx_pairs")
    return R.collect_packs(p.where("area_ix = 0"), p.where("area_ix = 1").drop("vector_score"))


Q["collect_packs"] = (
    packs, duck("fx_pairs") + " SELECT query_id, area_ix, doc_id, chunk_id, CASE WHEN area_ix = 0 THEN vector_score END AS vector_score FROM fx_pairs",
)


def pair_texts(s, d):
    return (
        fx(s, d, "fx_pairs").join(fx(s, d, "fx_queries").select("query_id", "query"), "query_id")
        .join(fx(s, d, "fx_chunks").select("chunk_id", "text"), "chunk_id")
    )


Q["keyword_overlap"] = (
    lambda s, d: pair_texts(s, d).select(
        "query_id", "area_ix", "chunk_id", R.keyword_overlap(F.col("query"), F.col("text")).alias("keyword_score")
    ),
    duck("fx_pairs", "fx_queries", "fx_chunks") + """
, x AS (SELECT p.query_id, p.area_ix, p.chunk_id, list_filter(list_transform(regexp_split_to_array(trim(query), '\\s+'), lambda t: lower(t)), lambda t: length(t) > 2) AS w, lower(text) AS low
  FROM fx_pairs p JOIN fx_queries USING (query_id) JOIN fx_chunks c ON c.chunk_id = p.chunk_id)
SELECT query_id, area_ix, chunk_id, round(len(list_filter(w, lambda t: contains(low, t))) / len(w), 4) AS keyword_score FROM x""",
)


def candidates(s, d):
    hits = fx(s, d, "fx_pairs").withColumnRenamed("vector_score", "score").drop("doc_id").join(fx(s, d, "fx_chunks"), "chunk_id")
    hits = hits.join(fx(s, d, "fx_queries").select("query_id", F.col("query").alias("query_text")), "query_id")
    cols = ["query_id", "area_ix", "chunk_id", "provision", "title", "chapter", "pages", "source_authority", "authority_level", "document_type",
            "jurisdiction", "legal_area", "vector_score"]
    return R.to_candidate(hits).select(*cols)


Q["to_candidate"] = (
    candidates,
    duck("fx_pairs", "fx_chunks") + """ SELECT query_id, area_ix, c.chunk_id, section AS provision, source_title AS title, 'N/A' AS chapter, '? to ?' AS pages,
  source_title AS source_authority, CAST(authority_level AS VARCHAR) AS authority_level, document_type, jurisdiction, legal_area, round(vector_score, 4) AS vector_score
  FROM fx_pairs p JOIN fx_chunks c ON c.chunk_id = p.chunk_id""",
)


def bm25(s, d):
    q = table(s, d, "benchmark").selectExpr("item_id AS query_id", "text AS query_text")
    c = table(s, d, "documents").selectExpr("doc_id AS chunk_id", "text")
    return R.bm25_topk(q, c, 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


Q["bm25_topk"] = (
    bm25,
    """WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS term FROM benchmark),
sized AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM sized),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT tf.chunk_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS w FROM tf JOIN df USING (term), st),
sc AS (SELECT query_id, chunk_id, round(sum(w), 6) AS s FROM asked JOIN wt USING (term) GROUP BY ALL)
SELECT query_id, chunk_id, round(s, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INT) AS rank FROM sc QUALIFY rank <= 10""",
)
