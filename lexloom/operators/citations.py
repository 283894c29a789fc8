"""Citations as shown to a reader: numbering, spans, labels, full texts, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions import rules as R
from lexloom.functions.text import contains_any, filled, first_rule, lookup, strip, tokens


def index_citations(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Number the references of each answer by first appearance and rewrite its text.

    ``sources`` (key, source_no, id, doc_id, chunk_ids, and optionally chunk_id)
    are the few sources shown with an answer. A reference takes the first source
    that matches by id, by listed chunk, or by prefix or containment; unknown
    references stay as text. Everything happens inside the answer's row.
    """
    have = set(sources.columns)
    cid = F.nullif(F.col("chunk_id"), F.lit("")) if "chunk_id" in have else F.lit(None).cast("string")
    sid = F.coalesce(F.nullif("id", F.lit("")), cid, F.nullif("doc_id", F.lit("")), F.lit("unknown"))
    chunk_ids = F.coalesce("chunk_ids", F.array().cast("array<string>")) if "chunk_ids" in have else F.array().cast("array<string>")
    if "sections" in have:
        chunk_ids = F.concat(chunk_ids, F.coalesce(F.transform("sections", lambda s: s["chunk_id"]), F.array().cast("array<string>")))
    src = sources.select(
        key,
        F.struct(
            F.col("source_no").alias("no"), sid.alias("id"), F.coalesce(cid, sid).alias("chunk"),
            F.coalesce(F.nullif("doc_id", F.lit("")), sid).alias("doc"), chunk_ids.alias("all"),
        ).alias("s"),
    )
    src = src.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("__src"))
    d = answers.join(src, key, "left")
    d = d.withColumn("__src", F.coalesce("__src", F.array().cast(src.schema["__src"].dataType)))
    d = d.withColumn("__text", F.coalesce("answer", F.lit("")))
    d = d.withColumns(
        {
            "__refs": F.regexp_extract_all("__text", F.lit(K.REF_PATTERN), F.lit(1)),
            "__full": F.regexp_extract_all("__text", F.lit(K.REF_PATTERN), F.lit(0)),
            "__rest": F.split("__text", K.REF_PATTERN, -1),
        }
    )

    def matches(s, r):
        return (
            (s["chunk"] == r) | (s["id"] == r) | (s["doc"] == r) | F.array_contains(s["all"], r)
            | F.startswith(r, s["id"]) | F.startswith(r, s["doc"]) | F.contains(s["chunk"], r) | F.contains(r, s["chunk"])
        )

    d = d.withColumn("__hit", F.transform("__refs", lambda r: F.get(F.filter("__src", lambda s: matches(s, r)), F.lit(0))["chunk"]))
    d = d.withColumn("cited_chunks", F.array_distinct(F.filter("__hit", lambda h: h.isNotNull())))
    shown = F.transform(
        F.sequence(F.lit(0), F.size("__rest") - 1),
        lambda i: F.when(
            i == 0, F.get("__rest", F.lit(0))
        ).otherwise(
            F.concat(
                F.when(F.get("__hit", i - 1).isNull(), F.get("__full", i - 1)).otherwise(
                    F.concat(
                        F.lit(" [^"), F.array_position("cited_chunks", F.get("__hit", i - 1)).cast("string"),
                        F.lit("](#citation:"), F.get("__refs", i - 1), F.lit(") "),
                    )
                ),
                F.get("__rest", i),
            )
        ),
    )
    d = d.withColumn("processed_text", F.array_join(shown, ""))
    d = d.withColumn(
        "ref_numbers",
        F.transform("__hit", lambda h: F.when(h.isNotNull(), F.array_position("cited_chunks", h).cast("int"))),
    )
    return d.withColumn("refs", F.col("__refs")).drop("__src", "__text", "__refs", "__full", "__rest", "__hit")


def highlight_span(full: Column, excerpt: Column) -> Column:
    """struct(start, end) of an excerpt in a text (code points), or null.

    Exact, then without case, then by the first and last three longer words.
    """
    exc = strip(excerpt)
    low_full, low_exc = F.lower(full), F.lower(exc)
    size = F.length(exc)

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    exact = F.instr(full, exc) - 1
    loose = F.instr(low_full, low_exc) - 1
    words = F.filter(tokens(exc), lambda w: F.length(w) > 2)
    head = F.lower(F.array_join(F.slice(words, 1, 3), " "))
    tail = F.lower(F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " "))
    begin = F.instr(low_full, head) - 1
    end = F.position(tail, low_full, begin + 1) - 1
    by_words = F.when(
        (F.size(words) >= 3) & (begin >= 0),
        F.when(end >= 0, span(begin, end + F.length(tail))).otherwise(
            span(begin, F.least(F.length(full), begin + size))
        ),
    )
    usable = (F.coalesce(full, F.lit("")) != "") & (F.coalesce(exc, F.lit("")) != "")
    return F.when(
        usable,
        F.when(exact >= 0, span(exact, exact + size)).when(loose >= 0, span(loose, loose + size)).otherwise(by_words),
    )


def statute_id(provision: Column, id_: Column, given: Column | None = None) -> Column:
    """Known id, else the first matching rule, else "unmapped"."""
    low = F.lower(F.concat_ws(" ", F.coalesce(provision, F.lit("")), F.coalesce(id_, F.lit(""))))
    by_rule = F.transform(F.array(low), lambda t: first_rule(t, K.STATUTE_RULES, "unmapped"))[0]
    return by_rule if given is None else F.when(given.isin(*K.STATUTE_IDS), given).otherwise(by_rule)


def statute_catalog(spark, bodies: dict[str, str] | None = None) -> DataFrame:
    """The statute dimension (six rows); texts are supplied by the caller."""
    rows = [(*s, (bodies or {}).get(s[0])) for s in K.STATUTES]
    return spark.createDataFrame(
        rows,
        "statute string, title string, record_id string, product_scope string, provisions string, "
        "published string, effective_from string, status string, body string",
    )


def clean_page(page: Column) -> Column:
    p = strip(page.cast("string"))
    return F.when((p != "") & ~p.contains("?") & (F.lower(p) != "n/a"), p)


def normalise_citation(df: DataFrame) -> DataFrame:
    """Uniform citation columns from whatever keys a source carries."""
    have = set(df.columns)

    def opt(*names: str) -> list[Column]:
        return [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have]

    def first(*names: str, default: str | None = None) -> Column:
        return F.coalesce(*opt(*names), F.lit(default).cast("string"))

    id_ = first("id", "chunk_id", "doc_id", default="unknown")
    doc_up = F.upper(F.coalesce(*opt("doc_id", "id"), F.lit("")))
    chunk_up = F.upper(F.coalesce(*opt("chunk_id"), F.lit("")))

    def by_id(rules, default: Column) -> Column:
        out = None
        for words, value in rules:
            cond = contains_any(doc_up, words) | contains_any(chunk_up, words)
            out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
        return out.otherwise(default)

    statute = first("statute")
    # The empty "unmapped" entry is a known statute too.
    mapped = statute.isin(*[s[0] for s in K.STATUTES])
    scope = F.nullif(lookup(statute, {s[0]: s[3] for s in K.STATUTES}), F.lit(""))
    covered = F.nullif(lookup(statute, {s[0]: s[4] for s in K.STATUTES}), F.lit(""))
    excerpt = opt("excerpt_text", "text")
    if "excerpts" in have:
        excerpt.append(F.get("excerpts", F.lit(0)))
    page = first("page_number") if "page_number" in have else F.lit(None).cast("string")
    page_given = F.col("page_number").isNotNull() if "page_number" in have else F.lit(False)
    chapter = first("chapter")
    status = F.nullif(lookup(statute, {s[0]: s[7] for s in K.STATUTES}), F.lit(""))
    out = {
        "n_id": id_,
        "n_chunk_id": first("chunk_id", "id", default="unknown") if "id" in have or "chunk_id" in have else id_,
        "n_doc_id": F.coalesce(*opt("doc_id", "sourceId"), id_),
        "n_title": first("title", "label", "source_authority", default=K.CITATION_TITLE),
        "n_section": first("section_title", "provision", "section", "clause_id", default=K.CITATION_SECTION),
        "n_excerpt": F.coalesce(*excerpt, F.lit("")),
        "n_page": F.when(page_given, clean_page(page)).otherwise(clean_page(first("pages"))),
        "n_authority": F.coalesce(
            *opt("source_authority", "authority"),
            by_id(K.AUTHORITY_BY_ID, F.when(F.coalesce(mapped, F.lit(False)), K.STATUTE_AUTHORITY)),
        ),
        "n_area": F.coalesce(
            *opt("legal_area"), by_id(K.AREA_BY_ID, F.coalesce(scope, F.lit(K.AREA_BY_ID_DEFAULT)))
        ),
        "n_breadcrumb": F.coalesce(
            *opt("breadcrumb", "context"), covered, F.concat(F.lit("Chapter "), chapter)
        ),
        "n_document_type": F.coalesce(
            *opt("document_type"),
            F.when(F.coalesce(mapped, F.lit(False)), K.DOCUMENT_TYPE_MAPPED).otherwise(K.DOCUMENT_TYPE_OTHER),
        ),
        "n_status": F.coalesce(status, F.lit("In Force")),
    }
    return df.withColumns(out)


def full_text(citations: DataFrame, statutes: DataFrame) -> DataFrame:
    """Add full_text: the citation's own, else the body of the statute it maps to.

    A plain equi-join on the statute id; Spark broadcasts the catalogue when its
    measured size allows.
    """
    cid, iid = F.upper(F.coalesce("n_chunk_id", F.lit(""))), F.upper(F.coalesce("n_id", F.lit("")))
    rule = None
    for name, words, both in K.FULL_TEXT_RULES:
        cond = contains_any(cid, words) | (contains_any(iid, words) if both else F.lit(False))
        rule = F.when(cond, F.lit(name)) if rule is None else rule.when(cond, F.lit(name))
    bodies = statutes.select(F.col("statute").alias("__s"), F.col("body").alias("__body")).where("__body is not null")
    direct = F.col("statute") if "statute" in citations.columns else F.lit(None).cast("string")
    d = citations.withColumn("__direct", direct).withColumn("__rule", rule)
    one = bodies.select(F.col("__s").alias("__direct"), F.col("__body").alias("__b1"))
    two = bodies.select(F.col("__s").alias("__rule"), F.col("__body").alias("__b2"))
    d = d.join(one, "__direct", "left").join(two, "__rule", "left")
    own = F.nullif(F.col("full_text"), F.lit("")) if "full_text" in citations.columns else F.lit(None).cast("string")
    return d.withColumn("full_text", F.coalesce(own, "__b1", "__b2")).drop("__direct", "__rule", "__b1", "__b2")


def source_label(df: DataFrame) -> DataFrame:
    """Add label: breadcrumb, else title and provision, cleaned of stock titles."""
    prov = F.regexp_replace(F.coalesce("provision", F.lit("")), r"(?i)^s\.(\d+)", "Section $1")
    prov = strip(F.regexp_replace(prov, r"(?i)^sec\.?\s*(\d+)", "Section $1"))
    title = strip(F.coalesce("title", F.lit("")))
    junk = title.startswith("The claims") | title.startswith("Document") | F.lower(title).contains("retrieved snippet")
    d = df.withColumns({"__p": prov, "__t": F.when(junk, "").otherwise(title)})
    crumb = F.nullif(F.col("breadcrumb"), F.lit("")) if "breadcrumb" in df.columns else F.lit(None).cast("string")
    p, t = F.col("__p"), F.col("__t")
    label = F.coalesce(
        crumb,
        F.when((t != "") & (p != "") & (t != p), F.concat(t, F.lit(" — "), p)).when(t != "", t).when(p != "", p),
        F.lit(K.CITATION_SECTION),
    )
    return d.withColumn("label", label).drop("__p", "__t")


def conversation_index(
    messages: DataFrame, cap: int = K.HISTORY_CAP, search: str | None = None, owner: str | None = None
) -> DataFrame:
    """Conversations newest first, one row each: title and tag of the first user text.

    Reads conv_id, turn, role, text and updated (any ordering value). The newest
    ``cap`` are kept per ``owner`` column, or in all.
    """
    keys = ([owner] if owner else []) + ["conv_id"]
    user = F.col("role") == "user"
    d = messages.groupBy(*keys).agg(
        F.min_by("text", F.when(user, F.col("turn"))).alias("__first"), F.max("updated").alias("updated"),
        F.count("*").alias("n_messages"),
    )
    d = d.where(F.col("__first").isNotNull()).withColumn("__low", F.lower("__first"))
    d = d.select(*keys, R.short_title(F.col("__first")).alias("title"), R.tag(F.col("__low")).alias("tag"), "updated", "n_messages")
    order = [F.col("updated").desc(), F.col("conv_id").desc()]
    if owner:
        w = Window.partitionBy(owner).orderBy(*order)
        d = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn")
    else:
        d = d.orderBy(*order).limit(cap)
    if search and search.strip():
        d = d.where(F.lower("title").contains(search.lower()))
    return d
