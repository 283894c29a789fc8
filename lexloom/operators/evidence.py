"""Merging evidence, building contexts and sources, and checking answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions import rules as R
from lexloom.functions.signals import locator_form
from lexloom.functions.text import contains_any, filled, fixed, let, present, round4, strip
from lexloom.session import checkpointed


def merge_evidence(ranked: DataFrame, n: int = K.EVIDENCE_KEPT) -> DataFrame:
    """Best instance per (query, chunk), then the ``n`` best per query, as ``evidence_rank``.

    Both steps prune inside the tasks first: a combined aggregate, then a
    limited window.
    """
    rest = [c for c in ranked.columns if c not in ("query_id", "chunk_id")]
    at = F.struct("area_ix", "position")
    # first instance wins a tie, so positions count negatively
    order = F.struct(F.col("final_score"), -F.col("area_ix"), -F.col("position"))
    best = ranked.groupBy("query_id", "chunk_id").agg(
        F.max_by(F.struct(*rest), order).alias("r"), F.min(at).alias("__seen")
    )
    best = best.select("query_id", "chunk_id", "r.*", "__seen")
    w = Window.partitionBy("query_id").orderBy(
        round4(F.col("final_score")).desc(), round4(F.col("relevance_score")).desc(),
        round4(F.coalesce("vector_score", F.lit(0.0))).desc(), F.col("__seen"),
    )
    return best.withColumn("evidence_rank", F.row_number().over(w)).where(F.col("evidence_rank") <= n).drop("__seen")


def canonical_doc(df: DataFrame) -> DataFrame:
    """Add doc_title, doc_authority, doc_area, doc_url and doc_key of the parent instrument."""
    low = F.lower(F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("provision", "title", "source_authority", "chunk_id")]
    ))
    d = df.withColumn("__low", low)
    area = F.nullif(F.col("legal_area"), F.lit(""))
    url = F.nullif(F.col("source_url"), F.lit("")) if "source_url" in df.columns else F.lit(None).cast("string")

    def info(title, authority, area_, link):
        return F.struct(
            title.alias("title"), authority.alias("authority"), area_.alias("area"), link.alias("url")
        )

    out = None
    for words, title, authority, default, link, own_url in K.CANONICAL_RULES:
        value = info(
            F.lit(title), F.lit(authority), F.coalesce(area, F.lit(default)),
            F.coalesce(url, F.lit(link)) if own_url else F.lit(link),
        )
        cond = contains_any(F.col("__low"), words)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    t, a, f = K.CANONICAL_FALLBACK
    auth = F.nullif(F.col("source_authority"), F.lit(""))
    out = out.otherwise(info(
        F.coalesce(auth, F.nullif(F.col("title"), F.lit("")), F.lit(t)), F.coalesce(auth, F.lit(a)),
        F.coalesce(area, F.lit(f)), F.coalesce(url, F.lit("")),
    ))
    d = d.withColumn("__doc", out)
    return d.withColumns(
        {
            "doc_title": F.col("__doc.title"), "doc_authority": F.col("__doc.authority"),
            "doc_area": F.col("__doc.area"), "doc_url": F.col("__doc.url"),
            "doc_key": strip(F.lower("__doc.title")),
        }
    ).drop("__low", "__doc")


def _sorted(items: Column, field: str) -> Column:
    return F.transform(F.array_sort(items), lambda x: x[field])


def context_string(evidence: DataFrame) -> DataFrame:
    """Context text per query: documents in order of appearance, header once, provisions below."""
    d = canonical_doc(evidence)
    prov = filled(F.col("provision"), F.coalesce("title", F.lit("")))
    chapter = F.when(
        (F.coalesce("chapter", F.lit("")) != "") & (F.col("chapter") != "N/A"), F.concat(F.lit(", Chapter: "), "chapter")
    ).otherwise("")
    pages = F.when(
        (F.coalesce("pages", F.lit("")) != "") & (F.col("pages") != "?"), F.concat(F.lit(", Pages: "), "pages")
    ).otherwise("")
    block = F.concat(
        F.lit("• [Provision: "), prov, F.lit(" | Ref: "), "chunk_id", chapter, pages, F.lit("]\n"),
        strip(F.coalesce("text", F.lit(""))),
    )
    d = d.withColumn("__block", block)
    head = F.struct("evidence_rank", "doc_title", "doc_authority", "doc_area")
    docs = d.groupBy("query_id", "doc_key").agg(
        F.min(head).alias("h"), F.collect_list(F.struct("evidence_rank", "__block")).alias("bs")
    )
    text = F.concat(
        F.lit("### [DOCUMENT: "), "h.doc_title", F.lit(" | Authority: "), "h.doc_authority",
        F.lit(" | Legal Framework: "), "h.doc_area", F.lit("]\n"),
        F.array_join(_sorted(F.col("bs"), "__block"), "\n\n"),
    )
    docs = docs.select("query_id", F.struct(F.col("h.evidence_rank").alias("r"), text.alias("t")).alias("d"))
    return docs.groupBy("query_id").agg(
        F.array_join(_sorted(F.collect_list("d"), "t"), "\n\n---\n\n").alias("context")
    )


def format_sources(evidence: DataFrame, max_sources: int = K.EVIDENCE_KEPT) -> DataFrame:
    """One row per (query, document): provisions, excerpts, chunks, sections and pages combined."""
    d = canonical_doc(evidence)

    def opt(name: str) -> Column:
        return F.col(name).cast("string") if name in evidence.columns else F.lit(None).cast("string")

    clean = strip(F.coalesce("text", F.lit("")))
    prov = filled(F.col("provision"), F.col("title"), K.PROVISION_FALLBACK)
    item = F.struct(
        F.col("evidence_rank").alias("rank"), F.col("chunk_id"), prov.alias("provision"), F.col("title"),
        clean.alias("text"), F.col("pages"), F.col("chapter"), F.col("doc_title"), F.col("doc_authority"),
        F.col("doc_area"), F.coalesce(opt("source_url"), "doc_url").alias("url"), opt("document_type").alias("dtype"),
    )
    g = d.groupBy("query_id", "doc_key").agg(F.array_sort(F.collect_list(item)).alias("s"))
    first = F.col("s")[0]

    def add_page(acc, x):
        p = x["pages"]
        useful = (F.coalesce(p, F.lit("")) != "") & (p != "?") & ~F.contains(F.coalesce(acc, F.lit("")), p)
        started = (F.coalesce(acc, F.lit("")) != "") & (acc != "?")
        return F.when(useful, F.when(started, F.concat(acc, F.lit(", "), p)).otherwise(p)).otherwise(acc)

    provisions = F.array_distinct(F.transform("s", lambda x: x["provision"]))
    excerpts = F.array_distinct(
        F.transform(F.filter("s", lambda x: x["text"] != ""), lambda x: F.substring(x["text"], 1, 600))
    )
    ids = F.array_distinct(F.transform("s", lambda x: x["chunk_id"]))
    out = g.select(
        "query_id", first["rank"].alias("__rank"), first["chunk_id"].alias("id"), F.col("doc_key").alias("doc_id"),
        first["doc_title"].alias("title"), F.array_join(provisions, ", ").alias("provision"),
        provisions.alias("provisions"), first["chapter"].alias("chapter"),
        F.aggregate(F.slice("s", 2, 1 << 30), first["pages"], add_page).alias("pages"),
        first["url"].alias("source_url"), first["doc_authority"].alias("source_authority"),
        filled(first["dtype"], K.DOCTYPE_FALLBACK).alias("document_type"), first["doc_area"].alias("legal_area"),
        F.nullif(F.substring(first["text"], 1, 1200), F.lit("")).alias("text"), excerpts.alias("excerpts"),
        ids.alias("chunk_ids"), F.size(ids).alias("chunk_count"),
        F.transform(
            "s", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["provision"].alias("provision"),
                                    x["title"].alias("title"), x["text"].alias("text"), x["pages"].alias("pages"),
                                    x["chapter"].alias("chapter"))
        ).alias("sections"),
    )
    w = Window.partitionBy("query_id").orderBy("__rank")
    out = out.withColumn("source_no", F.row_number().over(w)).where(F.col("source_no") <= max_sources)
    return out.drop("__rank")


# --- guardrails --------------------------------------------------------------------------
def guardrail(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """passed, enough_evidence, current_law, correct_jurisdiction and reason per answer."""
    agg = evidence.groupBy("query_id").agg(
        F.count("*").alias("__n"), F.avg("final_score").alias("__s"), F.avg("applicability_score").alias("__a")
    )
    d = answers.join(agg, "query_id", "left").withColumn("__low", F.lower(F.coalesce("answer", F.lit(""))))
    low = F.col("__low")

    def said(text: str, value: str) -> Column:
        head, tail = text.split("%.2f")
        return F.concat(F.lit(head), fixed(F.col(value), 2), F.lit(tail))

    thin = (low.contains("insufficient") & low.contains("material")) | low.contains("cannot answer")
    reason = (
        F.when(F.coalesce("__n", F.lit(0)) == 0, F.lit(K.GUARD_NO_EVIDENCE))
        .when(F.col("__s") < K.GUARD_MIN_SCORE, said(K.GUARD_LOW_SCORE, "__s"))
        .when(F.col("__a") < K.GUARD_MIN_APPLICABILITY, said(K.GUARD_LOW_APPLICABILITY, "__a"))
        .when(thin, F.lit(K.GUARD_INSUFFICIENT))
    )
    d = d.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return d.withColumns(
        {"passed": ok, "enough_evidence": ok, "current_law": F.lit(True), "correct_jurisdiction": F.lit(True)}
    ).drop("__n", "__s", "__a", "__low")


def gate_answers(df: DataFrame) -> DataFrame:
    """Final answer and status; chit-chat passes, failed answers abstain."""
    free = F.col("intent").isin("general_info", "other")
    fails = ~free & ~F.col("passed")
    return df.withColumns(
        {
            "status": F.when(fails, "abstained").otherwise("answered"),
            "final_answer": F.when(fails, F.concat(F.lit(K.ABSTAIN_PREFIX), "reason")).otherwise(F.col("answer")),
        }
    )


def retry_loop(
    queries: DataFrame,
    attempt: Callable[[DataFrame, int], DataFrame],
    rounds: int = 1,
) -> DataFrame:
    """Answer all queries, then give the failed ones ``rounds`` more attempts.

    ``attempt(queries, round)`` returns one row per query with ``status``, and may return
    ``unverified`` citations, which the next attempt gets as a column. Each
    result is checkpointed to the reliable folder, so a lost executor or a later
    round never repeats earlier retrieval, and a round without failures ends it.
    """
    out = checkpointed(attempt(queries, 0))
    for i in range(1, rounds + 1):
        failed = out.where("status = 'abstained'")
        if failed.isEmpty():
            break
        hints = ["unverified"] if "unverified" in out.columns else []
        again = checkpointed(attempt(queries.join(failed.select("query_id", *hints), "query_id"), i))
        done = out.join(again.select("query_id"), "query_id", "left_anti")
        out = done.unionByName(again, allowMissingColumns=True)
    return out


def assumption_caveat(df: DataFrame) -> DataFrame:
    """Append the assumptions block to non-empty answers."""
    has = (F.coalesce(F.size("assumptions"), F.lit(0)) > 0) & (F.coalesce("answer", F.lit("")) != "")
    block = F.concat(F.lit(K.CAVEAT_HEAD), F.array_join("assumptions", "\n> - "))
    return df.withColumn("answer", F.when(has, F.concat("answer", block)).otherwise(F.col("answer")))


def answer_citations(answer: Column) -> Column:
    """Cited sections, rules and articles, first spelling per normalised form."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(K.ANSWER_CITATION_PATTERN), F.lit(0)), strip)
    pairs = F.transform(found, lambda c: F.struct(c.alias("cite"), locator_form(c).alias("norm")))

    def firsts(ps):
        return let(
            F.transform(ps, lambda p: p["norm"]),
            lambda norms: F.filter(ps, lambda p, i: F.array_position(norms, p["norm"]) == i + 1),
        )

    return F.transform(let(pairs, firsts), lambda p: p["cite"])


def verify_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """passed, verified, unverified and reason per answer (opt-in check).

    Evidence is the merged top-n of a query, so its per-query array is small and
    every citation is tested against it inside one row.
    """
    locs = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", locator_form(F.col(c).cast("string")))
        for c in ("provision", "section", "article") if c in evidence.columns
    ]
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("provision", "title", "text")]))
    ev = evidence.groupBy("query_id").agg(
        F.collect_list(F.struct(present(F.array(*locs)).alias("locs"), text.alias("text"))).alias("__ev")
    )
    d = answers.join(ev, "query_id", "left")
    d = d.withColumn("__admit", R.admission_check(F.lower(F.coalesce("answer", F.lit("")))))
    d = d.withColumn("__cited", answer_citations(F.coalesce("answer", F.lit(""))))
    d = d.withColumn("__ev", F.coalesce("__ev", F.array().cast(ev.schema["__ev"].dataType)))

    def target(c):
        norm = locator_form(c)
        number = F.regexp_extract(norm, r"(\d+[a-z]?(?:\([a-z0-9]+\))*)", 1)
        return F.when(number != "", number).otherwise(norm)

    items = F.transform(
        "__cited",
        lambda c: F.struct(
            c.alias("cite"), target(c).alias("t"), F.regexp_extract(target(c), r"^(\d+)", 1).alias("parent"),
            F.regexp_extract(target(c), r"\(([a-z0-9]+)\)", 1).alias("clause"),
        ),
    )
    d = d.withColumn("__items", items)

    def backed(x):
        parent = F.when(x["parent"] != "", x["parent"]).otherwise(x["t"])
        return F.exists(
            "__ev",
            lambda e: F.exists(e["locs"], lambda s: F.contains(s, x["t"]) | F.contains(x["t"], s))
            | F.contains(e["text"], x["t"])
            | (
                F.contains(e["text"], F.concat(F.lit("section "), parent))
                & ((x["clause"] == "") | F.contains(e["text"], F.concat(F.lit("("), x["clause"], F.lit(")"))))
            ),
        )

    d = d.withColumn("__checked", F.transform("__items", lambda x: F.struct(x["cite"].alias("cite"), backed(x).alias("ok"))))
    admitted = F.col("__admit").isNotNull()
    none = F.array().cast("array<string>")
    good = F.transform(F.filter("__checked", lambda x: x["ok"]), lambda x: x["cite"])
    bad = F.transform(F.filter("__checked", lambda x: ~x["ok"]), lambda x: x["cite"])
    d = d.withColumns({"verified": F.when(admitted, none).otherwise(good), "unverified": F.when(admitted, none).otherwise(bad)})
    reason = F.coalesce(
        "__admit",
        F.when(F.size("unverified") > 0, F.format_string(K.UNVERIFIED_REASON, F.array_join("unverified", ", "))),
    )
    d = d.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())
    return d.drop("__ev", "__admit", "__cited", "__items", "__checked")
