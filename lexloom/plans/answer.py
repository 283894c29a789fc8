"""A table of questions → grounded answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.operators import evidence as E
from lexloom.operators import questions as Q
from lexloom.operators.rerank import rerank
from lexloom.operators.retrieval import embed, filtered_topk, route, to_candidate
from lexloom.session import checkpointed

BROADCAST_HITS = 500_000  # rows of ids and scores, below 50 MB


def prepare(queries: DataFrame, extracted: DataFrame | None = None, generated: DataFrame | None = None) -> DataFrame:
    """Understanding, classification, description gate and jurisdiction; no shuffle without model tables."""
    d = Q.understand(queries)
    d = Q.classify(d, "facts" if "facts" in queries.columns else None, extracted)
    return Q.route_jurisdiction(Q.hyde_gate(d, generated))


def retrieve(sub_queries: DataFrame, chunks: DataFrame, encoder: Callable | None = None, dim: int = 256,
             k: int = 5) -> DataFrame:
    """Candidates per (query, area): routed, filtered, exact top-k."""
    routed = route(sub_queries)
    asked = [c for c in ("query_text", "collection", "filter_areas", "product_category") if c in routed.columns]
    routed = routed.withColumn("__ask", F.sha2(F.to_json(F.struct(*asked)), 256))
    # Equal questions under equal filters are searched once, under the first of their names.
    once = routed.groupBy("__ask").agg(F.min(F.struct("query_id", "area_ix", *asked)).alias("s")).select("__ask", "s.*")
    once = checkpointed(once)
    # Hits are k rows per sub-query. Counted, and broadcast when few, they find their
    # texts without shuffling the corpus; otherwise both sides are joined by key.
    hits = filtered_topk(embed(once.drop("__ask"), "query_text", encoder, dim), chunks, k)
    hits = hits.join(once.select("__ask", "query_id", "area_ix"), ["query_id", "area_ix"]).drop("query_id", "area_ix")
    hits = checkpointed(hits.join(routed.select("__ask", "query_id", "area_ix"), "__ask").drop("__ask"))
    few = hits.count() <= BROADCAST_HITS
    found = chunks.drop("embedding").join(F.broadcast(hits) if few else hits, "chunk_id")
    return to_candidate(found.join(sub_queries.select("query_id", "area_ix", "query_text"), ["query_id", "area_ix"]))


def ranked_evidence(sub_queries: DataFrame, packs: DataFrame) -> DataFrame:
    return E.merge_evidence(rerank(packs, sub_queries, small=True))


def answer(
    queries: DataFrame, chunks: DataFrame, encoder: Callable | None = None, dim: int = 256,
    generator: Callable[[DataFrame], DataFrame] | None = None, verify: bool = False, retries: int = 1,
    extracted: DataFrame | None = None, generated: DataFrame | None = None, max_rounds: int = 2,
) -> DataFrame:
    """One row per question: status, final_answer, context, sources and pending_questions.

    ``generator`` maps (query_id, prompt) rows to (query_id, answer); without it
    the retrieved context itself is the answer. ``verify`` adds the citation
    check. ``extracted`` and ``generated`` are a model's readings and descriptions
    of the products. Failed questions are retried once over all areas, with the
    citations that could not be verified as hints.

    General questions are answered at once, without retrieval. Questions that lack
    a load-bearing fact stop with ``needs_clarification`` and what to ask, for at most
    ``max_rounds`` rounds (a column ``clarification_round`` counts them).
    """
    everyone = checkpointed(prepare(queries, extracted, generated))
    round_no = F.col("clarification_round") if "clarification_round" in queries.columns else F.lit(0)
    direct = F.coalesce(R.bypass_gate(F.col("intent")), F.lit(False))
    asks = F.coalesce(R.clarify_gate(F.col("intent"), F.col("missing_facts"), round_no, max_rounds), F.lit(False))
    prepared = everyone.where(~direct & ~asks)

    def attempt(part: DataFrame, round_no: int) -> DataFrame:
        subs = Q.decompose(part) if round_no == 0 else Q.retry_decompose(part)
        subs = checkpointed(subs)
        # Context, sources and checks all read the evidence (a few rows per question).
        evidence = checkpointed(ranked_evidence(subs, retrieve(subs, chunks, encoder, dim)))
        d = part.join(E.context_string(evidence), "query_id", "left")
        if generator is None:
            d = d.withColumn("answer", F.coalesce("context", F.lit("")))
        else:
            made = generator(Q.build_prompts(d, "answer").select("query_id", "prompt"))
            d = d.join(made.select("query_id", "answer"), "query_id", "left")
        d = E.guardrail(E.assumption_caveat(d), evidence)
        if verify:
            v = E.verify_citations(d.select("query_id", "answer"), evidence)
            v = v.select("query_id", F.col("passed").alias("__ok"), F.col("reason").alias("__why"), "verified", "unverified")
            d = d.drop("unverified").join(v, "query_id", "left")
            d = d.withColumns({"reason": F.coalesce("reason", "__why"), "passed": F.col("passed") & F.col("__ok")})
            d = d.drop("__ok", "__why")
        # Every pack of a question is ranked, so ranked evidence is empty only where nothing was found.
        sources = E.format_sources(evidence).groupBy("query_id").agg(
            F.array_sort(
                F.collect_list(F.struct("source_no", "id", "title", "provision", "pages", "chunk_ids"))
            ).alias("sources")
        )
        return E.gate_answers(d).join(sources, "query_id", "left")

    out = E.retry_loop(prepared, attempt, retries)
    if generator is None:
        greeted = everyone.where(direct).withColumn("answer", F.lit(""))
    else:
        made = generator(Q.build_prompts(everyone.where(direct), "answer").select("query_id", "prompt"))
        greeted = everyone.where(direct).join(made.select("query_id", "answer"), "query_id", "left")
    greeted = greeted.withColumns({"status": F.lit("answered"), "final_answer": F.col("answer")})
    open_ = everyone.where(~direct & asks)
    questions = Q.clarification_questions(open_)
    one = F.struct("question_no", "field", "question", "options")
    pending = questions.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("pending_questions"))
    paused = (
        open_.withColumn("status", F.lit("needs_clarification"))
        .join(Q.clarification_message(questions), "query_id", "left")
        .join(pending, "query_id", "left")
    )
    return out.unionByName(greeted, allowMissingColumns=True).unionByName(paused, allowMissingColumns=True)


def chat_result(answers: DataFrame) -> DataFrame:
    """The result record, with sources and pending questions as JSON for a text sink."""
    return answers.select(
        "query_id", "status", F.col("final_answer").alias("answer"), F.to_json("sources").alias("sources"),
        F.to_json("pending_questions").alias("questions"),
    )
