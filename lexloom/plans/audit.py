"""A table of formulation requests → banded verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import audit as A
from lexloom.operators.questions import build_prompts
from lexloom.operators.rerank import rerank
from lexloom.plans.answer import retrieve
from lexloom.session import checkpointed


def audit(requests: DataFrame, chunks: DataFrame, generator: Callable[[DataFrame], DataFrame] | None = None,
          encoder: Callable | None = None, dim: int = 256) -> DataFrame:
    """All requests in one job. ``generator`` maps (query_id, prompt) to (query_id, reply)."""
    subs = checkpointed(A.audit_queries(requests))
    packs = retrieve(subs, chunks, encoder, dim)
    ranked = rerank(packs, subs.withColumn("product_category", F.col("rerank_category")), small=True)
    d = requests.join(A.audit_context(ranked), "query_id", "left")
    if generator is None:
        d = d.withColumn("reply", F.lit(""))
    else:
        made = generator(build_prompts(d, "audit").select("query_id", "prompt"))
        d = d.join(made.select("query_id", "reply"), "query_id", "left")
    d = d.withColumn("v", A.parse_verdict(F.coalesce("reply", F.lit(""))))
    return A.audit_report(d.select("query_id", "context", "source_ids", "v.*"))
