"""Understanding, classifying and decomposing tables of questions.

The rules are deterministic. Model output, where there is any, comes in as extra
columns or joined tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions import rules as R
from lexloom.functions.blocked import dense_index
from lexloom.functions.text import filled, lookup, strip


def no_facts() -> Column:
    return F.create_map().cast("map<string,string>")


def understand(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add intent, raw_product_description, entities and mentions_jurisdiction."""
    d = queries.withColumn("__low", F.lower(query)).withColumn("intent", R.intent(F.col("__low")))
    d = d.withColumns(
        {
            "raw_product_description": R.product_description(F.col(query), F.col("__low"), F.col("intent")),
            "entities": R.entities(F.col("__low")),
            "mentions_jurisdiction": R.jurisdiction_mention(F.col("__low")),
        }
    )
    return d.drop("__low")


HALO = 16384  # turns per block of one session


def _with_history(turns: DataFrame, n: int, values: dict[str, Column], block: int = HALO) -> DataFrame:
    """Per turn the latest non-null value among the ``n`` turns before it.

    A session is cut into blocks of consecutive turns; the last ``n`` turns of a
    block are also copied into the next one, so a very long session is spread over
    tasks and the row frame stays exact. Blocks count turns, not turn numbers, so
    gaps in ``turn_index`` lose no history.
    """
    if block < n:
        raise ValueError("a block must hold the whole history")
    cols = turns.columns
    d = turns.select("*", *[v.alias(f"__v_{name}") for name, v in values.items()])
    d = dense_index(d, ["session_id"], "turn_index", "__ix", block=block)
    own = F.floor(F.col("__ix") / block)
    copied = F.when(F.col("__ix") % block >= block - n, F.array(own, own + 1)).otherwise(F.array(own))
    d = d.withColumn("__blk", F.explode(copied)).withColumn("__own", F.col("__blk") == own)
    w = Window.partitionBy("session_id", "__blk").orderBy("turn_index").rowsBetween(-n, -1)
    out = d.select(*cols, "__own", *[F.last(f"__v_{name}", ignorenulls=True).over(w).alias(name) for name in values])
    return out.where("__own").drop("__own")


def inherit_context(turns: DataFrame, n: int = 8) -> DataFrame:
    """Follow-ups take description and herbs from the latest earlier user turn having them.

    Reads session_id, turn_index, role, text. Adds intent, entities and
    raw_product_description (inherited only by user turns that refer back).
    """
    d = turns.withColumn("__low", F.lower("text")).withColumn("intent", R.intent(F.col("__low")))
    d = d.withColumns(
        {
            "entities": R.entities(F.col("__low")),
            "raw_product_description": R.product_description(F.col("text"), F.col("__low"), F.col("intent")),
            "__refers": R.is_follow_up(F.col("__low")),
            "__marked": R.has_product(F.col("__low")),
        }
    ).drop("__low")
    user = F.col("role") == "user"
    d = _with_history(
        d, n,
        {
            "__desc": F.when(user & F.col("__marked"), F.col("text")),
            "__ents": F.when(user & (F.size("entities") > 0), F.col("entities")),
        },
    )
    refers = user & F.col("__refers")
    ents = F.when(refers & (F.size("entities") == 0), F.coalesce("__ents", "entities")).otherwise(F.col("entities"))
    desc = F.coalesce("raw_product_description", F.when(refers, F.col("__desc")))
    return d.withColumns({"entities": ents, "raw_product_description": desc}).drop(
        "__refers", "__marked", "__desc", "__ents"
    )


def history_text(turns: DataFrame, last: int = 3, cut: int = 300, cut_roles: tuple = ("user", "assistant")) -> DataFrame:
    """Prompt block of the last messages per session, long ones shortened."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc())
    recent = turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= last)
    content = strip(F.col("text"))
    short = F.when(
        F.col("role").isin(*cut_roles) & (F.length(content) > cut), F.concat(F.substring(content, 1, cut), F.lit("..."))
    ).otherwise(content)
    line = F.concat(F.initcap("role"), F.lit(": "), short)
    recent = recent.where(content != "").select("session_id", "turn_index", line.alias("line"))
    return recent.groupBy("session_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "line"))), lambda x: x["line"]), "\n"
        ).alias("history")
    )


def classify(understood: DataFrame, facts: str | None = None, extracted: DataFrame | None = None) -> DataFrame:
    """Add category, confidence, reasoning, route, use, ingredients and missing facts."""
    d = understood if facts else understood.withColumn("facts", no_facts())
    facts = facts or "facts"
    d = d.withColumn("__low", F.lower(F.coalesce("raw_product_description", F.lit(""))))
    d = d.withColumn("__cat", R.category(F.col("__low"))).withColumns(
        {
            "category": F.col("__cat.category"), "confidence": F.col("__cat.confidence"),
            "reasoning": F.col("__cat.reason"), "route_of_administration": R.route(F.col("__low")),
            "intended_use": R.intended_use(F.col("__low")),
            "ingredients": R.botanicals(F.col("__low"), F.col("entities")),
        }
    ).drop("__low", "__cat")
    if extracted is not None:
        d = merge_extracted(d, extracted)
    d = apply_known_facts(d, facts)
    has = F.coalesce("raw_product_description", F.lit("")) != ""
    return d.withColumn(
        "missing_facts",
        R.missing_facts(F.col("category"), F.col("route_of_administration"), F.col("intent"), has, F.col(facts)),
    )


def merge_extracted(cls: DataFrame, extracted: DataFrame, key: str = "query_id") -> DataFrame:
    """Fill only open fields from a model's extraction; ingredients are united.

    The extraction counts only where a description exists and the category is
    open or no ingredient was found.
    """
    names = ["category", "confidence", "route_of_administration", "intended_use", "dosage_form", "ingredients", "reasoning"]
    have = set(extracted.columns)
    x = extracted.select(key, *[F.col(n).alias(f"x_{n}") for n in names if n in have])
    if "dosage_form" not in cls.columns:
        cls = cls.withColumn("dosage_form", F.lit(None).cast("string"))
    d = cls.join(x, key, "left")
    asked = (F.coalesce("raw_product_description", F.lit("")) != "") & (
        (F.col("category") == "unclassified") | (F.size("ingredients") == 0)
    )
    d = d.withColumn("__asked", asked)

    def opt(n):
        return F.when(F.col("__asked"), F.col(f"x_{n}")) if n in have else F.lit(None)

    take_cat = (F.col("category") == "unclassified") & (F.coalesce(opt("category"), F.lit("unclassified")) != "unclassified")
    new = {
        "confidence": F.when(take_cat, opt("confidence")).otherwise(F.col("confidence")),
        "reasoning": F.when(
            (F.col("reasoning") == K.DEFAULT_CLASS[2]) & (F.coalesce(opt("reasoning"), F.lit("")) != ""), opt("reasoning")
        ).otherwise(F.col("reasoning")),
        "ingredients": F.array_sort(
            F.array_union("ingredients", F.coalesce(opt("ingredients").cast("array<string>"), F.array().cast("array<string>")))
        ),
        "dosage_form": F.coalesce(F.nullif("dosage_form", F.lit("")), opt("dosage_form").cast("string")),
        "category": F.when(take_cat, opt("category")).otherwise(F.col("category")),
    }
    for n in ("route_of_administration", "intended_use"):
        use = (F.col(n) == "unknown") & (F.coalesce(opt(n).cast("string"), F.lit("unknown")) != "unknown")
        new[n] = F.when(use, opt(n).cast("string")).otherwise(F.col(n))
    return d.withColumns(new).drop("__asked", *[f"x_{n}" for n in names if n in have])


def apply_known_facts(cls: DataFrame, facts: str = "facts") -> DataFrame:
    """Known facts override; only allowed values count."""
    f = F.col(facts)
    route = F.lower(strip(R.fact(f, "route_of_administration")))
    use = F.lower(strip(R.fact(f, "intended_use")))
    if "dosage_form" not in cls.columns:
        cls = cls.withColumn("dosage_form", F.lit(None).cast("string"))
    return cls.withColumns(
        {
            "category": F.when(R.has_fact(f, "category"), R.parse_category(R.fact(f, "category"))).otherwise(F.col("category")),
            "route_of_administration": F.when(route.isin(*K.ROUTE_FACTS), route).otherwise(F.col("route_of_administration")),
            "intended_use": F.when(use.isin(*K.USE_FACTS), use).otherwise(F.col("intended_use")),
            "dosage_form": F.coalesce(R.fact(f, "dosage_form"), "dosage_form"),
        }
    )


def hyde_gate(cls: DataFrame, generated: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """Add hyde_eligible and hyde_context (a generated description, where eligible and given)."""
    ok = R.hyde_eligible(F.col("raw_product_description"), F.col("category"), F.col("confidence"))
    d = cls.withColumn("hyde_eligible", ok)
    if generated is None:
        return d.withColumn("hyde_context", F.lit(None).cast("string"))
    g = generated.select(key, strip(F.col("generated")).alias("__g"))
    d = d.join(g, key, "left")
    return d.withColumn("hyde_context", F.when(F.col("hyde_eligible"), F.nullif("__g", F.lit("")))).drop("__g")


def route_jurisdiction(cls: DataFrame, facts: str = "facts", query: str = "query", max_rounds: int = 2) -> DataFrame:
    """Add jurisdiction and assumptions."""
    d = cls.withColumn("__low", F.lower(query))
    round_ = F.col("clarification_round") if "clarification_round" in cls.columns else F.lit(0)
    assumed = F.coalesce(R.jurisdiction_assumed(F.col(facts), F.col("missing_facts"), round_, max_rounds), F.lit(False))
    j = F.when(assumed, F.lit("india")).otherwise(R.jurisdiction(F.col("__low"), F.col(facts)))
    notes = F.when(assumed, F.array(F.lit(K.INDIA_ASSUMPTION))).otherwise(F.array().cast("array<string>"))
    return d.withColumns({"jurisdiction": j, "assumptions": notes}).drop("__low")


def question_catalog(spark) -> DataFrame:
    rows = [(f, q, o) for f, q, o in K.QUESTION_CATALOG]
    return spark.createDataFrame(rows, "field string, question string, options array<string>")


def clarification_questions(missing: DataFrame, key: str = "query_id") -> DataFrame:
    """Questions for missing fields: catalogue questions (at most 3), else generic ones (at most 2).

    The catalogue is a four-row constant, so its look-up is a projection.
    """
    known = [f for f, _, _ in K.QUESTION_CATALOG]
    valid = F.filter("missing_facts", lambda f: f.isin(*known))
    asked = F.when(F.size(valid) > 0, F.slice(valid, 1, 3)).otherwise(F.slice("missing_facts", 1, 2))
    d = missing.select(key, F.posexplode_outer(asked).alias("pos", "field")).where("field is not null")
    generic = F.format_string(K.GENERIC_QUESTION, F.replace(F.col("field"), F.lit("_"), F.lit(" ")))
    return d.select(
        key, (F.col("pos") + 1).alias("question_no"), "field",
        lookup(F.col("field"), {f: q for f, q, _ in K.QUESTION_CATALOG}, generic).alias("question"),
        lookup(F.col("field"), {f: o for f, _, o in K.QUESTION_CATALOG}, F.lit(None).cast("array<string>")).alias("options"),
    )


def clarification_message(questions: DataFrame, key: str = "query_id") -> DataFrame:
    """The reply text that carries the questions of one turn."""
    opts = F.when(
        F.coalesce(F.size("options"), F.lit(0)) > 0,
        F.concat(F.lit(" (Options: "), F.array_join("options", ", "), F.lit(")")),
    ).otherwise("")
    line = F.concat(F.col("question_no").cast("string"), F.lit(". "), "question", opts)
    return questions.groupBy(key).agg(
        F.array_join(
            F.concat(
                F.array(F.lit(K.CLARIFY_INTRO)),
                F.transform(F.array_sort(F.collect_list(F.struct("question_no", line.alias("l")))), lambda x: x["l"]),
                F.array(F.lit(K.CLARIFY_OUTRO)),
            ),
            "\n",
        ).alias("final_answer")
    )


def refinement_query(messages: DataFrame) -> DataFrame:
    """Per session: the last ordinary user question joined with the newest refinement."""
    user = messages.where("role = 'user'")
    is_ref = F.col("text").startswith("Refinement:")
    d = user.groupBy("session_id").agg(
        F.max_by("text", F.when(is_ref, F.col("turn_index"))).alias("ref"),
        F.max_by("text", F.when(~is_ref, F.col("turn_index"))).alias("original"),
    )
    body = F.regexp_replace("ref", r"^Refinement:\s*", "")
    text = F.when(F.coalesce("original", F.lit("")) != "", F.concat("original", F.lit(" (Refinement: "), body, F.lit(")"))).otherwise(body)
    return d.where("ref is not null").select("session_id", text.alias("query"))


def decompose(cls: DataFrame, query: str = "query") -> DataFrame:
    """One row per (query, area) with the area's retrieval text."""
    d = cls.withColumn("__low", F.lower(query))
    ing = F.col("ingredients") if "ingredients" in cls.columns else F.lit(None).cast("array<string>")
    d = d.withColumn("__areas", R.select_areas(F.col("category"), F.col("__low"), ing))
    base = F.coalesce(F.nullif("hyde_context", F.lit("")), F.col(query)) if "hyde_context" in cls.columns else F.col(query)
    # Areas are never empty; the outer form adds no filter that repeats the rules.
    d = d.withColumn("__base", base).select("*", F.posexplode_outer("__areas").alias("area_ix", "legal_area"))
    d = d.withColumn("query_text", R.reframe(F.col("__base"), F.col("legal_area")))
    return d.withColumn("product_category", F.col("category")).drop("__low", "__areas", "__base")


def retry_decompose(failed: DataFrame, query: str = "query") -> DataFrame:
    """All six areas for failed queries, hinting at unverified citations; no category."""
    hints = F.col("unverified") if "unverified" in failed.columns else F.array().cast("array<string>")
    hint = F.when(F.coalesce(F.size(hints), F.lit(0)) > 0, F.concat(F.lit(" "), F.array_join(hints, ", "))).otherwise("")
    d = failed.withColumn("__base", F.concat(F.col(query), hint))
    areas = F.array(*[F.lit(a) for a in K.AREAS])
    d = d.select("*", F.posexplode_outer(areas).alias("area_ix", "legal_area"))
    d = d.withColumn("query_text", R.reframe(F.col("__base"), F.col("legal_area")))
    return d.withColumn("product_category", F.lit(None).cast("string")).drop("__base")


# --- request texts for an external generator -----------------------------------------------
def build_prompts(df: DataFrame, kind: str) -> DataFrame:
    """Add ``prompt`` for kind understand, classify, hyde, answer or audit."""

    def opt(name: str, default: str = "") -> Column:
        return filled(F.col(name).cast("string"), default) if name in df.columns else F.lit(default)

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    if kind == "understand":
        prompt = text(
            "Extract from the message: intent (patentability, compliance, abs_obligation, classification, "
            "general_info or other), entities, mentions_jurisdiction and raw_product_description. Resolve "
            "references with the conversation; infer nothing that is not stated.\n",
            opt("history"), "\nMessage:\n", F.col("query"),
        )
    elif kind == "classify":
        prompt = text(
            "Classify the product as one of: " + ", ".join(K.CATEGORIES) + ". Give ingredients, route, use and "
            "dosage form. Use unclassified when the description is vague.\nProduct:\n",
            opt("raw_product_description"),
        )
    elif kind == "hyde":
        prompt = text(
            "Write two or three declarative sentences describing this product as a regulatory filing would: "
            "ingredients, origin, form and use.\nProduct:\n", opt("raw_product_description"),
        )
    elif kind == "answer":
        greeting = text("Greet the user and say which legal questions you can help with.\nMessage: ", F.col("query"))
        grounded = text(
            "Intent: ", opt("intent", "other"), "\nAnswer from the context only, citing sections. Say so when the "
            "material is insufficient.\n", opt("history"), "\nCONTEXT:\n",
            opt("context", "No statutory context provided."), "\n\nQUESTION: ", F.col("query"),
        )
        prompt = F.when((opt("intent", "other") == "general_info") & (opt("context") == ""), greeting).otherwise(grounded)
    elif kind == "audit":
        prompt = text(
            "Assess the formulation under Indian law. Reply with one JSON object with the keys verdict, tkdl_band, "
            "s3e_band, nba_band and analysis.\nAbstract: ", opt("abstract", "(not provided)"),
            "\nClassification: ", opt("classification"),
            "\nSynergy: ", opt("synergy", "No comparative synergy data described."),
            "\nIngredients: ", opt("ingredients_text", "(not specified)"),
            "\nCONTEXT:\n",
            opt("context", "No retrieved context — analysis based on general statutory knowledge only."),
        )
    else:
        raise ValueError(f"unknown prompt kind: {kind}")
    return df.withColumn("prompt", prompt)
