"""Question, product and slot rules as column expressions.

Columns named ``low`` hold lower-cased text. Word rules match inside words, as
plain substrings: "hi" in "this" counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.text import contains_any, filled, first_rule, lookup, present, str_array, strip


def intent(low: Column) -> Column:
    return first_rule(low, K.INTENT_RULES, "other")


def has_product(low: Column) -> Column:
    return contains_any(low, K.FORMULATION_MARKERS)


def product_description(query: Column, low: Column, intent_: Column) -> Column:
    """The question itself when it describes a product; else null."""
    return F.when(has_product(low) & (intent_ != "general_info"), query)


def entities(low: Column) -> Column:
    """Known herb names in the text, capitalised, in list order."""
    return present(F.array(*[F.when(low.contains(m), F.lit(m.capitalize())) for m in K.ENTITY_MARKERS]))


def is_follow_up(low: Column) -> Column:
    return contains_any(low, K.PRONOUN_MARKERS)


def jurisdiction_mention(low: Column) -> Column:
    return first_rule(low, K.MENTION_RULES)


def category(low: Column) -> Column:
    """struct(category, confidence, reason) of the first matching category rule."""

    def value(label, conf, reason):
        return F.struct(
            F.lit(label).alias("category"), F.lit(conf).alias("confidence"), F.lit(reason).alias("reason")
        )

    out = None
    for label, conf, reason, words in K.CATEGORY_RULES:
        cond = contains_any(low, words)
        out = F.when(cond, value(label, conf, reason)) if out is None else out.when(cond, value(label, conf, reason))
    return out.otherwise(value(*K.DEFAULT_CLASS))


def route(low: Column) -> Column:
    return first_rule(low, K.ROUTE_RULES, "unknown")


def intended_use(low: Column) -> Column:
    return first_rule(low, K.USE_RULES, "unknown")


def botanicals(low_desc: Column, entity_list: Column, prior: Column | None = None) -> Column:
    """Canonical plant names found in description or entities, sorted, merged with prior ones."""
    low = F.concat(F.coalesce(low_desc, F.lit("")), F.lit(" "), F.lower(F.array_join(entity_list, " ")))
    names: dict[str, list[str]] = {}
    for key, name in K.BOTANICALS.items():
        names.setdefault(name, []).append(key)
    # one lower-casing per row: the text is bound once as a lambda argument
    found = F.transform(
        F.array(low), lambda t: present(F.array(*[F.when(contains_any(t, ks), F.lit(n)) for n, ks in names.items()]))
    )[0]
    every = found if prior is None else F.array_union(F.coalesce(prior, F.array().cast("array<string>")), found)
    return F.array_sort(F.array_distinct(every))


def parse_category(value: Column) -> Column:
    norm = strip(F.replace(F.lower(value), F.lit("_"), F.lit("-")))
    return F.when(norm.isin(*K.CATEGORIES), norm).otherwise(K.DEFAULT_CLASS[0])


def fact(facts: Column, name: str) -> Column:
    return F.try_element_at(facts, F.lit(name))


def has_fact(facts: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(facts, name), F.lit(False))


def missing_facts(category_: Column, route_: Column, intent_: Column, has_desc: Column, facts: Column) -> Column:
    """Load-bearing fields still to be asked."""
    need_category = (category_ == "unclassified") & ~has_fact(facts, "category") & has_desc
    need_route = (
        (category_ == "proprietary") & (intent_ == "compliance") & (route_ == "unknown")
        & ~has_fact(facts, "route_of_administration") & has_desc
    )
    return present(
        F.array(F.when(need_category, F.lit("category")), F.when(need_route, F.lit("route_of_administration")))
    )


def hyde_eligible(desc: Column, category_: Column, confidence: Column) -> Column:
    text = strip(F.coalesce(desc, F.lit("")))
    return (F.length(text) > 20) & (category_ != "unclassified") & (confidence >= 0.65)


def jurisdiction(low: Column, facts: Column) -> Column:
    """The known fact decides; else international keywords; else india."""
    known = F.lower(strip(fact(facts, "jurisdiction")))
    by_fact = F.when(contains_any(known, K.INTERNATIONAL_FACTS), "international").otherwise("india")
    by_text = F.when(contains_any(low, K.INTERNATIONAL_KEYWORDS), "international").otherwise("india")
    return F.when(has_fact(facts, "jurisdiction"), F.coalesce(by_fact, F.lit("india"))).otherwise(by_text)


def jurisdiction_assumed(facts: Column, missing: Column, round_: Column, max_rounds: int = 2) -> Column:
    """True when the rounds ran out while the jurisdiction was missing."""
    return ~has_fact(facts, "jurisdiction") & (round_ >= max_rounds) & F.array_contains(missing, "jurisdiction")


def slot_answers(low: Column) -> Column:
    """Map of the slots that a reply fills."""
    pairs = F.array(*[F.struct(F.lit(s).alias("k"), first_rule(low, r).alias("v")) for s, r in K.SLOT_RULES.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def clarify_gate(intent_: Column, missing: Column, round_: Column, max_rounds: int = 2) -> Column:
    """Whether to pause for questions. Chit-chat never pauses."""
    bearing = F.arrays_overlap(missing, str_array(K.LOAD_BEARING_FIELDS))
    return ~intent_.isin("general_info", "other") & F.coalesce(bearing, F.lit(False)) & (round_ < max_rounds)


def bypass_gate(intent_: Column) -> Column:
    return intent_ == "general_info"


def option_to_fact(field: Column, option: Column) -> Column:
    """Structured value of a chosen option text; null when it names none."""
    low = F.lower(option)
    out = F.when(field == "jurisdiction", F.when(low.contains("india"), "india").otherwise("international"))
    for name, rules in K.OPTION_RULES.items():
        out = out.when(field == name, first_rule(low, rules))
    return out


def select_areas(category_: Column, low_query: Column, ingredients: Column) -> Column:
    """Areas of the category, then added areas in enumeration order."""
    base = lookup(category_, K.CATEGORY_AREAS, K.AREAS)
    both = F.concat(low_query, F.lit(" "), F.lower(F.array_join(F.coalesce(ingredients, F.array().cast("array<string>")), " ")))
    herb = F.transform(F.array(both), lambda t: contains_any(t, K.HERB_KEYWORDS))[0]
    third = contains_any(low_query, K.SECTION3_KEYWORDS)
    extra = {a: contains_any(low_query, w) for a, w in K.AREA_QUERY_RULES.items()}
    extra["tk_prior_art"] = extra["tk_prior_art"] | herb | third
    extra["patent"] = extra["patent"] | third
    extra["gi"] = herb
    added = present(F.array(*[F.when(extra[a], F.lit(a)) for a in K.AREAS if a in extra]))
    legal = F.when(contains_any(low_query, K.LEGAL_WORDS), F.array(F.lit("drug_regulation"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_distinct(F.concat(base, added, legal))


def reframe(text: Column, area: Column) -> Column:
    return F.concat(text, lookup(area, K.AREA_SUFFIX, ""))


def strip_thinking(raw: Column) -> Column:
    no_think = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(no_think, r"(?s)<\|thinking\|>.*?<\|/thinking\|>", ""))


def admission_check(low_answer: Column) -> Column:
    """Reason text when an answer admits that evidence was absent; else null."""
    phrase = first_rule(low_answer, [(p, [p]) for p in K.ADMISSION_PHRASES])
    return F.when(phrase.isNotNull(), F.format_string(K.ADMISSION_REASON, phrase))


def tag(low: Column) -> Column:
    return first_rule(low, K.TAG_RULES, K.TAG_DEFAULT)


def short_title(text: Column) -> Column:
    flat = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    cut = F.concat(F.substring(flat, 1, K.TITLE_LENGTH), F.lit("…"))
    return F.when(F.length(flat) > K.TITLE_LENGTH, cut).otherwise(flat)
