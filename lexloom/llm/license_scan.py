"""License scans (6): canonical digests of entire texts, joined to the digests of known licences.

The canonical form is lower case, without copyright lines and "all rights reserved",
with every run of punctuation and blanks as one space and equivalent spellings made
equal; its SHA-256 is looked up in the table of known licences by a hash join. That table
is an argument (by default ``known``: full texts, and one-line notices built from names and
phrases); it is broadcast, and more than ``MOST`` digests are an error. The same lookup is made
for every single line, which finds notices inside other text.

* Null and empty texts, and texts of punctuation only, have the digest of the empty text and no licence.
* In the table of licences a row without digest or licence counts as absent; of licences with one
  digest the first by name counts.
* Repeated rows each get a result; equal texts get equal ones.
* All steps stay in the row: no shuffle, whatever the text's length.
* ``scanned`` keeps all columns; its own names replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.license_texts import FULL_TEXTS, NAMES, NOTICES, SPELLINGS, WHOLE_TEXTS

#: The begin of a line that may be a copyright line, after comment marks.
COPYRIGHT = r"^[ \t#*/;-]*(copyright|\(c\)|©)"
#: What makes a line prose that happens to begin with the word.
_PROSE_WORDS = r"[ \t]+(holders?|owners?|notices?|statements?|disclaimers?|laws?|licen[sc]es?|interests?|treat(y|ies)|and|or|in|on|to|the|is|are|by law)\b"
OWN_COPYRIGHT_LINE = rf"(^|\n)[ \t#*/;-]*(copyright(?!{_PROSE_WORDS})|\(c\)|©)[^\n]*"
RIGHTS = r"all rights reserved\.?"
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’–—]+"
MOST = 1 << 17
OWN = ("license_id", "digest", "n_license_lines", "line_licenses")


def canonical(text: Column) -> Column:
    """Words between single spaces, with a space before and after (only a space if there are none)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, OWN_COPYRIGHT_LINE, "\n")
    t = F.regexp_replace(t, RIGHTS, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, APART, "  "), F.lit(" "))
    for old, new in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical_text(text: str) -> str:
    """The same for one string."""
    t = re.sub(OWN_COPYRIGHT_LINE, "\n", text.lower())
    t = " " + re.sub(APART, "  ", re.sub(RIGHTS, " ", t)) + " "
    for old, new in SPELLINGS.items():
        t = t.replace(f" {old} ", f" {new} ")
    return t.replace("  ", " ").strip(" ")


def known_digests() -> list[tuple[str, str, str]]:
    """(digest, licence, kind) of all known texts and notices."""
    found: dict[str, tuple] = {}
    for name, text in FULL_TEXTS.items():
        for title in ("", *NAMES.get(name, ())):
            found.setdefault(canonical_text(f"{title}\n\n{text}"), (name, "text"))
    for name, titles in NAMES.items():
        for title in titles:
            for notice in NOTICES:
                for the in ("", "the "):
                    found.setdefault(canonical_text(notice.format(the + title)), (name, "notice"))
    return [(hashlib.sha256(t.encode()).hexdigest(), *v) for t, v in found.items()]


def whole_digests() -> list[tuple[str, str, str]]:
    """(digest, licence, kind) of the long licences, from the files beside this module."""
    folder = Path(__file__).parent / "licences"
    texts = {name: (folder / f"{file}.txt").read_text("utf-8") for name, file in WHOLE_TEXTS.items()}
    return [(hashlib.sha256(canonical_text(t).encode()).hexdigest(), name, "text") for name, t in texts.items()]


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_digests() + whole_digests(), "digest string, license_id string, kind string")


def scanned(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``license_id`` of the entire text, its ``digest``, and the licences of its notice lines.

    ``table`` has digest and license_id: the licences to look for, ``known`` if there is none.
    """
    docs = docs.drop(*OWN)
    table = known(docs.sparkSession) if table is None else table
    text = F.coalesce(F.col("text"), F.lit(""))
    table = table.where("digest IS NOT NULL AND license_id IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} licence digests")
    table = docs.sparkSession.createDataFrame(rows, "digest string, license_id string")
    lookup = F.create_map(*[F.lit(x) for r in rows for x in r]) if rows else F.create_map().cast("map<string,string>")
    lines = F.split(text, "\n")
    named = F.filter(F.transform(lines, lambda line: F.try_element_at(lookup, F.sha2(canonical(line), 256))), lambda x: x.isNotNull())
    out = docs.select("*", F.sha2(canonical(F.col("text")), 256).alias("digest"), named.alias("_lines"))
    out = out.join(F.broadcast(table), "digest", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "license_id",
        "digest",
        F.size("_lines").cast("long").alias("n_license_lines"),
        F.array_join(F.array_sort(F.array_distinct("_lines")), ",").alias("line_licenses"),
    )


def op6(docs: DataFrame) -> DataFrame:
    """Query op6: one row per document."""
    return scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")


def _sql_canonical(x: str) -> str:
    """As ``canonical``, with copyright lines found line by line instead of by a look-ahead."""
    own = f"regexp_matches(l, '{COPYRIGHT}') AND NOT regexp_matches(l, '^[ \\t#*/;-]*copyright{_PROSE_WORDS}')"
    lines = f"list_transform(string_split(lower(coalesce({x}, '')), chr(10)), lambda l: CASE WHEN {own} THEN '' ELSE l END)"
    t = f"array_to_string({lines}, chr(10))"
    t = f"regexp_replace({t}, '{RIGHTS}', ' ', 'g')"
    t = f"' ' || regexp_replace({t}, '{APART}', '  ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        t = f"replace({t}, ' {old} ', ' {new} ')"
    return f"trim(replace({t}, '  ', ' '), ' ')"


def oracle() -> str:
    """DuckDB SQL for the rows of op6."""
    rows = ", ".join(f"('{d}', '{name}')" for d, name in sorted({d: n for d, n, _ in known_digests() + whole_digests()}.items()))
    return f"""
WITH known(digest, license_id) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
whole AS (SELECT r, doc_id, sha256({_sql_canonical("text")}) AS digest FROM d),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
named AS (SELECT r, license_id FROM lines JOIN known ON sha256({_sql_canonical("line")}) = digest),
per AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM named GROUP BY r)
SELECT doc_id, license_id, whole.digest AS digest, coalesce(n, 0) AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN per ON whole.r = per.r
"""
