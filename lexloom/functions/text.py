"""Column helpers that give the text rules one meaning everywhere.

Rule helpers take an already lower-cased column (``low``): lowering once in an
earlier projection keeps a chain of ``contains`` from re-lowering long texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"  # RFC 4122 name space for DNS names


# White_Space of Unicode and the four separators below it
WHITE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space on both ends, without a scan of the text between them."""
    return F.btrim(c, F.lit(WHITE))


def filled(c: Column, *defaults) -> Column:
    """First value that is neither null nor the empty string."""
    parts = [F.nullif(c, F.lit(""))]
    for d in defaults:
        parts.append(F.nullif(d, F.lit("")) if isinstance(d, Column) else F.lit(d))
    return F.coalesce(*parts)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is otherwise evaluated for every element,
    even when an earlier projection named it: the optimizer merges projections.
    """
    return F.transform(F.array(value), body)[0]


def tokens(c: Column) -> Column:
    """Split on runs of Unicode white space, no empty tokens."""
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def contains_any(low: Column, words: Iterable[str]) -> Column:
    return any_of([low.contains(w) for w in words])


def first_rule(low: Column, rules, default=None) -> Column:
    """Label of the first (label, words) rule with a word inside ``low``."""
    out = None
    for label, words in rules:
        cond = contains_any(low, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def lookup(c: Column, table: dict, default=None) -> Column:
    out = None
    for key, value in table.items():
        v = F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value)
        out = F.when(c == key, v) if out is None else out.when(c == key, v)
    if isinstance(default, list):
        default = F.array(*[F.lit(x) for x in default])
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def str_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def present(a: Column) -> Column:
    """Drop the nulls of an array."""
    return F.filter(a, lambda x: x.isNotNull())


def first_cap(c: Column) -> Column:
    """Upper-case the first letter, lower-case the others."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def uuid5(name: Column) -> Column:
    """RFC 4122 version-5 UUID of a name in the DNS name space, without Python."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def fixed(c: Column, digits: int) -> Column:
    """Number with ``digits`` decimals, rounded by its binary value as C and Python do; ``format_string`` rounds the printed digits half up."""

    @F.pandas_udf("string")
    def printed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: f"{x:.{digits}f}", na_action="ignore").astype(object)

    return F.coalesce(printed(c), F.lit("null"))


def round4(c: Column) -> Column:
    return F.bround(c, 4)


def ordered_join(items: Column, sep: str, field: str) -> Column:
    """Join one field of an array of structs, in the order of the leading struct fields."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x[field]), sep)
