"""DuckDB SQL for operators over words and bytes: every window or period compared, nothing indexed.

The SQL spells windows out as strings, so it also checks the operators' 64-bit hashes.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_DOCS = "docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, {x} AS x FROM documents)"
_ITEMS = "w1 AS MATERIALIZED (SELECT r, id, unnest(x) AS k, generate_subscripts(x, 1) AS i FROM docs)"
_PLACE = "WINDOW o AS (PARTITION BY r ORDER BY i)"


def _doubled(sep: str, most: int) -> str:
    """w2, w4, ... : the items from i on, joined; null where the document ends before."""
    out, n = [], 1
    while 2 * n <= most:
        out.append(f"w{2 * n} AS MATERIALIZED (SELECT r, id, i, k || '{sep}' || lead(k, {n}) OVER o AS k FROM w{n} {_PLACE})")
        n *= 2
    return ",\n".join(out)


def _covered(sep: str, length: int) -> str:
    """(r, i, k, gone): is an item under a window of this length that also starts in a document with a smaller id?"""
    parts, at, n = [], 0, 1 << (length.bit_length() - 1)
    names = []
    while at < length:
        if at + n <= length:
            parts.append(f"SELECT r, i - {at} AS i, k AS k{at} FROM w{n}")
            names.append(f"k{at}")
            at += n
        n //= 2
    joined = f" JOIN ({parts[0]}) p0 USING (r, i)" + "".join(f" JOIN ({p}) p{j} USING (r, i)" for j, p in enumerate(parts[1:], 1))
    key = f" || '{sep}' || ".join(names)
    return f"""windows AS MATERIALIZED (SELECT * FROM (SELECT r, id, i, {key} AS k FROM (SELECT r, id, i FROM w1) w{joined}) WHERE k IS NOT NULL),
early AS (SELECT k, min(id) AS least FROM windows GROUP BY k HAVING min(id) < max(id)),
later AS (SELECT r, i, i AS s FROM windows JOIN early USING (k) WHERE id > least),
covered AS (SELECT w1.r, w1.i, w1.k, max(s) OVER (PARTITION BY w1.r ORDER BY w1.i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w1 LEFT JOIN later ON later.r = w1.r AND later.i = w1.i)"""


def substring_dedup() -> str:
    """op5: all windows of 13 words, as texts."""
    return f"""WITH {_DOCS.format(x=_WORDS)}, {_ITEMS},
{_doubled(' ', 13)},
{_covered(' ', 13)},
kept AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(k, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM covered GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""


def suffix_dedup() -> str:
    """op3: all strings of 50 bytes, in hexadecimal."""
    return f"""WITH {_DOCS.format(x="regexp_extract_all(hex(encode(coalesce(text, ''))), '..')")}, {_ITEMS},
{_doubled('', 50)},
{_covered('', 50)},
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER o, FALSE) AS opens FROM covered {_PLACE}),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS m, count(*) FILTER (opens) AS s, string_agg(k, '' ORDER BY i) FILTER (NOT gone) AS t
  FROM edges GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""


def _crc32(text: str) -> str:
    """Bit by bit, least significant first, of a text of ASCII characters."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))"
    step = "lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}::BIGINT[]), {step}), 4294967295)"


def periodic_runs(scales: int = 21) -> str:
    """op11: a run of period q in [2^j, 2^(j+1)) has equal windows of 2^(j+1) words exactly q apart and none nearer.

    Every such distance is compared over the whole text. Periods are below 2^scales.
    """
    grow = [f"k{j + 1} AS MATERIALIZED (SELECT * FROM (SELECT r, i, md5(k || lead(k, {1 << j}) OVER o) AS k FROM k{j} {_PLACE}) WHERE k IS NOT NULL)" for j in range(scales)]
    ask = [
        f"SELECT r, q FROM (SELECT r, lead(i) OVER (PARTITION BY r, k ORDER BY i) - i AS q FROM k{j + 1}) WHERE q BETWEEN {1 << j} AND {(2 << j) - 1}"
        for j in range(scales)
    ]
    between = ",\n".join(grow)
    asked = " UNION ".join(ask)
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS x, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
spot AS (SELECT *, len(x) AS n, h // 10 AS g FROM docs WHERE len(x) > 0),
plan AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM spot),
given AS MATERIALIZED (SELECT r, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM docs),
words AS MATERIALIZED (SELECT u.r, u.i, s.v FROM given u JOIN plan USING (r)
  JOIN given s ON s.r = u.r AND s.i = CASE WHEN h % 10 = 0 AND u.i >= a THEN a + (u.i - a) % p ELSE u.i END),
k0 AS MATERIALIZED (SELECT r, i, md5(v) AS k FROM words),
{between},
asked AS MATERIALIZED ({asked}),
same AS (SELECT asked.r, q, u.i, u.i - row_number() OVER (PARTITION BY asked.r, q ORDER BY u.i) AS island
  FROM asked JOIN words u ON u.r = asked.r JOIN words s ON s.r = u.r AND s.i = u.i + q WHERE u.v = s.v),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
named AS (SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs) WHERE place = 1),
dropped AS (SELECT DISTINCT words.r, words.i FROM words JOIN runs ON runs.r = words.r AND words.i >= start + period AND words.i < start + length),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(named.n, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(named.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN named USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
