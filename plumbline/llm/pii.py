"""PII and secrets: regular expressions propose spans, checksums confirm them, context words move the score.

Everything is DataFrame expressions; no row leaves the JVM and nothing is shuffled. Each kind has a score of its own;
a context word within CONTEXT code points before or after the span, no further than the next match of its kind, raises
it by RAISE, and a span whose checksum or
form is strong starts higher. The four base kinds are reported whatever their score; the kinds that the method adds are
reported from ACCEPT on.

Defined cases: a null text counts as empty; an empty text has no spans; a text of any length is read whole, in time
that grows with its length (and the logarithm of the number of its matches); equal rows give equal results; columns of
the input other than the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Each pattern starts only where a leftmost search could start (look-behind or end of the last match) and repeats
# possessively, so that a text of one long run costs linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A start, and beside it (group 1) the longest run that it may go on with; _found tries all ends of groups in it.
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9_]))"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Runs of hexadecimal digits of one case as long as digests are, and the fixed forms in which services issue their keys.
HEXKEY = r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![A-Za-z0-9_])"
APIKEY = r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|xox[abp]-[A-Za-z0-9-]{20,})(?![A-Za-z0-9_])"
PRIVATEKEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "hexkey", "apikey", "privatekey")
#: Score without context, and words that raise it when they stand beside the span.
SCORES = {
    "email": (0.7, "mail|contact|write"), "ip": (0.5, "\\bip\\b|host|server|address|login"), "card": (0.6, "card|visa|credit|pay"),
    "phone": (0.6, "phone|\\btel|call|mobile|fax"), "iban": (0.6, "iban|account|bank|konto"), "ssn": (0.2, "\\bssn|social|security"),
    "hexkey": (0.2, "token|secret|\\bkey|api|passw|auth|bearer|credential"), "apikey": (0.8, "token|secret|\\bkey|api"), "privatekey": (0.9, "secret|\\bkey"),
}
CONTEXT, RAISE, ACCEPT = 40, 0.3, 0.5

#: What a text must hold for a kind to be looked for; d says whether it holds a digit, found once for all kinds.
_GATE = {
    "email": "contains(t, '@')", "ip": "d and t rlike '[0-9][.][0-9]'", "card": "d and t rlike '[0-9]{2}|[0-9][ -][0-9]'", "phone": "d and contains(t, '+')", "iban": "d and t rlike '[A-Z]{2}[0-9]{2}'",
    "ssn": "d and t rlike '[0-9]-[0-9]{2}-[0-9]'", "hexkey": "d and t rlike '[0-9][A-Fa-f]|[A-Fa-f][0-9]'", "apikey": "contains(t, 'AKIA') or contains(t, 'gh') and t rlike 'gh[pousr]_' or contains(t, 'sk_live_') or contains(t, 'xox')", "privatekey": "contains(t, 'PRIVATE KEY')",
}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> if(i % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0))), 0, (a, d) -> a + d) % 10 = 0"
_MOD97 = (
    "aggregate(split(concat(substring(replace(x.m, ' ', ''), 5), substring(replace(x.m, ' ', ''), 1, 4)), ''), 0,"
    " (a, c) -> if(c between '0' and '9', a * 10 + cast(c as int), a * 100 + ascii(c) - 55) % 97) = 1"
)
_VALID = {
    "email": "true",
    "ip": r"x.m rlike '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.|$)){4}'",
    "card": f"if(length({_DIGITS}) between 13 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": f"length(replace(x.m, ' ', '')) between 15 and 34 and {_MOD97}",
    "ssn": "x.m not rlike '^(000|666|9)|-00-|0000$'",
    "hexkey": "x.m rlike '[0-9]' and x.m rlike '[A-Fa-f]'",
    "apikey": "true",
    "privatekey": "true",
}
_TYPE = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for the value, made once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(array: str, combine: str) -> str:
    """SQL for the running results of an array of ints: each step combines elements twice as far apart (l and x), so the
    whole takes n log n, where a fold that appends to its result would copy it n times."""
    step = f"if(i < shiftleft(1, k), x, {combine.format(l='l[i - shiftleft(1, k)]')})"
    far = "sequence(0, cast(ceil(log2(size(l0) + 1)) as int))"
    return _let(array, "l0", f"aggregate({far}, l0, (l, k) -> transform(l, (x, i) -> {step}))")


def _found(kind: str, text: str) -> str:
    """SQL for the matches of one kind with their places and the text beside them, failing ones dropped.

    The gaps g that split() leaves and the matches alternate, so running lengths are the places, in code points; the
    text beside a match is the end and the beginning of its gaps. An IBAN ends at the last end of a group where it is
    valid; one that begins within an earlier one isn't taken.
    """
    pattern = globals()[kind.upper()].replace("\\", "\\\\")
    ends = _running("transform(ms, (m, i) -> length(m) + length(g[i]))", "x + {l}")
    match = "concat(m, r[i])" if kind == "iban" else "m"
    spans = f"transform(ms, (m, i) -> named_struct('s', p[i] - length(m), 'e', p[i], 'm', {match}, 'b', substring(g[i], -{CONTEXT}, {CONTEXT}), 'a', substring(g[i + 1], 1, {CONTEXT})))"
    if kind == "iban":  # the gap behind a start holds the rest of the IBAN
        spans = spans.replace(f"substring(g[i + 1], 1, {CONTEXT})", "g[i + 1]")
        groups = "transform(sequence(size(split(y.m, ' ')), 1, -1), k -> array_join(slice(split(y.m, ' '), 1, k), ' '))"
        groups = f"transform({groups}, m -> named_struct('s', y.s, 'e', y.s + length(m), 'm', m, 'b', y.b, 'a', substring(y.a, length(m) - 3, {CONTEXT})))"
        spans = f"flatten(transform({spans}, y -> slice(filter({groups}, x -> {_VALID[kind]}), 1, 1)))"
        far = _running("transform(v, x -> x.e)", "greatest(x, {l})")
        spans = _let(_let(ends, "p", spans), "v", _let(far, "q", "filter(v, (x, i) -> i = 0 or q[greatest(i - 1, 0)] <= x.s)"))
        spans = _let(f"regexp_extract_all({text}, '{pattern}', 1)", "r", spans)
    else:
        spans = f"filter({_let(ends, 'p', spans)}, x -> {_VALID[kind]})"
    found = _let(f"split({text}, '{pattern}', -1)", "g", _let(f"regexp_extract_all({text}, '{pattern}', 0)", "ms", spans))
    return f"CASE WHEN {_GATE[kind]} THEN {found} ELSE cast(array() AS {_TYPE}) END"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and spans: array of (kind, start, end, score, value), by kind in the order of KINDS, then start.

    start and end are code points, end exclusive.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select("id", "t", F.col("t").rlike("[0-9]").alias("d")).select("id", "t", *[F.expr(_found(k, "t")).alias(k) for k in KINDS])
    parts = []
    for kind in KINDS:
        score, words = SCORES[kind]
        near = f"lower(concat(x.b, ' ', x.a)) rlike '{words.replace(chr(92), chr(92) * 2)}'"
        spans = f"transform({kind}, x -> named_struct('kind', '{kind}', 'start', x.s, 'end', x.e, 'score', round({score}D + if({near}, {RAISE}D, 0D), 2), 'value', x.m))"
        parts.append(spans if kind in BASE else f"filter({spans}, y -> y.score >= {ACCEPT})")
    return t.select(F.col("id").alias(id_col), F.expr(f"concat({', '.join(parts)})").alias("spans"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind and in all, a digest of the base spans, all spans and their scores as strings."""
    found = find_pii(docs, id_col, text_col)
    listed = lambda arr: f"array_join(transform({arr}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(spans, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    scores = F.expr("array_join(transform(spans, x -> cast(x.score as string)), ',')")
    return found.select(id_col, *counts, F.size("spans").cast("bigint").alias("n_spans"), F.expr(f"sha2({listed(base)}, 256)").alias("base_sha256"), F.expr(listed("spans")).alias("spans"), scores.alias("scores"))


def oracle_sql() -> str:
    """The same in DuckDB: plain patterns (its matcher is linear and knows no look-behind) and list functions."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}",  # the starts; see iban_r and what follows for the ends
        "ssn": r"[0-9-]+",  # whole runs of digits and hyphens: those of the right form have neither beside them
        "hexkey": r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b",
        "apikey": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|xox[abp]-[A-Za-z0-9-]{20,})\b",
        "privatekey": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    }
    digits, bare = "regexp_replace(m, '[^0-9]', '', 'g')", "replace(m, ' ', '')"
    turned = f"string_split(substr({bare}, 5) || substr({bare}, 1, 4), '')"
    valid = {
        "email": "true",
        "ip": r"regexp_full_match(m, '(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}')",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN list_sum([CASE WHEN i % 2 = 1 THEN c::int ELSE c::int * 2 - (CASE WHEN c::int > 4 THEN 9 ELSE 0 END) END for c, i in string_split(reverse({digits}), '')]) % 10 = 0 ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform({turned}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::int ELSE ascii(c) - 55 END)), lambda a, x: (CASE WHEN x < 10 THEN a * 10 ELSE a * 100 END + x) % 97) = 1",
        "ssn": r"NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$')",
        "hexkey": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]')",
        "apikey": "true",
        "privatekey": "true",
    }
    form = {"ssn": "WHERE regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"}
    ctes, lists = ["d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents)"], []
    for i, k in enumerate(KINDS):
        score, words = SCORES[k]
        low = f"greatest(s - {CONTEXT}, pe)"
        near = f"substr(t, {low} + 1, s - {low}) || ' ' || substr(t, s + length(m) + 1, greatest(0, least({CONTEXT}, ns - s - length(m))))"
        scored = f"round({score} + CASE WHEN regexp_matches(lower({near}), '{words}') THEN {RAISE} ELSE 0 END, 2)"
        ctes.append(f"{k}_0 AS (SELECT n, t, regexp_extract_all(t, '{plain[k]}') AS ms, regexp_split_to_array(t, '{plain[k]}') AS gs FROM d)")
        ctes.append(
            f"{k}_1 AS (SELECT n, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda j: list_sum(list_transform(gs[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:j-1], lambda q: length(q))), 0)))::bigint AS s FROM {k}_0 WHERE len(ms) > 0)"
        )
        if k == "iban":
            ctes.append(r"iban_r AS (SELECT *, m || regexp_extract(substr(t, s + 5, 61), '^(?:\x20?[A-Z0-9]){11,30}\b') AS run FROM iban_1)")
            ctes.append("iban_s AS (SELECT n, t, s, string_split(run, ' ') AS ps, coalesce(lag(s + 4) OVER w, 0) AS pe, coalesce(lead(s) OVER w, length(t)) AS ns FROM iban_r WHERE length(run) > 4 WINDOW w AS (PARTITION BY n ORDER BY s))")
            ctes.append("iban_c AS (SELECT n, t, s, pe, ns, unnest(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[1:i], ' '))) AS m FROM iban_s)")
            ctes.append(f"iban_v AS (SELECT n, s, any_value(t) AS t, any_value(pe) AS pe, any_value(ns) AS ns, arg_max(m, length(m)) AS m FROM iban_c WHERE {valid[k]} GROUP BY n, s)")
            ctes.append("iban_f AS (SELECT *, max(s + length(m)) OVER (PARTITION BY n ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iban_v)")
            ctes.append("iban_2 AS (SELECT * FROM iban_f WHERE coalesce(far, 0) <= s)")
        else:
            ctes.append(f"{k}_2 AS (SELECT *, coalesce(lag(s + length(m)) OVER (PARTITION BY n ORDER BY s), 0) AS pe, coalesce(lead(s) OVER (PARTITION BY n ORDER BY s), length(t)) AS ns FROM {k}_1 {form.get(k, '')})")
        ctes.append(f"{k}_3 AS (SELECT n, '{k}' AS kind, {i} AS o, s, s + length(m) AS e, {scored}::double AS score FROM {k}_2 WHERE {valid[k]}{'' if k in BASE else f' AND {scored} >= {ACCEPT}'})")
        lists.append(f"SELECT * FROM {k}_3")
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s)"
    return f"""WITH {', '.join(ctes)}, a AS ({' UNION ALL '.join(lists)}),
    g AS (SELECT n, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, count(*) AS n_spans, {listed} FILTER (o < {len(BASE)}) AS base, {listed} AS sp, string_agg(score::varchar, ',' ORDER BY o, s) AS scores FROM a GROUP BY n)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint AS n_{k}' for k in KINDS)}, coalesce(n_spans, 0)::bigint AS n_spans, sha256(coalesce(base, '')) AS base_sha256, coalesce(sp, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (n)"""
