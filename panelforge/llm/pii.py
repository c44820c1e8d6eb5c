"""PII: patterns propose spans, checksums confirm them, words close by adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import quoted, text_or_empty

#: The lengths of IBANs, and the countries that have them.
IBANS = {
    15: "NO", 16: "BE", 18: "DK|FO|FI|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "HR|LV|LI|CH", 22: "BH|BG|CR|GE|DE|IE|ME|RS|GB|VA",
    23: "GI|IQ|IL|OM|SO|TL|AE", 24: "AD|CZ|MD|PK|RO|SA|SK|ES|SE|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MR|MC|SM",
    28: "AL|AZ|BY|CY|DO|SV|GT|HU|LB|NI|PL", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBANS.items())
#: Kinds in the order of the output, with their patterns. The possessive forms and the look-behinds match the same
#: text as the plain forms of the contract, since each class ends where the next begins; they keep long runs of one
#: class linear and off the regex engine's stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A character that every match has: without it the pattern isn't tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span, what a context word adds, and the words, which stand by themselves.
SCORES = {
    "email": (0.9, 0.05, "mail|contact|write"),
    "ip": (0.6, 0.3, "ip|address|host|server"),
    "card": (0.8, 0.2, "card|visa|credit|amex|karte|carte|tarjeta"),
    "phone": (0.6, 0.3, "tel|phone|call|fax|mobile|handy"),
    "iban": (0.9, 0.1, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (0.3, 0.5, "ssn|social|security"),
}
#: Code points before and after a span that are searched for context words; kinds beyond the base need this score.
CONTEXT, THRESHOLD = 32, 0.5
OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
SPAN = "struct<kind:string,start:bigint,end:bigint,text:string,score:double>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    doubled = lambda c, i: F.when(i % 2 == 0, c).otherwise(F.when(c > 4, 2 * c - 9).otherwise(2 * c))
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: doubled(F.ascii(c) - 48, i))
    return F.aggregate(each, F.lit(0), lambda s, c: s + c) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN's letters and digits, with its first four moved to the end, are 1 modulo 97."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda r, c: F.when(F.ascii(c) < 58, r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def context(kind: str) -> str:
    """The pattern of a kind's context words in lower-case text."""
    return f"(?:^|[^a-z])(?:{SCORES[kind][2]})(?:[^a-z]|$)"


def confirmed(kind: str, whole: Column, span: Column) -> Column:
    text = span["text"]
    if kind == "ip":
        return text.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when(F.length(digits(text)).between(16, 19), luhn(digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(digits(text)).between(8, 15)
    if kind == "iban":
        # not a part of a longer run of letters and digits
        before = F.when(span["start"] > 0, F.substring(whole, span["start"].cast("int"), F.lit(1))).otherwise("")
        after = F.substring(whole, (span["end"] + 1).cast("int"), F.lit(1))
        return mod97(text) & ~F.concat(before, after).rlike("[A-Za-z0-9]")
    return F.lit(True)


def located(text: Column, hits: Column, kind: str) -> Column:
    """The confirmed matches of a pattern as spans in code points: what lies between matches tells where they start."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), hits.alias("hit"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("text"), F.lit(0.0).alias("score"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["hit"].isNotNull() & confirmed(kind, text, span), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def scored(text: Column, span: Column, kind: str) -> Column:
    base, more, _ = SCORES[kind]
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    near = F.concat(F.substring(text, (begin + 1).cast("int"), (span["start"] - begin).cast("int")), F.lit("\n"), F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT)))
    score = F.when(F.lower(near).rlike(context(kind)), F.lit(base + more)).otherwise(F.lit(base))
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["text"].alias("text"), score.alias("score"))


def _confirmed_spans(kind: str) -> Column:
    found = F.transform(located(F.col("text"), F.col(f"hit_{kind}"), kind), lambda s: scored(F.col("text"), s, kind))
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, base and spans, arrays of (kind, start, end, text, score).

    `base` holds the confirmed email, ip, card and phone spans: leftmost, without overlap within a kind, in the order
    of kinds, then of start. `spans` adds IBANs, as long as their country's and 1 modulo 97, and numbers in the form of
    a US social security number, each if its score, which context words on either side lift, reaches the threshold.
    Start and end are code points, the end exclusive.
    A null text is empty and has no spans; ids may be null or repeated; other columns are ignored.

    Scale: a projection without shuffle; a text without a pattern's needed character skips that pattern.
    """
    rows = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id")
    return rows.select("doc_id", F.concat(*BASE).alias("base"), F.concat(*PATTERNS).alias("spans"))


def _with_spans(rows: DataFrame, kept: str) -> DataFrame:
    """The columns `kept` and `text` of `rows`, and the spans of each kind."""
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"hit_{kind}", F.when(F.instr("text", NEEDS[kind]) > 0, hits).otherwise(none) if kind in NEEDS else hits)
    spans = {k: F.when(F.size(f"hit_{k}") > 0, _confirmed_spans(k)).otherwise(F.array().cast(f"array<{SPAN}>")) for k in PATTERNS}
    return rows.select(kept, "text", *(v.alias(k) for k, v in spans.items()))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span that `find_pii` finds replaced by its kind in angle brackets.

    Spans that overlap, which those of different kinds may, become one, of the kind that starts first (the longer of two
    that start together). Null texts stay null, other columns as they are. Scale: a projection without shuffle.
    """
    rows = _with_spans(docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("kept"), text_or_empty(text_col).alias("text")), "kept")
    found = F.array_sort(F.transform(F.concat(*PATTERNS), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    # one row each: the spans are computed before what follows, which reads them more than once
    rows = rows.select("kept", "text", F.explode(F.array(found)).alias("found"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        start, end, kind = s["start"], -s["minus_end"], s["kind"]
        between = F.substring("text", (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        out = F.when(start < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit("<"), kind, F.lit(">")))
        return F.struct(F.greatest(acc["at"], end).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.size("found") == 0, F.col("text")).otherwise(F.aggregate("found", zero, step, rest))
    same = lambda c: F.col("kept").getField(c)
    return rows.select(*(F.when(same(c).isNotNull(), clean).alias(c) if c.lower() == text_col.lower() else same(c).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts of base spans, their digest, all spans as text, and their scores in hundredths."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), scores.alias("scores"))


def _sql_spans(kind: str, pattern: str, check: str) -> str:
    """DuckDB: the spans of one kind as `x` (kind:start:end) and score `p`, from the pieces between matches."""
    base, more, _ = SCORES[kind]
    least = f"list_filter({{}}, lambda z: z.p >= {round(100 * THRESHOLD)})" if kind not in BASE else "{}"
    return least.format(f"""
  list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
      's': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda x: length(x))), 0),
      'm': regexp_extract_all(t, '{pattern}')[i]}}), lambda h: {check}),
    lambda h: {{'x': '{kind}:' || CAST(h.s AS BIGINT) || ':' || CAST(h.s + length(h.m) AS BIGINT),
               'p': CASE WHEN regexp_matches({_NEAR}, '{context(kind)}') THEN {round(100 * (base + more))} ELSE {round(100 * base)} END}})""")


_NEAR = f"lower(substring(t, greatest(h.s - {CONTEXT}, 0)::BIGINT + 1, least(h.s, {CONTEXT})::BIGINT) || chr(10) || substring(t, (h.s + length(h.m))::BIGINT + 1, {CONTEXT}))"
_BESIDE = "(CASE WHEN h.s > 0 THEN substring(t, h.s::BIGINT, 1) ELSE '' END || substring(t, (h.s + length(h.m))::BIGINT + 1, 1))"
_DIGITS = "regexp_replace(h.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1
      THEN CAST(substring(reverse({_DIGITS}), j, 1) AS INT)
      ELSE (2 * CAST(substring(reverse({_DIGITS}), j, 1) AS INT)) // 10 + (2 * CAST(substring(reverse({_DIGITS}), j, 1) AS INT)) % 10 END)) % 10 = 0"""
_PLAIN = "replace(h.m, ' ', '')"
_MOVED = f"substring({_PLAIN}, 5) || substring({_PLAIN}, 1, 4)"
_MOD97 = f"""CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({_PLAIN}) + 1),
      lambda j: ascii(substring({_MOVED}, j, 1))::BIGINT)),
      lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) AS BIGINT) = 1"""
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id,
{_sql_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")} AS email,
{_sql_spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"regexp_full_match(h.m, '" + OCTET + r"(\." + OCTET + r"){3}')")} AS ip,
{_sql_spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")} AS card,
{_sql_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")} AS phone,
{_sql_spans("iban", IBAN, f"{_MOD97} AND NOT regexp_matches({_BESIDE}, '[A-Za-z0-9]')")} AS iban,
{_sql_spans("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true")} AS ssn
FROM d),
b AS (SELECT *, list_concat(list_concat(email, ip), list_concat(card, phone)) AS base FROM k),
c AS (SELECT *, array_to_string(list_transform(base, lambda z: z.x), ',') AS joined, list_concat(base, list_concat(iban, ssn)) AS found FROM b)
SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone,
       sha256(joined) AS base_sha256, array_to_string(list_transform(found, lambda z: z.x), ',') AS spans,
       array_to_string(list_transform(found, lambda z: z.p::VARCHAR), ',') AS scores
FROM c
"""
