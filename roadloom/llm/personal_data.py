"""Personal data in texts: Aho-Corasick finds anchors, local parsers expand them to spans and validate these."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import table

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order of a text's spans.
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
#: Words before an identifier; none is the end of another.
CUES = ("account number", "account no", "account", "acct", "passport", "ssn", "tax id", "user id", "customer id", "api key", "api_key", "secret", "token", "password")
IBAN_CUE = "iban"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"([0-9]+)(?:\.([0-9]+)\.([0-9]+)\.([0-9]+))?")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SITE = re.compile(r'[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^ \t-\r<>"]*)?')
_AFTER_SITE = ".,;:!?')]}"
_SEPARATOR = r"(?: {0,2}[:=#] {0,2}| )[\"']?"
_IDENTIFIER = re.compile(_SEPARATOR + r"([A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*)")
_IBAN = re.compile(_SEPARATOR + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Least and most characters of an identifier.
IDENTIFIER_SIZE = (6, 64)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def iban_holds(iban: str) -> bool:
    """Whether an account number's check digits hold: the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors, each with its kind and length; words in lower case, upper case and capitalised."""
    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, ("0" if c.isdigit() else c, 1))
    for kind, words in (("url", SCHEMES), ("account", CUES), ("iban", (IBAN_CUE,))):
        for word in words:
            for form in (word, word.upper(), word.capitalize()):
                found.add_word(form, (kind, len(word)))
    found.make_automaton()
    return found


def _alone(text: str, at: int) -> bool:
    """Whether no letter or digit of ASCII stands before ``at``."""
    return at == 0 or not (text[at - 1].isascii() and text[at - 1].isalnum())


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of a whole text in code points, by kind and then by start; spans of a kind don't overlap.

    An at-sign is expanded to both sides, a plus sign and the first digit of a run to the right, and what follows a
    scheme or a cue is parsed. What a parser has consumed isn't parsed again for that kind, valid or not.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # up to where each kind has consumed the text, and the last at-sign
    after = dict.fromkeys(("@", "ip", "card", "+", "url", "account"), 0)
    for last, (kind, size) in anchors().iter(text):
        at = last + 1 - size
        if kind == "0":
            if at >= after["ip"]:
                m = _FOUR.match(text, at)
                after["ip"] = m.end()
                if m.group(2) is not None and all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
                    found["ip"].append(m.span())
            if at >= after["card"]:
                m = _DIGITS.match(text, at)
                after["card"] = m.end()
                if m.end() - at >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "@":
            before = text[after["@"] : at]
            start = at - (len(before) - len(before.rstrip(_LOCAL)))
            after["@"] = at + 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                after["@"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "+":
            if at >= after["+"] and (m := _PHONE.match(text, at)):
                after["+"] = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if at >= after["url"] and _alone(text, at) and (m := _SITE.match(text, last + 1)):
                after["url"] = m.end()
                found["url"].append((at, last + 1 + len(m.group().rstrip(_AFTER_SITE))))
        elif at >= after["account"] and _alone(text, at) and (m := (_IBAN if kind == "iban" else _IDENTIFIER).match(text, last + 1)):
            after["account"] = m.end()
            own = m.group(1)
            if iban_holds(own.replace(" ", "")) if kind == "iban" else IDENTIFIER_SIZE[0] <= len(own) <= IDENTIFIER_SIZE[1]:
                found["account"].append(m.span(1))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def find_personal_data(docs: DataFrame, into: str = "personal_data") -> DataFrame:
    """``docs(text, ...)`` with the array ``into`` of spans ``(kind, start, end)``, in code points and without the end.

    Rows don't meet, so nothing is shuffled. Null and empty texts have an empty array; equal texts have
    equal spans; a column named like ``into`` is replaced; an empty table stays empty.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kept = docs.drop(into)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [spans_of(t.as_py() or "") for t in part.column("text")]
                spans = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in rows], pa.list_(span))
                yield pa.RecordBatch.from_arrays([*part.columns, spans], [*part.schema.names, into])

    own = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, own)]))


def redacted(docs: DataFrame, into: str = "redacted") -> DataFrame:
    """``docs(text, ...)`` with ``into``, the text in which ``<kind>`` stands for each span; null texts stay null.

    Spans of several kinds that overlap are one stretch, named by the first of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if (t := x.as_py()) is None else redact(t) for x in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, into])

    kept = docs.drop(into)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())]))


def redact(text: str) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: numbers of the base kinds, their digest, and all spans."""
    docs = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.filter("personal_data", lambda s: s["kind"] == kind)
    base = F.filter("personal_data", lambda s: s["kind"].isin(*BASE))
    return docs.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("personal_data")).alias("spans"),
    )


def _any_case(words: Iterable[str]) -> str:
    """An expression for the words in lower case, upper case and capitalised, the longest first."""
    forms = sorted({f for w in words for f in (w, w.upper(), w.capitalize())}, key=lambda f: (-len(f), f))
    return "|".join(forms)


#: Of each kind its expression, the part before the span, and the condition on ``m``, the span's text.
_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "", "TRUE"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "", "length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN CAST(d[-1-i] AS INTEGER) ELSE (2 * CAST(d[-1-i] AS INTEGER)) // 10 + (2 * CAST(d[-1-i] AS INTEGER)) % 10 END FOR i IN range(length(d))]) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "", "length(d) BETWEEN 9 AND 15"),
    ("url", rf"(?:^|[^A-Za-z0-9])(?:{_any_case(SCHEMES)})" + _SITE.pattern, r"^[^A-Za-z0-9]", "TRUE"),
    ("account", rf"(?:^|[^A-Za-z0-9])(?:(?:{_any_case(CUES)}){_SEPARATOR}[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*|(?:{_any_case((IBAN_CUE,))}){_SEPARATOR}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})",
     rf"^[^A-Za-z0-9]?(?:{_any_case((*CUES, IBAN_CUE))}){_SEPARATOR}",
     f"""CASE WHEN regexp_matches(whole, '^[^A-Za-z0-9]?(?:{_any_case((IBAN_CUE,))})') THEN list_reduce(
        [CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END FOR c IN string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], '')],
        lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
      ELSE length(m) BETWEEN {IDENTIFIER_SIZE[0]} AND {IDENTIFIER_SIZE[1]} END"""),
)


def _kind_sql(k: int, kind: str, expression: str, before: str, condition: str) -> str:
    """Matches of a kind with their places: what lies between matches and the matches before add up to a match's start."""
    expression, before = (x.replace("'", "''") for x in (expression, before))
    span = f"regexp_replace(whole, '{before}', '')" if before else "whole"
    shown = f"rtrim({span}, '.,;:!?'')]}}')" if kind == "url" else span
    return f"""
  SELECT r, {k} AS k, '{kind}' AS kind, pos + length(whole) - length(raw) AS s, pos + length(whole) - length(raw) + length(m) AS e
  FROM (
    SELECT *, {span} AS raw, {shown} AS m, regexp_replace(whole, '[^0-9]', '', 'g') AS d FROM (
      SELECT r, whole, sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY i) - length(whole) AS pos
      FROM (SELECT r, unnest(ms) AS whole, unnest(ps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
        SELECT r, regexp_extract_all(t, '{expression}') AS ms, regexp_split_to_array(t, '{expression}') AS ps FROM d))
    )
  ) WHERE {condition}"""


ORACLE = (
    "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS MATERIALIZED ("
    + "\n  UNION ALL ".join(_kind_sql(k, *rule) for k, rule in enumerate(_RULES))
    + """
)
SELECT any_value(doc_id) AS doc_id, """
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    + """,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s), '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY r
"""
)
